"""Attempt logs, live calls, replies, conversations."""

import json

import pytest
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.operators import inference, requests

GOOD = json.dumps({"choices": [{"message": {"content": "fine"}}]})


def log(spark, *calls):
    """Attempt rows; each call is a list of ``(status, error, body)``."""
    rows = [
        (doc, number, status, error, body)
        for doc, attempts in enumerate(calls)
        for number, (status, error, body) in enumerate(attempts, 1)
    ]
    return spark.createDataFrame(rows, inference.ATTEMPT_TYPE)


BUSY, LIMITED, SLOW, OK = (
    (503, None, "busy"), (429, None, "slow down"), (None, "timeout", None), (200, None, GOOD)
)
# calls -> outcome, attempts, seconds waited, reply
OUTCOMES = [
    ([OK], "ok", 1, 0.0, "fine"),
    ([BUSY, BUSY, OK], "ok", 3, 6.0, "fine"),
    ([SLOW, OK, BUSY], "ok", 2, 2.0, "fine"),
    ([BUSY, SLOW, BUSY, OK], "exhausted", 3, 6.0, None),
    ([LIMITED, OK], "fatal", 1, 0.0, None),
    ([(400, None, "bad")], "fatal", 1, 0.0, None),
    ([BUSY, (None, "other", None), OK], "fatal", 2, 2.0, None),
    ([(None, "connection", None), OK], "ok", 2, 2.0, "fine"),
    ([(200, None, "{no json"), OK], "fatal", 1, 0.0, None),
    ([(200, None, None)], "fatal", 1, 0.0, None),
    ([(200, None, '{"choices":[]}')], "ok", 1, 0.0, None),
    ([BUSY, BUSY], "incomplete", 2, 6.0, None),
]


def test_outcomes(spark):
    resolved = inference.resolve_attempts(log(spark, *[case[0] for case in OUTCOMES]))
    costs = inference.backoff_cost(resolved)
    replies = inference.responses(resolved)
    rows = costs.join(replies, "doc_id", "left").orderBy("doc_id").collect()
    found = [(r["outcome"], r["n_attempts"], r["backoff_seconds"], r["response"]) for r in rows]
    assert found == [case[1:] for case in OUTCOMES]


def test_other_retry_limits(spark):
    attempts = log(spark, [BUSY, BUSY, OK])
    resolved = inference.resolve_attempts(attempts, max_retries=2)
    row = inference.backoff_cost(resolved, retry_backoff=3.0).first()
    assert (row["outcome"], row["n_attempts"], row["backoff_seconds"]) == ("exhausted", 2, 3.0)
    once = inference.resolve_attempts(attempts, max_retries=1)
    row = inference.backoff_cost(once).first()
    assert (row["outcome"], row["n_attempts"], row["backoff_seconds"]) == ("exhausted", 1, 0.0)


def test_one_document_with_a_huge_log(spark):
    """A third of all rows on one document, many of them repeats of an attempt."""
    hot = spark.range(20000).select(
        F.lit(7).cast("bigint").alias("doc_id"), (F.col("id") % 3 + 1).cast("int").alias("attempt")
    )
    rest = spark.range(40000).select(
        (F.col("id") + 100).alias("doc_id"), F.lit(1).alias("attempt")
    )
    attempts = hot.unionByName(rest).select(
        "doc_id", "attempt", F.lit(503).alias("status_code"),
        F.lit(None).cast("string").alias("error_kind"), F.lit("busy").alias("body"),
    )
    resolved = inference.resolve_attempts(attempts)
    assert resolved.count() == 40001
    assert resolved.where("doc_id = 7").first()["outcome"] == "exhausted"


def test_live_calls(spark):
    documents = spark.createDataFrame(
        [(1, "good"), (2, "busy"), (3, "bad"), (4, "broken"), (5, "slow")], "doc_id bigint, text string"
    )
    sent = requests.requests(documents, "the task", "m")

    def send(payload):
        content = json.loads(payload)["messages"][1]["content"]
        if "broken" in content:
            raise ValueError("no such thing")
        if "slow" in content:
            raise TimeoutError
        status = 503 if "busy" in content else 400 if "bad" in content else 200
        return status, None, GOOD if status == 200 else "no"

    attempts = inference.call_model(sent, send, max_retries=2, retry_backoff=0)
    resolved = inference.resolve_attempts(attempts, max_retries=2)
    rows = {r["doc_id"]: (r["outcome"], r["n_attempts"]) for r in resolved.collect()}
    assert rows == {
        1: ("ok", 1), 2: ("exhausted", 2), 3: ("fatal", 1), 4: ("fatal", 1), 5: ("exhausted", 2)
    }
    assert inference.responses(resolved).first()["response"] == "fine"


def test_payload_shape(spark):
    documents = spark.createDataFrame(
        [(1, 'a "quoted"\ntext'), (2, ""), (3, None)], "doc_id bigint, text string"
    )
    rows = requests.requests(documents, "the task", "m", max_content_length=3).collect()
    assert [r["doc_id"] for r in rows] == [1]
    assert json.loads(rows[0]["payload"]) == {
        "model": "m",
        "messages": [
            {"role": "system", "content": fv.SYSTEM_MESSAGE},
            {
                "role": "user",
                "content": 'PDF CONTENT:\na "... [Content truncated due to length]\n\nTASK:\nthe task',
            },
        ],
        "temperature": 0.1, "max_tokens": 1024, "stream": False,
    }


def test_prompt_alone_without_a_text(spark):
    documents = spark.createDataFrame([("",), (None,), ("x",)], "text string")
    found = documents.select(requests.full_prompt(F.col("text"), "task").alias("m")).collect()
    assert [r["m"] for r in found] == ["task", "task", "PDF CONTENT:\nx\n\nTASK:\ntask"]


@pytest.mark.parametrize("body, reply", [
    (GOOD, "fine"),
    ('{"choices":[{"message":{"content":"a"}},{"message":{"content":"b"}}]}', "a"),
    ('{"choices":[]}', None),
    ('{"choices":null}', None),
    ("{}", None),
    ('{"choices":[{}]}', None),
    ('{"choices":[{"message":{"content":null}}]}', None),
    ("no json", None),
    (None, None),
])
def test_extract_reply(spark, body, reply):
    row = spark.createDataFrame([(body,)], "body string")
    assert row.select(requests.extract_reply(F.col("body")).alias("r")).first()["r"] == reply


def test_unreadable_documents_get_no_reply(spark):
    documents = spark.createDataFrame(
        [(1, "a.pdf", "t"), (2, "b.pdf", ""), (3, "c.pdf", None), (4, "d.pdf", "t")],
        "doc_id bigint, file_name string, text string",
    )
    responses = spark.createDataFrame(
        [(1, "yes"), (2, "ghost"), (3, "ghost")], "doc_id bigint, response string"
    )
    attached = inference.attach_responses(inference.without_text(documents), responses)
    rows = attached.orderBy("doc_id").collect()
    assert [(r["has_text"], r["response"]) for r in rows] == [
        (True, "yes"), (False, None), (False, None), (True, None)
    ]


@pytest.mark.parametrize("size", [1, 7, 10])
def test_conversations_follow_file_names(spark, size):
    documents = spark.range(1000).repartition(13).select(
        F.col("id").alias("doc_id"), F.format_string("doc_%d.pdf", "id").alias("file_name")
    )
    rows = inference.conversation_batches(documents, size).collect()
    names = sorted(f"doc_{i}.pdf" for i in range(1000))
    assert sorted((r["position"], r["file_name"]) for r in rows) == list(enumerate(names))
    assert all(r["conversation"] == r["position"] // size for r in rows)


@pytest.mark.parametrize("names", [
    [], ["same.pdf"] * 9, ["a", "b"], ["", "z", None, "z", None], ["ab", "a", "abc", "a\x00", "a\x00\x00"],
    ["Paper 10.pdf", "paper 2.pdf", "\u00e9t\u00e9.pdf", "\U0001f600.pdf", "zz", "_x"],
    [f"{'x' * 40}{i}" for i in range(60)],
])
def test_conversations_of_odd_names(spark, names):
    documents = spark.createDataFrame(list(enumerate(names)), "doc_id bigint, file_name string").repartition(3)
    rows = inference.conversation_batches(documents, 4).collect()
    order = sorted(enumerate(names), key=lambda d: (d[1] is not None, (d[1] or "").encode(), d[0]))
    assert sorted((r["position"], r["doc_id"], r["file_name"]) for r in rows) == [
        (n, i, name) for n, (i, name) in enumerate(order)
    ]


def test_positions_go_on_from_run_to_run_and_nothing_runs_early(spark):
    context = spark.sparkContext
    documents = spark.range(100).select(
        F.col("id").alias("doc_id"), F.format_string("doc_%d.pdf", "id").alias("file_name")
    )
    context.setJobGroup("conversations", "numbering")
    try:
        none = inference.conversation_batches(documents.limit(0))
        first = inference.conversation_batches(documents.where("doc_id % 3 = 0"), after=none)
        second = inference.conversation_batches(documents.where("doc_id % 3 <> 0"), after=first)
        assert not context.statusTracker().getJobIdsForGroup("conversations")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    rows = first.unionAll(second).collect()
    assert sorted(r["position"] for r in rows) == list(range(100))
    assert {r["position"] for r in rows if r["doc_id"] % 3 == 0} == set(range(34))


def test_a_document_with_two_replies_stays_one_row(spark):
    known = spark.createDataFrame([(1, "a", True), (2, "b", True)], "doc_id int, file_name string, has_text boolean")
    replies = spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "doc_id int, response string")
    rows = inference.attach_responses(known, replies).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["response"]) for r in rows] == [(1, "y"), (2, None)]
