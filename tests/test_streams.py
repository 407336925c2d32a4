"""Streams come to what batches come to, whatever arrives twice, late, or across restarts."""

import time

import pytest
from pyspark.sql import functions as F

from catalogue import samples
from papersieve.operators.inference import ATTEMPT_TYPE, attach_responses, backoff_cost, resolve_attempts
from papersieve.plans.review import review_replies
from papersieve.sources.files import DocumentFiles, Files, dealt, File, list_files
from papersieve.streaming.attempts import read_due_retries, read_outcomes, start_attempts, wait_for_input
from papersieve.streaming.review import REPLY, read_review, start_review
from tests.conftest import SMALL


def rows(table):
    return sorted(map(tuple, table.collect()), key=repr)


def test_repeated_replies_give_one_decision(spark, schema, tmp_path):
    good = "==QUALITY_ASSESSMENT_START==QE2: a QE2_SCORE: {}==QUALITY_ASSESSMENT_END=="
    whole = samples.replies(samples.document_ids(spark, SMALL).where("doc_id < 40")).select("doc_id", "response")
    replies = [(r.doc_id, r.response) for r in whole.collect()]
    deliveries = [
        replies[:20] + [(1, good.format(7)), (None, good.format(8)), (41, None)],
        replies[10:] + [(1, good.format(9)), (1, good.format(7)), (2, good.format(1))],
        [(1, good.format(8)), (41, good.format(9)), (41, ""), (42, good.format(9))],
    ]
    known = [(i, f"doc_{i}.pdf", i != 42) for i in [*range(40), 41, 42, None]]
    names = {i: (name, has) for i, name, has in known}
    for n, delivery in enumerate(deliveries):
        made = [(i, *names[i], reply) for i, reply in delivery]
        spark.createDataFrame(made, REPLY).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(REPLY).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        start_review(stream, schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        arrived = [x for d in deliveries[: n + 1] for x in d]
        texts = spark.createDataFrame([k for k in known if k[0] is not None], "doc_id bigint, file_name string, has_text boolean")
        texts = texts.join(spark.createDataFrame(arrived, "doc_id bigint, r string").select("doc_id").distinct(), "doc_id")
        batch = review_replies(attach_responses(texts, spark.createDataFrame(arrived, "doc_id bigint, response string")), schema)
        found = read_review(spark, f"{tmp_path}/out", schema).where("doc_id IS NOT NULL")
        assert rows(found.select(batch.columns)) == rows(batch)
    assert read_review(spark, f"{tmp_path}/out", schema).where("doc_id IS NULL").count() == 1
    assert read_review(spark, f"{tmp_path}/none", schema).count() == 0


def test_attempts_in_batches_resolve_as_at_once(spark, tmp_path):
    attempts = samples.attempts(spark, SMALL)
    parts = [attempts.where(f"pmod(xxhash64(doc_id, attempt), 3) = {n}") for n in range(3)]
    for part in parts:
        part.unionAll(part.limit(20)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ATTEMPT_TYPE).parquet(f"{tmp_path}/in")
        running = start_attempts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", every="200 milliseconds")
        wait_for_input(running, 100)
        running.stop()
    whole = resolve_attempts(attempts)
    found = read_outcomes(spark, f"{tmp_path}/out")
    assert rows(found.select(whole.columns)) == rows(whole)
    assert rows(backoff_cost(found)) == rows(backoff_cost(whole))


def test_a_retry_falls_due_after_its_backoff(spark, tmp_path):
    def arrive(*made):
        spark.createDataFrame(made, ATTEMPT_TYPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def until(wanted):
        end = time.monotonic() + 60
        while (due := rows(read_due_retries(spark, f"{tmp_path}/out"))) != wanted and time.monotonic() < end:
            time.sleep(0.5)
        return due

    good = '{"choices":[]}'
    arrive((1, 1, 503, None, None), (2, 1, 200, None, good), (3, 1, 400, None, None), (4, 1, None, "timeout", None))
    stream = spark.readStream.schema(ATTEMPT_TYPE).parquet(f"{tmp_path}/in")
    running = start_attempts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", retry_backoff=0.5, every="200 milliseconds")
    try:
        assert until([(1, 1), (4, 1)]) == [(1, 1), (4, 1)]
        arrive((1, 2, 200, None, good), (4, 2, 503, None, None))
        assert until([(4, 2)]) == [(4, 2)]
        arrive((4, 3, 503, None, None))
        assert until([]) == []
    finally:
        running.stop()
    found = rows(read_outcomes(spark, f"{tmp_path}/out").select("doc_id", "outcome", "n_attempts"))
    assert found == [(1, "ok", 2), (2, "ok", 1), (3, "fatal", 1), (4, "exhausted", 3)]


def test_documents_share_states_and_keep_their_own_timers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("papersieve.streaming.attempts.GROUPS", 2)
    ids = [None, 2**60 + 1, 2**60 + 2, *range(40)]
    good = '{"choices":[]}'

    def arrive(*made):
        spark.createDataFrame(made, ATTEMPT_TYPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    arrive(*[(i, 1, 503, None, None) for i in ids])
    stream = spark.readStream.schema(ATTEMPT_TYPE).parquet(f"{tmp_path}/in")
    running = start_attempts(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", retry_backoff=0.5, every="200 milliseconds")
    try:
        wait_for_input(running, 100)
        arrive(*[(i, 3, 200, None, good) for i in ids[:3]], (ids[1], 2, 200, None, good), (5, 2, 503, None, None))
        due, end = [], time.monotonic() + 60
        wanted = sorted([(i, 1 + (i == 5)) for i in ids[3:]], key=repr)
        while (due := rows(read_due_retries(spark, f"{tmp_path}/out"))) != wanted and time.monotonic() < end:
            time.sleep(0.5)
        assert due == wanted
        assert 1 <= running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    finally:
        running.stop()
    found = rows(read_outcomes(spark, f"{tmp_path}/out").where("outcome = 'ok'").select("doc_id", "n_attempts", "body"))
    assert found == rows(spark.createDataFrame([(None, 3, good), (ids[1], 2, good), (ids[2], 3, good)], "a long, b int, c string"))


def test_waiting_goes_on_while_batches_end():
    class Query:
        """Takes in two batches, each of them longer than half the patience, then finds nothing new."""

        def __init__(self):
            self.began = time.monotonic()

        def exception(self):
            return None

        @property
        def lastProgress(self):
            ended = int((time.monotonic() - self.began) / 0.8)
            return {"batchId": ended, "numInputRows": 5 if ended < 3 else 0} if ended else None

    wait_for_input(Query(), 1.5)

    class Stuck(Query):
        lastProgress = {"batchId": 1, "numInputRows": 5}

    with pytest.raises(TimeoutError):
        wait_for_input(Stuck(), 0.5)


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(DocumentFiles)
    inside = tmp_path / "papers"
    inside.mkdir()
    for name in ("a.pdf", "_b.pdf", ".c.PDF", "_d=e.pdf", "notes.txt", "f.Pdf"):
        (inside / name).write_bytes(f"content of {name}".encode())
    (inside / "sub.pdf").mkdir()
    (inside / "sub.pdf" / "g.pdf").write_bytes(b"below")
    return inside


def test_files_with_hidden_names_come_with_their_content(spark, folder):
    found = spark.read.format("documents").option("path", str(folder)).load()
    assert {r.file_name: bytes(r.content).decode() for r in found.collect()} == {
        n: f"content of {n}" for n in ("a.pdf", "_b.pdf", ".c.PDF", "_d=e.pdf", "f.Pdf")
    }
    assert found.where("size <> length(content) OR modified < '2020-01-01'").count() == 0
    listed = spark.read.format("documents").options(path=f"file://{folder}", content="false", pattern="*.txt").load()
    assert [tuple(r)[1:3] for r in listed.collect()] == [("notes.txt", 20)] and "content" not in listed.columns
    one_each = spark.read.format("documents").options(path=str(folder), bytes="1").load()
    assert one_each.rdd.getNumPartitions() == 5 and one_each.count() == 5
    for options in ({"path": str(folder / "absent")}, {}):
        with pytest.raises(Exception):  # noqa: B017 - whatever the file system raises
            spark.read.format("documents").options(**options).load().count()


def test_files_are_dealt_by_bytes(folder):
    files = [File(str(n), size, 0) for n, size in enumerate([5, 5, 1, 20, 3, 3, 3, 3])]
    assert [[f[1] for f in task.value] for task in dealt(files, 10, 3)] == [[5, 5], [1], [20], [3, 3, 3], [3]]
    assert dealt([]) == [] and isinstance(dealt(files)[0], Files)
    assert [f.path.rpartition("/")[2] for f in list_files(str(folder))] == [".c.PDF", "_b.pdf", "_d=e.pdf", "a.pdf", "f.Pdf"]


def test_new_files_arrive_on_a_stream_once(spark, folder, tmp_path):
    def arrived():
        stream = spark.readStream.format("documents").options(path=str(folder), log=f"{tmp_path}/log").load()
        query = (
            stream.select("file_name", F.length("content").alias("n")).writeStream.format("parquet")
            .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
            .trigger(processingTime="0 seconds").start()
        )
        query.processAllAvailable()
        query.stop()
        return sorted(r.file_name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [".c.PDF", "_b.pdf", "_d=e.pdf", "a.pdf", "f.Pdf"]
    assert arrived() == first
    assert arrived() == first
    (folder / "z.pdf").write_bytes(b"late")
    (folder / "_0.pdf").write_bytes(b"late as well")
    assert arrived() == sorted([*first, "z.pdf", "_0.pdf"])
