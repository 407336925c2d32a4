"""Decisions hold a reply once, its answers as places in it, and a run leaves nothing on disk that is not a table."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import samples
from papersieve.functions.places import LEAST_CHARS, MOST_ITEMS, from_places, stored_item, to_places
from papersieve.operators.inference import attach_responses, without_text
from papersieve.plans import review as plans
from papersieve.plans.review import read_decisions, report_paths, review, review_replies, run_review, scanned_path, write_run
from papersieve.sources.reports import read_manifest
from papersieve.sources.storage import SHUFFLE_CLEANUP

FIRST, SECOND = "2024-06-01 00:00:00", "2024-06-02 00:00:00"
ITEM = T.StructType().add("qid", "string").add("descr", "string").add("score", "double")
LONG, OTHER = "a long answer, " * 10, "über \U0001d11e " * 30


def placed(spark, items, reply):
    """What is stored for items, and what is read of that."""
    rows = spark.createDataFrame([(items, reply)], T.StructType().add("items", T.ArrayType(ITEM)).add("reply", "string"))
    stored = rows.select(to_places(F.col("items"), ITEM, "descr", F.col("reply")).alias("stored"), "reply")
    assert stored.schema["stored"].dataType.elementType.simpleString() == stored_item(ITEM).simpleString()
    row = stored.select("stored", from_places(F.col("stored"), ITEM, "descr", F.col("reply")).alias("read")).first()
    return row["stored"], row["read"]


@pytest.mark.parametrize("items, reply, told", [
    ([("QE1", LONG, 1.0), ("QE2", OTHER, None)], f"QE1: {LONG} QE2: {OTHER}.", [True, True]),
    ([("QE1", LONG, 1.0), ("QE1", LONG, 0.0)], f"{LONG}{LONG}", [True, True]),
    ([("QE1", LONG, 1.0), ("QE1", LONG, 0.0)], LONG, [True, False]),  # not behind the first
    ([("QE2", OTHER, 1.0), ("QE1", LONG, 1.0)], f"QE1: {LONG} QE2: {OTHER}.", [True, False]),
    ([("QE1", f"so ä {LONG}", 1.0)], f'QE1: "so" ä {LONG[:20]}"{LONG[20:]}', [True]),  # answers lose quotation marks
    ([("QE1", f'so "{LONG}', 1.0)], f'so "{LONG}', [False]),
    ([("QE1", "x" * (LEAST_CHARS - 1), 1.0), ("QE2", "x" * LEAST_CHARS, 1.0)], "x" * 3 * LEAST_CHARS, [False, True]),
    ([("QE1", None, 1.0), ("QE2", "", 1.0), (None, LONG, None), None], f"..{LONG}", [False, False, True, False]),
    ([("QE1", LONG, 1.0)], "", [False]),
    ([("QE1", LONG, 1.0)], None, [False]),
    ([("QE1", LONG, 1.0)] * MOST_ITEMS, LONG * MOST_ITEMS, [True] * MOST_ITEMS),
    ([("QE1", LONG, 1.0)] * (MOST_ITEMS + 1), LONG * (MOST_ITEMS + 1), [False] * (MOST_ITEMS + 1)),
    ([], "a", []),
    (None, LONG, None),
])
def test_items_are_read_as_they_were(spark, items, reply, told):
    stored, read = placed(spark, items, reply)
    assert read == items
    if items is not None:
        assert [item is not None and item["at"] is not None for item in stored] == told
        assert all(item["descr"] is None for item in stored if item and item["at"] is not None)


def test_texts_that_end_inside_a_character_are_kept(spark):
    # E2 82 opens a character of three bytes
    whole, cut = "61" * 80 + "E282AC" + "61" * 80, "61" * 80 + "E282"
    rows = spark.sql(
        f"select string(X'{whole}') as reply, array(named_struct('qid', 'a', 'descr', string(X'{cut}'), 'score', 1D)) as items"
    )
    stored = rows.withColumn("items", to_places(F.col("items"), ITEM, "descr", F.col("reply")))
    read = stored.select(from_places(F.col("items"), ITEM, "descr", F.col("reply")).alias("items"))
    assert read.selectExpr("hex(items[0].descr)").first()[0] == cut


@pytest.fixture(scope="module")
def inputs(spark):
    """Documents, some twice or without an id, and replies of every shape that quote texts with quotation marks."""
    ids = [*range(48), 3, 4, None]
    texts = spark.createDataFrame([(n, f'No. {n} says "{LONG}" {n or 0:04} times. ' * 20) for n in ids], "doc_id bigint, text string")
    return samples.papers(texts).cache(), samples.replies(texts.where("doc_id IS NOT NULL")).cache()


def as_json(table):
    return sorted(row[0] for row in table.select(F.to_json(F.struct(*table.columns))).collect())


def test_decisions_hold_a_reply_once_and_are_read_whole(spark, schema, inputs, tmp_path):
    out = str(tmp_path / "out")
    paths = run_review(*inputs, schema, out, FIRST)
    expected = review(*inputs, schema)
    assert expected.where("status = 'ANALYSED'").count() > 10
    assert as_json(read_decisions(spark, paths.decisions, expected.schema, FIRST)) == as_json(expected)
    for names in (["doc_id", "qa_items"], ["doc_id", "status"]):
        some = expected.select(*names)
        assert as_json(read_decisions(spark, paths.decisions, some.schema, FIRST)) == as_json(some)
    held = spark.read.parquet(paths.decisions).selectExpr("response", "explode(qa_items) as item")
    long_ones = held.where("item.at is not null")
    assert long_ones.count() > 200
    assert held.where(f"length(item.descr) >= {LEAST_CHARS}").count() == 0
    assert held.agg(F.sum(F.length("item.descr"))).first()[0] < 0.05 * long_ones.agg(F.sum("item.chars")).first()[0]


def test_decisions_of_former_versions_are_read(spark, schema, inputs, tmp_path):
    out = str(tmp_path / "out")
    documents, replies = inputs
    paths = run_review(documents, replies, schema, out, FIRST)
    former = review_replies(attach_responses(without_text(documents), replies), schema)
    written = glob.glob(f"{paths.decisions}/run_id=*")[0]
    former.withColumn("run_ts", F.lit(FIRST)).write.mode("overwrite").partitionBy("run_ts", "status").parquet(written)
    assert as_json(read_decisions(spark, paths.decisions, former.schema, FIRST)) == as_json(former)


def shuffle_files(spark):
    return [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]


def test_a_run_leaves_no_shuffled_replies(spark, schema, inputs, tmp_path, monkeypatch):
    documents, replies = inputs
    former = spark.conf.get(SHUFFLE_CLEANUP)
    kept, written = [], []

    def first_report(*given):
        written.append(glob.glob(f"{scanned_path(str(tmp_path / 'out'))}/**/*.parquet", recursive=True))
        kept.append({f for f in shuffle_files(spark) if f.endswith(".data")} - before)
        return report(*given)

    # ids that are counted stay until the driver collects garbage; there are none without a bound
    monkeypatch.setattr(plans, "wanted_replies", lambda responses, *_: responses)
    report = plans.quality_report
    monkeypatch.setattr(plans, "quality_report", first_report)
    before = set(shuffle_files(spark))
    write_run(documents, replies, schema, str(tmp_path / "out"), FIRST)
    assert kept == [set()]
    assert written == [[]]  # openings are in the artifacts by then
    assert spark.conf.get(SHUFFLE_CLEANUP) == former


def test_settings_are_as_before_when_a_run_breaks_off(spark, schema, inputs, tmp_path):
    documents, replies = inputs
    former = spark.conf.get(SHUFFLE_CLEANUP)
    broken = documents.withColumn("text", F.raise_error(F.lit("no text")).cast("string"))
    with pytest.raises(Exception, match="no text"):
        write_run(broken, replies, schema, str(tmp_path / "out"), FIRST)
    assert spark.conf.get(SHUFFLE_CLEANUP) == former


def test_later_runs_go_on_from_stored_decisions(spark, schema, inputs, tmp_path):
    documents, replies = inputs
    out = str(tmp_path / "out")
    known = report_paths(out).manifest
    run_review(documents.where("doc_id % 3 = 0"), replies, schema, out, FIRST, mode="append")
    first = read_manifest(spark, known)
    run_review(documents, replies, schema, out, SECOND, mode="append", earlier=first)
    decided = first.where("status IN ('ANALYSED', 'REJECTED')").select("doc_id")
    every = review(documents, replies, schema)
    later = read_decisions(spark, report_paths(out).decisions, every.schema, SECOND)
    assert as_json(later) == as_json(every.join(decided, "doc_id", "left_anti").select(*every.columns))


@pytest.mark.parametrize("bound", [samples.BROADCAST_LABELS, 0])
def test_texts_are_not_moved_for_labels(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(samples, "BROADCAST_LABELS", bound)
    rows = [(n, f"text {n}", "web", "en", 6) for n in (1, 2, 2, 3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    labels = [(1, 1, None), (2, 0, 1), (2, 1, 0), (None, 1, 1), (9, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = samples.described(spark, str(tmp_path))
        found = sorted(((r.doc_id or 0, r.text, r.quality, r.toxic) for r in joined.collect()), key=repr)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [(0, "text None", None, None), (1, "text 1", 1, None), (2, "text 2", 1, 1), (2, "text 2", 1, 1), (3, "text 3", None, None)]
    assert ("SortMergeJoin" in plan) == (bound == 0)
