"""The whole review: written tables, repeated runs, streams, plans."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import samples
from catalogue.queries import QUERIES, RUN_TS
from papersieve import fixed_values as fv
from papersieve.functions import quality
from papersieve.operators import parsing, reports
from papersieve.operators.triage import excluded_by_any, excluded_by_join
from papersieve.plans.review import report_paths, review, review_replies, run_review
from papersieve.sources.reports import read_manifest, read_report
from papersieve.streaming.review import start_review
from tests.conftest import SMALL

KEY = T.StructType([T.StructField("doc_id", T.LongType())])


@pytest.fixture(scope="module")
def inputs(spark):
    documents = samples.papers(samples.documents(spark, SMALL))
    return documents, samples.replies(samples.document_ids(spark, SMALL))


def rows(table):
    """Rows as sortable text, columns by name."""
    return sorted(str(r) for r in table.select(sorted(table.columns)).collect())


def test_written_tables(spark, schema, inputs, tmp_path):
    paths = run_review(*inputs, schema, str(tmp_path / "out"), RUN_TS)
    lazy = review(*inputs, schema)
    for path, table, header in (
        (paths.qa_report, reports.quality_report(lazy, schema, "doc_id"), schema.qa_header()),
        (paths.de_report, reports.extraction_report(lazy, schema, "doc_id"), schema.de_header()),
    ):
        assert rows(read_report(spark, path, header, KEY)) == rows(table)
    written = spark.read.parquet(paths.manifest)
    assert written.count() == inputs[0].count()
    plan = written.where("status = 'ANALYSED'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan
    log = spark.read.parquet(paths.response_log)
    assert log.where(F.col("body") == fv.NO_RESPONSE_NOTICE).count() == (
        written.where(F.col("status").isin("NO_TEXT", "NO_RESPONSE")).count()
    )
    kinds = spark.read.parquet(paths.artifacts).groupBy(
        F.regexp_extract("artifact", "_(prompt|pdf_extract|response).txt$", 1).alias("kind")
    ).count().collect()
    assert {r["kind"] for r in kinds} == {"prompt", "pdf_extract", "response"}


def test_overwrite_starts_anew(spark, schema, inputs, tmp_path):
    out = str(tmp_path / "out")
    run_review(*inputs, schema, out, RUN_TS)
    few = inputs[0].where("doc_id < 10")
    paths = run_review(few, inputs[1], schema, out, "2024-06-01 00:00:00")
    assert spark.read.parquet(paths.manifest).count() == 10
    assert spark.read.parquet(paths.response_log).select("logged_at").distinct().count() == 1


def test_append_goes_on_with_what_is_pending(spark, schema, inputs, tmp_path):
    documents, replies = inputs
    out = str(tmp_path / "out")
    paths = run_review(
        documents.where("doc_id < 100"), replies, schema, out, "2024-06-01 00:00:00", mode="append"
    )
    first = read_manifest(spark, paths.manifest)
    assert first.columns == ["doc_id", "run_ts", "status"]
    decided = first.where(F.col("status").isin(*fv.DECIDED)).count()
    second_run = "2024-06-02 00:00:00"
    for _ in range(2):  # a run that is repeated replaces its own rows only
        earlier = read_manifest(spark, paths.manifest).where(F.col("run_ts") != second_run)
        run_review(documents, replies, schema, out, second_run, mode="append", earlier=earlier)
    both = spark.read.parquet(paths.manifest)
    assert both.count() == 100 + documents.count() - decided
    final = both.where(F.col("status").isin(*fv.DECIDED))
    assert final.count() == final.select("doc_id").distinct().count()
    whole = review(documents, replies, schema)
    assert rows(final.select("doc_id", "status", "reason")) == rows(
        whole.where(F.col("status").isin(*fv.DECIDED)).select("doc_id", "status", "reason")
    )


@pytest.mark.parametrize("source, options", [
    ("json", {}),
    ("orc", {}),
    ("csv", {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "-"}),
])
def test_other_report_formats(spark, schema, inputs, tmp_path, source, options):
    paths = run_review(
        *inputs, schema, str(tmp_path / "out"), RUN_TS, source=source, options=options
    )
    found = read_report(spark, paths.qa_report, schema.qa_header(), KEY, source, options)
    assert rows(found) == rows(reports.quality_report(review(*inputs, schema), schema, "doc_id"))


def test_accepted_without_fields_has_no_extraction_row(replies, schema):
    good = "==QUALITY_ASSESSMENT_START==QE2: a QE2_SCORE: 9==QUALITY_ASSESSMENT_END=="
    table = review_replies(
        replies(
            good,
            good + "==DATA_EXTRACTION_START==Title: Foo bar==DATA_EXTRACTION_END==",
            good + "==DATA_EXTRACTION_START==YEAR: 1 OTHER: x==DATA_EXTRACTION_END==",
            good + "\nData Extraction\nTitle: mixed\nYEAR: 2",
        ),
        schema,
    )
    found = reports.extraction_report(table, schema, "doc_id").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["TITLE"], r["YEAR"], r["AUTHOR"]) for r in found] == [
        (1, "doc_1", "", ""), (2, "", "1", ""), (3, "", "2", "")
    ]
    titles = reports.quality_report(table, schema, "doc_id").orderBy("doc_id").collect()
    assert [r["TITLE"] for r in titles] == ["doc_0", "doc_1", "doc_2", "mixed"]


def test_stream_and_batch_agree(spark, schema, inputs, tmp_path):
    replies = str(tmp_path / "replies")
    known = inputs[1].withColumn("has_text", F.lit(True))
    known.where("doc_id < 120").write.parquet(replies)
    out, checkpoint = str(tmp_path / "decisions"), str(tmp_path / "checkpoint")

    def go_on():
        stream = spark.readStream.schema(known.schema).parquet(replies)
        start_review(stream, schema, out, checkpoint).awaitTermination()
        return spark.read.parquet(out)

    assert go_on().count() == 120
    known.where("doc_id >= 120").write.mode("append").parquet(replies)
    batch = review_replies(known, schema)
    assert rows(go_on().select(batch.columns)) == rows(batch)


def test_wide_columns_equal_the_pivoted_items(spark, schema):
    parsed = parsing.parse_quality(samples.replies(samples.document_ids(spark, SMALL)))
    wide = parsing.quality_wide(parsed, schema, "doc_id")
    scores = [f"{i}_SCORE" for i in schema.question_ids]
    pivoted = (
        parsing.quality_long(parsed, "doc_id").groupBy("doc_id")
        .pivot("qid", schema.question_ids).agg(F.max_by("score", "ord"))
        .withColumnsRenamed({i: f"{i}_SCORE" for i in schema.question_ids})
    )
    having = wide.join(pivoted, "doc_id", "left_semi")
    assert rows(having.select("doc_id", *scores)) == rows(pivoted.select("doc_id", *scores))


def test_exclusion_by_lookup_equals_exclusion_by_join(spark, schema):
    replies = samples.replies(samples.document_ids(spark, SMALL)).withColumn("has_text", F.lit(True))
    looked_up = review_replies(replies, schema).where("excluded_by IS NOT NULL")
    items = parsing.quality_long(parsing.parse_quality(replies), "doc_id")
    joined = excluded_by_join(items, schema.excluding_table(spark), "doc_id")
    assert rows(looked_up.select("doc_id", "excluded_by")) == rows(joined)


def plan_of(table):
    execution = table._jdf.queryExecution()
    return execution.optimizedPlan().toString(), execution.executedPlan().toString()


def test_filters_do_not_repeat_the_patterns(replies, schema):
    """A report's filter must stay above the parsing, or each pattern runs twice."""
    table = review_replies(replies("x"), schema)
    for report in (
        reports.quality_report(table, schema, "doc_id"),
        reports.extraction_report(table, schema, "doc_id"),
    ):
        optimized, executed = plan_of(report)
        filters = [line for line in optimized.splitlines() if "Filter" in line.split("(")[0]]
        assert filters and not any("regexp" in line for line in filters)
        assert "Exchange" not in executed
        # once for quality items (marked), once each for ids and groups of the fallbacks,
        # once for fields
        assert executed.count("regexp_extract_all(_section") <= 4


def test_review_reads_and_shuffles_only_what_it_needs(spark, schema, tmp_path):
    documents = spark.range(50).select(
        F.col("id").alias("doc_id"), F.format_string("d%d.pdf", "id").alias("file_name"),
        F.lit("text").alias("text"), F.lit("unused").alias("other"),
    )
    documents.write.parquet(str(tmp_path / "documents"))
    spark.range(50).select(
        F.col("id").alias("doc_id"), F.lit("reply").alias("response"), F.lit(1).alias("other")
    ).write.parquet(str(tmp_path / "responses"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = review(
            spark.read.parquet(str(tmp_path / "documents")),
            spark.read.parquet(str(tmp_path / "responses")), schema,
        )
        _, executed = plan_of(table)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert executed.count("Exchange hashpartitioning(doc_id") == 2  # the two sides of the join
    assert executed.count("Exchange") == 2
    assert "other" not in executed
    # below its exchange the document side is doc_id, file_name, has_text
    lines = executed.splitlines()
    at = next(n for n, line in enumerate(lines) if "Exchange hashpartitioning(doc_id" in line)
    assert re.search(r"Project \[doc_id#\S+ file_name#\S+ coalesce\(.*\) AS has_text#\d+\]$", lines[at + 1])


def test_parsed_replies_of_many_reviews_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, executed = plan_of(QUERIES["many_reviews"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = executed.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    parsing_at = [n for n, line in enumerate(lines) if "regexp_extract_all" in line]
    moved = [n for n, line in enumerate(lines) if "Exchange hashpartitioning(review_id" in line]
    assert parsing_at and moved and max(parsing_at) < min(moved) and depth[max(parsing_at)] < depth[min(moved)]


def test_many_excluding_questions_look_up_one_array(spark):
    items = "array<struct<qid:string,descr:string,score:double>>"
    newest = [("QE2", "b", 0.0), ("QE1", "a", 1.0), ("QE2", "older", 1.0), ("QE1", "older", 0.0), ("QE3", "c", None), (None, "d", 0.0)]
    cases = [
        (newest, ["QE9", "QE1", "QE3", "QE2", "QE2"], "QE2"), (newest, ["QE1"], None), (newest, [None, "QE3"], None),
        (newest, [], None), (newest, None, None), ([], ["QE1"], None), (None, ["QE1"], None),
    ]
    table = spark.createDataFrame([(n, *case) for n, case in enumerate(cases)], f"n int, items {items}, excluding array<string>, wanted string")
    found = excluded_by_any(F.col("items"), F.col("items.qid"), F.col("excluding"))
    assert [r.found for r in table.select("n", found.alias("found")).sort("n").collect()] == [case[2] for case in cases]
    plan = table.select(found.alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 1 and plan.count("items#") - plan.count("items#", plan.rfind("LogicalRDD")) <= 2


def test_ids_and_scores_in_turn_are_read_as_all_others(spark, monkeypatch):
    rng = random.Random(3)
    pieces = ["QE1: a ", "QE1_SCORE: 1 ", "QE2: \n", "QE2_SCORE:0.5", "QE12: x ", "QE12_SCORE: 2. ", "QE1: b QE1_SCORE: 0 ", "QE2: QE2_SCORE: 2"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(7))) for _ in range(400)]
    texts += ["".join(pieces), "".join(pieces * 2) + " end", "", None]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n long, text string")

    def spans():
        return [r.spans for r in table.select("n", quality.marked_matches(F.col("text")).alias("spans")).sort("n").collect()]

    tokens = quality._tokens(F.col("text"), fv.QUESTION_ID, rf"{fv.SPACE}*+[0-9.]++")["tokens"]
    turns = [r[1] for r in table.select("n", quality._in_turn(tokens)).sort("n").collect()]
    assert turns[-4:-1] == [True, True, False] and 20 < sum(map(bool, turns)) < 200
    found = spans()
    monkeypatch.setattr(quality, "_in_turn", lambda tokens: F.lit(False))
    assert found == spans()


def test_every_query_has_sql():
    from catalogue.oracles import ORACLES

    assert set(ORACLES) == set(QUERIES)


def test_nothing_is_decided_before_the_first_run(spark, tmp_path):
    assert read_manifest(spark, str(tmp_path / "manifest")).count() == 0


def test_unknown_mode(schema, inputs, tmp_path):
    with pytest.raises(ValueError):
        run_review(*inputs, schema, str(tmp_path / "out"), RUN_TS, mode="errorifexists")


def test_paths():
    assert report_paths("x/").qa_report == os.path.join("x", "qa_report")
