"""Runs count as a whole or not at all, and read the texts once."""

import glob
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import samples
from catalogue.sample_schema import LATER_SCHEMA
from papersieve.plans import review as plans
from papersieve.plans.review import report_paths, run_review, scan_documents, write_run
from papersieve.sources import runs
from papersieve.sources.reports import headers_path, read_across_runs, read_manifest, read_report
from tests.conftest import SMALL

KEY = T.StructType([T.StructField("doc_id", T.LongType())])
FIRST, SECOND = "2024-06-01 00:00:00", "2024-06-02 00:00:00"
STEPS = [
    "attach_responses", "quality_report", "extraction_report", "response_log", "artifacts", "manifest", "write_headers", "commit",
]


@pytest.fixture(scope="module")
def inputs(spark):
    texts = samples.documents(spark, SMALL).where("doc_id < 60")
    return samples.papers(texts).cache(), samples.replies(texts.select("doc_id")).cache()


def state(spark, folder, schema):
    """All that readers see of a folder."""
    paths = report_paths(folder)
    found = [read_report(spark, paths.qa_report, schema.qa_header(), KEY)]
    found += [read_report(spark, paths.de_report, schema.de_header(), KEY), read_manifest(spark, paths.manifest)]
    for path in (paths.response_log, paths.artifacts):
        found.append(read_report(spark, path, [], KEY))
    return [sorted(map(tuple, table.collect()), key=repr) for table in found]


def break_at(monkeypatch, step):
    def broken(*_args, **_kwargs):
        raise RuntimeError(f"broken at {step}")

    monkeypatch.setattr(plans, step, broken)


def test_an_overwrite_that_breaks_off_changes_nothing(spark, schema, inputs, tmp_path, monkeypatch):
    documents, replies = inputs
    out = str(tmp_path / "out")
    run_review(documents.where("doc_id < 30"), replies, schema, out, FIRST)
    before = state(spark, out, schema)
    assert all(before) and len(before[2]) == 30
    for step in STEPS:
        with monkeypatch.context() as patch:
            break_at(patch, step)
            with pytest.raises(RuntimeError, match="broken at"):
                run_review(documents, replies, schema, out, SECOND)
        assert state(spark, out, schema) == before, step
    run_review(documents, replies, schema, out, SECOND)
    after = state(spark, out, schema)
    assert {row[1] for row in after[2]} == {SECOND} and len(after[2]) == 60
    # the former run and all remains of broken ones are gone
    now = set(runs.snapshot(spark, out).runs)
    tables = {path.rpartition("/")[2] for path in [*report_paths(out), headers_path(out)]}
    assert runs.written_runs(spark, out) == {(table, run) for table in tables for run in now}


def test_a_first_run_that_breaks_off_leaves_all_pending(spark, schema, inputs, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    break_at(monkeypatch, "commit")
    with pytest.raises(RuntimeError, match="broken at"):
        run_review(*inputs, schema, out, FIRST)
    assert not any(state(spark, out, schema))


def test_former_versions_stay_until_vacuum(spark, schema, inputs, tmp_path):
    documents, replies = inputs
    out = str(tmp_path / "out")
    run_review(documents, replies, schema, out, FIRST)
    old = runs.snapshot(spark, out)
    opened = read_manifest(spark, report_paths(out).manifest)
    run_review(documents.limit(0), replies, schema, out, SECOND, keep_former=True)
    assert opened.count() == 60 and read_manifest(spark, report_paths(out).manifest).count() == 0
    assert runs.vacuum(spark, out) == set(old.runs)
    assert runs.snapshot(spark, out).version == old.version + 1
    assert runs.vacuum(spark, out) == set()


def test_the_second_of_two_runs_at_once_is_refused(spark, schema, inputs, tmp_path):
    documents, replies = inputs
    out = str(tmp_path / "out")
    before = runs.snapshot(spark, out)
    assert before == runs.Snapshot(0, {})
    one = write_run(documents, replies, schema, out, FIRST)
    other = write_run(documents, replies, schema, out, SECOND)
    runs.commit(spark, out, before, {one: FIRST})
    with pytest.raises(Exception, match="already exists"):
        runs.commit(spark, out, before, {other: SECOND})
    assert runs.snapshot(spark, out).runs == {one: FIRST}
    # both past the test for the folder at the same moment
    rows = spark.createDataFrame([("x", SECOND, other)], runs.COMMIT)
    rows.coalesce(1).write.mode("append").parquet(f"{out}/{runs.COMMITS}/version=1")
    with pytest.raises(RuntimeError, match="at once"):
        runs.snapshot(spark, out)


def counted(spark, documents):
    """Documents whose texts count how often they are made."""
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    made = F.udf(read, "string").asNondeterministic()
    return documents.withColumn("text", made("text")), reads


def test_texts_are_read_once(spark, schema, inputs, tmp_path):
    documents, replies = inputs
    out = str(tmp_path / "out")
    few, reads = counted(spark, documents.where("doc_id < 40"))
    run_review(few, replies, schema, out, FIRST)
    assert reads.value == 40
    earlier = read_manifest(spark, report_paths(out).manifest)
    whole, reads = counted(spark, documents)
    run_review(whole, replies, schema, out, SECOND, mode="append", earlier=earlier)
    assert reads.value <= 60


def shuffled(plan):
    """What stands below each exchange of a plan that moves rows by a hash."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for n, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            end = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            yield "\n".join(lines[n:end])


@pytest.mark.parametrize("bound", [1_000, 25, 0])
def test_openings_are_not_shuffled_beside_few_ids(spark, inputs, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(plans, "BROADCAST_IDS", bound)
    documents = inputs[0].withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    documents.write.parquet(f"{tmp_path}/documents")
    documents = spark.read.parquet(f"{tmp_path}/documents")
    earlier = documents.where("doc_id >= 20 AND doc_id < 55").select("doc_id", F.lit("ANALYSED").alias("status"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scanned = scan_documents(documents, earlier)
        plan = scanned._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.has_text, r.preview) for r in scanned.collect())
    every = scan_documents(documents).collect()
    wanted = [r for r in every if r.doc_id is None or not 20 <= r.doc_id < 55]
    assert found == sorted((r.doc_id if r.doc_id is not None else -1, r.has_text, r.preview) for r in wanted)
    assert len(found) == 25
    assert plan.count("text:string") == 1
    # an opening is cut before it is shuffled, if it must be (its notice breaks the line of the plan)
    assert any("Project" in part and "substring(text#" in part for part in shuffled(plan)) == (bound == 0)


def test_only_wanted_replies_are_shuffled(spark, inputs, monkeypatch):
    todo = spark.createDataFrame([(1, True), (2, False), (4, True), (4, True), (None, True)], "doc_id bigint, has_text boolean")
    earlier = spark.createDataFrame([(1, "NO_RESPONSE"), (3, "ANALYSED")], "doc_id bigint, status string")
    replies = spark.createDataFrame([(n, f"reply {n}") for n in (1, 1, 2, 3, 4, 5)], "doc_id bigint, response string")

    def kept(*given):
        return sorted(r.doc_id for r in plans.wanted_replies(replies, todo, *given).collect())

    assert kept() == kept(earlier) == [1, 1, 4]
    monkeypatch.setattr(plans, "BROADCAST_IDS", 1)
    assert kept() == [1, 1, 2, 3, 4, 5] and kept(earlier) == [1, 1, 2, 4, 5]
    monkeypatch.setattr(plans, "BROADCAST_IDS", 0)
    assert kept(earlier) == [1, 1, 2, 3, 4, 5]


def test_texts_are_written_small_and_decisions_not_shuffled_again(spark, schema, inputs, tmp_path):
    out = tmp_path / "out"
    paths = run_review(*inputs, schema, str(out), FIRST)
    files = [f for path in paths for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    one = len(glob.glob(f"{paths.manifest}/**/status=ANALYSED/*.parquet", recursive=True))
    assert one == 1
    run_review(*inputs, schema, str(out), SECOND, options={"compression": "gzip"})
    assert all(f.endswith(".gz.parquet") for f in glob.glob(f"{paths.qa_report}/**/*.parquet", recursive=True))


@pytest.mark.parametrize("source, options", [
    ("parquet", {}), ("csv", {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "-"}),
])
def test_reports_of_different_questionnaires_are_read_as_one(spark, schema, inputs, tmp_path, source, options):
    documents, replies = inputs
    out = str(tmp_path / "out")
    assert read_across_runs(spark, out, "de_report").columns == ["doc_id", "run_ts"]
    for rest, asked, run_ts in ((0, schema, FIRST), (1, LATER_SCHEMA, SECOND), (2, schema, SECOND + ".5")):
        some = documents.where(F.col("doc_id") % 3 == rest)
        run_review(some, replies, asked, out, run_ts, mode="append", source=source, options=options)
    for report, first, later in (
        ("qa_report", schema.qa_header(), LATER_SCHEMA.qa_header()),
        ("de_report", schema.de_header(), LATER_SCHEMA.de_header()),
    ):
        found = read_across_runs(spark, out, report, source=source, options=options)
        assert found.columns == ["doc_id", "run_ts", *first, *[n for n in later if n not in first]]
        rows = found.collect()
        assert {r.run_ts for r in rows} == {FIRST, SECOND, SECOND + ".5"}
        for row in rows:
            mine = later if row.doc_id % 3 == 1 else first
            assert all(row[name] is None for name in found.columns[2:] if name not in mine)
            assert all(row[name] is not None for name in mine if not name.endswith("_SCORE"))
    assert dict(found.dtypes)["YEAR"] == "string"
    scores = dict(read_across_runs(spark, out, "qa_report", source=source, options=options).dtypes)
    assert {scores[n] for n in ("QE1_SCORE", "QE9_SCORE", "TOTAL_SCORE")} == {"double"}


def test_the_log_opens_with_its_run(spark, schema, inputs, tmp_path):
    out = str(tmp_path / "out")
    paths = run_review(*inputs, schema, out, FIRST, backend=("http://model.example", "m"))
    log = read_report(spark, paths.response_log, ["file_name", "body"], KEY)
    heading = log.where("doc_id IS NULL").collect()
    assert [r.body for r in heading] == [
        f"=== LLM Response Log - Started at {FIRST} ===\n\nUsing LLM backend at http://model.example (model: m)\n"
    ]
    assert log.count() == 61
