"""Listing, decoding and assembling documents; the schema; reading reports."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from papersieve import ReviewSchema
from papersieve.functions.text import file_stem, number, preview, strip, truncate
from papersieve.operators.requests import render_prompts
from papersieve.schema import header_type, report_header
from papersieve.sources import corpus
from papersieve.sources.reports import read_report
from papersieve.sources.storage import durable

RAW = {
    "quality_assessment_questions": [
        {"id": "QE1", "question": "Is it?", "scores": [0.0, 0.5, 1.0]},
        {"id": "QE2", "question": "Was it?", "scores": [0, 1]},
    ],
    "data_extraction_fields": [{"key": "TITLE", "description": "Name."}],
    "cutoff_score": 1.5,
    "excluding_questions": ["QE2"],
}


@pytest.fixture
def folder(tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", "sub/d.pdf", "e.Pdf", "status=x/f.pdf", "g.pdf/h.txt", "g.pdf/i.pdf"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(f"page one of {name}|page two".encode())
    return tmp_path


def test_list_documents(spark, folder):
    rows = corpus.list_documents(spark, str(folder)).orderBy("file_name").collect()
    assert [r["file_name"] for r in rows] == ["a.pdf", "b.PDF", "e.Pdf"]


def test_hidden_documents_are_listed_and_never_left_out_silently(spark, folder):
    for name in ("_a.pdf", ".b.pdf", ".PDF", "_c=d.pdf", "_note.txt"):
        (folder / name).write_bytes(b"x")
    (folder / "_sub.pdf").mkdir()
    rows = corpus.list_documents(spark, str(folder)).collect()
    assert sorted(r["file_name"] for r in rows) == [".PDF", ".b.pdf", "_a.pdf", "_c=d.pdf", "a.pdf", "b.PDF", "e.Pdf"]
    assert len({r["path"].rsplit("/", 1)[0] for r in rows}) == 1
    with pytest.raises(ValueError, match="^3 documents"):
        corpus.read_files(spark, str(folder))
    assert corpus.read_files(spark, str(folder), leave_hidden=True).count() == 4


def test_list_documents_of_an_empty_or_absent_folder(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    assert corpus.list_documents(spark, str(tmp_path)).count() == 0
    with pytest.raises(AnalysisException):
        corpus.list_documents(spark, str(tmp_path / "absent"))


def test_decode_and_assemble(spark, folder):
    def decoder(content):
        if content.startswith(b"page one of b"):
            raise ValueError("damaged")
        return content.decode().split("|")

    pages = corpus.decode_pages(corpus.read_files(spark, str(folder)), decoder)
    whole = corpus.decode_text(corpus.read_files(spark, str(folder)), decoder)
    for table in (corpus.assemble_text(pages, "path"), whole):
        texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in table.collect()}
        assert texts == {
            "a.pdf": "page one of a.pdfpage two", "b.PDF": None,
            "e.Pdf": "page one of e.Pdfpage two",
        }


def test_assemble_text_order_and_gaps(spark):
    pages = spark.createDataFrame(
        [(1, 10, "c"), (1, 2, "b"), (1, 1, "a"), (2, 1, "x"), (2, 2, None), (3, 1, "")],
        "doc_id bigint, page_no int, page_text string",
    )
    documents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id bigint")
    rows = corpus.with_text(documents, pages).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["abc", None, "", ""]


def test_pending_documents(spark):
    documents = spark.createDataFrame([(i,) for i in range(6)], "doc_id bigint")
    manifest = spark.createDataFrame(
        [(0, "ANALYSED"), (1, "REJECTED"), (2, "NO_TEXT"), (3, "NO_RESPONSE"), (4, "PARSE_ERROR"),
         (0, "ANALYSED"), (2, "REJECTED")],
        "doc_id bigint, status string",
    )
    rows = corpus.pending_documents(documents, manifest).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [3, 4, 5]


@pytest.mark.parametrize("name, stem", [
    ("a.b.pdf", "a.b"), (".pdf", ".pdf"), ("a", "a"), ("a..pdf", "a."), ("..pdf", "..pdf"),
    (".a.pdf", ".a"), ("x/y.z/doc.pdf", "doc"), ("two\nlines.pdf", "two\nlines"), ("a.", "a"),
])
def test_file_stem(spark, name, stem):
    row = spark.createDataFrame([(name,)], "n string").select(file_stem(F.col("n")).alias("s"))
    assert row.first()["s"] == stem


def test_strip_and_shorten(spark):
    spaced = "\x1c   a b　\n"
    row = spark.createDataFrame([(spaced, "\U0001f600é" * 3)], "s string, t string").select(
        strip(F.col("s")).alias("stripped"), truncate(F.col("t"), 2).alias("cut"),
        truncate(F.col("t"), 6).alias("whole"), truncate(F.col("t"), None).alias("none"),
        truncate(F.col("t"), 0).alias("zero"), preview(F.repeat("t", F.lit(1000))).alias("opening"),
    ).first()
    whole = "\U0001f600é" * 3
    assert row["stripped"] == "a b"
    assert row["cut"] == "\U0001f600é... [Content truncated due to length]"
    assert row["whole"] == row["none"] == row["zero"] == whole
    assert row["opening"] == (whole * 1000)[:5000] + (
        "\n\n... [content truncated for debug file only] ..."
    )


def test_numbers(spark):
    shown = ["1", "+1.", "-.5", "1e3", "1_0.0_1", " 2 ", "inf", "-Infinity", "+nan", "", "1.0f",
             "1d", "0x1p3", "1__0", "_1", "1.0.", ".", "e1", "one", "- 1"]
    rows = spark.createDataFrame([(s,) for s in shown], "s string").select(
        number(F.col("s")).alias("n")
    ).collect()

    def by_python(text):
        try:
            return float(text)
        except ValueError:
            return None

    assert [str(r["n"]) for r in rows] == [str(by_python(s)) for s in shown]


def test_schema_files(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(RAW))
    schema = ReviewSchema.from_file(tmp_path / "s.json")
    assert schema.question_ids == ["QE1", "QE2"] and schema.field_keys == ["TITLE"]
    assert schema.cutoff == 1.5 and schema.excluding == ("QE2",)
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(RAW))
    assert ReviewSchema.from_file(tmp_path / "s.yaml") == schema


def test_schema_defaults_and_checks():
    bare = {k: RAW[k] for k in ("quality_assessment_questions", "data_extraction_fields")}
    schema = ReviewSchema.from_dict(bare)
    assert schema.cutoff == 0 and schema.excluding == ()
    for broken in (
        {**bare, "quality_assessment_questions": []},
        {**bare, "data_extraction_fields": None},
        {**bare, "cutoff_score": "high"},
        {**bare, "data_extraction_fields": [{"key": "A"}]},
        {**bare, "data_extraction_fields": [{"key": k, "description": ""} for k in ("Ab", "AB")]},
    ):
        with pytest.raises(ValueError):
            ReviewSchema.from_dict(broken)


def test_headers():
    schema = ReviewSchema.from_dict(RAW)
    assert schema.qa_header() == ["TITLE", "QE1", "QE1_SCORE", "QE2", "QE2_SCORE", "TOTAL_SCORE"]
    assert schema.de_header() == ["TITLE"]
    assert report_header(["QE1", "B"]) == ["TITLE", "QE1", "B"]
    assert report_header(["B"]) == ["B"]


def test_prompt_of_a_schema_and_of_tables_agree(spark):
    schema = ReviewSchema.from_dict(RAW)
    prompt = schema.prompt()
    assert "* QE1: Is it? (Possible scores: 0.0, 0.5, 1.0)\n* QE2: Was it? (Possible scores: 0, 1)" in prompt
    assert "* TITLE: Name.\n\nMinimum acceptance score: 1.5\n\n===== OUTPUT" in prompt
    reviews = spark.createDataFrame([(1, 1.5), (2, 0.0)], "review_id bigint, cutoff double")
    questions = schema.questions_table(spark).withColumn("review_id", F.lit(1))
    fields = schema.fields_table(spark).withColumnRenamed("key", "field_key").withColumn(
        "review_id", F.lit(1)
    )
    rows = {r["review_id"]: r["prompt"] for r in render_prompts(reviews, questions, fields).collect()}
    assert rows[1] == prompt.replace("scores: 0, 1)", "scores: 0.0, 1.0)")
    assert rows[2] == ""


def test_only_scores_are_numbers():
    kinds = header_type(["TITLE", "QE1", "QE1_SCORE", "TOTAL_SCORE"])
    assert [f.dataType.simpleString() for f in kinds] == ["string", "string", "double", "double"]
    assert header_type(["TITLE", "RISK_SCORE"])["RISK_SCORE"].dataType.simpleString() == "string"


@pytest.mark.parametrize("part,name", [
    ("data_extraction_fields", "Doc_ID"), ("data_extraction_fields", "TOTAL_SCORE"),
    ("data_extraction_fields", "A`B"),
])
def test_names_that_no_report_can_hold(part, name):
    with pytest.raises(ValueError, match="not usable"):
        ReviewSchema.from_dict(RAW | {part: [{"key": name, "description": "x"}]})


def test_question_named_like_a_score():
    questions = [{"id": i, "question": "?", "scores": [0, 1]} for i in ("QE1", "qe1_score")]
    with pytest.raises(ValueError, match="not usable"):
        ReviewSchema.from_dict(RAW | {"quality_assessment_questions": questions, "excluding_questions": []})


def test_report_that_was_never_written(spark, tmp_path):
    rows = read_report(spark, str(tmp_path / "absent"), ["TITLE", "QE1_SCORE"])
    assert rows.count() == 0
    assert rows.dtypes == [("TITLE", "string"), ("QE1_SCORE", "double")]


def test_durable_reads_back_what_was_there(spark):
    rows = durable(spark.range(100).withColumn("slot", F.monotonically_increasing_id()))
    assert rows.count() == 100
    assert rows.inputFiles() == []  # lineage is cut: the plan no longer reads the source
    assert spark.sparkContext.getCheckpointDir() is not None
