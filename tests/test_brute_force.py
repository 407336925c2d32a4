"""Column expressions against a reading of each reply on its own."""

import random

import pytest
from pyspark.sql import functions as F

from catalogue import samples
from papersieve.operators.parsing import parse_extraction, parse_quality
from papersieve.plans.review import review_replies
from tests import expected
from tests.conftest import SMALL

PIECES = [
    "==QUALITY_ASSESSMENT_START==", "==QUALITY_ASSESSMENT_END==", "==DATA_EXTRACTION_START==",
    "==DATA_EXTRACTION_END==", "QE1:", "QE1_SCORE:", "QE2:", "QE2_SCORE:", "QE12:", "QE12_SCORE:",
    "QE1 Score", "QE2Score:", "QE3.", "QE1_SCORE:+1 ", "QE2_SCORE:-0.5 ", "QE1_SCORE:nan ",
    "1.0", "0", "0.5", "1.0.", ".", "2", "TITLE:", "Title:", "title :", "YEAR:", "YEAR OF USE:",
    "AUTHOR", "IEEE", "A", "word", "two words", "\"said\"", "**", ":", "Data Extraction",
    "Data Extraction:\n", "SECTION 3", "Cutoff Score", "Minimum acceptance score", "\n", "\n\n\n",
    " ", "  ", "\t", " ", " ", "\x1c", "\u0085", "\r\n", "é", "\U0001f600",
]


ITEMS = [
    "QE1: note QE1_SCORE: 1.0\n", "QE2: a \"b\" QE2_SCORE:0.5 ", "QE12: x\nQE12_SCORE:\t2 ",
    "QE2: y QE2_SCORE: 1.0. ", "QE7: none given ", "QE7: z QE7_SCORE: 0 ", "QE1: again QE1_SCORE:+1 ",
    "QE8 Score 1", "QE8. loose QE8Score: 0.5 ", "QE3: QE3_SCORE: 7\n", "QE1_SCORE: 0 ",
]
FIELDS = [
    "TITLE: A Study\n", "YEAR:\n", "YEAR: 2020 ", "AUTHOR: Ann Lee IEEE\n", "USE OF CAD MODEL: no ",
    "DOF OF ARM : 6\n", "Title: mixed case\n", "note: lower\n", "NEW\nLINE: x ", "A: one letter ",
]
SECTIONS = {
    "QA": ("==QUALITY_ASSESSMENT_START==", "==QUALITY_ASSESSMENT_END=="),
    "DE": ("==DATA_EXTRACTION_START==", "==DATA_EXTRACTION_END=="),
    "heading": ("Data Extraction:\n", ""),
    "bare": ("", ""),
}


def random_replies(count, seed):
    """Replies from broken to whole: one or two sections, each with pieces of some pool."""
    rng = random.Random(seed)

    def part():
        opening, closing = SECTIONS[rng.choice(list(SECTIONS))]
        pool = rng.choice([PIECES, ITEMS, FIELDS, ITEMS + PIECES, FIELDS + PIECES])
        body = "".join(rng.choices(pool, k=rng.randint(0, 14)))
        return opening + body + (closing if rng.random() < 0.85 else "")

    return [part() + (part() if rng.random() < 0.6 else "") for _ in range(count)]


def check(rows, schema=None):
    for row in rows:
        reply = row["response"]
        if not reply:
            continue
        wanted = expected.items(reply)
        assert row["qa_failed"] == (wanted is None), reply
        if wanted is not None:
            assert str([tuple(i) for i in row["qa_items"]]) == str(wanted), reply
            assert str(row["total_score"]) == str(sum((s for _, _, s in wanted), 0.0)), reply
        assert [tuple(f) for f in row["de_items"]] == expected.fields(reply), reply
        if schema:
            found = row["status"], row["reason"], row["excluded_by"]
            assert found == expected.decision(reply, schema), reply


@pytest.mark.parametrize("seed", range(4))
def test_random_replies(replies, schema, seed):
    rows = review_replies(replies(*random_replies(3000, seed)), schema)
    check(rows.collect(), schema)


def test_derived_replies(spark, schema):
    ids = samples.document_ids(spark, SMALL)
    rows = review_replies(samples.replies(ids).withColumn("has_text", F.lit(True)), schema)
    check(rows.collect(), schema)


@pytest.mark.parametrize(
    "derive", [samples.glued_replies, samples.loose_replies, samples.lone_titles, samples.title_fields]
)
def test_derived_variants(spark, derive):
    rows = derive(samples.document_ids(spark, SMALL))
    check(parse_extraction(parse_quality(rows)).collect())


@pytest.mark.parametrize("derive", [samples.quality_quotes, samples.field_quotes])
def test_whole_texts(spark, derive):
    rows = derive(samples.documents(spark, SMALL))
    check(parse_extraction(parse_quality(rows)).collect())


def test_whole_pages_and_texts_as_replies(spark):
    """Web pages and plain documents, which were never meant to be replies."""
    check(parse_extraction(parse_quality(samples.page_listings(spark, SMALL))).collect())
    texts = samples.documents(spark, SMALL).withColumnRenamed("text", "response")
    check(parse_extraction(parse_quality(texts)).collect())


def test_long_replies(replies):
    """Many ids without scores, and texts far longer than a usual reply."""
    ids = " ".join(f"QE{k}: note" for k in range(500))
    check(parse_extraction(parse_quality(replies(
        f"==QUALITY_ASSESSMENT_START=={ids} QE499_SCORE: 1==QUALITY_ASSESSMENT_END==",
        f"==QUALITY_ASSESSMENT_START=={ids} QE499_SCORE:+1==QUALITY_ASSESSMENT_END==",
        "==QUALITY_ASSESSMENT_START==QE1: " + "word " * 60000 + "QE1_SCORE: 1==QUALITY_ASSESSMENT_END==",
        "==DATA_EXTRACTION_START==TITLE: " + "WORD " * 2000 + "END==DATA_EXTRACTION_END==",
        "==DATA_EXTRACTION_START==TITLE: " + "word word\n" * 30000 + "YEAR: 1==DATA_EXTRACTION_END==",
    ))).collect())
