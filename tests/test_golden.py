"""Replies with a known reading, one for each peculiarity of the rules."""

import math

import pytest

from papersieve.operators.parsing import parse_extraction, parse_quality
from papersieve.plans.review import review_replies
from papersieve.schema import ReviewSchema

QA = "==QUALITY_ASSESSMENT_START=={}==QUALITY_ASSESSMENT_END=="
DE = "==DATA_EXTRACTION_START=={}==DATA_EXTRACTION_END=="

WELL_FORMED = (
    "Here is the review.\n" + QA.format(
        "\nQE3: One language throughout.\nQE3_SCORE: 1\n\nQE1: Mostly tables.\nQE1_SCORE: 0.0\n"
        "QE10: Two typing errors. QE10_SCORE: .5\n"
    ) + "\n\n" + DE.format(
        "\nLANGUAGE: nb\nLINES OF TEXT: 40, of which 3 repeat\nTITLE: Rain on the fjord\n"
    )
)
ITEM_CASES = {
    "well formed": (
        WELL_FORMED,
        "marked",
        [("QE3", "One language throughout.", 1.0), ("QE1", "Mostly tables.", 0.0),
         ("QE10", "Two typing errors.", 0.5)],
    ),
    "no markers": (
        "QE1: Some words QE1_SCORE: 1.0", "unmarked", [("QE1", "Some words", 1.0)]
    ),
    "score is a word": (QA.format("QE1: a QE1_SCORE: N/A"), "positional", []),
    "one score is a word": (
        QA.format("QE1: a QE1_SCORE: N/A QE2: b QE2_SCORE: 1"), "marked", [("QE2", "b", 1.0)]
    ),
    "full stop after a score": (
        QA.format("QE1: a QE1_SCORE: 1.0. QE2: b QE2_SCORE: 1"), "marked", [("QE2", "b", 1.0)]
    ),
    "only a full stop": (QA.format("QE1: a QE1_SCORE: ."), "marked", []),
    "missing score takes the next": (
        "QE1: a QE2: b QE2_SCORE: 1", "unmarked", [("QE1", "a QE2: b", 1.0)]
    ),
    "marker counts as an id": (
        "QE1_SCORE: 1 QE2 Score 0.5", "unmarked", [("QE1", "_SCORE: 1", 0.5)]
    ),
    "repeated id": (
        QA.format("QE1: a QE1_SCORE: 1 QE1: b QE1_SCORE: 0"), "marked",
        [("QE1", "a", 1.0), ("QE1", "b", 0.0)],
    ),
    "signed scores": (
        QA.format(" QE1: a QE1_SCORE:+1 QE2: b QE2_SCORE:-1 "), "positional",
        [("QE1", "a", 1.0), ("QE2", "b", -1.0)],
    ),
    "signed score with a repeat": (
        QA.format("QE1: a QE1_SCORE:-1 QE1: b QE2: c"), "positional",
        [("QE1", "a", -1.0), ("QE1", "a", -1.0)],
    ),
    "underscore and exponent": (
        QA.format("QE1: a QE1_SCORE:-1_0 QE2: b QE2_SCORE:+1e1"), "positional",
        [("QE1", "a", -10.0), ("QE2", "b", 10.0)],
    ),
    "suffix that a cast would take": (QA.format("QE1: a QE1_SCORE:-1.0f"), "positional", []),
    "infinite": (
        QA.format("QE1: a QE1_SCORE:-Infinity"), "positional", [("QE1", "a", -math.inf)]
    ),
    "quotes and Unicode spaces": (
        QA.format('QE1:  "so" it \n\x1cQE1_SCORE:　 0.5'), "marked",
        [("QE1", "so it", 0.5)],
    ),
    "quotes around spaces": (
        QA.format('QE1: " a " QE1_SCORE: 1'), "marked", [("QE1", " a ", 1.0)]
    ),
    "other digits in an id": (
        QA.format("QE١: a QE١_SCORE: 1"), "marked", [("QE١", "a", 1.0)]
    ),
    "echoed template first": (
        QA.format("QE1: [text]\nQE1_SCORE: [score]\n") + QA.format("QE1: a QE1_SCORE: 1"),
        "positional", [],
    ),
    "no end marker": (
        "==QUALITY_ASSESSMENT_START==\nQE1: a\nQE1_SCORE: 1", "unmarked", [("QE1", "a", 1.0)]
    ),
    "end marker first": (
        "==QUALITY_ASSESSMENT_END==" + QA.format("QE1: a QE1_SCORE: 1"), "marked",
        [("QE1", "a", 1.0)],
    ),
    "empty section": (QA.format(""), "positional", []),
    "nothing but spaces": (" \n ", "unmarked", []),
}
FIELD_CASES = {
    "well formed": (
        WELL_FORMED,
        "marked",
        [("LANGUAGE", "nb"), ("LINES OF TEXT", "40, of which 3 repeat"),
         ("TITLE", "Rain on the fjord")],
    ),
    "empty value takes the next field": (
        DE.format("YEAR:\nTITLE: x"), "marked", [("YEAR", "TITLE: x")]
    ),
    "capitals at the end go to the next key": (
        DE.format("PUBLISHER: by IEEE\nYEAR: 2020"), "marked",
        [("PUBLISHER", "by"), ("IEEE\nYEAR", "2020")],
    ),
    "capitals alone stay": (
        DE.format("PUBLISHER: IEEE YEAR: 2020"), "marked",
        [("PUBLISHER", "IEEE"), ("YEAR", "2020")],
    ),
    "repeated field": (
        DE.format("YEAR: a\nYEAR: b"), "marked", [("YEAR", "a"), ("YEAR", "b")]
    ),
    "lower-case title cut at a word": (DE.format("Title: Foo bar"), "title", [("TITLE", "")]),
    "lower-case title without a word": (DE.format("Title: 3D"), "title", [("TITLE", "3D")]),
    "dotless letter": (DE.format("Tıtle: 3D"), "title", [("TITLE", "3D")]),
    "inside a longer word": (DE.format("subtitle: 7 x 9"), "title", [("TITLE", "7 x 9")]),
    "no key at all": (DE.format("nothing here"), "none", []),
    "empty section": (DE.format(" "), "none", []),
    "one letter is no key": (DE.format("A: b"), "none", []),
    "heading": (
        "x\nData Extraction:\n**Title**: \"Foo\"\nno pair\n: no key\nYEAR:2020\nYEAR: a: b\n\n\nAUTHOR: z",
        "unmarked", [("Title", "Foo"), ("YEAR", "2020"), ("YEAR", "a: b")],
    ),
    "stop phrase": (
        "Data Extraction\nYEAR: 1\nCutoff Score: 2\nSECTION 3: 4", "unmarked", [("YEAR", "1")]
    ),
    "no heading": ("TITLE: x", "unmarked", []),
    "no end marker": ("==DATA_EXTRACTION_START==\nTITLE: x", "unmarked", []),
}


def _same(found, wanted):
    return [tuple(row) for row in found] == wanted


@pytest.fixture(scope="module")
def read(spark):
    texts = [case[0] for case in [*ITEM_CASES.values(), *FIELD_CASES.values()]]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "response string")
    parsed = parse_extraction(parse_quality(rows)).collect()
    return {row["response"]: row for row in parsed}


@pytest.mark.parametrize("name", ITEM_CASES)
def test_items(read, name):
    reply, strategy, wanted = ITEM_CASES[name]
    row = read[reply]
    assert row["qa_strategy"] == strategy
    assert _same(row["qa_items"], wanted)
    assert row["total_score"] == sum((score for _, _, score in wanted), 0.0)
    assert row["qa_failed"] is False


@pytest.mark.parametrize("name", FIELD_CASES)
def test_fields(read, name):
    reply, strategy, wanted = FIELD_CASES[name]
    row = read[reply]
    assert row["de_strategy"] == strategy
    assert _same(row["de_items"], wanted)


def test_unreadable_score_fails_an_unmarked_reply(replies):
    row = parse_quality(replies("QE1: a QE1_SCORE: 1 QE2: b QE2_SCORE: 1.0.")).first()
    assert row["qa_failed"] is True
    assert row["qa_items"] is None and row["total_score"] is None


def test_no_reply_is_not_a_failure(replies):
    for row in parse_extraction(parse_quality(replies(None, ""))).collect():
        assert row["qa_failed"] is False
        assert row["qa_items"] is None and row["de_items"] is None
        assert row["qa_strategy"] is None and row["de_strategy"] is None


def test_other_id_pattern(replies):
    row = parse_quality(
        replies(QA.format("RQ-1: a RQ-1_SCORE: 1 QE1: b QE1_SCORE: 2")), id_pattern=r"RQ-[0-9]+"
    ).first()
    assert _same(row["qa_items"], [("RQ-1", "a", 1.0)])


def _decide(replies, schema, *texts):
    rows = review_replies(replies(*texts), schema).orderBy("doc_id").collect()
    return [(r["status"], r["reason"], r["excluded_by"]) for r in rows]


def test_repeated_id_columns_take_the_last_and_totals_take_all(replies, schema):
    reply = QA.format("QE1: a QE1_SCORE: 9 QE1: b QE1_SCORE: 0")
    row = review_replies(replies(reply), schema).first()
    assert row["total_score"] == 9.0
    assert (row["status"], row["reason"], row["excluded_by"]) == ("REJECTED", "EXCLUDED", "QE1")


def test_total_that_is_no_number_is_below_the_cutoff(replies, schema):
    reply = QA.format("QE2: a QE2_SCORE:nan")
    row = review_replies(replies(reply), schema).first()
    assert math.isnan(row["total_score"])
    assert (row["status"], row["reason"]) == ("REJECTED", "CUTOFF")


def test_zero_total_never_passes(replies, schema):
    low = ReviewSchema(schema.questions, schema.fields, (), -1)
    texts = [QA.format("QE2: a QE2_SCORE: 0"), QA.format("QE2: a QE2_SCORE:-0.5 QE3: c")]
    assert _decide(replies, low, *texts) == [
        ("REJECTED", "CUTOFF", None), ("ANALYSED", None, None)
    ]


def test_missing_score_does_not_exclude(replies, schema):
    reply = QA.format("QE2: a QE2_SCORE: 7")
    assert _decide(replies, schema, reply) == [("ANALYSED", None, None)]


def test_first_excluding_question_in_schema_order(replies, schema):
    reply = QA.format("QE8: a QE8_SCORE: 0 QE7: b QE7_SCORE: 0 QE1: c QE1_SCORE: 9")
    assert _decide(replies, schema, reply) == [("REJECTED", "EXCLUDED", "QE7")]


def test_excluding_question_outside_the_questions(replies, schema):
    wider = ReviewSchema(schema.questions, schema.fields, ("QE40",), 1)
    reply = QA.format("QE40: a QE40_SCORE: 0 QE2: b QE2_SCORE: 2")
    assert _decide(replies, wider, reply) == [("REJECTED", "EXCLUDED", "QE40")]


def test_titles(replies, schema):
    texts = [
        DE.format("TITLE: Found"), DE.format("Title: Foo bar"), "Data Extraction:\nTITLE:\nTitle: x",
        "Data Extraction\ntitle: low", "none",
    ]
    rows = review_replies(replies(*texts), schema).orderBy("doc_id").collect()
    assert [(r["title"], r["has_title"]) for r in rows] == [
        ("Found", True), ("doc_1", True), ("doc_2", True), ("low", False), ("doc_4", False)
    ]
