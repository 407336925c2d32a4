"""Parsing takes time in proportion to the reply, whatever the reply looks like."""

import time

import pytest

from papersieve.operators.parsing import parse_extraction, parse_quality

REPLIES = {
    "unmarked ids and the word": (parse_quality, "QE7: words and more Score so far ", "{}"),
    "unmarked ids after a score": (parse_quality, "QE7: words and more ", "QE1: a QE1_SCORE: 1 {}"),
    "marked ids without a score": (
        parse_quality, "QE7: words and more ", "==QUALITY_ASSESSMENT_START=={}QE1: a QE1_SCORE: 1==QUALITY_ASSESSMENT_END=="
    ),
    "marked ids after their score": (
        parse_quality, "QE1: words QE1: more ",
        "==QUALITY_ASSESSMENT_START==QE1: a QE1_SCORE: 1 {}QE2: b QE2_SCORE: 1==QUALITY_ASSESSMENT_END=="
    ),
    "many marked items": (parse_quality, "QE7: words QE7_SCORE: 1\n", "==QUALITY_ASSESSMENT_START=={}==QUALITY_ASSESSMENT_END=="),
    "ids with words for scores": (
        parse_quality, "QE7: words QE7_SCORE: high ", "==QUALITY_ASSESSMENT_START=={}==QUALITY_ASSESSMENT_END=="
    ),
    "ids with signed scores": (
        parse_quality, "QE7: words and more QE8: text ", "==QUALITY_ASSESSMENT_START=={}QE8_SCORE:+1 ==QUALITY_ASSESSMENT_END=="
    ),
    "different ids with words for scores": (parse_quality, "QE{n}: words QE{n}_SCORE: high ", "==QUALITY_ASSESSMENT_START=={}==QUALITY_ASSESSMENT_END=="),
    "different ids without scores": (
        parse_quality, "QE{n}: words and more ", "==QUALITY_ASSESSMENT_START=={}QE1: a QE1_SCORE: 1==QUALITY_ASSESSMENT_END=="
    ),
    "capitals without a key": (
        parse_extraction, "ALL OF IT ", "==DATA_EXTRACTION_START==YEAR: 1 {}==DATA_EXTRACTION_END=="
    ),
}


@pytest.mark.parametrize("name", REPLIES)
def test_long_replies_end_in_seconds(spark, name):
    parse, unit, frame = REPLIES[name]
    reply = frame.format("".join(unit.replace("{n}", str(n)) for n in range(300_000 // len(unit))))
    parse(spark.createDataFrame([(1, frame)], "doc_id long, response string")).collect()  # the first plan takes its time
    began = time.monotonic()
    rows = parse(spark.createDataFrame([(1, reply)], "doc_id long, response string")).collect()
    assert len(rows) == 1
    assert time.monotonic() - began < 20
