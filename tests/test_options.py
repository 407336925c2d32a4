"""Options beyond the default reading of replies."""

import time

from catalogue.sample_schema import SCHEMA
from papersieve import fixed_values as fv
from papersieve.operators.inference import CALLS_A_GROUP, call_model
from papersieve.operators.parsing import check_items, parse_extraction, parse_quality


def fields(replies, text, keys):
    parsed = parse_extraction(replies(f"{fv.DE_START}{text}{fv.DE_END}"), keys=keys)
    return [tuple(item) for item in parsed.first()["de_items"]]


def test_capitals_stay_in_the_value_with_strict_keys(replies):
    text = "\nSOURCE: read at IEEE\nYEAR: 2020 NOTE: x\nVISION SYSTEM: YEAR:\n"
    assert fields(replies, text, None)[1][0] == "IEEE\nYEAR"
    strict = [("SOURCE", "read at IEEE"), ("YEAR", "2020 NOTE: x"), ("VISION SYSTEM", ""), ("YEAR", "")]
    assert fields(replies, text, SCHEMA.field_keys) == strict
    assert fields(replies, "\nMYYEAR: 1\n", SCHEMA.field_keys) == []
    assert fields(replies, "\nYEAR: 1\n", []) == []


def test_strict_keys_in_a_long_section(replies):
    text = "\n" + "YEAR: A B C " * 20_000
    began = time.monotonic()
    assert len(fields(replies, text, SCHEMA.field_keys)) == 20_000
    assert time.monotonic() - began < 20


def test_unknown_ids_and_scores_outside_the_list(replies):
    def reply(*scores):
        lines = "".join(f"{qid}: said\n{qid}_SCORE: {score}\n" for qid, score in scores)
        return f"{fv.QA_START}\n{lines}{fv.QA_END}"

    rows = replies(
        reply(("QE1", 0.5), ("QE9", 7.0), ("QE10", 1.0), ("QE9", 1.0)), reply(("QE2", 0.5)), None
    )
    found = check_items(parse_quality(rows), SCHEMA).orderBy("doc_id").collect()
    assert [r["unknown_ids"] for r in found] == [["QE9", "QE10"], [], None]
    assert [r["score_in_range"] for r in found] == [True, False, None]


def test_calls_are_handed_on_in_small_groups(spark):
    n = 2 * CALLS_A_GROUP + 1
    sent = spark.range(n).selectExpr("id AS doc_id", "CAST(id AS STRING) AS payload").coalesce(1)
    rows = call_model(sent, lambda payload: (200, None, payload)).collect()
    assert sorted(int(r["body"]) for r in rows) == list(range(n))
