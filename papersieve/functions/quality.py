"""Column expressions that read scored question items out of a reply.

An item is ``STRUCT<qid, descr, score>``; items keep the order of the reply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions.arrays import bound, scan
from papersieve.functions.text import number, section, strip


def qa_section(response: Column) -> Column:
    return section(response, fv.QA_START, fv.QA_END)


def _item(qid: Column, descr: Column, score: Column) -> Column:
    clean = F.replace(strip(descr), F.lit('"'), F.lit(""))
    return F.struct(qid.alias("qid"), clean.alias("descr"), score.alias("score"))


def _up_to_last(text: Column, marker: str) -> Column:
    """``text`` up to the end of its last ``marker``; empty where it holds none.

    No match can end later, and an id behind it would search to the end in vain.
    """
    return F.regexp_extract(text, f"(?s)^.*{marker}", 0)


def _scored(items: Column) -> Column:
    return F.filter(items, lambda item: item["score"].isNotNull())


def _tokens(text: Column, id_pattern: str, score: str) -> Column:
    """``STRUCT<tokens, gaps>``: the marks of a text as they stand there, and the texts around them.

    A mark is an id with a colon, or with the suffix of its score and what ``score``
    matches behind it. One pass finds the marks, another what lies between, so
    the text is never searched again from an id. ``gaps`` has one element more.
    """
    pattern = rf"(?:{id_pattern})(?::|{fv.SCORE_SUFFIX}:{score})"
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(tokens.alias("tokens"), F.split(text, pattern, -1).alias("gaps"))


def _marks(found: Column) -> Column:
    """``STRUCT<marks, gaps>`` of tokens: ids in order, as ``STRUCT<qid, at, scores, shown>``, and the texts around them."""
    def mark(token: Column, at: Column) -> Column:
        # neither an id nor a score holds a colon
        qid = F.substring_index(token, ":", 1)
        scores = F.endswith(qid, F.lit(fv.SCORE_SUFFIX))
        return F.struct(
            F.when(scores, F.substring_index(qid, fv.SCORE_SUFFIX, 1)).otherwise(qid).alias("qid"),
            at.alias("at"), scores.alias("scores"), token.alias("shown"),
        )

    return F.struct(F.transform(found["tokens"], mark).alias("marks"), found["gaps"].alias("gaps"))


def _between(found: Column, first: Column, last: Column) -> Column:
    """The text between two marks, marks on the way included."""
    inner = F.transform(
        F.sequence(first + 1, last - 1),
        lambda at: F.concat(F.get(found["gaps"], at), F.get(found["marks"], at)["shown"]),
    )
    closing = F.get(found["gaps"], last)
    return F.when(last - first == 1, closing).otherwise(F.concat(F.array_join(inner, ""), closing))


def _marks_in_order(marks: Column) -> Column:
    return F.sort_array(
        F.transform(marks, lambda m: F.struct(m["qid"].alias("qid"), m["at"].alias("at"), m["scores"].alias("scores")))
    )


def _own_scores(marks: Column) -> Column:
    """``STRUCT<start, end>``: for each id with a later score of its own, the places of both, in order.

    Marks sorted by id hold an id's marks together; read backwards, the score
    that was seen last is the next one.
    """
    pairs = scan(
        F.reverse(_marks_in_order(marks)),
        F.struct(F.lit("").alias("qid"), F.lit(-1).alias("end")),
        lambda seen, m: F.when(m["scores"], F.struct(m["qid"].alias("qid"), m["at"].alias("end"))).otherwise(seen),
        lambda seen, m: F.when(
            ~m["scores"] & (seen["end"] >= 0) & (seen["qid"] == m["qid"]),
            F.struct(m["at"].alias("start"), seen["end"].alias("end")),
        ),
        "struct<start:int,end:int>",
    )
    return F.sort_array(pairs)


def _pairs(tokens: Column) -> Column:
    """Numbers of the pairs of tokens, from 0."""
    return F.sequence(F.lit(0), F.shiftright(F.size(tokens), 1) - 1)


def _id_of_pair(tokens: Column, at: Column) -> Column:
    return F.substring_index(F.get(tokens, at * 2), ":", 1)


def _in_turn(tokens: Column) -> Column:
    """Whether each id is followed by its own score at once, and nothing else is there; false without marks."""
    def own(at: Column) -> Column:
        qid = _id_of_pair(tokens, at)
        score = F.concat(qid, F.lit(f"{fv.SCORE_SUFFIX}:"))
        return ~F.contains(qid, F.lit(fv.SCORE_SUFFIX)) & F.startswith(F.get(tokens, at * 2 + 1), score)

    return (F.size(tokens) >= 2) & (F.size(tokens) % 2 == 0) & F.forall(_pairs(tokens), own)


def marked_matches(text: Column, id_pattern: str = fv.QUESTION_ID) -> Column:
    """Spans from an id to the nearest score that carries the same id: ``STRUCT<qid, descr, shown>``.

    A span opens with the first id that has a score of its own behind it, and the
    next one opens behind that score. Linear but for sorting the marks, whatever
    ids lack a score; where ids and their scores take turns, as they should, each pair is a span
    and nothing is sorted. ``id_pattern`` must hold no capturing group and match no
    colon, and no id may overlap another.
    """
    def spans(found: Column) -> Column:
        chosen = scan(
            _own_scores(found["marks"]),
            F.lit(-1),
            lambda end, pair: F.when(pair["start"] > end, pair["end"]).otherwise(end),
            lambda end, pair: F.when(pair["start"] > end, pair),
            "struct<start:int,end:int>",
        )
        return F.transform(
            chosen,
            lambda pair: F.struct(
                F.get(found["marks"], pair["start"])["qid"].alias("qid"),
                _between(found, pair["start"], pair["end"]).alias("descr"),
                F.substring_index(F.get(found["marks"], pair["end"])["shown"], ":", -1).alias("shown"),
            ),
        )

    def in_turn(found: Column) -> Column:
        return F.transform(
            _pairs(found["tokens"]),
            lambda at: F.struct(
                _id_of_pair(found["tokens"], at).alias("qid"),
                F.get(found["gaps"], at * 2 + 1).alias("descr"),
                F.substring_index(F.get(found["tokens"], at * 2 + 1), ":", -1).alias("shown"),
            ),
        )

    return bound(
        _tokens(text, id_pattern, rf"{fv.SPACE}*+[0-9.]++"),
        lambda found: F.when(_in_turn(found["tokens"]), in_turn(found)).otherwise(bound(_marks(found), spans)),
    )


def marked_items(matches: Column) -> Column:
    """Items of marked spans; one whose score is no number is left out."""
    return _scored(
        F.transform(matches, lambda m: _item(m["qid"], m["descr"], strip(m["shown"]).try_cast("double")))
    )


def _first_scores(marks: Column) -> Column:
    """``STRUCT<qid, start, end>``: of each id, its first mention and the first score of its own behind that."""
    def state(qid: Column, at: Column, done: bool) -> Column:
        return F.struct(qid.alias("qid"), at.alias("at"), F.lit(done).alias("done"))

    return scan(
        _marks_in_order(marks),
        state(F.lit(""), F.lit(-1), True),
        lambda seen, m: F.when(m["qid"] == seen["qid"], F.when(m["scores"], state(seen["qid"], seen["at"], True)).otherwise(seen))
        .when(m["scores"], seen).otherwise(state(m["qid"], m["at"], False)),
        lambda seen, m: F.when(
            m["scores"] & (m["qid"] == seen["qid"]) & ~seen["done"],
            F.struct(m["qid"].alias("qid"), seen["at"].alias("start"), m["at"].alias("end")),
        ),
        "struct<qid:string,start:int,end:int>",
    )


def _next_others(marks: Column) -> Column:
    """For each mark, the place of the first later mention of another id than the one mentioned there."""
    def state(qid: Column, at: Column, other: Column) -> Column:
        return F.struct(qid.alias("qid"), at.cast("int").alias("at"), other.cast("int").alias("beyond"))

    def other(seen: Column, m: Column) -> Column:
        return F.when(m["qid"] == seen["qid"], seen["beyond"]).otherwise(seen["at"])

    backwards = scan(
        F.reverse(marks),
        state(F.lit(""), F.lit(None), F.lit(None)),
        lambda seen, m: F.when(m["scores"], seen).otherwise(state(m["qid"], m["at"], other(seen, m))),
        lambda seen, m: F.struct(other(seen, m).alias("beyond")),
        "struct<beyond:int>",
    )
    return F.reverse(backwards)


def positional_items(text: Column, id_pattern: str = fv.QUESTION_ID) -> Column:
    """Items located by the position of their markers, for scores of other shapes.

    Each mention of an id stands for the id's first occurrence, so an id that
    is mentioned twice yields its item twice. An answer ends at the id's score, or
    before that where another id is mentioned; a score ends at a blank. Ids as
    for ``marked_matches``, and linear like that.
    """
    def answered(found: Column) -> Column:
        """``STRUCT<qid, item>`` of each id with a score that is a number."""
        def item(pair: Column) -> Column:
            behind = F.get(found["gaps"], pair["end"] + 1)
            # without a blank a score runs into the next mark, so that it is no number
            ends = F.contains(behind, F.lit(" ")) | (pair["end"] + 2 == F.size(found["gaps"]))
            score = number(F.when(ends, F.substring_index(behind, " ", 1)))
            stop = F.least(pair["end"], F.get(found["beyond"], pair["start"])["beyond"])
            descr = F.when(score.isNotNull(), _between(found, pair["start"], stop))
            return F.struct(pair["qid"].alias("qid"), _item(pair["qid"], descr, score).alias("item"))

        return F.filter(F.transform(_first_scores(found["marks"]), item), lambda known: known["item"]["score"].isNotNull())

    def mentioned(found: Column) -> Column:
        """The items of all mentions, in their order."""
        shape = "struct<qid:string,descr:string,score:double>"
        known = F.transform(
            answered(found), lambda k: F.struct(k["qid"].alias("qid"), F.lit(-1).alias("at"), k["item"].alias("item"))
        )
        mentions = F.transform(
            F.filter(found["marks"], lambda m: ~m["scores"]),
            lambda m: F.struct(m["qid"].alias("qid"), m["at"].alias("at"), F.lit(None).cast(shape).alias("item")),
        )
        items = scan(
            F.sort_array(F.concat(known, mentions)),  # an item comes before the mentions of its id
            F.struct(F.lit("").alias("qid"), F.lit(None).cast(shape).alias("item")),
            lambda seen, e: F.when(e["at"] < 0, F.struct(e["qid"].alias("qid"), e["item"].alias("item"))).otherwise(seen),
            lambda seen, e: F.when(
                (e["at"] >= 0) & (e["qid"] == seen["qid"]), F.struct(e["at"].alias("at"), seen["item"].alias("item"))
            ),
            f"struct<at:int,item:{shape}>",
        )
        return F.transform(F.sort_array(items), lambda e: e["item"])

    with_others = bound(
        bound(_tokens(text, id_pattern, ""), _marks),
        lambda found: F.struct(
            found["marks"].alias("marks"), found["gaps"].alias("gaps"), _next_others(found["marks"]).alias("beyond")
        ),
    )
    return bound(with_others, mentioned)


def unmarked_items(response: Column, id_pattern: str = fv.QUESTION_ID) -> Column:
    """Items of a reply without section markers; an unreadable score stays NULL.

    The score marker may carry any id, not just that of the item it closes.
    """
    marker = (
        rf"(?:{id_pattern})(?:{fv.SPACE}*Score|{fv.SCORE_SUFFIX})[:.]?{fv.SPACE}*"
    )
    pattern = rf"(?s)({id_pattern})[:.]?(.*?){marker}([0-9.]+)"
    # Any score closes any id, so before the last one every search succeeds.
    searched = _up_to_last(response, marker + "[0-9.]+")
    spans = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    # neither an id nor a score holds a colon
    parts = F.transform(
        spans, lambda span: F.split(F.regexp_replace(span, pattern, "$1:$3:$2"), ":", 3)
    )
    return F.transform(
        parts,
        lambda part: _item(F.get(part, 0), F.get(part, 2), F.get(part, 1).try_cast("double")),
    )


def total_score(items: Column) -> Column:
    """Sum over every item in order, repeated and unknown ids included."""
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + item["score"])
