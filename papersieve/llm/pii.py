"""Personal data: fixed patterns, and bootstrapped contexts that find more of the same kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, stored

KINDS = ("email", "ip", "card", "phone")

# What each kind matches, leftmost and without overlap. Written so
# that Java needs no step back: a match starts at the start of a run, or where
# the last one ended (\G); runs of no use as a card are not matched at all.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TOKEN = r"A-Za-z0-9@._%+()-"
TOKEN = rf"(?<![{_TOKEN}])[A-Za-z._%+()-]*+[0-9@][{_TOKEN}]*+"
"""What may turn out to be personal data: a run of such characters with a digit or @."""
WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "token": "[0-9@]"}
"""Texts without this have no match."""

CONTEXT = 64
"""Characters before and after an instance that patterns are taken from."""
ROUNDS = 3
SUPPORT = 3
"""Different known instances that a pattern needs."""
CONFIDENCE = 0.8
"""Share of a pattern's instances, and score of an instance, that count as certain."""
FEWEST_DIGITS = 5
"""Digits, or an @, with which a value stands for the same thing in every context; with fewer, in its own alone."""
_BLANK = r"[ \u00a0\u2007\u202f]"
JOINT = rf"\A{_BLANK}(?:[A-Z]{{1,4}}{_BLANK})?\z"
"""What may stand between two tokens of one identifier: a blank, or a group of capitals (as in an IBAN) between two."""


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Each match with its number, the length of the gap before it, and what stands around it."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"))
    numbered = F.transform(F.arrays_zip(values.alias("value"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next")), lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("number"), m["value"].alias("value"),
        F.length(m["gap"]).alias("gap"),
        F.right(m["gap"], F.lit(CONTEXT)).alias("before"), F.left(m["next"], F.lit(CONTEXT)).alias("after"),
    ))
    return F.when(text.rlike(WORTH[kind]), F.filter(numbered, lambda m: m["value"].isNotNull()))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    figures = F.transform(F.reverse(F.split(_digits(value), "")), lambda d, i: (
        (d.cast("int") * (i % 2 + 1)) - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0)
    ))
    return F.aggregate(figures, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match counts; tokens always do here."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.length(_digits(value)).between(13, 19) & _luhn(value))
        .when(kind == "phone", F.length(_digits(value)).between(9, 15))
        .otherwise(True)
    )


def _instances(documents: DataFrame) -> DataFrame:
    """Matches of every distinct text: ``text_digest``, ``kind``, ``value``, ``name``, ``whole``, ``start``, ``end``, ``outer``, ``patterns``.

    Kind ``token`` stands for whatever might be personal data and overlaps no base
    match: tokens in a row that ``JOINT`` joins, as one value, and those of them
    that stand for something by themselves once more, with ``whole`` false and
    ``outer``, the start of the whole. Values of one ``name`` are taken as one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = documents.select(text.alias("text")).where(F.col("text").rlike("[0-9@]")).select(
        digest(F.col("text")).alias("text_digest"),
        F.explode(F.concat(*(
            F.coalesce(_matches(F.col("text"), kind, pattern), F.array().cast(_MATCHES))
            for kind, pattern in (*PATTERNS.items(), ("token", TOKEN))
        ))).alias("m"),
    ).select("text_digest", "m.*")
    found = found.groupBy("text_digest", "kind", "number").agg(
        *(F.first(c).alias(c) for c in ("value", "gap", "before", "after"))
    )  # equal texts have equal matches
    so_far = Window.partitionBy("text_digest", "kind").orderBy("number")
    size = F.length("value")
    found = found.withColumn("end", F.sum(F.col("gap") + size).over(so_far).cast("bigint"))
    found = found.withColumn("start", F.col("end") - size).where(_valid(F.col("kind"), F.col("value")))
    base = F.col("kind") != "token"
    # two running frames, one from each end: a frame up to the end of the text would be gone through for each row
    place = ("start", "end", "kind")
    forward, backward = (
        Window.partitionBy("text_digest").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for order in (place, [F.desc(c) for c in place])
    )
    reached = F.max(F.when(base, F.col("end"))).over(forward)
    coming = F.min(F.when(base, F.col("start"))).over(backward)
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    found = found.withColumn("free", free).where(base | F.col("free"))

    # tokens in a row become one; each base match stays by itself
    last = F.lag(F.struct("number", "value")).over(so_far)
    joined = (
        ~base & (last["number"] == F.col("number") - 1) & ~last["value"].endswith(".")
        & (F.col("gap") <= 6) & F.col("before").rlike(JOINT)
    )
    found = found.withColumn("joined", F.coalesce(joined, F.lit(False)))
    found = found.withColumn("run", F.count_if(~F.col("joined")).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.groupBy("text_digest", "kind", "run").agg(F.sort_array(F.collect_list(F.struct(
        "number", "value", "start", "end", "before", "after", F.when(F.col("joined"), F.col("before")).otherwise("").alias("joint"),
    ))).alias("m"))
    first, end = F.get("m", F.lit(0)), F.element_at("m", -1)
    whole = F.struct(
        F.lit(True).alias("whole"), F.array_join(F.transform("m", lambda t: F.concat(t["joint"], t["value"])), "").alias("value"),
        first["start"].alias("start"), end["end"].alias("end"), first["before"].alias("before"), end["after"].alias("after"),
    )
    inner = F.transform(F.filter("m", lambda t: _telling(t["value"])), lambda t: F.struct(
        F.lit(False).alias("whole"), *(t[c].alias(c) for c in ("value", "start", "end", "before", "after"))
    ))
    found = found.select("text_digest", "kind", first["start"].alias("outer"), F.inline(
        F.when(F.size("m") > 1, F.concat(F.array(whole), inner)).otherwise(F.array(whole))
    ))
    found = found.withColumn("patterns", F.array_compact(_patterns()))
    telling = base | _telling(F.col("value"))
    name = F.when(telling, F.col("value")).otherwise(F.array_join(F.concat(F.array("value"), F.col("patterns")), "\n"))
    return found.where(telling | (F.size("patterns") > 0)).select(
        "text_digest", "kind", "value", name.alias("name"), "whole", "start", "end", "outer", "patterns"
    )


def _telling(value: Column) -> Column:
    return value.contains("@") | (F.length(_digits(value)) >= FEWEST_DIGITS)


_MATCHES = "array<struct<kind:string,number:int,value:string,gap:int,before:string,after:string>>"


def _patterns() -> Column:
    """Patterns of ``before`` and ``after``; null where there are too few words."""
    before, after = (
        F.lower(F.regexp_replace(F.col(c), "[0-9]", "0")) for c in ("before", "after")
    )
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    one = F.regexp_extract(before, r"(\S+)\s*$", 1)
    right = F.regexp_extract(after, r"^\s*(\S+)", 1)
    return F.array(
        F.when(two != "", F.concat(F.regexp_replace(two, r"\s+", " "), F.lit(" _"))),
        F.when((one != "") & (right != ""), F.concat(one, F.lit(" _ "), right)),
    )


def _edges(instances: DataFrame) -> DataFrame:
    """Graph of patterns and instances: ``pattern``, ``value``, ``name``, ``whole``, ``known`` (kind of a base match, else null)."""
    known = F.when(F.col("kind") != "token", F.col("kind"))
    return instances.select(F.explode("patterns").alias("pattern"), "value", "name", "whole", known.alias("known")).distinct()


def discover(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Kinds of values that are no base match, by their names: ``name``, ``kind``, ``score``.

    In each round a pattern's confidence for a kind is the share of that kind
    among its different instances, and it counts with ``SUPPORT`` of them and
    ``CONFIDENCE``; a value's score is the chance that not all of its patterns err.
    Values that reach ``CONFIDENCE`` support patterns in the next round. Parts of
    a value are found as well, but neither support a pattern nor add to its size.
    """
    edges = stored(_edges(instances))
    sizes = edges.where("whole").groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    seeds = edges.where("known IS NOT NULL").select("pattern", "value", F.col("known").alias("kind"), F.lit(1.0).alias("score"))
    open_edges = edges.where("known IS NULL").select("pattern", "value", "name", "whole")
    scored = None
    for _ in range(rounds):
        support = seeds
        if scored is not None:
            found = open_edges.where("whole").join(scored, "name").groupBy("pattern", "value", "kind").agg(F.max("score").alias("score"))
            support = seeds.unionAll(found)
        rated = (
            support.groupBy("pattern", "kind").agg(F.sum("score").alias("weight"), F.countDistinct("value").alias("support"))
            .where(F.col("support") >= SUPPORT).join(sizes, "pattern")
            .select("pattern", "kind", F.least(F.col("weight") / F.col("n"), F.lit(0.999)).alias("confidence"))
            .where(F.col("confidence") >= CONFIDENCE)
        )
        votes = open_edges.join(rated, "pattern").select("pattern", "name", "kind", "confidence").distinct().groupBy("name", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")
        )
        best = votes.groupBy("name").agg(F.max(F.struct("score", "kind")).alias("b"))
        scored = stored(best.select("name", "b.kind", "b.score").where(F.col("score") >= CONFIDENCE))
    return scored


def spans(documents: DataFrame) -> DataFrame:
    """All spans of every distinct text: ``text_digest``, ``kind``, ``start``, ``end``, ``base``, ``value``, ``score``.

    Ends are exclusive, places count code points. Base matches have score 1;
    those discovered by context come on top. Null texts count as empty.
    """
    instances = stored(_instances(documents))
    base = instances.where("kind <> 'token'").select(
        "text_digest", "kind", "start", "end", F.lit(True).alias("base"), "value", F.lit(1.0).alias("score")
    )
    found = instances.where("kind = 'token'").drop("kind").join(discover(instances), "name")
    covered = F.max("whole").over(Window.partitionBy("text_digest", "outer"))
    more = found.withColumn("covered", covered).where(F.col("whole") | ~F.col("covered")).select(
        "text_digest", "kind", "start", "end", F.lit(False).alias("base"), "value", "score"
    )
    return base.unionAll(more)


def report(documents: DataFrame) -> DataFrame:
    """Spans of each of ``documents`` (``doc_id``, ``text``), a row per row: ``doc_id``, ``spans``.

    ``spans`` is an array of ``kind``, ``start``, ``end``, ``base``, by kind as in ``KINDS``, then start; empty without any.
    """
    place = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), list(enumerate(KINDS))[1:], F.when(F.col("kind") == KINDS[0], 0))
    kept = spans(documents).groupBy("text_digest").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base"))).alias("spans")
    )
    ids = documents.select("doc_id", digest(F.coalesce(F.col("text"), F.lit(""))).alias("text_digest"))
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string,base:boolean>>")
    return ids.join(kept, "text_digest", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each span replaced by its kind in brackets; overlapping spans become one.

    All columns are kept; ``n_chars`` is counted anew if present. Null texts stay null.
    """
    by_place = Window.partitionBy("text_digest").orderBy("start", "end", "kind")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans(documents).withColumn("new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(by_place))
    whole = parts.groupBy("text_digest", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind")
    )
    hidden = whole.groupBy(F.col("text_digest").alias("__hidden")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans")
    )
    mine = documents.withColumn("__digest", digest(F.col("text"))).join(
        hidden, F.col("__digest") == F.col("__hidden"), "left"
    )
    at = F.col("__spans")
    pieces = F.transform(at, lambda s, i: F.concat(
        F.substring(F.col("text"), F.coalesce(F.get(at, i - 1)["end"], F.lit(0)).cast("int") + 1,
                    (s["start"] - F.coalesce(F.get(at, i - 1)["end"], F.lit(0))).cast("int")),
        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
    ))
    rest = F.substring(F.col("text"), F.element_at(at, -1)["end"].cast("int") + 1, F.lit(2**31 - 1))
    text = F.when(at.isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    columns = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in documents.columns else {})
    return mine.withColumns(columns).drop("__digest", "__hidden", "__spans")
