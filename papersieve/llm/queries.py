"""One query for each operator, over the whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.sources.storage import shared_folder

from . import (
    bpe, codes, decontaminate, fingerprints, hardneg, language, neardup, packing, pii, quality, rollups, sharding,
    toxicity, vectors,
)
from .common import digest, held_out, stored, table

QUALITY_CUT = quality.CUT
TOXICITY_CUT = 0.3


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = language.train(documents)
    found = documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), language.language(F.col("text"), model).alias("found")
    )
    return found.select("doc_id", "held_out", "found.*")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.report(table(spark, folder, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def n_of(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *(n_of(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_found"),
    )


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents")).withColumn("law", F.lit("key"))


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """``class_id`` is the least ``doc_id`` of the class, ``class_documents`` its size."""
    classes = stored(neardup.near_duplicates(table(spark, folder, "documents"), weighted=True))
    least = classes.where("class_digest IS NOT NULL").groupBy("class_digest").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n")
    )
    return classes.join(least, "class_digest", "left").select(
        "doc_id",
        F.when(F.col("class_digest").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("class_documents"),
    )


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality.train(documents, table(spark, folder, "labels"))
    score = quality.quality(F.col("text"), model)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= QUALITY_CUT).cast("int")
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    score = toxicity.toxicity(F.col("text"), model)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= TOXICITY_CUT).cast("int")
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after three batches: all documents; copies deleted; licence lines cut out of what is left.

    The deletion is sent twice and counts once.
    """
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    licence = r"(?m)^Licensed under .*$\n?"
    cut = F.regexp_replace("text", licence, "")

    def counted(rows: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        both = rows.select(
            "doc_id", "source", "lang", digest(F.col("text")).alias("text_digest"),
            F.octet_length(text).cast("bigint").alias("bytes"),
            F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint").alias("words"),
            rollups.count_tokens(F.col("text")).alias("ids"),
        )
        versions = F.array(*(F.struct(F.lit(n).alias("tokenizer"), F.col(c).alias("tokens")) for n, c in (("word_bpe_49k", "ids"), ("white_space", "words"))))
        return both.select("doc_id", "source", "lang", "text_digest", "bytes", F.inline(versions))

    inserted = stored(counted(documents))
    # the least doc_id of each text stays; a null text is no copy of anything
    first = inserted.groupBy("text_digest").agg(F.min("doc_id").alias("first"))
    copies = inserted.join(first, "text_digest").where("doc_id > first")
    revised = documents.withColumn("new", cut).where("new <> text").withColumn("text_digest", digest(F.col("text")))
    revised = stored(
        revised.join(first, "text_digest").where("doc_id = first").select("doc_id", "source", "lang", "text", "new")
    )
    before = counted(revised)
    after = counted(revised.select("doc_id", "source", "lang", F.col("new").alias("text")))

    rollup = rollups.Rollup(spark, f"{shared_folder(spark)}/rollups/{uuid.uuid4().hex}")
    rollup.commit("insert", rollups.deltas(None, inserted))
    rollup.commit("delete-copies", rollups.deltas(copies, None))
    rollup.commit("cut-licences", rollups.deltas(before, after))
    rollup.commit("delete-copies", rollups.deltas(copies, None))
    return rollup.totals()


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.size("hit_words").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are rows whose ``vec_id`` is divisible by 50; every seventh row has the label of another class."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").where(F.col("label").isNotNull() & vectors.usable("embedding"))
    whole = vectors.whole_numbers("embedding", 256)
    return hardneg.hard_negatives(
        rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(vectors.usable("embedding"))
    whole = stored(rows.select("vec_id", "label", vectors.whole_numbers("embedding", 4096).alias("vector")))
    books = codes.train(whole)
    found = stored(codes.compress(whole, books))
    return codes.with_group_total(found, "label", "error", "label_error").select(
        "vec_id",
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"),
    )


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.round_trip(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and callable(query)
}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes_sql() -> str:
    """Lloyd's rounds as one chain of common table expressions."""
    width = "len(v) // 8"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {_whole(4096)} AS v FROM embeddings WHERE {_FINITE})",
        "positions AS (SELECT unnest(range(8)) AS p)",
        f"parts AS MATERIALIZED (SELECT r, p, v[p * ({width}) + 1 : (p + 1) * ({width})] AS x FROM kept, positions)",
        "books0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16)",
    ]
    for i in range(7):
        steps.append(
            f"""near{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d
            FROM (SELECT r, p, x, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                  FROM parts JOIN books{i} USING (p)) GROUP BY r, p)"""
        )
        if i < 6:
            steps.append(
                f"""means{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (
                SELECT p, e, j, CAST(floor(sum(y) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
                FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM near{i}) GROUP BY p, e, j) GROUP BY p, e),
                books{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM books{i} b LEFT JOIN means{i} m USING (p, e))"""
            )
    steps.append(
        """coded AS (SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
        FROM near6 GROUP BY r)"""
    )
    steps.append("digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books6)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


ORACLES = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
           FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM starts),
lengths AS (SELECT DISTINCT l FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
texts AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM places, lengths WHERE i + l - 1 <= len(w)),
hits AS (SELECT doc_id, i, l, item_id FROM texts JOIN windows USING (l, s)),
inside AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_hard_negatives": f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              {_whole(256)} AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM kept a JOIN kept b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
              row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM scored WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, n ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.r = s.r AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY "rank" <= 3""",
    "op12_vector_codes": _codes_sql(),
}
