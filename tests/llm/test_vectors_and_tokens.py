"""Hard negatives, vector codes and byte-pair encoding against brute force and the library, and on odd input."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersieve.llm import bpe, codes, hardneg, tokens, vectors
from papersieve.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, row string"


def clustered(count, size=8, seed=3):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(10)]
    return [
        (i, [c + draw.gauss(0, 0.6) for c in centres[i * 7 % 10]], i * 7 % 10) for i in range(count)
    ]


@pytest.fixture(scope="module")
def odd_vectors():
    rows = clustered(300)
    rows += [(i, list(v), label) for i, v, label in rows[:60:7]]  # repeated rows
    rows += [(50, [0.5] * 8, 3), (100, [-0.5] * 8, 3), (None, [0.4] * 8, 3), (None, None, 3), (400, None, 1)]
    rows += [(401, [0.1] * 8, None), (402, [NAN] + [0.1] * 7, 1), (403, [INF] * 8, 2), (404, [None] * 8, 2)]
    rows += [(450, [0.9, 0.9], 4), (500, [], 5), (501, [0.0] * 8, 5)]  # shorter ones, and no length at all
    return [(i, v, label, "a", "b", "c") for i, v, label in rows]


@pytest.fixture(scope="module")
def vector_folder(spark, odd_vectors, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(odd_vectors, SCHEMA).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def finite(row):
    return row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def integers(row, scale):
    return [math.floor(scale * float(np.float32(x))) for x in row[1]]


def ordered(rows):
    return sorted(rows, key=repr)


def mined(rows):
    kept = [(r[0], integers(r, 256), r[2]) for r in rows if finite(r) and r[2] is not None]
    kept = [(i, v, (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in kept]
    out = []
    for a, (anchor, u, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scores = sorted(
            (-sum(x * y for x, y in zip(u, v, strict=False)), i is None, i, c != label)
            for b, (i, v, c) in enumerate(kept) if b != a
        )
        for minus, _, positive, _ in [s for s in scores if not s[3]][:5]:
            hard = [s for s in scores if s[3] and -50 * minus <= -100 * s[0] <= -95 * minus][:3]
            out += [(anchor, positive, n + 1, s[2], -minus, -s[0]) for n, s in enumerate(hard)]
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_odd_rows(spark, odd_vectors, vector_folder):
    found = QUERIES["op11_hard_negatives"](spark, vector_folder)
    wanted = mined(odd_vectors)
    assert ordered(tuple(r) for r in found.select(COLUMNS).collect()) == ordered(wanted) and len(wanted) > 50


def test_blocks_do_not_change_hard_negatives(spark, odd_vectors, vector_folder):
    rows = spark.read.parquet(f"{vector_folder}/embeddings.parquet").where(
        F.col("label").isNotNull() & vectors.usable("embedding")
    )
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", label.alias("label"), vectors.whole_numbers("embedding", 256).alias("vector"))
    for block in (3, 40):
        found = hardneg.hard_negatives(whole, F.col("vec_id") % 50 == 0, block=block).select(COLUMNS)
        assert ordered(tuple(r) for r in found.collect()) == ordered(mined(odd_vectors))
    assert hardneg.hard_negatives(whole, F.lit(False)).count() == 0
    assert hardneg.hard_negatives(whole.limit(0), F.col("vec_id") == 0).count() == 0
    assert hardneg.hard_negatives(whole.where("label = 3"), F.lit(True)).count() == 0


def test_windows_of_scores():
    for score in range(-300, 300):
        low, high = hardneg.window(score)
        inside = [n for n in range(-400, 400) if 50 * score <= 100 * n <= 95 * score]
        assert inside == list(range(low, high + 1))


def test_products_are_exact():
    draw = random.Random(5)
    for size in (10, 1 << 20, 1 << 28):
        a, b = ([[draw.randint(-size, size) for _ in range(6)] for _ in range(4)] for _ in range(2))
        wanted = [[sum(x * y for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        found = vectors.products(np.array(a), np.array(b))
        assert [[int(x) for x in row] for row in found] == wanted
    with pytest.raises(OverflowError):
        vectors.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def coded(rows, parts=8, entries=16, rounds=6):
    kept = [(r[0], integers(r, 4096), r[2]) for r in rows if finite(r)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), c) for i, v, c in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = [near(p, c[p])[1] for c in cut]
            for e in range(len(books[p])):
                held = [c[p] for c, m in zip(cut, mine, strict=True) if m == e]
                if held:
                    books[p][e] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return [(i, code, error, totals[label], sha) for i, label, code, error in out]


def test_vector_codes_of_odd_rows(spark, odd_vectors, vector_folder, monkeypatch):
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = QUERIES["op12_vector_codes"](spark, vector_folder).select(columns)
    wanted = ordered(coded(odd_vectors))
    assert ordered(tuple(r) for r in found.collect()) == wanted
    monkeypatch.setattr(codes, "GROUPS", 0)  # totals that are not broadcast
    found = QUERIES["op12_vector_codes"](spark, vector_folder).select(columns)
    assert ordered(tuple(r) for r in found.collect()) == wanted


def test_few_and_no_vectors(spark, tmp_path):
    rows = [(i, [0.1 * i, 0.2, 0.3], 1, "", "", "") for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/few/embeddings.parquet")
    found = QUERIES["op12_vector_codes"](spark, f"{tmp_path}/few").select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256"
    )
    assert ordered(tuple(r) for r in found.collect()) == ordered(coded(rows))
    for name, left in (("none", rows[:0]), ("nulls", [(1, None, 1, "", "", "")]), ("blank", [(1, [], 1, "", "", "")])):
        spark.createDataFrame(left, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        kept = 1 if name == "blank" else 0
        assert QUERIES["op12_vector_codes"](spark, f"{tmp_path}/{name}").count() == kept
        assert QUERIES["op11_hard_negatives"](spark, f"{tmp_path}/{name}").count() == 0
    with pytest.raises(OverflowError):
        codes.train(spark.createDataFrame([(1, [1 << 40])], "vec_id bigint, vector array<bigint>"))


def test_a_walk_in_any_order_gives_all_distances():
    draw = np.random.default_rng(1)
    entries = draw.integers(-50, 50, (16, 5))
    parts = draw.integers(-3, 3, (5000, 5))
    wanted = ((parts[:, None] - entries) ** 2).sum(2)
    order = np.lexsort(parts.T[::-1])
    walk = codes.Walk(entries)
    found = [walk.distances(parts[order[i : i + 777]]) for i in range(0, 5000, 777)]
    assert (np.concatenate(found) == wanted[order]).all()
    assert (codes.Walk(entries).distances(parts) == wanted).all()


def test_the_path_is_carried_from_run_to_run():
    parts = np.array([[7, 7, 7, i] for i in range(100)])
    walk = codes.Walk(np.zeros((2, 4), np.int64))
    walk.distances(parts[:50])
    path = walk._path.copy()
    walk.distances(parts[50:])
    assert (walk._path[:4] == path[:4]).all() and (walk._path[4] != path[4]).all()


def test_vector_sql(spark):
    import duckdb

    database = duckdb.connect()
    database.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    for name in ("op11_hard_negatives", "op12_vector_codes"):
        wanted = database.execute(ORACLES[name]).df()
        found = QUERIES[name](spark, SMALL).toPandas()[list(wanted.columns)]
        order = list(wanted.columns)
        assert len(found) == len(wanted) > 0
        assert (found.sort_values(order, ignore_index=True) == wanted.sort_values(order, ignore_index=True)).all(axis=None)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


SIGNS = "abcdefgh etaoin THE 'S's'll 09½٣.,;:-_#@\n\t\x1c\x1f\x85\xa0　​éÉßẞİıΣσςŁ日本語한글😀́̈"


def test_ids_and_texts_are_the_librarys(spark, library):
    draw = random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(draw.randrange(0x20, 0xD7FF)) for _ in range(20)) for _ in range(300)]
    texts += ["", " ", None, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|<|endoftext|>", "x" * 5000]
    texts += ["ab" * 100_000, "word " * 50_000, "ΑΣ ΑΣΑ", "don't DON'T 'tis", "é e ́", "\U0003fc3a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    ids = bpe.encode(F.col("text"))
    found = {r.doc_id: r for r in rows.select("doc_id", ids.alias("ids")).select("*", bpe.decode(F.col("ids")).alias("back")).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert list(found[i].ids) == wanted, repr(text)[:80]
        assert found[i].back == library.decode(wanted, skip_special_tokens=False)


def test_merging_takes_the_lowest_rank_first():
    draw = random.Random(2)
    for _ in range(400):
        ranks, size = {}, 6
        for _ in range(12):
            pair = draw.randrange(size), draw.randrange(size)
            if pair not in ranks:
                ranks[pair], size = (len(ranks), size), size + 1
        symbols = wanted = [draw.randrange(6) for _ in range(draw.randint(0, 30))]
        while pairs := [(ranks[p][0], i) for i, p in enumerate(zip(wanted, wanted[1:], strict=False)) if p in ranks]:
            _, i = min(pairs)
            wanted = [*wanted[:i], ranks[wanted[i], wanted[i + 1]][1], *wanted[i + 2 :]]
        merges = bpe.Merges(list(ranks), [new for _, new in ranks.values()])
        assert bpe.merge(symbols, merges.ranks, merges.merged) == wanted
        together, sizes = merges.side_by_side(np.array([*symbols, 0, 1, *symbols]), np.array([len(symbols), 0, 2, len(symbols)]))
        assert together[: sizes[0]].tolist() == wanted and sizes[0] == len(wanted) and sizes[1] == 0
        assert together[len(together) - sizes[3] :].tolist() == wanted


def test_bpe_query_and_odd_ids(spark, library, tmp_path):
    rows = [(1, None, "x"), (1, "One two", "y"), (1, "One two", "y"), (None, "", None), (2, "long " * 30_000, "z")]
    spark.createDataFrame(rows, "doc_id bigint, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_bpe"](spark, str(tmp_path)).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    wanted = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(back)))
    assert ordered(tuple(r) for r in found) == ordered(wanted)
    lists = spark.createDataFrame([(None,), ([],), ([320, 99_999, -1, 49407],)], "ids array<int>")
    texts = [r.t for r in lists.select(bpe.decode(F.col("ids")).alias("t")).collect()]
    assert texts == [None, "", library.decode([320, 49407], skip_special_tokens=False)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert empty.select(bpe.encode(F.col("text"))).count() == 0
