"""Near-duplicates in groups of many near copies: the classes of all pairs, at about one comparison each."""

import collections
import re

import numpy as np
import pytest

from papersieve.llm import neardup


def shingled(text, weighted):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    starts = range(max(len(words) - 4, 1)) if words else ()
    found = collections.Counter(tuple(words[i : i + 5]) for i in starts)
    return found if weighted else collections.Counter(dict.fromkeys(found, 1))


def classes(texts, weighted):
    """The least member of each text's class, by comparing all pairs."""
    owner = list(range(len(texts)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    bags = [shingled(t, weighted) for t in texts]
    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            total = sum(a.values()) + sum(bags[j].values()) - both
            if texts[i] == texts[j] or (total and both / total >= 0.8):
                x, y = sorted((root(i), root(j)))
                owner[y] = x
    return [root(i) for i in range(len(texts))]


def planted(seed=6):
    """Near copies with few and many changes, texts that share a passage, repeated lines, copies, odd ones."""
    draw = np.random.default_rng(seed)

    def words(n):
        return ["".join(draw.choice(list("abcdefghij"), 5)) for _ in range(n)]

    base, passage, line = words(150), words(60), " ".join(words(8))
    out = []
    for n in range(90):  # from a word to more than one in fifteen changed
        copy = list(base)
        for at in draw.choice(150, n % 11 + 1, replace=False):
            copy[at] = words(1)[0]
        out.append(" ".join(copy))
    out += [" ".join(words(40) + passage + words(40)) for _ in range(60)]
    out += [f"{line}\n" * k + " ".join(base[:40]) for k in (1, 2, 3, 4, 5, 9, 10)]
    out += [" ".join(base), out[0], out[0], "", " ", "one", "one", "ONE two", "... !"]
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_classes_are_those_of_all_pairs(spark, weighted):
    texts = planted()
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = neardup.near_duplicates(documents, weighted=weighted).toPandas()
    least = found.groupby("class_digest")["doc_id"].min()
    mine = {r.doc_id: least[r.class_digest] for r in found.itertuples()}
    assert [mine[i] for i in range(len(texts))] == classes(texts, weighted)


def test_a_group_of_near_copies_costs_about_one_comparison_each(spark, monkeypatch):
    compared = []
    plain = neardup._verified

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counting)
    texts = planted()
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    neardup.near_duplicates(documents, weighted=True).count()
    assert sum(compared) <= 12 * len(texts)


def test_a_hub_is_cut_into_shingles_once_for_each_share(spark):
    texts = planted()[:60]
    digests = [f"d{i}" for i in range(len(texts))]
    table = spark.createDataFrame(list(zip(digests, texts, strict=True)), "text_digest string, text string")
    pairs = [(a, b) for n, a in enumerate(digests) for b in digests[n + 1 : n + 9]]
    found = neardup._verified(spark.createDataFrame(pairs, "a string, b string"), table, 0.8, True)
    wanted = {(a, b) for a, b in pairs if neardup.similarity(texts[int(a[1:])], texts[int(b[1:])], True) >= 0.8}
    assert {tuple(r) for r in found.collect()} == wanted and 0 < len(wanted) < len(pairs)
