"""Whole queries against plain Python, on the small tables and on odd rows."""

import collections
import re
import zlib

import pytest

from papersieve.llm import tokens
from papersieve.llm.queries import QUERIES
from tests.conftest import SMALL

ODD = [
    (0, "one two one", "a", "en"), (0, "one two one", "a", "en"), (1, None, "a", None), (None, "x", None, "en"), (2, "", "b", "de"),
    (3, "Licensed under it\nkept\nLicensed under that", "b", "de"), (4, "Licensed under it\nkept\nLicensed under that", "a", "de"),
    (-7, "word " * 30_000, "b", "en"), (1 << 62, "日本 😀 é", "b", "en"),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    columns = "doc_id bigint, text string, source string, lang string"
    for name, rows in (("odd", ODD), ("none", [])):
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}/documents.parquet")
    return [SMALL, f"{folder}/odd", f"{folder}/none"]


def documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang")
    return [tuple(r) for r in rows.collect()]


def jump(key, shards):
    """Shard of an integer key, in exact integers and Python's floats."""
    key %= 1 << 64
    place, after = -1, 0
    while after < shards:
        place = after
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        after = int((place + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return place


def test_shards(spark, folders):
    for folder in folders:
        rows = documents(spark, folder)
        found = QUERIES["op3_shards"](spark, folder).collect()
        wanted = []
        for doc_id, text, *_ in rows:
            data = (text or "").encode()
            wanted.append((doc_id, len(data) + 16, zlib.crc32(data), "key", jump(doc_id or 0, 40), jump(doc_id or 0, 41)))
        mine = [(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found]
        # (a Row is a tuple, and its method size is hidden by the column)
        assert sorted(mine, key=repr) == sorted(wanted, key=repr)
        slots = collections.defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_counts(spark, folders):
    encode = tokens.tokenizer(tokens.default_path()).ids
    licence = re.compile(r"^Licensed under .*$\n?", re.MULTILINE)

    def counts(text):
        text = text or ""
        return {"word_bpe_49k": len(encode(text)) // 4, "white_space": len(text.split())}, len(text.encode())

    for folder in folders:
        totals = collections.Counter()

        def add(source, lang, text, sign, totals=totals):
            found, size = counts(text)
            for name, n in found.items():
                for what, value in (("documents", 1), ("tokens", n), ("bytes", size)):
                    totals[source, lang, name, what] += sign * value

        rows = documents(spark, folder)
        first = {}
        for doc_id, text, *_ in rows:
            if text is not None and doc_id is not None:
                first[text] = min(first.get(text, doc_id), doc_id)
        for doc_id, text, source, lang in rows:
            add(source, lang, text, 1)
            if text is None or doc_id is None or text not in first:
                continue
            if doc_id > first[text]:
                add(source, lang, text, -1)
            elif licence.sub("", text) != text:
                add(source, lang, text, -1)
                add(source, lang, licence.sub("", text), 1)
        wanted = {}
        for (source, lang, name, _), _ in totals.items():
            key = source, lang, name
            wanted[key] = tuple(totals[(*key, what)] for what in ("documents", "tokens", "bytes"))
        wanted = {key: value for key, value in wanted.items() if any(value)}
        found = QUERIES["op9_token_counts"](spark, folder).collect()
        assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.bytes) for r in found} == wanted
