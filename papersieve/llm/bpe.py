"""Byte-pair encoding by a priority queue over linked symbols, and decoding by the vocabulary's strings."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import text_slices
from .tokens import default_path

WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
"""White space as the tokenizer files mean it; ``str.split`` also cuts at four control characters."""
CONTROLS = re.compile("[\x1c-\x1f]")
REMEMBERED = 200_000
"""Chunks that are remembered; beyond that the memory starts anew."""
LONGEST = 64
"""Symbols of the longest words that are merged side by side; longer ones are merged one by one and not remembered."""
SIMPLE = 0x250
"""Letters below this code point, taken by themselves, are what words are mostly made of."""
SHIFT = 20
"""A pair of ids is one number, the first shifted by so many bits; so is a rank with a place, by ``PLACES``."""
PLACES = 32

Ranks = dict[int, int]


def merge(symbols: list[int], ranks: Ranks, merged: list[int]) -> list[int]:
    """Ids of one word: of all neighbours the pair of lowest rank merges first, the leftmost of equal ones.

    ``symbols`` is the list of ids of its characters, ``ranks`` the rank of each pair, ``merged`` the id that
    a rank makes. Symbols are linked to both neighbours, and a queue holds the
    rank and place of a pair whenever one comes up. What is taken from the queue is
    stale if the pair at its place has another rank by now; it is skipped. So a word of n
    characters takes about n log n steps, however long it is.
    """
    n, rank_of = len(symbols), ranks.get
    ids, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    now = [rank_of(a << SHIFT | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
    now.append(-1)
    queue = [rank << PLACES | i for i, rank in enumerate(now) if rank >= 0]
    heapify(queue)
    while queue:
        top = heappop(queue)
        rank, i = top >> PLACES, top & (1 << PLACES) - 1
        if now[i] != rank:
            continue
        new, j = merged[rank], after[i]
        ids[i], ids[j], now[i], now[j] = new, -1, -1, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            now[i] = rank = rank_of(new << SHIFT | ids[k], -1)
            if rank >= 0:
                heappush(queue, rank << PLACES | i)
        h = before[i]
        if h >= 0:
            now[h] = rank = rank_of(ids[h] << SHIFT | new, -1)
            if rank >= 0:
                heappush(queue, rank << PLACES | h)
    return [s for s in ids if s >= 0]


class Merges:
    """The merges of a tokenizer file: the rank of each pair of ids, and the id that a rank makes."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        self.ranks: Ranks = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[a << SHIFT | b] = rank
        self.merged = merged
        order = sorted(self.ranks)
        self._pairs = np.array([*order, 1 << 62], np.int64)
        self._ranks = np.array([*(self.ranks[p] for p in order), -1], np.int64)
        self._made = np.array([*merged, -1], np.int64)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << SHIFT | b
        at = np.searchsorted(self._pairs, pair)
        return np.where(self._pairs[at] == pair, self._ranks[at], -1)

    def side_by_side(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many words of at most ``LONGEST`` symbols at once: the ids of all, and how many each has.

        Their queues are one sorted array of (word, rank, place). In each round every
        word takes the first of its own, skips it if it is stale, else merges the
        pair, unlinks its second symbol and queues the pairs that come up.
        """
        ids, n, least = ids.astype(np.int64), len(ids), -1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        there = sizes > 0
        before[starts[there]], after[ends[there] - 1] = -1, n
        word = np.repeat(np.arange(len(sizes)), sizes)
        now = np.full(n, least)
        linked = np.flatnonzero(after < n)
        now[linked] = self._rank_of(ids[linked], ids[linked + 1])

        def entries(at: np.ndarray) -> np.ndarray:
            at = at[now[at] >= 0]
            return np.sort((word[at] << SHIFT | now[at]) << 6 | at - starts[word[at]])

        queue = entries(linked)
        while len(queue):
            owner = queue >> SHIFT + 6
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            top, queue = queue[first], queue[~first]
            i, rank = starts[owner[first]] + (top & 63), top >> 6 & (1 << SHIFT) - 1
            live = now[i] == rank
            i, rank = i[live], rank[live]
            j = after[i]
            ids[i], ids[j], now[i], now[j] = self._made[rank], -1, -1, -1
            after[i] = k = after[j]
            right = k < n
            before[k[right]] = i[right]
            now[i[right]] = self._rank_of(ids[i[right]], ids[k[right]])
            h = before[i]
            left = h >= 0
            now[h[left]] = self._rank_of(ids[h[left]], ids[i[left]])
            queue = np.sort(np.concatenate((queue, entries(np.concatenate((i, h[left]))))), kind="stable")
        kept = ids >= 0
        return ids[kept], np.bincount(word[kept], minlength=len(sizes))


class Encoder:
    """Ids of whole texts by a tokenizer file whose words never span white space.

    The file's own rules normalise a chunk between white space and cut it into
    words, whose symbols are then merged. The ids of chunks are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, whole = rules["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only plain byte-pair encoding is supported")
        self._normalizer, self._cutter = whole.normalizer, whole.pre_tokenizer
        self._ids, self._end = model["vocab"], model.get("end_of_word_suffix") or ""
        special = {token["content"]: token["id"] for token in rules["added_tokens"]}
        longest_first = sorted(special, key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._special = {content: np.array([i], "<u4").tobytes() for content, i in special.items()}
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.merges = Merges(
            [(self._ids[a], self._ids[b]) for a, b in pairs], [self._ids[a + b] for a, b in pairs]
        )
        self._known: dict[str, bytes] = {}
        self._letters()

    def _letters(self) -> None:
        """Ids of a letter within a word and at its end, for letters that the rules take one by one."""
        inside, last = [], []
        self._size, self._at = np.zeros(SIMPLE + 1, np.int64), np.zeros(SIMPLE + 1, np.int64)
        for letter in filter(str.isalpha, map(chr, range(SIMPLE))):
            words = self._words(letter)
            if len(words) == 1 and self._normalised(letter).isalpha() and all(s in self._ids for s in words[0]):
                self._at[ord(letter)], self._size[ord(letter)] = len(inside), len(words[0])
                inside += [self._ids[s] for s in words[0]]
                last += self._symbols(words[0])
        self._inside, self._last = np.array(inside, np.int64), np.array(last, np.int64)

    def _normalised(self, chunk: str) -> str:
        return self._normalizer.normalize_str(chunk) if self._normalizer else chunk

    def _words(self, chunk: str) -> list[str]:
        return [word for word, _ in self._cutter.pre_tokenize_str(self._normalised(chunk))]

    def _symbols(self, word: str) -> list[int]:
        return [self._ids[s] for s in [*word[:-1], word[-1] + self._end] if s in self._ids]

    def _codes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all chunks, those without an own entry in the tables as one; ends and sizes of chunks."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        return np.minimum(codes, SIMPLE), np.cumsum(sizes), sizes

    def _letter_symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that are letters alone, and how many each has."""
        codes, ends, sizes = self._codes(words)
        size = self._size[codes]
        at = np.repeat(self._at[codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        closes = np.zeros(len(codes), bool)
        closes[ends - 1] = True
        symbols = np.where(np.repeat(closes, size), self._last[at], self._inside[at])
        return symbols, np.add.reduceat(size, ends - sizes) if len(words) else sizes

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that are not known."""
        if not chunks:
            return {}
        codes, ends, sizes = self._codes(chunks)
        letters = np.add.reduceat((self._size[codes] > 0).astype(np.int64), ends - sizes)
        plain = letters == sizes
        # a sign behind letters is a word of its own
        signed = (sizes > 1) & (letters == sizes - 1) & np.isin(codes[ends - 1], [ord(c) for c in ".,;:!?"])
        stems = {chunks[i][:-1] for i in np.flatnonzero(signed)} - self._known.keys()
        words = list(stems | {chunks[i] for i in np.flatnonzero(plain)})
        signs = {chunks[i][-1] for i in np.flatnonzero(signed)} - self._known.keys()
        rest = list(signs | {chunks[i] for i in np.flatnonzero(~plain & ~signed)})
        cut = [[self._symbols(w) for w in self._words(c)] for c in rest]

        symbols, counts = self._letter_symbols(words)
        others = [w for c in cut for w in c]
        symbols = np.concatenate((symbols, np.array([s for w in others for s in w], np.int64)))
        counts = np.concatenate((counts, np.array([len(w) for w in others], np.int64)))
        merged = self._merged(symbols, counts)
        found = dict(zip(words, merged, strict=False))
        at = len(words)
        for chunk, parts in zip(rest, cut, strict=True):
            found[chunk] = b"".join(merged[at : at + len(parts)])
            at += len(parts)
        for i in np.flatnonzero(signed):
            stem, sign = chunks[i][:-1], chunks[i][-1]
            found[chunks[i]] = (found.get(stem) or self._known[stem]) + (found.get(sign) or self._known[sign])
        return found

    def _merged(self, symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of each word."""
        short = counts <= LONGEST
        ids, sizes = self.merges.side_by_side(symbols[np.repeat(short, counts)], counts[short])
        blob, cuts = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out: list[bytes] = [b""] * len(counts)
        for word, first, end in zip(np.flatnonzero(short).tolist(), [0, *cuts], cuts, strict=False):
            out[word] = blob[first:end]
        ends = np.cumsum(counts)
        for word in np.flatnonzero(~short).tolist():
            one = symbols[ends[word] - counts[word] : ends[word]].tolist()
            out[word] = np.array(merge(one, self.merges.ranks, self.merges.merged), "<u4").tobytes()
        return out

    def _plain(self, text: str) -> list[str]:
        return [c for c in WHITE.split(text) if c] if CONTROLS.search(text) else text.split()

    def _chunks(self, text: str) -> list[str]:
        """What stands between white space; added tokens are met before anything else and stay whole."""
        if self._specials is None or not self._specials.search(text):
            return self._plain(text)
        parts = self._specials.split(text)
        return [c for part in parts for c in ([part] if part in self._special else self._plain(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts; a null text has none."""
        cut = [self._chunks(text or "") for text in texts]
        if len(self._known) > REMEMBERED:
            self._known = {}
        self._known |= self._special
        new = self._learn(list(set().union(*cut) - self._known.keys()))
        self._known |= new
        found = [b"".join(map(self._known.__getitem__, chunks)) for chunks in cut]
        for chunk in [c for c in new if len(c) > LONGEST]:
            del self._known[chunk]
        return found


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> pa.Array:
    """The string of each id of a tokenizer file; null where an id has none."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    strings = {i: s for s, i in rules["model"]["vocab"].items()}
    strings |= {token["id"]: token["content"] for token in rules["added_tokens"]}
    return pa.array([strings.get(i) for i in range(max(strings, default=-1) + 1)], pa.string())


def _lists(found: list[bytes]) -> pa.Array:
    ids = np.frombuffer(b"".join(found), "<i4")
    offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def encoded(texts: pa.Array, path: str) -> pa.Array:
    """A list of ids for each text; a null text is empty."""
    parts = [_lists(encoder(path).encode(part)) for part in text_slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decoded(ids: pa.Array, path: str) -> pa.Array:
    """The strings of each list of ids, joined by one space; null for null. Ids without a string are left out."""
    words = vocabulary(path)
    flat = ids.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(words)))
    strings = words.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
    offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(False))))
    there = pc.is_valid(strings).to_numpy(False)
    offsets = np.concatenate(([0], np.cumsum(there)))[offsets].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), strings.filter(pa.array(there, pa.bool_())))
    joined = pc.binary_join(lists, " ")
    return pc.if_else(pc.is_valid(ids), joined, pa.scalar(None, pa.string()))


def encode(text: Column, path: str | None = None) -> Column:
    """Token ids (``array<int>``) of whole texts by the tokenizer file ``path``, which each executor must have.

    As the file's library gives them without special tokens added; those that
    stand in a text are met. Null, empty and blank texts have no ids. Any text
    counts on its own, so repeated rows and other columns change nothing.
    """
    where = path or default_path()

    def ids(texts: pa.Array) -> pa.Array:
        return encoded(texts, where)

    # else the plan would copy it into each column that uses the ids, and encode again for each
    return F.arrow_udf(ids, "array<int>").asNondeterministic()(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Texts of token ids: their strings in the vocabulary in order, with one space between two.

    That is what the library gives for a file without a decoder, special tokens
    kept. Null ids give null; ids that the file lacks are left out.
    """
    where = path or default_path()

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        return decoded(lists, where)

    return texts(ids)


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of ``documents`` (``doc_id``, ``text``): ``encode``, then ``decode``.

    One Python worker does both for a task, on about 1 MB of texts at a time, and
    hands each slice on before it takes the next. Other columns are not looked at; repeated rows each
    get their row.
    """
    where = path or default_path()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in text_slices(batch.column(1)):
                ids = _lists(encoder(where).encode(part))
                names = batch.column(0).slice(first, len(part))
                yield pa.RecordBatch.from_arrays([names, ids, decoded(ids, where)], ["doc_id", "ids", "decoded"])
                first += len(part)

    kept = documents.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(both, f"doc_id {kind}, ids array<int>, decoded string")
