"""Token ids of whole texts by a public tokenizer, with a memory of the words it has met."""

from __future__ import annotations

import functools
import re

import numpy as np

PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*"
"""Texts that can be taken word by word: Latin, already composed, with ordinary white space."""
WORDS = (
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
"""How ``word_bpe_49k.json`` cuts a lower-cased plain text; a fixed value of that file."""
REMEMBERED = 300_000
"""Words of one generation of the memory; those met again move on to the next."""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer(dict):
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, for the rules of that file.

    A plain text is cut at white space, which no token spans, and then into
    words; those go to the file's vocabulary and merges directly, once while
    they are remembered. All other texts go through its whole tokenizer.
    The dictionary holds the ids of words, and of pieces between white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self._whole = Tokenizer.from_file(path)
        self._merges = self._whole.model
        self._bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self._cut, self._plain = re.compile(WORDS), re.compile(PLAIN)
        self._older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self[chunk[-1]]
        found = self._older.get(chunk)
        if found is None:
            words = [chunk] if chunk.isalpha() else self._cut.findall(chunk)
            found = self._word(chunk) if len(words) == 1 else b"".join(map(self.__getitem__, words))
        if len(self) >= REMEMBERED:
            self._older = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else self._bytes.pre_tokenize_str(word)[0][0]
        return np.array([t.id for t in self._merges.tokenize(shown)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if "<|" in text or not self._plain.fullmatch(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)
