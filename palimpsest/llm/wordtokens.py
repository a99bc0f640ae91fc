"""Token ids of a word tokenizer whose pieces never hold white space.

Such a tokenizer gives a text the ids of its blank-separated words, one after another. Words are found by Arrow, each distinct
one is encoded once by the tokenizer library, and a text's ids are gathered from a bounded cache. ASCII letters are
lower-cased first, as the tokenizer does itself, and closing punctuation is parted from a letter before it, where a piece ends anyway.
Texts in which the name of a special token may stand go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries and ids after which the cache is emptied, and the longest word it keeps, in bytes.
CACHE_WORDS = 400_000
CACHE_IDS = 4_000_000
CACHE_BYTES = 64
SPECIAL = "<|"


class WordTokens:
    """Encoder over one tokenizer file; one for each Python worker."""

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = [0]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The cache's number of each word; new words are encoded and added."""
        get, new = self.known.get, {}
        out = [get(w, -1) for w in words]
        for w, n in zip(words, out, strict=True):
            if n < 0:
                new[w] = len(self.first) - 1 + len(new)
        if new:
            found = self._library(list(new))
            ids = np.array([i for x in found for i in x], np.uint32)
            at = self.first[-1]
            while at + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[at : at + len(ids)] = ids
            self.first.extend((at + np.cumsum([len(x) for x in found])).tolist())
            self.known.update((w, n) for w, n in new.items() if len(w) <= CACHE_BYTES)
            out = [new[w] if n < 0 else n for w, n in zip(words, out, strict=True)]
        return np.array(out, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and each text's offsets; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False))
        whole = {int(i): np.array(ids, np.uint32) for i, ids in zip(odd, self._library([texts[int(i)].as_py() for i in odd]), strict=True)}
        plain = pc.if_else(pc.match_substring(texts, SPECIAL), "", texts) if whole else texts
        parted = pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,;:!?])", r"\1 \2")
        lists = pc.ascii_split_whitespace(parted)
        words = lists.flatten().dictionary_encode()
        if len(self.known) > CACHE_WORDS or self.first[-1] > CACHE_IDS:
            self._clear()
        number = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        first = np.array(self.first, np.int64)
        start, length = first[number], first[number + 1] - first[number]
        ends = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
        ids = self.flat[source]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        offsets = ends[bounds]
        if not whole:
            return ids, offsets
        rows = [whole.get(i, ids[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


@lru_cache(2)
def encoder(data: str) -> WordTokens:
    """The worker's encoder, kept from task to task."""
    return WordTokens(data)
