"""Exact token ids of whole texts, one white-space chunk at a time.

A word-level tokenizer never merges across ASCII white space, so the ids of a
text are those of its chunks in order, and a chunk of printable ASCII falls into
pre-tokens where the class of its bytes changes. Slices of texts are cut that way
as arrays, each distinct unit is hashed and looked up once in the worker's cache,
and ids are gathered by place. Only units that the cache lacks reach the library;
chunks with other bytes, apostrophes or special strings go to it whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from folioflow.llm.common import FOLD, SOLID, TABLED, SortedCache, Words, runs, spans, text_bytes, text_slices, worker_cache

# The pre-token rule of the vocabulary, for lower-case Latin-1 text.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\t-\r \x85\xa0]+")


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


# Classes of bytes: white space, letters, numbers, others; and those whose chunks are not cut here.
_BLANK, _LETTER, _NUMBER, _OTHER, _WHOLE = range(5)
_CLASS = np.array([_BLANK if not SOLID[c] else _WHOLE if c < 32 or c > 126 or c == 39 else _LETTER if chr(c).isalpha() else _NUMBER if chr(c).isdigit() else _OTHER for c in range(256)], np.uint8)


def units(texts: pa.Array) -> Words:
    """Pre-tokens of printable ASCII, lower-cased, and whole chunks with anything else."""
    raw, at = text_bytes(texts)
    kind = _CLASS[raw]
    start, end = runs(kind != _BLANK, at)
    odd = kind == _WHOLE
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # "<|" opens a special string
    whole = np.zeros(len(start), bool)
    whole[np.searchsorted(start, np.flatnonzero(odd), "right") - 1] = True
    cut = kind != _BLANK
    cut[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    cut[start] = True
    places = np.flatnonzero(cut)
    chunk = np.searchsorted(start, places, "right") - 1
    stays = ~whole[chunk] | (places == start[chunk])
    places, chunk = places[stays], chunk[stays]
    ends = end[chunk]
    ends[:-1] = np.minimum(ends[:-1], places[1:])
    data = FOLD[raw]
    kept = spans(start[whole], (end - start)[whole])
    data[kept] = raw[kept]
    return Words(data, places, ends, np.searchsorted(places, at), at)


class WordTokenizer:
    """Ids of whole texts under a ``tokenizers`` file with a word-level pre-tokenizer."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._letters = _byte_letters()
        self.cache = SortedCache(limit)
        self._check_rule(path)

    def vocabulary(self) -> dict[str, int]:
        return self._library.get_vocab(with_added_tokens=False)

    def _check_rule(self, path: str) -> None:
        """Pre-tokens are cut here by a fixed rule: a file of another rule raises instead of giving other ids."""
        every = "".join(chr(c) for c in range(1, 256))
        for sample in (every, " ".join(every), "don't we'll I've 'tis x'", "a1b22 c_d--e 3.14 ½ß µº ~é~é", "<|endoftext|> <|x <| ab<|startoftext|>ab", "naïve Ünïcode 日本 ŵ \u0130 end"):
            for text in (sample, f"  {sample}\n\t{sample.upper()} "):
                mine = np.concatenate([x for x, _ in self.ids(pa.array([text]))])
                if mine.tolist() != self._library.encode(text, add_special_tokens=False).ids:
                    raise ValueError(f"{path}: its pre-tokens are not cut by the rule of word-level vocabularies that is built in here")

    def _pre_token(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # those stand for themselves in the byte-level alphabet
            letters = self._letters
            word = "".join([letters[b] for b in word.encode()])
        ids = [t.id for t in self._library.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def unit(self, unit: bytes) -> bytes:
        """Ids of a pre-token or a whole chunk, as little-endian unsigned 32-bit integers."""
        text = unit.decode("utf-8", "replace")
        if text.isascii() and text.isprintable() and "'" not in text and "<|" not in text:  # cut where its class changes, so a pre-token
            ids = [t.id for t in self._library.model.tokenize(text)]
            return struct.pack(f"<{len(ids)}I", *ids)
        if "<|" in text or not (text.isascii() or max(text) <= "\xff"):
            ids = self._library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = _PRE_TOKEN.findall(text.lower())
        return b"".join(map(self._pre_token, words))

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pool, first places, sizes) of the ids of the distinct units, and each unit's number among them."""
        keys, some, number = np.unique(words.hashes(), return_index=True, return_inverse=True)

        def make(missing: np.ndarray) -> list[bytes]:
            return [self.unit(words.word(i)) for i in some[missing].tolist()]

        # A long unit is not held: so the cache is bounded in bytes.
        return *self.cache.find(keys, make, (words.end - words.start)[some] <= TABLED), number

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a column of texts, slice by slice: all ids, and each text's first place among them (with the end). Null texts have none."""
        for part in text_slices(texts):
            words = units(part)
            pool, at, size, number = self.found(words)
            ends = np.concatenate([[0], np.cumsum(size[number])])
            yield pool[spans(at[number], size[number])], ends[words.first]


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return worker_cache(("tokenizer", path), lambda: WordTokenizer(path))
