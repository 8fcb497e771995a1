"""Token counts by a map-side two-tier lookup (operator 6).

Tier 1 is a compact hash table of frequent pre-tokens and their token counts,
broadcast. Which are frequent is known before the corpus is read: a vocabulary is
merged in the order of frequency, so its whole words are the frequent ones of the
texts that it was made from. Tier 2 encodes what the table misses, through a cache
in each worker, which holds the pre-tokens that are frequent in the corpus itself.
Texts are read once, and no pre-token is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.llm.common import append_columns, text_slices, tokenizer_path
from folioflow.llm.tokens import WordTokenizer, units, word_tokenizer

#: Entries of the broadcast table at most, 12 bytes each: as many whole words as a vocabulary has first.
TABLE = 65_536
#: What ends a whole word in the vocabulary, and bytes of the longest pre-token in the table.
WORD_END, LONGEST = "</w>", 32


def whole_words(tokenizer: WordTokenizer, most: int = TABLE) -> list[bytes]:
    """The vocabulary's whole words that are pre-tokens as they stand, in the order of their ids."""
    known = sorted(tokenizer.vocabulary().items(), key=lambda x: x[1])
    words = [w.removesuffix(WORD_END).encode() for w, _ in known if w.endswith(WORD_END) and w.isascii() and 0 < len(w) - len(WORD_END) <= LONGEST]
    cut = units(pa.array(words, pa.binary()))
    alone = np.diff(cut.first) == 1
    return [w for w, x in zip(words, alone.tolist()) if x and w.lower() == w][:most]


def hash_table(path: str, most: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pre-tokens' hashes, ascending, and their numbers of tokens, as the library gives them."""
    tokenizer = WordTokenizer(path)
    words = units(pa.array(whole_words(tokenizer, most), pa.binary()))
    keys, some = np.unique(words.hashes(), return_index=True)
    return keys, np.array([len(tokenizer.unit(words.word(i))) >> 2 for i in some.tolist()], np.uint32)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, carry: list[str] | None = None, limit: int = 2048) -> DataFrame:
    """``carry`` columns plus ``n_bytes``, ``n_tokens`` and ``over_limit`` for every document.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated
    rows; an empty table gives an empty result; texts of any length are counted
    whole; other columns are left alone, even where their names are those of the
    results (they stay inside ``_row``).
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    shared = docs.sparkSession.sparkContext.broadcast(hash_table(path))

    def compute(batches):
        keys, lengths = shared.value
        tokenizer = word_tokenizer(path)
        for (texts,) in batches:
            n_bytes, n_tokens = [], []
            for part in text_slices(texts):
                words = units(part)
                hashes = words.hashes()
                place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                size = np.empty(len(hashes), np.int64)
                size[hit] = lengths[place[hit]]
                missed = words.some(np.flatnonzero(~hit))
                _, _, counts, number = tokenizer.found(missed)
                size[~hit] = counts[number]
                total = np.concatenate([[0], np.cumsum(size)])
                n_tokens.append(np.diff(total[words.first]))
                n_bytes.append(np.diff(words.bytes))
            n_tokens, n_bytes = (np.concatenate([np.empty(0, np.int64), *x]) for x in (n_tokens, n_bytes))
            yield [pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], None

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(docs, [text], fields, compute, carry, "tokens")
