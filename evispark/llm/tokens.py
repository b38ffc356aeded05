"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer.

Texts are split by the tokenizer's pattern; words not seen before in the task are merged together, all in one flat array
of symbols: in each round the pairs of neighbours are looked up by binary search over the sorted pair keys, and every
word merges its pair of lowest rank wherever it stands. Rounds go on until no word has a pair left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are on every node; a parameter.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, where the built-in engine is faster.
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max
_BASE = 1 << 20
MOST_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies use for bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of a tokenizer file, and the merging of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * _BASE + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.known: dict[str, list[int]] = {}
        self.split, self.split_ascii = regex.compile(PATTERN), re.compile(_ASCII, re.ASCII)

    def merge(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        out_symbols, out_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            key = symbols[:-1] * _BASE + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.rank[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            least = np.repeat(lowest, counts)
            done = least == _NONE
            if done.any():
                out_symbols.append(symbols[done])
                out_words.append(word[done])
            mark = (rank == least) & ~done
            # In a run of overlapping pairs every second one is merged, from the left.
            spots = np.flatnonzero(mark)
            if len(spots):
                new_run = np.r_[True, np.diff(spots) != 1]
                run = np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
                symbols[spots] = self.merged[rank[spots]]
                keep = ~done
                keep[spots + 1] = False
            else:
                keep = ~done
            symbols, word = symbols[keep], word[keep]
        if not out_words:
            return [[] for _ in words]
        word, symbols = np.concatenate(out_words), np.concatenate(out_symbols)
        order = np.argsort(word, kind="stable")
        cuts = np.cumsum(np.bincount(word, minlength=len(words)))[:-1]
        return [x.tolist() for x in np.split(symbols[order], cuts)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """ids of each text, [] for empty and null ones."""
        split = [(self.split_ascii if t.isascii() else self.split).findall(t) if t else [] for t in texts]
        new = list({w for words in split for w in words}.difference(self.known))
        if new:
            self.known.update(zip(new, self.merge(new)))
        known = self.known
        ids = [[i for w in words for i in known[w]] for words in split]
        if len(known) > MOST_WORDS:
            known.clear()
        return ids


_loaded: dict[str, BytePairs] = {}


def tokenizer(folder: str = TOKENIZERS, name: str = BYTE_BPE) -> BytePairs:
    path = f"{folder}/{name}.json"
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def encoded(text: Column, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> Column:
    """The ids of a text, without special tokens; an empty list for empty and null texts. Special tokens' strings in a
    text are ordinary text. Whole texts are encoded; rows may repeat."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(folder, name)
        for texts in batches:
            yield pd.Series(bpe.encode([t if isinstance(t, str) else None for t in texts]), dtype=object)

    return ids(text)


def token_count(text: Column, folder: str = TOKENIZERS, name: str = BYTE_BPE) -> Column:
    """The number of ids of a text; 0 for empty and null texts."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = tokenizer(folder, name)
        for texts in batches:
            yield pd.Series([len(x) for x in bpe.encode([t if isinstance(t, str) else None for t in texts])], dtype="int32")

    return count(text)


def spread(df: DataFrame) -> DataFrame:
    """Files come in few large splits; encoding is CPU work, so small inputs are spread over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
