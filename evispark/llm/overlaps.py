"""Problem 4: same or near-same records across splits.

Rows become text: the fingerprint, and for each of uts_mpa and stress_amplitude_mpa the publication's code followed by the
value, whole MPa first. The texts of validation and test rows (with the whole numbers beside theirs) are cut into shards,
and for each shard a compressed full-text index is built once and stored. Training texts stream through the indexes by
backward search: every text is matched as far as any indexed one agrees with it, and a match that reaches the end of the
whole MPa (of the fingerprint) is located. So 1171.4 meets 1171, 1171.0 and 1172.3 by matches of different lengths, which
no equal key would give. The matches of two rows are merged into their spans and matched letters, and each pair is then
checked exactly.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.results import ANCHORS, agreement, clean, measures_of
from evispark.session import Scratch

SEPARATOR = b"\n"


class FullTextIndex:
    """A Burrows-Wheeler index with sampled ranks and sampled places over texts that are stored mirrored, so that backward
    search reads a pattern from its start and finds how far any text goes on like it."""

    RANKS, PLACES = 64, 8
    _ARRAYS = ("code", "bwt", "first", "marks", "places", "starts")

    def __init__(self, texts: list[bytes]):
        joined = SEPARATOR + SEPARATOR.join(t[::-1] for t in texts) + SEPARATOR
        codes = np.frombuffer(joined, dtype=np.uint8)
        present = np.unique(codes)
        self.code = np.full(256, -1, dtype=np.int16)
        self.code[present] = np.arange(1, len(present) + 1)
        s = np.append(self.code[codes], 0).astype(np.int64)
        order = self._suffixes(s)
        self.bwt = s[order - 1].astype(np.uint8)
        counts = np.bincount(s, minlength=len(present) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sampled = order % self.PLACES == 0
        self.marks, self.places = np.packbits(sampled), (order[sampled] // self.PLACES).astype(np.int32)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.starts = (1 + np.cumsum(sizes) - sizes).astype(np.int32)
        self._open()

    def _open(self) -> None:
        """What follows from the stored arrays: ranks at every 64th letter, and the marked places before each."""
        self.n = len(self.bwt)
        blocks = -(-self.n // self.RANKS) + 1
        padded = np.full(blocks * self.RANKS, 255, dtype=np.uint8)
        padded[: self.n] = self.bwt
        self.blocks = padded.reshape(blocks, self.RANKS)
        self.ranks = np.zeros((len(self.first), blocks + 1), dtype=np.int32)
        for c in range(len(self.first)):
            np.cumsum((self.blocks == c).sum(axis=1), out=self.ranks[c, 1:])
        self.marked = np.unpackbits(self.marks, count=self.n).astype(bool)
        self.before = np.cumsum(self.marked) - self.marked

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: getattr(self, k) for k in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def unpacked(cls, stored: bytes) -> FullTextIndex:
        index = cls.__new__(cls)
        with np.load(io.BytesIO(stored)) as arrays:
            for k in cls._ARRAYS:
                setattr(index, k, arrays[k])
        index._open()
        return index

    @staticmethod
    def _suffixes(s: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; the last symbol is the only 0."""
        n, rank, k = len(s), s.copy(), 1
        while True:
            later = np.zeros(n, dtype=np.int64)
            if k < n:
                later[:-k] = rank[k:] + 1
            key = rank * (max(n, int(rank.max()) + 1) + 2) + later
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            rank[order] = new
            if new[-1] == n - 1:
                return order
            k *= 2

    def _rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of c before each position."""
        block, rest = at // self.RANKS, at % self.RANKS
        inside = (self.blocks[np.minimum(block, len(self.blocks) - 1)] == c[:, None]) & (np.arange(self.RANKS) < rest[:, None])
        return self.ranks[c, block] + inside.sum(axis=1)

    def _texts_at(self, rows: np.ndarray) -> np.ndarray:
        """The text that holds each row's suffix: back letter by letter to a sampled place."""
        place, steps, live = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(live):
            hit = self.marked[at[live]]
            done = live[hit]
            place[done] = self.places[self.before[at[done]]].astype(np.int64) * self.PLACES + steps[done]
            live = live[~hit]
            c = self.bwt[at[live]].astype(np.int64)
            at[live] = self.first[c] + self._rank(c, at[live])
            steps[live] += 1
        return np.searchsorted(self.starts, place, side="right") - 1

    def matches(self, patterns: list[bytes], least: np.ndarray, batch: int = 65_536) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, text, letters) of the maximal matches: how far each text agrees with each pattern from the pattern's
        start on, wherever it does so for at least ``least`` (1 or more) letters."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for begin in range(0, len(patterns), batch):
            part, need = patterns[begin : begin + batch], np.asarray(least[begin : begin + batch], dtype=np.int64)
            sizes = np.array([len(p) for p in part], dtype=np.int64)
            flat = self.code[np.frombuffer(b"".join(part), dtype=np.uint8)].astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            lo, hi = np.zeros(len(part), dtype=np.int64), np.full(len(part), self.n, dtype=np.int64)
            done, live = np.zeros(len(part), dtype=np.int64), np.flatnonzero(sizes > 0)
            hits: list[tuple[np.ndarray, ...]] = []  # (pattern, lo, hi, letters) at each length from the least on
            while len(live):
                c = flat[starts[live] + done[live]]
                live, c = live[c > 0], c[c > 0]
                a, b = self.first[c] + self._rank(c, lo[live]), self.first[c] + self._rank(c, hi[live])
                go = b > a
                live = live[go]
                lo[live], hi[live] = a[go], b[go]
                done[live] += 1
                enough = live[done[live] >= need[live]]
                if len(enough):
                    hits.append((enough, lo[enough], hi[enough], done[enough]))
                live = live[done[live] < sizes[live]]
            if not hits:
                continue
            who, low, high, letters = (np.concatenate(x) for x in zip(*hits))
            many = high - low
            rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            each = pd.DataFrame({"pattern": np.repeat(who, many), "text": self._texts_at(rows), "letters": np.repeat(letters, many)})
            best = each.groupby(["pattern", "text"], as_index=False)["letters"].max()
            found.append((best["pattern"].to_numpy() + begin, best["text"].to_numpy(), best["letters"].to_numpy()))
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


#: Distinct texts of one shard; the number of shards follows the table. MPa of a publication that go to one shard.
SHARD, REACH = 20_000, 64


def _written(kind: str, x: Column) -> Column:
    """The publication's code, the kind, the whole MPa in five digits or more and, after a point, thousandths."""
    whole = F.floor(x)
    digits = F.concat(F.when(whole < 0, "-").otherwise(""), F.lpad(F.abs(whole).cast("string"), F.greatest(F.length(F.abs(whole).cast("string")), F.lit(5)), F.lit("0")))
    rest = F.lpad(F.floor((x - whole) * 1000 + 1e-6).cast("string"), 3, "0")
    return F.concat(F.substring(F.md5("pub"), 1, 16), F.lit(kind), digits, F.lit("."), rest)


def _anchor(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), _written(kind, x).alias("text"), F.hash(F.col("pub"), F.lit(kind), F.floor(x / REACH)).alias("route"))


def _texts(rows: DataFrame, wide: bool) -> DataFrame:
    """(k, kind, id, text, least, route) of each row; wide: also the whole numbers beside the anchors.

    route names the shard: by publication and REACH MPa, or by the fingerprint; what agrees inside it is found there."""
    parts = [F.array(F.struct(F.lit("f").alias("kind"), F.concat(F.lit("f"), F.translate("fingerprint", "\n", "\1")).alias("text"), F.hash("fingerprint").alias("route")))]
    for m in (m for m in ANCHORS if m in rows.columns):
        near = F.array(F.col(m), F.floor(m) - 1.0, F.floor(m) + 1.0) if wide else F.array(F.col(m))
        parts.append(F.transform(near, _anchor(m[0])))
    flat = F.filter(F.flatten(F.array(*parts)), lambda x: x["text"].isNotNull())
    least = F.when(F.col("kind") == "f", F.octet_length("text")).otherwise(F.instr("text", "."))
    return rows.select("k", F.explode(flat).alias("x")).select("k", "x.*").select("k", "kind", F.xxhash64("text").alias("id"), "text", least.alias("least"), "route")


def shard_indexes(held: DataFrame, shards: int) -> DataFrame:
    """(shard, index, ids): the stored full-text index of each shard's distinct texts, and their ids in its order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = FullTextIndex([x.encode() for x in pdf["text"]])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "index": [index.packed()], "ids": [pdf["id"].tolist()]})

    texts = held.select(F.pmod("route", F.lit(shards)).alias("shard"), "id", "text").distinct()
    return texts.groupBy("shard").applyInPandas(build, "shard int, index binary, ids array<bigint>")


def text_matches(train: DataFrame, indexes: DataFrame, shards: int) -> DataFrame:
    """(id, held_id, letters): the maximal matches of the distinct training texts in the index of their shard."""
    asked = train.select(F.pmod("route", F.lit(shards)).alias("shard"), "id", "text", "least").distinct()

    def search(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(asked):
            return pd.DataFrame({"id": [], "held_id": [], "letters": []}).astype("int64")
        index, ids = FullTextIndex.unpacked(stored["index"].iloc[0]), np.asarray(stored["ids"].iloc[0])
        pattern, text, letters = index.matches([x.encode() for x in asked["text"]], asked["least"].to_numpy())
        return pd.DataFrame({"id": asked["id"].to_numpy()[pattern], "held_id": ids[text], "letters": letters})

    return indexes.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(search, "id bigint, held_id bigint, letters bigint")


def split_overlaps(rows: DataFrame, scratch: Scratch, key: str = "view_row_id") -> DataFrame:
    """(train_id, held_id, held_split, source_id, spans, letters, same_fingerprint) of every pair of a training row and a
    validation or test row that hold the same result. rows: view rows with pub.

    spans, letters: matched texts of the pair (fingerprint, strength, stress) and their letters. Splits are read without
    case and blanks; rows of other splits are ignored. A null fingerprint or publication matches nothing by it. Repeated
    rows pair each; one empty side gives an empty result."""
    measures = measures_of(rows)
    split = F.lower(F.trim("split_name"))
    base = clean(
        rows.select(F.col(key).alias("k"), split.alias("split"), "source_id", "pub", F.nullif(F.trim("record_fingerprint"), F.lit("")).alias("fingerprint"), *measures),
        measures,
    )
    base = scratch.keep(base.where(F.col("split").isin("train", "validation", "test")))
    train, held = base.where("split = 'train'"), base.where("split <> 'train'")
    train_texts, held_texts = scratch.keep(_texts(train, False)), scratch.keep(_texts(held, True))
    shards = held_texts.count() // SHARD + 1
    indexes = scratch.keep(shard_indexes(held_texts, shards))
    hits = scratch.keep(text_matches(train_texts, indexes, shards))
    kinds = ("f", *(m[0] for m in ANCHORS if m in measures))
    spans = (
        train_texts.select(F.col("k").alias("a"), "kind", "id").join(hits, "id")
        .join(held_texts.select(F.col("k").alias("b"), F.col("id").alias("held_id")), "held_id")
        .groupBy("a", "b").agg(*(F.max(F.when(F.col("kind") == k, F.col("letters"))).alias(f"l_{k}") for k in kinds))
    )
    pairs = spans.select(
        "a", "b", sum((F.col(f"l_{k}").isNotNull().cast("bigint") for k in kinds), F.lit(0)).alias("spans"),
        sum((F.coalesce(f"l_{k}", F.lit(0)) for k in kinds), F.lit(0)).alias("letters"),
    )
    left = train.select(*(F.col(c).alias(f"a_{c}") for c in base.columns))
    right = held.select(*(F.col(c).alias(f"b_{c}") for c in base.columns))
    full = pairs.join(left, F.col("a") == F.col("a_k")).join(right, F.col("b") == F.col("b_k"))
    same = F.coalesce(F.col("a_fingerprint") == F.col("b_fingerprint"), F.lit(False))
    alike = F.coalesce(F.col("a_pub") == F.col("b_pub"), F.lit(False)) & agreement(full, full, measures, "a_", "b_")
    return full.where(same | alike).select(
        F.col("a").alias("train_id"), F.col("b").alias("held_id"), F.col("b_split").alias("held_split"),
        F.col("b_source_id").alias("source_id"), "spans", "letters", same.alias("same_fingerprint"),
    )
