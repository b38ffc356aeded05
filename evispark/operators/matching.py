"""Fuzzy matching of titles: a near one by common letters, then all whose letters could come nearer."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def title_text(c: Column) -> Column:
    """A title in lower case with everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


#: Titles of the left and the right side in one block of pairs; titles by letters that a first match is sought among: where
#: the search starts, not what it finds.
LEFT_BLOCK, RIGHT_BLOCK, LIKELY = 250, 5_000, 8
#: What is rounded off a similarity.
SLACK = 1e-6


def _similar(x: str | None, y: str | None) -> float:
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    whole = SequenceMatcher(None, x, y, autojunk=False)
    if whole.quick_ratio() < 0.6:  # an upper bound, of the sorted words' ratio too
        return 0.0
    best = max(whole.ratio(), SequenceMatcher(None, _sorted(x), _sorted(y), autojunk=False).ratio())
    return max(best, 0.99) if min(len(x), len(y)) >= 20 and (x in y or y in x) else best


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the longest matching blocks; words sorted first if that is nearer; 0.99 where one holds the other."""
    return pd.Series([_similar(x, y) for x, y in zip(a, b)], dtype="float64")


class Titles:
    """Titles as letter counts and codes, to bound their similarity to another from above."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts])
        self.code = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
        at = np.repeat(np.arange(len(texts)), self.size) * len(self.code) + self._flat(texts)
        self.counts = np.bincount(at, minlength=len(texts) * len(self.code)).reshape(len(texts), -1).astype(np.int16)

    def _flat(self, texts: list[str]) -> np.ndarray:
        points = np.array([ord(c) for c in self.code], dtype=np.uint32)  # sorted like the letters
        return np.searchsorted(points, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"))

    @cached_property
    def plain(self) -> np.ndarray:
        return self._codes(self.texts)

    @cached_property
    def ordered(self) -> np.ndarray:
        return self._codes([_sorted(t) for t in self.texts])

    def _codes(self, texts: list[str]) -> np.ndarray:
        """A row of codes for each text, filled up with one that is no letter's."""
        sizes = np.array([len(t) for t in texts])
        out = np.full((len(texts), sizes.max()), len(self.code), dtype=np.int32)
        out[np.arange(sizes.max()) < sizes[:, None]] = self._flat(texts)
        return out

    def _common(self, x: str, codes: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence with each row of codes, by bits of x."""
        words = -(-len(x) // 64)
        held = np.zeros((words, len(self.code) + 1), dtype=np.uint64)
        for i, c in enumerate(x):
            if c in self.code:
                held[i // 64, self.code[c]] |= np.uint64(1 << i % 64)
        v = np.full((words, len(codes)), ~np.uint64(0))
        for row in np.ascontiguousarray(codes.T):
            carry = None
            for w in range(words):
                u = v[w] & held[w].take(row)
                two = one = v[w] + u
                over = one < u
                if carry is not None:
                    two = one + carry
                    over |= two < one
                carry = over.astype(np.uint64)
                v[w] = two | (v[w] ^ u)
        return np.bitwise_count(~v).sum(axis=0)

    def _letters(self, x: str) -> tuple[np.ndarray, np.ndarray]:
        """The letters in common with each title, and the bound that they are of the similarity."""
        mine = np.array([x.count(c) for c in self.code], dtype=np.int16)
        common = np.minimum(self.counts, mine).sum(axis=1, dtype=np.int64)
        return common, 2 * common / (self.size + len(x))

    def likely(self, x: str, least: float, most: int) -> list[tuple[int, float]]:
        """(place, bound) of at most ``most`` titles with the highest bounds by letters, from ``least`` on."""
        letters = self._letters(x)[1]
        top = np.argpartition(-letters, most)[:most] if len(letters) > most else np.arange(len(letters))
        return [(int(i), float(letters[i])) for i in top if letters[i] >= least - SLACK]

    def nearest(self, x: str, least: float) -> tuple[int, float] | None:
        """(place, similarity) of the first most similar title, from ``least`` on.

        Matching blocks are a common subsequence, so they hold at most the longest one, and that at most the common letters;
        what is below by either bound isn't scored. Titles come by their letters, so what is found cuts off the rest."""
        common, letters = self._letters(x)
        # One that holds the other has all its letters in common.
        inside = np.flatnonzero((common == np.minimum(self.size, len(x))) & (np.minimum(self.size, len(x)) >= 20))
        best = None

        def score(places) -> None:
            nonlocal best
            for b, i in places:
                if b < (best[0] if best else least) - SLACK:
                    break
                got = round(_similar(x, self.texts[i]), 6)
                if got >= least - SLACK and (best is None or (got, -i) > (best[0], -best[1])):
                    best = got, int(i)

        score((1.0, i) for i in inside if x in self.texts[i] or self.texts[i] in x)
        near = np.flatnonzero(letters >= least - SLACK)
        near = near[np.argsort(-letters[near], kind="stable")]
        at, step = 0, 32
        while at < len(near) and letters[near[at]] >= (best[0] if best else least) - SLACK:
            some, at, step = near[at : at + step], at + step, step * 4
            some = some[letters[some] >= (best[0] if best else least) - SLACK]
            longest = self.size[some].max()
            same = np.maximum(self._common(x, self.plain[some, :longest]), self._common(_sorted(x), self.ordered[some, :longest]))
            score(sorted(zip(2 * same / (self.size[some] + len(x)), some), key=lambda v: (-v[0], v[1])))
        return (best[1], best[0]) if best else None


def best_titles(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 0.72, sure: float = 0.86, shared: float = 0.9) -> DataFrame:
    """(left_key, right_key, score, needs_review): for each left key its most similar right key by letters, from ``least`` on.

    Both sides are (key, title), any number of titles a key; each distinct title is searched once. In blocks of all pairs, a
    first match is found among the titles with most letters in common; then every title is scored whose letters allow
    ``least`` and no less than the first match, so none is missed. ``shared`` is of a former search and changes nothing."""
    a = left.select(F.col(left_key).alias("_a"), title_text(F.col("title")).alias("_x")).where("_x <> ''")
    b = right.select(F.col(right_key).alias("_b"), title_text(F.col("title")).alias("_y")).where("_y <> ''").groupBy("_y").agg(F.min("_b").alias("_b"))
    # Equal titles need no search; they are the best there can be.
    equal = a.join(b, F.col("_x") == F.col("_y")).groupBy("_a").agg(F.min("_b").alias("_b")).select("_a", "_b", F.lit(1.0).alias("score"))
    a = a.join(equal, "_a", "left_anti").distinct()
    found = _nearest(a.select("_x").distinct(), b, least).join(a, "_x").select("_a", "_b", "score").unionAll(equal)
    best = found.withColumn("_k", F.row_number().over(Window.partitionBy("_a").orderBy(F.desc("score"), "_b"))).where("_k = 1")
    return best.select(F.col("_a").alias(left_key), F.col("_b").alias(right_key), "score", (F.col("score") < sure).alias("needs_review"))


def _nearest(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(_x, _b, score) of the nearest of each block of right titles, no less than the best of the likely ones of all blocks."""
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n, m = blocks(a, LEFT_BLOCK), blocks(b, RIGHT_BLOCK)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    kind = dict(b.dtypes)["_b"]
    y = b.select("_b", "_y", F.pmod(F.xxhash64("_y"), F.lit(m)).cast("int").alias("_j"), each(n).alias("_i")).repartition(n * m, "_i", "_j")

    def by_blocks(left: DataFrame, search, columns: list[str], shape: str) -> DataFrame:
        def run(u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(u) and len(v):
                v = v.sort_values("_b", kind="stable")
                titles, keys = Titles(list(v["_y"])), list(v["_b"])
                for row in u.itertuples(index=False):
                    found += search(titles, keys, row)
            return pd.DataFrame(found, columns=columns)

        x = left.select("*", F.pmod(F.xxhash64("_x"), F.lit(n)).cast("int").alias("_i"), each(m).alias("_j")).repartition(n * m, "_i", "_j")
        return x.groupBy("_i", "_j").cogroup(y.groupBy("_i", "_j")).applyInPandas(run, shape)

    def likely(titles: Titles, keys: list, row) -> list[tuple]:
        return [(row[0], titles.texts[i], bound) for i, bound in titles.likely(row[0], least, LIKELY)]

    def nearest(titles: Titles, keys: list, row) -> list[tuple]:
        x, known = row[0], row[1]
        hit = titles.nearest(x, least if pd.isna(known) else max(least, known))
        return [(x, keys[hit[0]], hit[1])] if hit else []

    top = by_blocks(a.select("_x"), likely, ["_x", "_y", "_s"], "_x string, _y string, _s double")
    top = top.withColumn("_k", F.row_number().over(Window.partitionBy("_x").orderBy(F.desc("_s"), "_y"))).where(F.col("_k") <= LIKELY)
    # Scoring is CPU work on few bytes: spread over the cores, where adaptive execution would take one task.
    top = top.select("_x", "_y").repartition(a.sparkSession.sparkContext.defaultParallelism * 2, "_x")
    first = top.withColumn("_s", F.round(similarity("_x", "_y"), 6)).where(F.col("_s") >= least).groupBy("_x").agg(F.max("_s").alias("_s"))
    return by_blocks(a.join(first, "_x", "left").select("_x", "_s"), nearest, ["_x", "_b", "score"], f"_x string, _b {kind}, score double")
