"""Rows chosen within groups: best rows, first and last ones, even samples, sequence numbers, balanced and capped picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import Scratch


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return best_per_key(df, keys, *(F.desc(c) for c in order))


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """At most k rows of each key; map tasks keep k of each before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def ranked(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """df with _i, each row's place from 0 within its key, and _n, the key's rows.

    Rows are laid out by ranges of key and order, ranked within a range, and shifted by the key's rows in earlier ranges:
    a key with a third of all rows spreads over a third of the ranges. Nulls come first. The order must be total."""
    spark = df.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = scratch.keep(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    per = laid.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    shift = per.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_range").alias("_at"), (F.sum("_c").over(whole.orderBy("_range")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    out = laid.withColumn("_r", inner).join(shift, same).withColumn("_i", F.col("_r") + F.col("_before"))
    return out.select(*df.columns, "_i", "_n")


def even_sample(df: DataFrame, keys: list[str], k: int, order: list[str], scratch: Scratch) -> DataFrame:
    """At most k rows of each key, evenly spaced over the order, both ends included (places rounded half to even)."""
    numbered = ranked(df, keys, order, scratch)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / (k - 1), 0).cast("int"))
    return numbered.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i").cast("int"))).drop("_i", "_n")


def numbered(df: DataFrame, prefix: str, by: list[str], order: list[str], scratch: Scratch, width: int = 6, name: str = "sequence_id") -> DataFrame:
    """Sequential ids prefix_000001 within each group of ``by``."""
    place = F.lpad((F.col("_i") + 1).cast("string"), width, "0")
    return ranked(df, by, order, scratch).withColumn(name, F.concat(F.lit(prefix + "_"), place)).drop("_i", "_n")


def balanced(df: DataFrame, group: str, least: int, target: int, key: list[str], *order: Column) -> DataFrame:
    """Up to ``least`` of each group first, then the best of the rest until ``target`` rows; a top-k report.

    Both picks are limited before their shuffle; no group is ranked whole."""
    seeds = top_per_key(df, [group], least, *order).drop("rank").withColumn("seeded", F.lit(True))
    rest = df.join(seeds.select(*key), key, "left_anti").orderBy(*order).limit(target).withColumn("seeded", F.lit(False))
    return seeds.unionByName(rest).orderBy(F.desc("seeded"), *order).limit(target)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows on every run and machine."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def group_key(*candidates: Column, fallback: Column) -> Column:
    """The first candidate that isn't blank, else the row's own fallback."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates), fallback)


def equal_weights(df: DataFrame, key: str, name: str = "weight") -> DataFrame:
    """Weights by which every group counts the same, with mean 1. The sizes are aggregated and joined, not windowed."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups"))
    factor = sizes.crossJoin(F.broadcast(totals)).select(key, (F.col("_rows") / (F.col("_n") * F.col("_groups"))).alias(name))
    return df.join(factor.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def holdout(groups: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, is_test): the ceil(share) of the groups that come first by hash. No group is on both sides."""
    ranked = _hash_ranked(groups, key, seed)
    return ranked.select(key, (F.col("_rank") <= F.ceil(F.col("_n") * share)).alias("is_test"))


def folds(groups: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold): folds that differ by one group at most."""
    return _hash_ranked(groups, key, seed).select(key, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold"))


#: Ranges of the hash that are ranked apart, so that no window holds all groups.
PARTS = 256


def _hash_ranked(groups: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct groups with their rank by md5(key:seed), and how many there are.

    Ranked within the first byte of the hash, then shifted by the counts of the bytes before, 256 rows that are broadcast."""
    h = groups.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    h = h.withColumn("_b", F.substring("_h", 1, 2))
    counts = h.groupBy("_b").agg(F.count("*").alias("_c"))
    w = Window.orderBy("_b")
    shift = counts.select(F.col("_b"), (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_n"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return h.withColumn("_r", inner).join(F.broadcast(shift), "_b").withColumn("_rank", F.col("_r") + F.col("_before"))
