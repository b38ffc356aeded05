"""Log-log curves by level, survival expressions, isotonic calibration, monotone scans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.session import Scratch

#: Least rows of a curve by level: whole, family, family and ratio bin.
LEAST_ROWS = {"global": 100, "family": 50, "family_ratio": 30}


def hierarchical_curves(df: DataFrame, family: str, ratio: str, x: Column, y: Column, least: dict[str, int] | None = None) -> DataFrame:
    """(level, family, ratio, n, slope, intercept, usable) of y over x at three levels, in one pass by grouping sets.

    A curve is usable with enough rows, three distinct x and a falling slope."""
    rows = df.select(F.coalesce(family, F.lit("missing")).alias("family"), F.coalesce(ratio, F.lit("missing")).alias("ratio"), x.alias("x"), y.alias("y"))
    rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    sets = [[], [F.col("family")], [F.col("family"), F.col("ratio")]]
    out = rows.groupingSets(sets, "family", "ratio").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.countDistinct("x").alias("n_x"),
    )
    level = F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "family").otherwise("family_ratio")
    need = F.lit(0)
    for name, n in (least or LEAST_ROWS).items():
        need = F.when(level == name, n).otherwise(need)
    return out.select(
        level.alias("level"), "family", "ratio", "n", "slope", "intercept",
        ((F.col("n") >= need) & (F.col("n_x") >= 3) & (F.col("slope") < 0)).alias("usable"),
    )


def monotone(df: DataFrame, keys: list[str], order: str, value: str, scratch: Scratch, falling: bool = True, slack: float = 1e-12) -> DataFrame:
    """(keys, n, monotone): whether values never rise (or never fall) in the given order, whose values are unique in a key.

    Each row is joined to the one before it by their places, which come from ranges: no window holds a group."""
    from evispark.operators.selection import ranked

    placed = scratch.keep(ranked(df.select(*keys, order, value), keys, [order], scratch))
    before = placed.select(*(F.col(k).alias(f"_of_{k}") for k in keys), (F.col("_i") + 1).alias("_at"), F.col(value).alias("_before"))
    same = F.col("_i") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    step = F.col(value) - F.col("_before")
    bad = (step > slack) if falling else (step < -slack)
    return placed.join(before, same, "left").withColumn("_bad", bad).groupBy(*keys).agg(F.count("*").alias("n"), (~F.coalesce(F.bool_or("_bad"), F.lit(False))).alias("monotone"))


def stress_scan(curves: DataFrame, low: float, high: float, points: int = 50) -> DataFrame:
    """Each curve over geometrically spaced stresses: (..., step, stress, log_life)."""
    ratio = math.log(high / low)
    stepped = curves.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    stress = F.lit(low) * F.exp(F.col("step") * ratio / (points - 1))
    return stepped.withColumn("stress", stress).withColumn("log_life", F.col("intercept") + F.col("slope") * F.log10("stress"))


def survival_probability(location: Column, scale: float, at: float, family: str) -> Column:
    """P(life > at) for log lives around a location: logistic, or extreme (least) value."""
    z = (F.lit(math.log(at)) - F.log(location)) / scale
    if family == "logistic":
        return 1 / (1 + F.exp(z))
    if family == "extreme":
        return F.exp(-F.exp(z))
    if family == "normal":
        return _normal_tail(z)
    raise ValueError("logistic, extreme or normal")


def _normal_tail(z: Column) -> Column:
    from statistics import NormalDist

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else 1.0 - NormalDist().cdf(v)).astype("float64")

    return tail(z)


def life_quantile(location: Column, scale: float, q: float, family: str) -> Column:
    """The life that a share q does not exceed."""
    if family == "logistic":
        z = math.log(q / (1 - q))
    elif family == "extreme":
        z = math.log(-math.log(1 - q))
    else:
        from statistics import NormalDist

        z = NormalDist().inv_cdf(q)
    return F.exp(F.log(location) + scale * z)


def threshold_label(life: Column, event: Column, threshold: float) -> Column:
    """0: failed before, 1: lived at least so long, null: censored before."""
    return F.when(life >= threshold, 1).when(event & (life < threshold), 0)


def isotonic(df: DataFrame, keys: list[str], score: str, label: str, scratch: Scratch) -> DataFrame:
    """(keys, score, value): a rising step function through the labels, by pooling adjacent violators.

    Equal scores are one point. Points are pooled within ranges of the scores first; what is left of each range, its rising
    blocks, is pooled again for the whole key. That gives the same steps as one pass over all points, and a task holds a
    range or the blocks, never all points of a key."""
    kinds = dict(df.dtypes)
    spark = df.sparkSession
    points = df.groupBy(*keys, F.col(score).cast("double").alias("_x")).agg(F.sum(F.col(label).cast("double")).alias("_s"), F.count(label).alias("_n")).where("_n > 0")
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = scratch.keep(points.repartitionByRange(ranges, *keys, "_x").withColumn("_range", F.spark_partition_id()))
    head = "".join(f"{c} {kinds[c]}, " for c in keys)

    def pooled(pdf: pd.DataFrame, at: str) -> tuple[pd.DataFrame, list[list[float]]]:
        pdf = pdf.sort_values(at)
        blocks: list[list[float]] = []
        for s, n in zip(pdf["_s"], pdf["_n"]):
            blocks.append([s, n, 1])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s2, n2, k2 = blocks.pop()
                blocks[-1][0] += s2
                blocks[-1][1] += n2
                blocks[-1][2] += k2
        return pdf, blocks

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, blocks = pooled(pdf, "_x")
        size = np.array([k for _, _, k in blocks])
        first = np.cumsum(size) - size
        out = {**{c: pdf[c] for c in keys}, "_x": pdf["_x"], "_block": np.repeat(pdf["_x"].to_numpy()[first], size)}
        return pd.DataFrame({**out, "_s": np.repeat([s for s, _, _ in blocks], size), "_n": np.repeat([n for _, n, _ in blocks], size)})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, blocks = pooled(pdf, "_block")
        return pd.DataFrame({**{f"_of_{c}": pdf[c] for c in keys}, "_at": pdf["_block"], "value": [s / n for s, n, k in blocks for _ in range(k)]})

    parts = scratch.keep(laid.groupBy(*keys, "_range").applyInPandas(within, f"{head}_x double, _block double, _s double, _n double"))
    steps = parts.where("_x = _block").groupBy(*keys).applyInPandas(across, "".join(f"_of_{c} {kinds[c]}, " for c in keys) + "_at double, value double")
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return parts.join(steps, same).select(*keys, F.col("_x").alias(score), "value")


def break_points(steps: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, points): both ends of each step of an isotonic function, in rising order; as many as it has steps, not points."""
    blocks = steps.groupBy(*keys, "value").agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    ends = blocks.select(*keys, F.explode(F.array_distinct(F.array("_low", "_high"))).alias("x"), F.col("value").alias("y"))
    return ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


def interpolated(points: Column, at: Column) -> Column:
    """Linear between the points, level beyond their ends; null without points."""
    low = F.try_element_at(F.filter(points, lambda p: p["x"] <= at), F.lit(-1))
    high = F.try_element_at(F.filter(points, lambda p: p["x"] >= at), F.lit(1))
    part = (at - low["x"]) / F.nullif(high["x"] - low["x"], F.lit(0.0))
    return F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(low["y"] + F.coalesce(part, F.lit(0.0)) * (high["y"] - low["y"]))
