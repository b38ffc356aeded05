"""Aggregations: metrics, quantiles, ranks, coverage, grouping sets, concordance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import Scratch


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys, n, mae, rmse, r2) over pairs of finite numbers; r2 is null under two rows or without spread."""
    a, b = F.col(y), F.col(p)
    pairs = df.where(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    sse, sst = F.sum((a - b) * (a - b)), F.var_pop(a) * F.count("*")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(a - b)).alias("mae"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"),
        F.when((F.count("*") >= 2) & (sst > 0), 1 - sse / sst).alias("r2"),
    )


def conformal_radius(df: DataFrame, keys: list[str], residual: Column, scratch: Scratch, level: float = 0.9) -> DataFrame:
    """(keys, n, radius): the "higher" quantile of absolute residuals at min(1, ceil((n + 1) level) / n).

    Places come from ranges, so a key with a third of all rows is ranked in many tasks."""
    from evispark.operators.selection import ranked

    rows = df.select(*keys, F.abs(residual).alias("_gap")).where("_gap is not null and not isnan(_gap)")
    q = F.least(F.lit(1.0), F.ceil((F.col("_n") + 1) * level) / F.col("_n"))
    return ranked(rows, keys, ["_gap"], scratch).where(F.col("_i") == F.ceil(q * (F.col("_n") - 1))).select(*keys, F.col("_n").alias("n"), F.col("_gap").alias("radius"))


def single_column_sets(df: DataFrame, columns: list[str], *aggs: Column, least: int = 1) -> DataFrame:
    """One block of groups for each column, in one pass by grouping sets; null groups are left out."""
    sets = [[F.col(c)] for c in columns]
    shown = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))
    grouped = df.groupingSets(sets, *columns).agg(F.count("*").alias("n_rows"), shown.alias("group_column"), *aggs)
    value = F.coalesce(*(F.col(c).cast("string") for c in columns))
    return grouped.withColumn("group_value", value).where(F.col("group_value").isNotNull() & (F.col("n_rows") >= least)).drop(*columns)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, scratch: Scratch, least: int = 5) -> DataFrame:
    """(keys, n, rho): correlation of average ranks, where there are enough pairs.

    Ranks come from ranges, and equal values share the mean of their places, so no group is ranked whole in one task."""
    from evispark.operators.selection import ranked

    pairs = scratch.keep(df.select(*keys, x, y).where(f"{x} is not null and {y} is not null"))
    out = pairs
    for c, name in ((x, "_rx"), (y, "_ry")):
        places = ranked(pairs.select(*keys, c), keys, [c], scratch)
        ranks = places.groupBy(*keys, c).agg((F.avg("_i") + 1).alias(name)).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col(c).alias("_at"), name)
        same = F.col(c) == F.col("_at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        out = out.join(ranks, same).drop("_at", *(f"_of_{k}" for k in keys))
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho")).where(F.col("n") >= least)


def iqr(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, iqr): between linear quartiles; the deviation of all where that is 0, and 1 where that is 0 too."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    out = df.groupBy(*keys).agg((F.get(q, F.lit(1)) - F.get(q, F.lit(0))).alias("_w"), F.stddev_pop(column).alias("_s"))
    return out.select(*keys, F.when(F.col("_w") > 0, F.col("_w")).when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("iqr"))


def medoid(df: DataFrame, keys: list[str], columns: list[str], key: str) -> DataFrame:
    """The row of each group nearest to the medians, each column scaled by its quartile range; missing values count as the
    median. The medians are aggregated and joined, the nearest row is a minimum."""
    aggs = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.get(q, F.lit(1)).alias(f"_m_{c}"), (F.get(q, F.lit(2)) - F.get(q, F.lit(0))).alias(f"_w_{c}")]
    middle = df.groupBy(*keys).agg(*aggs)
    distance = sum(
        (F.pow(F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_w_{c}") > 0, F.col(f"_w_{c}")).otherwise(1.0), F.lit(0.0)), 2) for c in columns),
        F.lit(0.0),
    )
    near = df.join(middle, keys).withColumn("_d", F.round(distance, 9))
    return near.groupBy(*keys).agg(F.min_by(key, F.struct("_d", key)).alias(key), F.min("_d").alias("distance"))


def dominance(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, share): the largest source's share of a group's rows; 1 without sources."""
    by = df.groupBy(*keys, source).agg(F.count(source).alias("n"))
    return by.groupBy(*keys).agg(F.coalesce(F.max("n") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)).alias("dominance"))


def coverage(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """(feature, n_filled, share, n_values, n_sources): one row for each column, by unpivoting once."""
    long = df.select(source, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return long.select(source, "x.*").groupBy("feature").agg(
        F.count("value").alias("n_filled"), (F.count("value") / F.count("*")).alias("share"),
        F.countDistinct("value").alias("n_values"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col(source))).alias("n_sources"),
    )


def _lower_later(order: list, risk: list, weight: list, rows: list) -> tuple[float, float]:
    """(pairs, concordant) of weighted rows with a strictly later order, where lower risks count one, equal ones a half.

    Swept from the last order on, with a tree of sums over risk ranks."""
    ranks = pd.Series(risk).rank(method="dense").astype(int).tolist() if risk else []
    top = max(ranks, default=0)
    tree = [0] * (top + 1)

    def below(i: int) -> int:
        total = 0
        while i > 0:
            total += tree[i]
            i -= i & -i
        return total

    places = sorted(range(len(order)), key=lambda i: order[i], reverse=True)
    pairs = good = 0.0
    i = seen = 0
    while i < len(places):
        j = i
        while j < len(places) and order[places[j]] == order[places[i]]:
            j += 1
        for k in places[i:j]:
            if weight[k]:
                under, upto = below(ranks[k] - 1), below(ranks[k])
                pairs += weight[k] * seen
                good += weight[k] * (under + 0.5 * (upto - under))
        for k in places[i:j]:
            r = ranks[k]
            while r <= top:
                tree[r] += rows[k]
                r += r & -r
            seen += rows[k]
        i = j
    return pairs, good


def _block(value: str, bounds: Column) -> Column:
    """Odd for a value that is a bound, even between bounds: a value that many rows share has a block of its own."""
    under = F.size(F.filter(bounds, lambda b: b < F.col(value)))
    return 2 * under + F.array_contains(bounds, F.col(value)).cast("int")


def concordance(df: DataFrame, keys: list[str], time: str, event: str, risk: str, scratch: Scratch, block: int = 50_000, most: int = 256) -> DataFrame:
    """(keys, n_pairs, c_index): Harrell's concordance under right censoring; equal risks count a half.

    A pair counts where the earlier row is an event and the later time is greater. Equal rows are one weighted row. Times
    and risks are cut into blocks of about ``block`` rows (at most ``most``) at approximate quantiles. Pairs that differ in
    both blocks are counted from the grid of block counts, those of one risk block by risk and time block, those of one
    time block by sweeping it: exact, and no task holds more than a block or the grid. Keys without a pair have a null."""
    kinds = dict(df.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in keys)
    rows = df.select(*keys, F.col(time).cast("double").alias("_t"), F.col(event).alias("_e"), F.col(risk).cast("double").alias("_r"))
    rows = rows.where("_t is not null and _r is not null and not isnan(_t) and not isnan(_r)")
    rows = rows.groupBy(*keys, "_t", "_r").agg(F.count_if(F.col("_e")).alias("_w"), F.count("*").alias("_n"))
    shares = F.array(*(F.lit(i / most) for i in range(1, most)))
    cuts = rows.groupBy(*keys).agg(F.count("*").alias("_size"), F.percentile_approx("_t", shares, 10_000).alias("_bt"), F.percentile_approx("_r", shares, 10_000).alias("_br"))
    step = F.greatest(F.lit(1), F.floor(F.lit(most * block) / F.col("_size"))).cast("int")
    few = lambda c: F.array_distinct(F.filter(c, lambda _, i: (i + 1) % step == 0))
    cuts = cuts.select(*(F.col(k).alias(f"_of_{k}") for k in keys), few("_bt").alias("_bt"), few("_br").alias("_br"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    placed = rows.join(cuts, same).select(*keys, "_t", "_r", "_w", "_n", _block("_t", F.col("_bt")).alias("_tb"), _block("_r", F.col("_br")).alias("_rb"))
    placed = scratch.keep(placed)

    def out(pdf: pd.DataFrame, pairs: float, good: float) -> pd.DataFrame:
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "_pairs": [pairs], "_good": [good]})

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf.pivot_table(index="_tb", columns="_rb", values=["_w", "_n"], aggfunc="sum", fill_value=0)
        w, n = cells["_w"].to_numpy(dtype="float64"), cells["_n"].to_numpy(dtype="float64")
        later = n[::-1].cumsum(axis=0)[::-1] - n
        lower = later.cumsum(axis=1) - later
        return out(pdf, float((w.sum(axis=1) * later.sum(axis=1)).sum()), float((w * lower).sum()))

    def one_risk_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return out(pdf, 0.0, _lower_later(*(pdf[c].tolist() for c in ("_tb", "_r", "_w", "_n")))[1])

    def one_time_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return out(pdf, *_lower_later(*(pdf[c].tolist() for c in ("_t", "_r", "_w", "_n"))))

    schema = (head + ", " if head else "") + "_pairs double, _good double"
    sums = [F.sum("_w").alias("_w"), F.sum("_n").alias("_n")]
    parts = placed.groupBy(*keys, "_tb", "_rb").agg(*sums).groupBy(*keys).applyInPandas(grid, schema)
    parts = parts.unionAll(placed.groupBy(*keys, "_rb", "_tb", "_r").agg(*sums).groupBy(*keys, "_rb").applyInPandas(one_risk_block, schema))
    # A time block of one time has no pairs within.
    parts = parts.unionAll(placed.where("_tb % 2 = 0").groupBy(*keys, "_tb").applyInPandas(one_time_block, schema))
    total = parts.groupBy(*keys).agg(F.sum("_pairs").cast("bigint").alias("n_pairs"), F.sum("_good").alias("_good"))
    return total.select(*keys, "n_pairs", (F.col("_good") / F.nullif(F.col("n_pairs"), F.lit(0))).alias("c_index"))


def normalised(df: DataFrame, keys: list[str], value: str, name: str = "fraction") -> DataFrame:
    """Values without negatives as shares of their group; 0 where the group has none."""
    clipped = F.greatest(F.col(value), F.lit(0.0))
    total = df.groupBy(*keys).agg(F.sum(clipped).alias("_total"))
    return df.join(total, keys).withColumn(name, F.when(F.col("_total") > 0, clipped / F.col("_total")).otherwise(0.0)).drop("_total")
