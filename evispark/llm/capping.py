"""Problem 2: capping records per dominant contributor.

A contributor's cap is split over its strata (topics or periods) by largest-remainder apportionment, in proportion to
their rows or evenly with spare slots passed on; inside a stratum rows are ranked by quality. With one stratum the cap is
a plain ranking. Only the row at the end of each quota is looked up: its rank is joined back to all rows, so no group is
ever collected. The ranking keeps at most ``cap`` rows of a group in each map task before its shuffle, which is what
makes a contributor with a third of all rows harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LAST = -(1 << 63) + 1


def trusted(confidence: Column) -> Column:
    """The confidence; -1 where it is missing, NaN or outside 0 to 1, so that these come last, as equals."""
    return F.when(confidence.between(0.0, 1.0) & ~F.isnan(confidence), confidence).otherwise(-1.0)


def moment(at: Column) -> Column:
    """Microseconds; the least number where the time is missing."""
    return F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(_LAST))


def _quotas(sizes: DataFrame, cap: int, weights: str) -> DataFrame:
    """(c, st, quota) from (c, st, n) of contributors beyond the cap."""
    whole = Window.partitionBy("c")
    if weights == "proportional":
        # cap * n / N in whole numbers: never more than n, so no slot is left over.
        share = sizes.withColumn("of", F.sum("n").over(whole)).where(F.col("of") > cap)
        share = share.withColumn("base", F.expr(f"{cap} * n div of")).withColumn("rest", F.expr(f"{cap} * n % of"))
        order = whole.orderBy(F.desc("rest"), F.desc("n"), F.asc_nulls_last("st"))
        spare = cap - F.sum("base").over(whole)
        return share.select("c", "st", (F.col("base") + (F.row_number().over(order) <= spare).cast("bigint")).alias("quota"))
    if weights != "equal":
        raise ValueError("weights: proportional or equal")
    # Evenly, where a stratum smaller than its part passes its spare slots on: fill from the smallest stratum.
    rising = whole.orderBy("n", F.asc_nulls_last("st"))
    s = (
        sizes.withColumn("of", F.sum("n").over(whole)).where(F.col("of") > cap)
        .withColumn("before", F.sum("n").over(rising) - F.col("n"))
        .withColumn("to_go", F.count("*").over(whole) - F.row_number().over(rising) + 1)
        .withColumn("full", F.col("n") * F.col("to_go") <= F.lit(cap) - F.col("before"))
    )
    s = s.withColumn("rest", cap - F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))).over(whole), F.lit(0)))
    s = s.withColumn("open", F.sum((~F.col("full")).cast("bigint")).over(whole))
    order = Window.partitionBy("c", "full").orderBy(F.desc("n"), F.asc_nulls_last("st"))
    even = F.expr("rest div greatest(open, 1)") + (F.row_number().over(order) <= F.expr("rest % greatest(open, 1)")).cast("bigint")
    return s.select("c", "st", F.when(F.col("full"), F.col("n")).otherwise(even).alias("quota"))


def cap_contributors(
    df: DataFrame, contributor: Column, cap: int = 25, stratum: Column | None = None, weights: str = "proportional",
    confidence: str = "confidence", at: str = "extracted_at", key: str = "row_id",
) -> DataFrame:
    """(key, contributor, stratum, kept) of every row.

    Order inside a stratum: confidence descending (see trusted), time descending (missing last), key ascending; key is
    unique, repeated records with their own keys count each. Rows without contributor are kept. A null stratum is a
    stratum of its own. Extra columns are ignored; an empty table gives an empty result."""
    if cap < 1:
        raise ValueError("the cap is at least 1")
    one = F.lit(0) if stratum is None else stratum
    rows = df.select(
        F.col(key).alias("k"), contributor.alias("c"), one.alias("st"), trusted(F.col(confidence)).alias("q"), moment(F.col(at)).alias("t")
    )
    sizes = rows.where("c is not null").groupBy("c", "st").agg(F.count("*").alias("n"))
    quotas = _quotas(sizes, cap, weights)
    best = Window.partitionBy("c", "st").orderBy(F.desc("q"), F.desc("t"), "k")
    top = rows.where("c is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap)
    # The quotas' columns are named apart: both sides come from the same rows.
    quotas = quotas.select(F.col("c").alias("ec"), F.col("st").alias("es"), "quota")
    top = top.select(F.col("c").alias("tc"), F.col("st").alias("ts"), "rank", F.col("q").alias("eq"), F.col("t").alias("et"), F.col("k").alias("ek"))
    ends = quotas.join(top, F.expr("ec = tc and es <=> ts and quota = rank"), "left").drop("tc", "ts", "rank")
    within = (F.col("q") > F.col("eq")) | (
        (F.col("q") == F.col("eq")) & ((F.col("t") > F.col("et")) | ((F.col("t") == F.col("et")) & (F.col("k") <= F.col("ek"))))
    )
    return rows.join(ends, F.expr("c = ec and st <=> es"), "left").select(
        F.col("k").alias(key), F.col("c").alias("contributor"), F.col("st").alias("stratum"),
        F.when(F.col("quota").isNull(), True).when(F.col("quota") == 0, False).otherwise(within).alias("kept"),
    )
