"""The modelling views and the pieces they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.operators import selection as S
from evispark.session import Scratch


def coalesced(df: DataFrame) -> DataFrame:
    """Columns that were named apart as x, x.1, x.2 as one: the first of them that is filled. Order of first appearance."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        stem, _, number = c.rpartition(".")
        groups.setdefault(stem if number.isdigit() and stem in df.columns else c, []).append(c)
    return df.select(*(F.coalesce(*(F.col(f"`{c}`") for c in cs)).alias(n) for n, cs in groups.items()))


def mapping_report(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(original, normalised, mapped, is_mapped) of (original): the standard column of each header, blank where none."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("standard").alias("_standard"))
    named = headers.select("original", C.header_name("original").alias("normalised"))
    out = named.join(F.broadcast(known), F.col("normalised") == F.col("_alias"), "left")
    return out.select("original", "normalised", F.coalesce("_standard", F.lit("")).alias("mapped"), F.col("_standard").isNotNull().alias("is_mapped"))


def task_type(crack: tuple[str, ...], fatigue: tuple[str, ...], static: tuple[str, ...]) -> Column:
    """What a record is about, by the first group of columns of which one is filled."""
    any_of = lambda cs: F.coalesce(*(C.finite(c) for c in cs)).isNotNull() if cs else F.lit(False)
    return F.when(any_of(crack), "crack_growth").when(any_of(fatigue), "sn_fatigue").when(any_of(static), "static_tensile").otherwise("unknown")


def sheet_task(c: str | Column) -> Column:
    """The task that a sheet's name tells; the first rule that holds."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    has = lambda *words: F.lit(False) if not words else F.greatest(*(F.contains(t, F.lit(w)) for w in words), F.lit(False))
    return (
        F.when(has("parameter"), "parameter_static").when(has("sn", "s-n"), "sn_fatigue").when(has("en", "e-n", "strain"), "strain_life_fatigue")
        .when(has("dadn", "da/dn", "crack"), "crack_growth").otherwise(F.concat(F.lit("fatigue_"), t))
    )


def static_view(rows: DataFrame, name: str, targets: list[str], keys: list[str], score: list[str], *tie: Column) -> DataFrame:
    """The rows in which a target is filled, for each key the one with most information."""
    filled = rows.where(F.coalesce(*(C.finite(c) for c in targets)).isNotNull())
    points = sum((C.finite(c).isNotNull().cast("int") for c in score), F.lit(0))
    best = S.best_per_key(filled.withColumn("score", points), keys, F.desc("score"), *tie)
    return best.withColumns({"view_name": F.lit(name), "sample_weight": F.lit(1.0)})


def sn_view(rows: DataFrame, key: str, group: Column, life: str, loads: list[str], scratch: Scratch, most: int = 10) -> DataFrame:
    """(key, view_name, modelling_group_id, log_life, load, sample_weight): fatigue rows with a life and a load, at most
    ``most`` of each group evenly over its curve, every group weighing the same."""
    log = C.log_life(F.col(life))
    load = F.coalesce(*(C.finite(c) for c in loads))
    good = rows.select(key, group.alias("modelling_group_id"), log.alias("log_life"), load.alias("load")).where("log_life is not null and load is not null")
    even = S.even_sample(good, ["modelling_group_id"], most, ["load", key], scratch)
    return S.equal_weights(scratch.keep(even), "modelling_group_id", "sample_weight").withColumn("view_name", F.lit("sn_fatigue"))


def domain_key(*parts: str | Column) -> Column:
    """The parts of a domain joined by bars, missing ones as "missing"."""
    return F.concat_ws("|", *(F.coalesce(C.filled(p), F.lit("missing")) for p in parts))


def combination_holdout(rows: DataFrame, columns: list[str], group: str, least: int = 20, groups: int = 2, share: float = 0.5) -> DataFrame:
    """(columns, n_rows, n_groups) of the largest combination that has enough rows and groups, but not most of the rows: the
    one to hold out. One row, or none."""
    named = rows.select(group, *(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing")).alias(c) for c in columns))
    sized = named.groupBy(*columns).agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"))
    total = rows.agg(F.count("*").alias("_of"))
    good = sized.crossJoin(F.broadcast(total)).where((F.col("n_rows") >= least) & (F.col("n_groups") >= groups) & (F.col("n_rows") < share * F.col("_of")))
    return good.drop("_of").orderBy(F.desc("n_rows"), F.desc("n_groups"), *columns).limit(1)


def metric_parts(rows: DataFrame, keys: list[str], y: str, p: str, half_width: str) -> DataFrame:
    """(keys, mae, nmae, hit_rate, half_width, width_over_iqr): errors against the spread of the target, and how often and
    how tightly the interval holds it."""
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.75)))
    error = F.abs(F.col(y) - F.col(p))
    out = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.avg(error).alias("mae"), (F.get(q, F.lit(1)) - F.get(q, F.lit(0))).alias("_iqr"),
        F.avg((error <= F.col(half_width)).cast("double")).alias("hit_rate"), F.median(half_width).alias("half_width"),
    )
    iqr = F.when(F.col("_iqr") > 0, F.col("_iqr"))
    return out.select(*keys, "mae", (F.col("mae") / iqr).alias("nmae"), "hit_rate", "half_width", (2 * F.col("half_width") / iqr).alias("width_over_iqr"))


def merged_registry(old: DataFrame, new: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """The rows of both; a key that both have is an error, or the new row's with ``replace``."""
    if not replace and (clash := old.join(new.select(key), key, "left_semi").select(key).limit(5).collect()):
        raise ValueError(f"keys in both registries: {[r[0] for r in clash]}")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
