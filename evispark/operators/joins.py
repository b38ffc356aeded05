"""Joins with the reference semantics spelt out: coalescing, approvals, change logs, lookups by level, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent_child(child: DataFrame, parent: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Every child row with its parent's columns; shared columns keep the child's value and take the parent's where it lacks."""
    renamed = parent.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_p_{c}") for c in parent.columns if c != key))
    out = child.join(renamed, child[key] == F.col("_key"), "left")
    kept = [F.coalesce(F.col(c), F.col(f"_p_{c}")).alias(c) if c in shared else F.col(c) for c in child.columns]
    extra = [F.col(f"_p_{c}").alias(c) for c in parent.columns if c != key and c not in child.columns]
    return out.select(*kept, *extra)


def approved_only(candidates: DataFrame, decisions: DataFrame, keys: list[str], status: str, word: str = "approved") -> DataFrame:
    """The candidates whose latest decision is an approval, each once; keys that are null match nothing."""
    yes = decisions.where(F.lower(F.trim(status)) == word).select(*keys).distinct()
    return candidates.join(yes, keys, "left_semi")


def change_log(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(key, before, after, change) of rows that are new, gone or changed."""
    a = before.select(F.col(key).alias("_a"), F.col(column).alias("before"), F.lit(True).alias("_in_a"))
    b = after.select(F.col(key).alias("_b"), F.col(column).alias("after"), F.lit(True).alias("_in_b"))
    full = a.join(b, F.col("_a") == F.col("_b"), "full")
    kind = (
        F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    return full.withColumn("change", kind).where("change is not null").select(F.coalesce("_a", "_b").alias(key), "before", "after", "change")


def by_level(df: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """df with value and level of the first lookup that has its keys; each lookup is (name, table, keys), unique in them."""
    out, values, names = df, [], []
    for i, (name, table, keys) in enumerate(levels):
        side = table.select(*(F.col(k).alias(f"_k{i}_{k}") for k in keys), F.col(value).alias(f"_v{i}"))
        if keys:
            condition = F.lit(True)
            for k in keys:
                condition = condition & (F.col(k) == F.col(f"_k{i}_{k}"))
            out = out.join(side, condition, "left")
        else:
            # The global level is one row.
            out = out.crossJoin(F.broadcast(side.limit(1)))
        values.append(F.col(f"_v{i}"))
        names.append(F.when(F.col(f"_v{i}").isNotNull(), name))
    return out.withColumns({value: F.coalesce(*values), "level": F.coalesce(*names)}).drop(*(c for c in out.columns if c.startswith(("_k", "_v"))))


def nearest(df: DataFrame, targets: list[dict], scales: dict[str, float], key: str) -> DataFrame:
    """(target, key, distance): for each target the row at the least scaled distance, 1 more for each value that lacks.

    The targets are literals, so the table is read once and each target is a minimum: no pairs are made."""
    aggs = []
    for i, t in enumerate(targets):
        d = sum((F.coalesce(F.pow((F.col(c) - t[c]) / s, 2), F.lit(1.0)) for c, s in scales.items()), F.lit(0.0))
        d = F.round(d, 9)
        aggs.append(F.struct(F.lit(i).alias("target"), F.min_by(key, F.struct(d, key)).alias(key), F.sqrt(F.min(d)).alias("distance")).alias(f"t{i}"))
    return df.agg(*aggs).select(F.inline(F.array(*(F.col(f"t{i}") for i in range(len(targets))))))


def semi_by(df: DataFrame, manifest: DataFrame, key: Column, other: Column, keep: bool = True) -> DataFrame:
    """Rows whose key is in the manifest, or, without keep, those whose key isn't (null keys included)."""
    ids = manifest.select(other.alias("_id")).where("_id is not null").distinct()
    return df.withColumn("_of", key).join(ids, F.col("_of") == F.col("_id"), "left_semi" if keep else "left_anti").drop("_of")


def replace_rows(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base without the rows whose keys are in new, and new; columns that one lacks are null."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
