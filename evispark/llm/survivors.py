"""Problem 5: the best representative of each duplicate group.

Skyline selection: a record is dominated by one that is no worse in completeness, recency and trust and better in one.
The undominated records are layer 1, those undominated without them layer 2, and so on. The survivor is the first of
layer 1 by the lexicographic policy (completeness, trust, recency, least key), and each field it lacks comes from the
first record that has it, by layer and policy.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.capping import moment, trusted
from evispark.session import Scratch

#: The fields whose filling is the completeness.
COMPLETENESS = (
    "doi", "post_processing", "laser_power_w", "scan_speed_mm_s", "hatch_spacing_um", "layer_thickness_um",
    "yield_strength_mpa", "uts_mpa", "elongation_percent", "hardness_hv", "stress_amplitude_mpa", "fatigue_life_cycles",
)
CONDITIONS = ("alloy", "am_process", "surface_condition", "heat_treatment", "build_orientation", "test_type")
#: Rows of a group beyond which it is thinned in parts first, and the parts.
LARGE_GROUP, PARTS = 5_000, 64


def _filled(df: DataFrame, names: tuple[str, ...]) -> dict:
    kinds = dict(df.dtypes)
    out = {}
    for c in names:
        if kinds[c] == "string":
            out[c] = F.when(F.regexp_replace(c, r"\s+", "") != "", F.col(c))
        elif kinds[c] in ("double", "float"):
            out[c] = F.when(~F.isnan(c), F.col(c))
        else:
            out[c] = F.col(c)
    return out


def _depths(points: list[tuple[float, ...]]) -> list[int]:
    """Dominance layer of each of distinct points in falling order, so that what dominates a point comes before it.

    A layer is kept as its staircase of second and third values (negated second rising, third rising). A point that is
    beaten in a layer is beaten in all before it, so its layer is found by bisection."""
    steps: list[tuple[list[float], list[float]]] = []
    out = []
    for _, y, z in points:
        low, high = 0, len(steps)
        while low < high:
            mid = (low + high) // 2
            ys, zs = steps[mid]
            i = bisect_right(ys, -y)
            if i and zs[i - 1] >= z:
                low = mid + 1
            else:
                high = mid
        if low == len(steps):
            steps.append(([], []))
        ys, zs = steps[low]
        i = j = bisect_left(ys, -y)
        while j < len(zs) and zs[j] <= z:
            j += 1
        ys[i:j], zs[i:j] = [-y], [z]
        out.append(low + 1)
    return out


def _layers(group: np.ndarray, criteria: np.ndarray) -> np.ndarray:
    """Dominance layer of each row within its group; rows are sorted by group. criteria: larger is better."""
    layer = np.ones(len(group), dtype="int32")
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        rows = list(map(tuple, criteria[a:b].tolist()))
        points = sorted(set(rows), reverse=True)
        depth = dict(zip(points, _depths(points)))
        layer[a:b] = [depth[x] for x in rows]
    return layer


def skyline_survivors(
    df: DataFrame, groups: DataFrame, scratch: Scratch, fields: tuple[str, ...] = COMPLETENESS + CONDITIONS, key: str = "row_id"
) -> DataFrame:
    """(g, survivor, n_records, n_layers, fields...) of each group in (key, g, n).

    A record dominated by one that is filled in the same fields can give nothing that the other doesn't, but it pushes others
    to deeper layers: of it only the criteria are kept, once for all records that share them. That is done in parts where a
    group is large, so no group's records are ever whole in one task, only its distinct criteria. Null, blank and NaN count as lacking; ties end at the least key; fields that
    the table lacks are ignored; empty in, empty out."""
    counted = tuple(c for c in COMPLETENESS if c in df.columns)
    fields = tuple(c for c in fields if c in df.columns)
    names = tuple(dict.fromkeys(counted + fields))
    have = _filled(df, names)
    pattern = sum((F.when(have[c].isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    complete = sum((have[c].isNotNull().cast("int") for c in counted), F.lit(0))
    rows = df.select(
        F.col(key).alias("k"), pattern.alias("pattern"), complete.alias("complete"), trusted(F.col("confidence")).alias("q"),
        moment(F.col("extracted_at")).alias("t"), *(have[c].alias(c) for c in fields),
    ).join(groups.select(F.col(key).alias("k"), "g", "n"), "k")
    part = F.when(F.col("n") > LARGE_GROUP, F.pmod(F.xxhash64("k"), F.lit(PARTS))).otherwise(0)
    rows = rows.withColumn("part", part)
    points = rows.select("g", "n", "complete", "q", "t").distinct()
    for by in (("g", "pattern", "part"), ("g", "pattern")):
        w = Window.partitionBy(*by).orderBy(F.desc("q"), F.desc("t"), "k").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("newest", F.max("t").over(w)).where("newest is null or t > newest").drop("newest")
    buckets = max(1, min(4096, groups.count() // 20_000 + 1))
    shape = "g string, survivor bigint, n_records bigint, n_layers int" + "".join(f", {c} {dict(df.dtypes)[c]}" for c in fields)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", kind="stable").reset_index(drop=True)
        codes = pd.factorize(pdf["g"])[0]
        pdf["layer"] = _layers(codes, pdf[["complete", "q", "t"]].to_numpy(dtype="float64"))
        deepest = pdf.groupby("g", sort=False)["layer"].max()
        pdf = pdf[pdf["own"]].astype({"k": "int64"})
        pdf = pdf.sort_values(["g", "layer", "complete", "q", "t", "k"], ascending=[True, True, False, False, False, True], kind="stable")
        by = pdf.groupby("g", sort=False)
        out = by[["k", "n", *fields]].first().reset_index()
        out.insert(3, "n_layers", out["g"].map(deepest).astype("int32"))
        return out.rename(columns={"k": "survivor", "n": "n_records"})

    rows = rows.drop("pattern", "part").withColumn("own", F.lit(True)).unionByName(points.withColumn("own", F.lit(False)), allowMissingColumns=True)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        lambda pdf: choose(pdf.drop(columns="bucket")), shape
    )
