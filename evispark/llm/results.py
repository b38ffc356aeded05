"""Test results that are the same: what problems 4 and 5 share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.components import connected_components
from evispark.llm.text import doi_key, source_key
from evispark.session import Scratch

#: Measured columns and how far two written values of one result may be apart: whole MPa, three digits of a life, two
#: decimals of its logarithm; the others are written as they are.
MEASURES = {
    "yield_strength_mpa": "mpa", "uts_mpa": "mpa", "elongation_percent": "tenth", "youngs_modulus_gpa": "tenth",
    "hardness_hv": "half", "stress_amplitude_mpa": "mpa", "max_stress_mpa": "mpa", "r_ratio": "equal",
    "frequency_hz": "equal", "fatigue_life_cycles": "digits", "log10_fatigue_life_cycles": "log",
}
ANCHORS = ("uts_mpa", "stress_amplitude_mpa")


def _close(kind: str, a: Column, b: Column) -> Column:
    if kind == "digits":
        return F.abs(a - b) <= 0.00503 * F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= {"mpa": 0.5 + 1e-6, "half": 0.5 + 1e-6, "tenth": 0.05 + 1e-6, "log": 0.005 + 1e-6, "equal": 1e-9}[kind]


def measures_of(df: DataFrame) -> list[str]:
    return [m for m in MEASURES if m in df.columns]


def agreement(a: DataFrame, b: DataFrame, measures: list[str], left: str = "", right: str = "") -> Column:
    """uts_mpa or stress_amplitude_mpa filled in both, and every measure filled in both agrees."""
    anchored, all_close = F.lit(False), F.lit(True)
    for m in measures:
        x, y = a[left + m], b[right + m]
        if m in ANCHORS:
            anchored = anchored | (x.isNotNull() & y.isNotNull())
        all_close = all_close & F.coalesce(_close(MEASURES[m], x, y), F.lit(True))
    return anchored & all_close


def with_publication(df: DataFrame, pubs: DataFrame) -> DataFrame:
    """df with pub: the publication of its source_id; inside a collection the DOI, or the record without one."""
    joined = df.withColumn("s", source_key("source_id")).join(pubs, "s", "left")
    inside = F.coalesce(F.concat(F.lit("doi:"), doi_key("doi")), F.concat(F.lit("rec:"), F.coalesce("record_id", F.lit(""))))
    return joined.withColumn("pub", F.when(F.col("many"), inside).otherwise(F.coalesce("pub", "s"))).drop("s", "many")


def clean(df: DataFrame, measures: list[str]) -> DataFrame:
    return df.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in measures})


def result_groups(df: DataFrame, scratch: Scratch, key: str = "row_id") -> DataFrame:
    """(key, g, n) of the rows whose result also stands in another row; df has pub and the measures.

    Rows with equal values are one node, however many they are. Nodes meet in blocks of one MPa of a publication (each
    also in the block above), are held against each other there, and their components are the groups."""
    measures = measures_of(df)
    rows = clean(df.select(key, "pub", *measures), measures).where(
        F.col("pub").isNotNull() & F.coalesce(*(F.col(m) for m in ANCHORS if m in measures)).isNotNull()
    )
    node = F.md5(F.concat_ws("|", F.col("pub"), *(F.coalesce(F.col(m).cast("string"), F.lit("-")) for m in measures)))
    rows = scratch.keep(rows.withColumn("node", node))
    nodes = scratch.keep(rows.groupBy("node", "pub", *measures).agg(F.count("*").alias("copies")))
    blocks = F.array_compact(F.array(*(F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("kind"), F.floor(m).alias("at"))) for m in ANCHORS if m in measures)))
    spots = nodes.withColumn("b", F.explode(blocks)).select("node", "pub", F.col("b.kind").alias("kind"), F.col("b.at").alias("at"), *measures)
    a = spots.withColumn("block", F.col("at"))
    b = spots.withColumn("block", F.explode(F.array(F.col("at"), F.col("at") + 1)))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    met = a.join(b, (a["pub"] == b["b_pub"]) & (a["kind"] == b["b_kind"]) & (a["block"] == b["b_block"]))
    edges = met.where((F.col("at") != F.col("b_at")) | (F.col("node") < F.col("b_node"))).where(agreement(met, met, measures, "", "b_"))
    comp = connected_components(edges.select(F.col("node").alias("u"), F.col("b_node").alias("v")), scratch)
    grouped = scratch.keep(
        nodes.select("node", "copies").join(comp, "node", "left").select("node", "copies", F.coalesce("component", "node").alias("g"))
    )
    sizes = grouped.groupBy("g").agg(F.sum("copies").alias("n")).where("n >= 2")
    return rows.select(key, "node").join(grouped.select("node", "g"), "node").join(sizes, "g").select(key, "g", "n")
