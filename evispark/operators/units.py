"""Problem 7: quantities recorded in different units, told only in text.

Each source_file holds one unit per quantity. What the texts of its rows tell are votes: a quantity with its unit is held
against the stored number, which then says in which unit it is stored; a column heading names the unit itself. Votes are
labels and an audit, never features. A random forest predicts the unit of every row from magnitude, roundness in each unit,
category, neighbouring fields and what these are over its file. It is fitted on labelled rows; its probabilities, averaged
over each file, are calibrated on the labelled files that it was not fitted on, which gives

 * how sure the most likely unit is: confident ones are converted, unless the file's texts tell another,
 * the units that can't be ruled out (the likeliest and all above a conformal threshold). An uncertain file is sent to review, where the unit
   that its texts tell is taken if it is one of these. Everything else stays in review, unconverted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.session import Scratch


@dataclass(frozen=True)
class Quantity:
    """A column, its units with the factor to the common one (the first), how texts write them, and plausible values."""

    column: str
    units: tuple[tuple[str, float, str], ...]
    named: str
    not_named: str
    least: float
    most: float


_SEC, _MIN = r"(?:s|sec|secs|second|seconds|sekunde|seconde|segundo)", r"(?:min|mins|minute|minutes|minuto)"


def _per(length: str, time: str) -> str:
    return rf"(?:{length})\s*(?:/\s*{time}|per\s+{time}|[·⋅.*\s]?\s*{time}\s*(?:\^?\s*\(?\s*[-−–]\s*1\)?|⁻¹))"


_MM, _CM, _M, _IN = r"mm|millimet(?:re|er)s?", r"cm|centimet(?:re|er)s?", r"m|met(?:re|er)s?", r"in\.?|inch(?:es)?|zoll|pouces?|pulgadas?"
HATCH = Quantity(
    "hatch_spacing_um",
    (
        ("um", 1.0, r"[µμu]m|microns?|microm[eè]t(?:re|er)s?|mikrometer"),
        ("mm", 1000.0, _MM),
        ("cm", 10_000.0, _CM),
        ("inch", 25_400.0, _IN),
        ("mil", 25.4, r"mils?|thou"),
        ("nm", 0.001, r"nm|nanomet(?:re|er)s?"),
    ),
    r"hatch|line offset|pas de hachure|spurabstand|spaced|espaciado|\bh\b",
    r"layer|schicht|couche|capa|thick",
    20.0,
    500.0,
)
SPEED = Quantity(
    "scan_speed_mm_s",
    (
        ("mm/s", 1.0, _per(_MM, _SEC)),
        ("m/s", 1000.0, _per(_M, _SEC)),
        ("cm/s", 10.0, _per(_CM, _SEC)),
        ("mm/min", 1 / 60, _per(_MM, _MIN)),
        ("m/min", 1000 / 60, _per(_M, _MIN)),
        ("in/s", 25.4, rf"{_per(_IN, _SEC)}|ips"),
    ),
    r"speed|velocity|geschwindigkeit|vitesse|velocidad|travelled|\bv\b",
    r"\bflow\b|recoat",
    50.0,
    6000.0,
)
QUANTITIES = (HATCH, SPEED)
_NUMBER = r"(?<![\w.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?(?:e[-+]?\d+)?)"
_END = r"(?![\w²³⁻^/])"
#: A length is no part of a speed.
_NO_TIME = r"(?!\s*(?:/|per\b|[·⋅*]|(?:s|secs?|min|mins)\b))"


def _readings(text: str) -> list[float]:
    """What a written number may mean: a single comma before three digits divides thousands or decimals."""
    if re.fullmatch(r"[1-9]\d{0,2}(,\d{3})+(\.\d+)?", text):
        whole = float(text.replace(",", ""))
        return [whole, float(text.replace(",", "."))] if text.count(",") == 1 and "." not in text else [whole]
    return [float(text.replace(",", "."))]


def _compiled(q: Quantity):
    unit = "|".join(f"(?P<u{i}>{p})" for i, (_, _, p) in enumerate(q.units))
    end = _END if "/" in q.units[0][0] else _END + _NO_TIME
    return (
        re.compile(rf"{_NUMBER}\s*(?:{unit}){end}", re.I),
        re.compile(rf"(?:{q.named})[^.;,\d]{{0,28}}?[\s(\[]+(?:(?:is|are|given|in|unit:?)\s+)*[(\[]?(?:{unit}){end}", re.I),
        re.compile(q.not_named, re.I),
    )


def told(q: Quantity):
    """A function (text, stored) -> unit told for the stored number, or None."""
    quantity, heading, other = _compiled(q)

    def which(m: re.Match) -> int:
        return next(i for i in range(len(q.units)) if m[f"u{i}"])

    def one(text: str | None, stored: float | None) -> str | None:
        if not text:
            return None
        fallback = None
        for m in quantity.finditer(text):
            if other.search(text[max(0, m.start() - 20) : m.start()]):
                continue
            if not stored or not stored > 0:
                continue
            near = [
                (abs(math.log(stored * f / common)), u)
                for common in (x * q.units[which(m)][1] for x in _readings(m[1]) if x > 0)
                for u, f, _ in q.units
                if q.least <= stored * f <= q.most
            ]
            if near and min(near)[0] < 0.01:
                return min(near)[1]
        for m in heading.finditer(text):
            u, f, _ = q.units[which(m)]
            if stored is None or stored != stored or q.least <= stored * f <= q.most:
                fallback = fallback or u
        return fallback

    return one


def _vote(q: Quantity):
    one = told(q)

    @F.pandas_udf(T.StringType())
    def vote(text: pd.Series, stored: pd.Series) -> pd.Series:
        return pd.Series([one(t, s) for t, s in zip(text, stored)], dtype=object)

    return vote


def file_key(c: Column) -> Column:
    """A source_file without folder, case, surrounding blanks and repeated extension; null when blank."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"^.*[/\\]", "")
    return F.nullif(F.regexp_replace(name, r"(\.[a-z0-9]{2,5})\1+$", "$1"), F.lit(""))


def _log(c: Column) -> Column:
    return F.coalesce(F.when((c > 0) & ~F.isnan(c), F.log10(c)), F.lit(-9.0))


def _roundness(q: Quantity) -> dict[str, Column]:
    """How far the value is from a whole and from a multiple of five in each unit, and whether it is plausible in it."""
    cols = {}
    for i, (_, f, _) in enumerate(q.units):
        v = F.col("x") * f
        slack = F.greatest(v * 2e-4, F.lit(0.02))
        cols[f"f_round{i}"] = F.coalesce(F.least(F.abs(v - F.round(v)) / slack, F.lit(5.0)), F.lit(5.0))
        cols[f"f_five{i}"] = F.coalesce(F.least(F.abs(v - 5 * F.round(v / 5)) / slack, F.lit(5.0)), F.lit(5.0))
        cols[f"f_in{i}"] = F.coalesce(((v >= q.least) & (v <= q.most)).cast("double"), F.lit(0.0))
    return cols


def _files(q: Quantity, rows: DataFrame) -> DataFrame:
    """(file, votes, voted, mean and spread of the magnitude, mean roundness in each unit) of each file."""
    logs = F.when(F.col("x") > 0, F.log10("x"))
    means = [F.avg(F.when(F.col("x") > 0, c)).alias(f"m_{n}") for n, c in _roundness(q).items()]
    votes = rows.where("told is not null").groupBy("file", "told").agg(F.count("*").alias("n"), F.count("x").alias("n_with"))
    decided = votes.groupBy("file").agg(F.max_by("told", F.struct("n_with", "n", "told")).alias("voted"))
    stats = rows.groupBy("file").agg(F.avg(logs).alias("m_log"), F.stddev_pop(logs).alias("m_sd"), F.count(logs).alias("m_n"), F.min(logs).alias("m_least"), F.max(logs).alias("m_most"), *means)
    return stats.join(decided, "file", "left")


def _features(q: Quantity, rows: DataFrame, files: DataFrame) -> tuple[DataFrame, list[str]]:
    own = {"f_mag": _log(F.col("x")), "f_near": _log(F.col("near")), "f_power": _log(F.col("power")), "f_layer": _log(F.col("layer")), **_roundness(q)}
    own["f_process"] = F.pmod(F.xxhash64(F.lower(F.coalesce("process", F.lit("")))), F.lit(16)).cast("double")
    shared = [c for c in files.columns if c.startswith("m_")]
    joined = rows.where("x > 0").join(files.select("file", "voted", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in shared)), "file")
    return joined.withColumns(own), [*own, *shared]


#: Labelled rows that the classifier is fitted on at most; the labelled files of one hash in FOLDS calibrate it.
MOST_TRAINING, FOLDS = 10_000, 5
#: Least labelled rows of least two units to learn from, how right a converted unit has to be, and the share of files whose
#: true unit must not be ruled out.
LEAST_TRAINING, CONFIDENT, KEPT = 50, 0.95, 0.9995


def _monotone(pairs: list[tuple[float, float, int]]) -> list[tuple[float, float]]:
    """(lower score, share right) by pooling adjacent violators of (score, share, n) in rising score."""
    pools: list[list[float]] = []
    for score, share, n in pairs:
        pools.append([score, share * n, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return [(s, (k + 0.5) / (n + 1)) for s, k, n in pools]


def _likely(q: Quantity, rows: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(file, guess, score, p, voted, held) of files: the likeliest unit, and the mean probability of each unit over the
    file's rows. held: the forest saw no row of it. None where there is too little to learn from."""
    data, names = _features(q, rows, files)
    units = [u for u, _, _ in q.units]
    index = F.create_map(*(x for i, u in enumerate(units) for x in (F.lit(u), F.lit(float(i)))))
    held = F.pmod(F.xxhash64("file"), F.lit(FOLDS)) == 0
    labelled = data.where(F.col("told").isNotNull() & ~held).withColumn("label", index[F.col("told")])
    sample = scratch.keep(labelled.select("label", *names, F.xxhash64("file", "row_hash").alias("h")).orderBy("h").limit(MOST_TRAINING))
    kinds = sample.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if kinds.n < LEAST_TRAINING or kinds.k < 2:
        return None
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(numTrees=30, maxDepth=9, seed=7, labelCol="label", featuresCol="features")
    model = forest.fit(vectors.transform(sample).coalesce(4))
    # A forest knows the classes up to the last label that it saw.
    p = [F.coalesce(F.get(vector_to_array("probability"), F.lit(i)), F.lit(0.0)) for i in range(len(units))]
    scored = model.transform(vectors.transform(data)).select("file", "voted", *(c.alias(f"p{i}") for i, c in enumerate(p)))
    per_file = scored.groupBy("file").agg(F.first("voted").alias("voted"), *(F.avg(f"p{i}").alias(f"p{i}") for i in range(len(units))))
    each = F.array(*(F.struct(F.col(f"p{i}").alias("p"), F.lit(u).alias("unit")) for i, u in enumerate(units)))
    best = F.array_max(each)
    return scratch.keep(per_file.select("file", "voted", held.alias("held"), best["unit"].alias("guess"), best["p"].alias("score"), each.alias("p")))


def calibration(likely: DataFrame) -> DataFrame:
    """(low, n_files, share_right) of the likeliest unit by its score, over the labelled files that were held out."""
    tested = likely.where("held and voted is not null")
    return tested.groupBy((F.floor(F.col("score") * 20) / 20).alias("low")).agg(F.count("*").alias("n_files"), F.avg((F.col("guess") == F.col("voted")).cast("double")).alias("share_right"))


def _not_ruled_out(likely: DataFrame) -> float:
    """The probability that all but 1 - KEPT of the true units of held out files reach; 0 with too few files to say."""
    true = F.array_max(F.transform(F.filter("p", lambda x: x["unit"] == F.col("voted")), lambda x: x["p"]))
    bins = likely.where("held and voted is not null").groupBy(F.floor(true * 1000).cast("int").alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    under, spare = 0, (1 - KEPT) * (sum(r.n for r in bins) + 1) - 1
    for r in bins:
        under += r.n
        if under > spare:
            return r.b / 1000
    return 0.0


def _verdicts(q: Quantity, files: DataFrame, likely: DataFrame | None) -> DataFrame:
    """(file, unit, how, audit) of each file."""
    none = F.lit(None).cast("string")
    if likely is None:
        return files.select("file", none.alias("unit"), F.lit("review").alias("how"), F.when(F.col("voted").isNotNull(), "told").otherwise("silent").alias("audit"))
    sure = F.lit(0.0)
    for low, share in _monotone([(r.low, r.share_right, r.n_files) for r in calibration(likely).orderBy("low").collect()]):
        sure = F.when(F.col("score") >= low, share).otherwise(sure)
    least = _not_ruled_out(likely)
    confident = F.coalesce(sure >= CONFIDENT, F.lit(False)) & F.coalesce(F.col("voted") == F.col("guess"), F.lit(True))
    possible = F.exists("p", lambda x: (x["unit"] == F.col("voted")) & (x["p"] >= least) & (x["p"] > 0))
    possible = F.coalesce((F.col("voted") == F.col("guess")) | possible, F.lit(False))
    joined = files.select("file", "voted").join(likely.drop("voted"), "file", "left")
    return joined.select(
        "file", F.when(confident, F.col("guess")).when(possible, F.col("voted")).alias("unit"),
        F.when(confident, "learnt").when(possible, "checked").otherwise("review").alias("how"),
        F.when(F.col("voted").isNull(), "silent").when(F.col("voted") == F.col("guess"), "agrees").otherwise("differs").alias("audit"),
    )


def _rows(q: Quantity, other: str, df: DataFrame, key: str) -> DataFrame:
    vote = _vote(q)
    filled = F.col(q.column).isNotNull() & ~F.isnan(q.column)
    return df.select(
        key, F.coalesce(file_key(F.col("source_file")), F.concat(F.lit("\0row "), F.col(key).cast("string"))).alias("file"),
        F.when(filled, F.col(q.column)).alias("x"), F.col(other).alias("near"), F.col("laser_power_w").alias("power"),
        F.col("layer_thickness_um").alias("layer"), F.col("am_process").alias("process"),
        F.xxhash64(F.col(key)).alias("row_hash"), "evidence_text",
    ).withColumn("told", F.when(F.col("evidence_text").isNotNull(), vote("evidence_text", "x"))).drop("evidence_text")


def _each(df: DataFrame, scratch: Scratch, key: str, quantities: tuple[Quantity, ...]) -> Iterator[tuple[Quantity, DataFrame, DataFrame, DataFrame | None]]:
    for q in quantities:
        other = next((o.column for o in quantities if o is not q), q.column)
        rows = scratch.keep(_rows(q, other, df, key))
        files = scratch.keep(_files(q, rows))
        yield q, rows, files, _likely(q, rows, files, scratch)


def common_units(df: DataFrame, scratch: Scratch, key: str = "row_id", quantities: tuple[Quantity, ...] = QUANTITIES) -> DataFrame:
    """(key, field_name, stored, unit, value_common, how, audit) of every filled (neither null nor NaN) quantity.

    how: "learnt" (the forest, confidently, and no text of the file against it), "checked" (the forest is unsure or the texts
    contradict it; they tell a unit that it doesn't rule out), "review" (unit and value_common are null). audit: whether the
    file's texts agree with the forest, differ or are silent. With fewer than LEAST_TRAINING labelled rows, or of one unit
    only, all is review. Rows without source_file form one file per row key. Repeated rows have a row each, extra columns
    are ignored, an empty table gives an empty result."""
    parts = []
    for q, rows, files, likely in _each(df, scratch, key, quantities):
        factor = F.create_map(*(x for u, f, _ in q.units for x in (F.lit(u), F.lit(f))))
        parts.append(
            rows.where("x is not null").join(_verdicts(q, files, likely), "file")
            .select(key, F.lit(q.column).alias("field_name"), F.col("x").alias("stored"), "unit",
                    F.round(F.col("x") * factor[F.col("unit")]).cast("bigint").alias("value_common"), "how", "audit")
        )
    return reduce(DataFrame.unionAll, parts)


def unit_calibration(df: DataFrame, scratch: Scratch, key: str = "row_id", quantities: tuple[Quantity, ...] = QUANTITIES) -> DataFrame:
    """(field_name, low, n_files, share_right): how often the likeliest unit is the told one, by its score, over files that
    the forest was not fitted on."""
    parts = [calibration(likely).select(F.lit(q.column).alias("field_name"), "*") for q, _, _, likely in _each(df, scratch, key, quantities) if likely is not None]
    empty = df.sparkSession.createDataFrame([], "field_name string, low double, n_files bigint, share_right double")
    return reduce(DataFrame.unionAll, parts, empty)
