"""Grouped cross-validation, out-of-fold predictions, intervals and explanations with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.cleaning import finite
from evispark.operators.selection import folds
from evispark.operators.statistics import regression_metrics
from evispark.session import Scratch

#: Trees of a forest, boosted trees and depth by profile.
PROFILES = {"fast": (120, 200, 5), "balanced": (160, 240, 6), "standard": (200, 300, 7)}


def clean_features(df: DataFrame, numbers: list[str], words: list[str]) -> DataFrame:
    """Numbers finite or null, words trimmed and "missing" where blank."""
    cols = {c: finite(c) for c in numbers} | {c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("missing")) for c in words}
    return df.withColumns(cols)


def usable(df: DataFrame, columns: list[str], least: int = 20, share: float = 0.01) -> list[str]:
    """Columns with enough values and more than one of them, in one pass."""
    row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in columns), *(F.approx_count_distinct(c).alias(f"d_{c}") for c in columns)).first()
    return [c for c in columns if row[f"n_{c}"] >= max(least, share * row.n) and row[f"d_{c}"] > 1]


def pipeline(numbers: list[str], words: list[str], candidate: str, target: str, profile: str = "fast", weight: str | None = None, boosts: int | None = None) -> Pipeline:
    """Median imputation and scaling, one-hot words with unseen ones kept apart, and a learner; boosts: other than the profile's."""
    trees, rounds, depth = PROFILES[profile]
    rounds = boosts or rounds
    stages, parts = [], []
    if numbers:
        imputed = [f"{c}_i" for c in numbers]
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_numbers")]
        stages.append(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True))
        parts.append("_scaled")
    if words:
        stages.append(StringIndexer(inputCols=words, outputCols=[f"{c}_n" for c in words], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_n" for c in words], outputCols=[f"{c}_h" for c in words], handleInvalid="keep"))
        parts += [f"{c}_h" for c in words]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    extra = {"weightCol": weight} if weight else {}
    learners = {
        "linear_l2": lambda: LinearRegression(labelCol=target, regParam=1.0, elasticNetParam=0.0, **extra),
        "random_forest": lambda: RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=42, **extra),
        "gbt": lambda: GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=min(depth, 5), seed=42, **extra),
    }
    return Pipeline(stages=[*stages, learners[candidate]()])


def _baseline(data: DataFrame, fold: int, candidate: str, target: str, family: str) -> DataFrame:
    """The mean, the median or the family's median of the other folds; a family that they lack has their median."""
    seen = data.where(F.col("fold") != fold)
    overall = seen.agg(F.avg(target).alias("mean"), F.median(target).alias("median"))  # one row
    rows = data.where(F.col("fold") == fold).crossJoin(F.broadcast(overall))
    if candidate != "family_median":
        return rows.withColumn("prediction", F.col(candidate))
    own = seen.groupBy(F.col(family).alias("_family")).agg(F.median(target).alias("_own"))
    return rows.join(own, F.col(family) == F.col("_family"), "left").withColumn("prediction", F.coalesce("_own", "median"))


BASELINES = ("mean", "median", "family_median")


def out_of_fold(df: DataFrame, group: str, numbers: list[str], words: list[str], target: str, candidates: tuple[str, ...] = (*BASELINES, "linear_l2", "random_forest"), k: int = 5, family: str = "alloy_family") -> DataFrame:
    """(row columns, candidate, fold, prediction): each row predicted by a model that saw no row of its group.

    "gbt" may be asked for too; its boosted trees are fitted one after the other."""
    data = clean_features(df, numbers, words).where(F.col(target).isNotNull())
    data = Scratch(df.sparkSession).keep(data.join(folds(data, group, k), group))
    parts = []
    for c in candidates:
        for i in range(k):
            if c in BASELINES:
                done = _baseline(data, i, c, target, family)
            else:
                done = pipeline(numbers, words, c, target).fit(data.where(F.col("fold") != i)).transform(data.where(F.col("fold") == i))
            parts.append(done.select(*df.columns, F.lit(c).alias("candidate"), "fold", "prediction"))
    return reduce(DataFrame.unionAll, parts)


def background(rows: DataFrame, features: list[str]) -> dict[str, object]:
    """One row to explain against: the median of numbers, the commonest of words."""
    kinds = dict(rows.dtypes)
    found = rows.agg(*((F.mode(f, True) if kinds[f] == "string" else F.median(f)).alias(f) for f in features)).first()
    return found.asDict()


def best_candidate(oof: DataFrame, target: str) -> DataFrame:
    """Metrics of each candidate, the best by r2, then rmse, then mae marked."""
    m = regression_metrics(oof, ["candidate"], target, "prediction")
    order = F.struct(-F.coalesce("r2", F.lit(-1e9)), "rmse", "mae", "candidate")
    first = m.agg(F.min_by("candidate", order).alias("_best"))
    return m.crossJoin(F.broadcast(first)).withColumn("selected", F.col("candidate") == F.col("_best")).drop("_best")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], target: str, key: str, repeats: int = 5) -> DataFrame:
    """(feature, repeat, rise): how much the mean absolute error rises when a feature is taken from another row.

    All copies are scored in one transform. A feature is permuted by joining each row with the row whose rank by a seeded
    hash equals its own rank by another; ranks come from ranges, not from one window."""
    from evispark.operators.selection import _hash_ranked

    base = model.transform(df).agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("base"))
    parts = []
    for r in range(repeats):
        to = _hash_ranked(df, key, 1000 + r).select(key, F.col("_rank"))
        source = _hash_ranked(df, key, 2000 + r).select(F.col(key).alias("_from"), "_rank")
        other = df.select(F.col(key).alias("_from"), *(F.col(f).alias(f"_o_{f}") for f in features))
        mixed = df.join(to.join(source, "_rank").join(other, "_from"), key)
        for f in features:
            parts.append(mixed.select(*(F.col(f"_o_{f}").alias(c) if c == f else F.col(c) for c in df.columns), F.lit(f).alias("feature"), F.lit(r).alias("repeat")))
    scored = model.transform(reduce(DataFrame.unionAll, parts))
    worse = scored.groupBy("feature", "repeat").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("worse"))
    return worse.crossJoin(F.broadcast(base)).select("feature", "repeat", (F.col("worse") - F.col("base")).alias("rise"))


def shapley(model: PipelineModel, rows: DataFrame, background: dict[str, object], features: list[str], key: str, permutations: int = 8) -> DataFrame:
    """(key, feature, value): Monte-Carlo Shapley values against one background row, by the same orders for all rows.

    Each row is repeated for every prefix of every order, scored once, and differences of neighbours are averaged."""
    import random

    rng = random.Random(42)
    orders = [rng.sample(features, len(features)) for _ in range(permutations)]
    kinds = dict(rows.dtypes)
    spots = F.explode(F.array(*(F.struct(F.lit(o).alias("order"), F.lit(i).alias("size")) for o in range(permutations) for i in range(len(features) + 1))))
    each = rows.select("*", spots.alias("_s"))
    cols = {}
    for f in features:
        rank = F.lit(-1)
        for o, order in enumerate(orders):
            rank = F.when(F.col("_s.order") == o, order.index(f)).otherwise(rank)
        cols[f] = F.when(rank < F.col("_s.size"), F.col(f)).otherwise(F.lit(background[f]).cast(kinds[f]))
    scored = model.transform(each.withColumns(cols)).select(key, "_s.order", "_s.size", "prediction")
    after = scored.select(key, "order", (F.col("size") - 1).alias("size"), F.col("prediction").alias("next"))
    steps = scored.join(after, [key, "order", "size"]).withColumn("gain", F.col("next") - F.col("prediction"))
    name = F.lit(None).cast("string")
    for o, order in enumerate(orders):
        for i, f in enumerate(order):
            name = F.when((F.col("order") == o) & (F.col("size") == i), f).otherwise(name)
    return steps.withColumn("feature", name).groupBy(key, "feature").agg(F.avg("gain").alias("value"))
