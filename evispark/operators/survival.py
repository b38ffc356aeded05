"""Accelerated failure time models under right censoring, of three error laws and several scales at once.

log(life) = b . x + scale * error. The log-likelihood of each law is concave in b for a given scale, so each model is fitted
by Newton steps: a pass over the data adds up gradient and curvature of every (domain, law, scale) in Arrow batches, the
driver solves the small systems. Only sums travel, so the size of the data doesn't matter to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.curves import life_quantile, survival_probability
from evispark.session import Scratch

LAWS, SCALES = ("normal", "logistic", "extreme"), (0.5, 1.0, 1.5)
#: Domains that are fitted at most: each has a few hundred numbers of sums.
MOST_DOMAINS = 10_000


def bounds(life: Column, runout: Column) -> tuple[Column, Column, Column]:
    """(lower, upper, event): a run-out lives at least so long, a failure exactly; null where the run-out is unknown."""
    event = ~runout
    return F.when(event.isNotNull(), life), F.when(event, life).when(~event, F.lit(float("inf"))), event


def _tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log, hazard) of the normal tail beyond z, steady far out by the continued fraction."""
    far = z > 8
    near = np.where(far, 0.0, z)
    q = 0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in near])
    density = np.exp(-0.5 * near * near) / math.sqrt(2 * math.pi)
    x = np.where(far, z, 10.0)
    hazard = np.where(far, x + 1 / (x + 2 / (x + 3 / (x + 4 / x))), density / q)
    return np.where(far, -0.5 * x * x - 0.5 * math.log(2 * math.pi) - np.log(hazard), np.log(q)), hazard


def likelihood(law: str, z: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood without the scale, its first and its second derivative by z) of standardised log lives."""
    if law == "normal":
        log, hazard = _tail(z)
        return np.where(event, -0.5 * z * z - 0.5 * math.log(2 * math.pi), log), np.where(event, -z, -hazard), np.where(event, -1.0, -hazard * (hazard - z))
    z = np.clip(z, -300, 300)
    if law == "logistic":
        p = 1 / (1 + np.exp(-z))
        soft = np.logaddexp(0, z)
        return np.where(event, z - 2 * soft, -soft), np.where(event, 1 - 2 * p, -p), np.where(event, -2 * p * (1 - p), -p * (1 - p))
    e = np.exp(np.minimum(z, 50))
    return np.where(event, z - e, -e), np.where(event, 1 - e, -e), -e


def _sums(data: DataFrame, features: list[str], models: list[tuple[str, float]], beta: dict) -> list:
    """The summed log-likelihood, gradient and curvature of every domain and model, added up in each task first."""
    k = len(features) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            for domain, part in pdf.groupby("domain"):
                x = np.column_stack([np.ones(len(part)), part[features].to_numpy(dtype="float64")])
                y, event = part["y"].to_numpy(), part["event"].to_numpy(dtype=bool)
                for m, (law, scale) in enumerate(models):
                    z = (y - x @ beta.get((domain, m), beta[None])) / scale
                    ll, first, second = likelihood(law, z, event)
                    ll = ll - event * (math.log(scale) + y)
                    sums = np.r_[len(y), ll.sum(), -(first @ x) / scale, ((x * second[:, None]).T @ x).ravel() / scale**2]
                    total[domain, m] = total.get((domain, m), 0) + sums
        if total:
            yield pd.DataFrame([(d, m, s.tolist()) for (d, m), s in total.items()], columns=["domain", "m", "s"])

    summed = data.mapInPandas(run, "domain string, m int, s array<double>")
    size = 2 + k + k * k
    return summed.groupBy("domain", "m").agg(*(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(size))).collect()


def fit(rows: DataFrame, features: list[str], scratch: Scratch, falling: tuple[str, ...] = (), models: tuple[tuple[str, float], ...] | None = None, steps: int = 25, ridge: float = 1e-3) -> tuple[DataFrame, dict]:
    """((domain, law, scale, n, nll, coefficients...), {domain: {(law, scale): coefficients}}) of (domain, y, event, features):
    y is the log of the life, features are numbers without nulls, best scaled to about one.

    falling: features whose coefficient may not be above 0; one that would be is fixed at 0. Steps are halved until the
    likelihood doesn't fall. An empty table gives no rows."""
    spark = rows.sparkSession
    models = models or tuple((law, s) for law in LAWS for s in SCALES)
    k = len(features) + 1
    data = scratch.keep(rows.select("domain", "y", "event", *features))
    means = {r.domain: r.m for r in data.groupBy("domain").agg(F.avg("y").alias("m")).limit(MOST_DOMAINS + 1).collect()}
    if len(means) > MOST_DOMAINS:
        raise ValueError(f"over {MOST_DOMAINS} domains")
    start = np.zeros(k)
    beta = {None: start, **{(d, m): np.r_[mean, np.zeros(k - 1)] for d, mean in means.items() for m in range(len(models))}}
    best: dict = {}  # (domain, m): (objective, beta, gradient, curvature, n, log-likelihood)
    step: dict = {}
    fixed: dict = {key: set() for key in beta if key}
    live = set(fixed)
    for _ in range(steps):
        if not live:
            break
        for r in _sums(data, features, list(models), beta):
            key = (r.domain, r.m)
            if key not in live:
                continue
            s = np.array(r[2:], dtype=float)
            b, n, ll = beta[key], s[0], s[1]
            objective = ll - 0.5 * ridge * (b[1:] ** 2).sum()
            if key in best and objective < best[key][0] - 1e-9 * abs(best[key][0]):
                step[key] /= 2
                if step[key] < 1e-4:
                    live.discard(key)
                    beta[key] = best[key][1]
                else:
                    beta[key] = best[key][1] + step[key] * best[key][6]
                continue
            gradient = s[2 : 2 + k] - np.r_[0, ridge * b[1:]]
            curvature = s[2 + k :].reshape(k, k) - np.diag(np.r_[1e-9, np.full(k - 1, ridge)])
            names = [i for i in range(k) if i not in fixed[key]]
            move = np.zeros(k)
            move[names] = np.linalg.solve(-curvature[np.ix_(names, names)], gradient[names])
            for f in falling:
                i = features.index(f) + 1
                if b[i] + move[i] > 0:
                    fixed[key].add(i)
                    move[i] = -b[i]
            best[key] = (objective, b, gradient, curvature, n, ll, move)
            step[key] = 1.0
            beta[key] = b + move
            if np.abs(move).max() < 1e-6:
                live.discard(key)
    out, table = [], {}
    for (d, m), (_, b, _, _, n, ll, _) in sorted(best.items()):
        law, scale = models[m]
        table.setdefault(d, {})[law, scale] = b
        out.append((d, law, scale, int(n), float(-ll / n), *map(float, b)))
    shape = "domain string, law string, scale double, n bigint, nll double, intercept double" + "".join(f", {f} double" for f in features)
    return spark.createDataFrame(out, shape), table


def location(models: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows (with domain) and each model of their domain: (..., law, scale, location), the median log life for symmetric
    laws."""
    named = models.select(F.col("domain").alias("_d"), "law", "scale", F.col("intercept").alias("_b"), *(F.col(f).alias(f"_b_{f}") for f in features))
    at = F.col("_b") + sum((F.col(f"_b_{f}") * F.col(f) for f in features), F.lit(0.0))
    return rows.join(F.broadcast(named), F.col("domain") == F.col("_d")).withColumn("location", at).drop("_d", "_b", *(f"_b_{f}" for f in features))


def per_law(of) -> Column:
    """of(law, scale) for the row's own law and scale."""
    out = F.lit(None).cast("double")
    for law in LAWS:
        for s in SCALES:
            out = F.when((F.col("law") == law) & (F.col("scale") == s), of(law, s)).otherwise(out)
    return out


def scenario_scores(scored: DataFrame, at: tuple[float, float] = (1e7, 2e7), quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """scored (law, scale, location) with p_first, p_second and the life quantiles, put in order: living longer is never
    likelier, and a higher quantile never lower."""
    life = F.exp("location")
    first, second = (per_law(lambda law, s, t=t: survival_probability(life, s, t, law)) for t in at)
    cols = {"p_first": first, "p_second": F.least(first, second)}
    before = None
    for q in quantiles:
        value = per_law(lambda law, s, q=q: life_quantile(life, s, q, law))
        cols[f"q{round(100 * q)}"] = before = value if before is None else F.greatest(before, value)
    return scored.withColumns(cols)
