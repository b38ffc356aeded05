import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.operators import curves, joins, matching, selection, statistics, survival, text_search, views
from evispark.sources import tables
from evispark.streaming import ingest


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_labels_of_runout(spark):
    words = [("Run-out",), ("survived",), ("y",), ("failed",), ("0",), ("perhaps",), (None,), ("",)]
    assert values(spark, words, "x string", C.truth("x")) == [True, True, True, False, False, None, None, None]
    assert values(spark, words, "x string", C.truth("x", short=False))[2] is None


def test_routes_and_states(spark):
    rows = [("SURF machine; SURF polish P400",), ("SURF polish; SURF polish",), ("HIP 900 C; HT 800",), ("NHT; SURF as-built",), (None,), ("grinding",)]
    assert values(spark, rows, "x string", C.surface_route("x")) == ["machined+polished", "polished", None, "as-built", None, None]
    assert values(spark, rows, "x string", C.heat_route("x")) == [None, None, "hip+heat-treated", "no-heat-treatment", None, None]
    state = C.material_state("x", C.surface_route("x"), C.heat_route("x"))
    assert values(spark, rows, "x string", state)[2:] == ["hip-and-heat-treated", "as-manufactured", None, "reported-processing-route-unclassified"]


def test_numbers(spark):
    assert values(spark, [(" 1,234.5%",), ("5 mm",), ("nan",), ("inf",), (None,)], "x string", C.numeric("x")) == [1234.5, None, None, None, None]
    assert values(spark, [("5.0",), ("50, 10",)], "x string", C.single_number("x")) == [5.0, None]
    assert values(spark, [("0",), ("0.0",), ("0 deg",), ("0°",), (None,)], "x string", C.orientation("x")) == ["0", "0", "0", "0", "missing"]


@pytest.mark.parametrize("block", [50_000, 5])
def test_concordance_is_that_of_all_pairs(spark, scratch, block):
    rng = random.Random(3)
    rows = [("g", rng.choice([5.0, 5.0, float(rng.randint(1, 40))]), rng.random() < 0.6, rng.choice([2.0, float(rng.randint(1, 25))])) for _ in range(120)]
    pairs = good = 0.0
    for (_, t, e, r), (_, u, _, s) in itertools.product(rows, rows):
        if e and u > t:
            pairs += 1
            good += 1.0 if s < r else 0.5 if s == r else 0.0
    df = spark.createDataFrame([*rows, ("g", None, True, 1.0), ("one", 1.0, True, 1.0)], "g string, t double, e boolean, r double")
    got = {r.g: r for r in statistics.concordance(df, ["g"], "t", "e", "r", scratch, block=block, most=16).collect()}
    assert got["g"].n_pairs == pairs and got["g"].c_index == pytest.approx(good / pairs)
    assert got["one"].n_pairs == 0 and got["one"].c_index is None


def test_holdout_and_folds_are_disjoint(spark):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(101)] * 2 + [(None,)], "g string")
    out = selection.holdout(groups, "g").collect()
    assert len(out) == 101 and sum(r.is_test for r in out) == 16
    sizes = [r["count"] for r in selection.folds(groups, "g", 5).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 20, 20, 21]


def test_even_sample_keeps_both_ends(spark, scratch):
    rows = spark.createDataFrame([("a", i) for i in range(57)] + [("b", 1)] + [(None, i) for i in range(30)], "g string, x int")
    got = selection.even_sample(rows, ["g"], 10, ["x"], scratch).collect()
    for g, last in (("a", 56), (None, 29)):
        mine = {r.x for r in got if r.g == g}
        assert mine == {round(k * last / 9) for k in range(10)}
    assert selection.even_sample(rows.limit(0), ["g"], 10, ["x"], scratch).count() == 0


def test_ranks_over_ranges_are_those_of_one_window(spark, scratch):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 1.0, 2.0, 3.5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, id int")
    got = {r.id: (r._i, r._n) for r in selection.ranked(df, ["g"], ["x", "id"], scratch).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_change_log_and_levels(spark):
    a = spark.createDataFrame([("k1", "x"), ("k2", None), ("k3", "y")], "k string, v string")
    b = spark.createDataFrame([("k1", "x"), ("k2", "z"), ("k4", "w")], "k string, v string")
    assert {(r.k, r.change) for r in joins.change_log(a, b, "k", "v").collect()} == {("k2", "changed"), ("k3", "removed"), ("k4", "added")}
    rows = spark.createDataFrame([("p", "q"), ("p", None), (None, None)], "a string, b string")
    exact = spark.createDataFrame([("p", "q", 1.0)], "a string, b string, v double")
    family = spark.createDataFrame([("p", 2.0)], "a string, v double")
    whole = spark.createDataFrame([(3.0,)], "v double")
    got = joins.by_level(rows, [("exact", exact, ["a", "b"]), ("family", family, ["a"]), ("global", whole, [])], "v").collect()
    assert sorted((r.v, r.level) for r in got) == [(1.0, "exact"), (2.0, "family"), (3.0, "global")]


def test_isotonic_is_one_pass_over_all_points(spark, scratch):
    rng = random.Random(5)
    rows = [(g, float(rng.randint(0, 300)), int(rng.random() < 0.5 + 0.4 * math.sin(i / 90))) for g in ("g", "h", None) for i in range(400)]
    got = {}
    for r in curves.isotonic(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y", scratch).collect():
        got.setdefault(r.g, []).append((r.s, r.value))
    for g in ("g", "h", None):
        by = {}
        for h, s, y in rows:
            if h == g:
                by.setdefault(s, []).append(y)
        blocks = []
        for s in sorted(by):
            blocks.append([sum(by[s]), len(by[s]), [s]])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                x = blocks.pop()
                blocks[-1] = [blocks[-1][0] + x[0], blocks[-1][1] + x[1], blocks[-1][2] + x[2]]
        assert sorted(got[g]) == [(s, pytest.approx(a / n)) for a, n, ss in blocks for s in ss]


def test_ranked_statistics_are_those_by_hand(spark, scratch):
    rng = random.Random(8)
    rows = [(g, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for g in ("a", "a", "a", "b", None) for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    rho = {r.g: (r.n, r.rho) for r in statistics.spearman(df, ["g"], "x", "y", scratch).collect()}
    radius = {r.g: (r.n, r.radius) for r in statistics.conformal_radius(df, ["g"], F.col("x") - F.col("y"), scratch).collect()}
    for g in ("a", "b", None):
        x, y = (pd.Series([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        assert rho[g] == (len(x), pytest.approx(x.rank().corr(y.rank())))
        n, gaps = len(x), sorted((x - y).abs())
        assert radius[g] == (n, gaps[math.ceil(min(1.0, math.ceil((n + 1) * 0.9) / n) * (n - 1))])
    steps = spark.createDataFrame([("up", 1, 1.0), ("up", 2, 2.0), ("down", 1, 3.0), ("down", 2, 3.0), ("down", 3, 1.0), (None, 1, 1.0)], "g string, o int, v double")
    assert {r.g: (r.n, r.monotone) for r in curves.monotone(steps, ["g"], "o", "v", scratch).collect()} == {"up": (2, False), "down": (3, True), None: (1, True)}


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(4000))
    got = text_search.chunks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "k int, t string"), "k", "t").orderBy("k", "chunk_index").collect()
    assert [(r.k, len(r.chunk)) for r in got] == [(1, 3500), (1, 800), (4, 5)]
    with pytest.raises(ValueError):
        text_search.chunks(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", 100, 100)


def test_best_titles(spark):
    a = spark.createDataFrame([("p1", "Fatigue of printed 316L steel bars"), ("p2", "Fatigue of printed 316L steel rods in air"), ("p3", None)], "k string, title string")
    b = spark.createDataFrame([("s1", "fatigue of printed 316l steel bars."), ("s2", "Fatigue of printed 316L stel rods in air"), ("s3", "Other matters")], "k string, title string")
    got = matching.best_titles(a.withColumnRenamed("k", "paper"), b.withColumnRenamed("k", "source"), "paper", "source", shared=0.5).collect()
    assert {(r.paper, r.source) for r in got} == {("p1", "s1"), ("p2", "s2")}


@pytest.mark.parametrize("block", [5_000, 2])
def test_best_titles_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "RIGHT_BLOCK", block)
    a = [("p1", "Fatigue of alsi10mg brackets"), ("p2", "crack growth in weldedjoints of steel"), ("p3", "hardness maps of copper"), ("p4", "steel fatigue at high loads"), ("p5", "unlike all"), ("p6", None)]
    b = [("s1", "Fatigue of al si10 mg brackets"), ("s1", "a title of its own"), ("s2", "crack growths in welded joint of steels"), ("s3", "hardnes map of coper"), ("s4", "high loads at fatigue steel"), ("s5", "steel fatigue at high temperatures")]
    left, right = spark.createDataFrame(a, "paper string, title string"), spark.createDataFrame(b, "source string, title string")
    got = {r.paper: (r.source, r.score) for r in matching.best_titles(left, right, "paper", "source").collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    all_pairs = {p: max((round(matching._similar(norm(x), norm(y)), 6), s) for s, y in b) for p, x in a if x}
    assert got == {p: (s, score) for p, (score, s) in all_pairs.items() if score >= 0.72}
    assert set(got) == {"p1", "p2", "p3", "p4"}


def test_few_titles_are_compared_once_a_near_one_is_found(monkeypatch):
    words = ["fatigue", "steel", "bars", "printed", "laser", "bed", "fusion", "tests", "air"]
    texts = [" ".join(words[i % 9 :] + words[: i % 9]) + f" {i:03d} " + words[i // 9 % 9] for i in range(600)]
    held, common = [], matching.Titles._common
    monkeypatch.setattr(matching.Titles, "_common", lambda self, x, codes: held.append(len(found := common(self, x, codes))) or found)
    x = texts[321].replace("laser", "lasr")
    assert matching.Titles(texts).nearest(x, 0.72) == (321, round(matching._similar(x, texts[321]), 6))
    assert sum(held) < 2 * len(texts)


def test_files(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text('﻿row,uts_mpa,extra\n1,"1,200",x\n2,bad,y\n', encoding="utf-8")
    schema = T.StructType().add("row", T.LongType()).add("uts_mpa", T.DoubleType()).add("alloy", T.StringType())
    got = tables.read_csv(spark, f"file://{tmp_path}/a.csv", schema).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(1, 1200.0, None), (2, None, None)]
    assert tables.read_csv(spark, f"file://{tmp_path}/none.csv", schema, optional=True).count() == 0
    assert tables.unique_names(["x", "x", None, "", "x"]) == ["x", "x.1", "unnamed_column_2", "unnamed_column_3", "x.2"]
    assert len(tables.inventory(spark, f"file://{tmp_path}").collect()[0].sha256) == 64
    target = f"file://{tmp_path}/t"
    assert tables.replace_table(spark.range(3).toDF("id"), target) is None
    assert tables.replace_table(spark.range(5).toDF("id"), target) is not None
    assert spark.read.parquet(target).count() == 5


def test_stream_keeps_the_last_row_and_each_once(spark, tmp_path):
    import datetime as d

    rows = [(1, d.datetime(2024, 1, 1), "a"), (1, d.datetime(2024, 1, 2), "b"), (2, d.datetime(2024, 1, 1), "c")]
    schema = "k long, at timestamp, v string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    stream = ingest.stream_table(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    query = stream.writeStream.foreachBatch(ingest.upsert_last(out, ["k"], "at")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {(1, "b"), (2, "c")}
    once = ingest.once_each(stream, "k", "at").groupBy("k").count()
    got = ingest.run_to_memory(once, "once_each_test", f"{tmp_path}/cp2")
    assert {(r.k, r["count"]) for r in got.collect()} == {(1, 1), (2, 1)}


def test_survival_models(spark, scratch):
    """Simulated lives: the true law fits best, coefficients come back, censored rows count, falling features don't rise."""
    rng = np.random.default_rng(4)
    rows = []
    for domain, slope in (("a", -3.0), ("b", -5.0)):
        x, z = rng.normal(0, 0.5, 1500), rng.normal(0, 1, 1500)
        y = 12 + slope * x + 0.5 * np.log(rng.exponential(1, 1500))
        end = np.full(1500, 13.0)
        rows += [(domain, float(min(a, e)), bool(a <= e), float(u), float(v)) for a, e, u, v in zip(y, end, x, z)]
    df = spark.createDataFrame(rows, "domain string, y double, event boolean, x double, z double")
    models, table = survival.fit(df, ["x", "z"], scratch, falling=("z",))
    got = {(r.domain, r.law, r.scale): r for r in models.collect()}
    assert len(got) == 18 and all(r.n == 1500 and r.z <= 1e-12 for r in got.values())
    for domain, slope in (("a", -3.0), ("b", -5.0)):
        best = min((r for r in got.values() if r.domain == domain), key=lambda r: r.nll)
        assert (best.law, best.scale) == ("extreme", 0.5) and best.x == pytest.approx(slope, abs=0.15) and best.intercept == pytest.approx(12, abs=0.1)
        assert table[domain]["extreme", 0.5][1] == best.x
    cases = spark.createDataFrame([("a", 0.1, 0.0), ("b", -0.5, 1.0), ("none", 0.0, 0.0)], "domain string, x double, z double")
    out = survival.scenario_scores(survival.location(models, cases, ["x", "z"])).collect()
    assert len(out) == 18 and all(r.p_second <= r.p_first and r.q10 <= r.q50 <= r.q90 for r in out)
    assert survival.fit(df.limit(0), ["x"], scratch)[0].count() == 0


@pytest.mark.parametrize("law", survival.LAWS)
def test_survival_derivatives(law):
    z = np.linspace(-6, 6, 41)
    for event in (True, False):
        e = np.full(len(z), event)
        ll, first, second = survival.likelihood(law, z, e)
        h = 1e-5
        up, down = (survival.likelihood(law, z + d, e) for d in (h, -h))
        assert np.allclose(first, (up[0] - down[0]) / (2 * h), rtol=1e-4, atol=1e-6) and np.allclose(second, (up[1] - down[1]) / (2 * h), rtol=1e-4, atol=1e-6)
    assert np.isfinite(survival.likelihood(law, np.array([-40.0, 30.0]), np.array([False, False]))[0]).all()


def test_views_and_registries(spark, scratch):
    df = spark.createDataFrame([(None, 2.0, "a"), (1.0, 3.0, None), (None, None, " ")], "x double, `x.1` double, t string")
    assert [tuple(r) for r in views.coalesced(df).collect()] == [(2.0, "a"), (1.0, None), (None, " ")]
    sheets = spark.createDataFrame([("Parameters",), ("S-N data",), ("e-n",), ("dadN",), ("misc",), (None,)], "s string")
    assert [r.t for r in sheets.select(views.sheet_task("s").alias("t")).collect()] == ["parameter_static", "sn_fatigue", "strain_life_fatigue", "crack_growth", "fatigue_misc", None]
    assert [r.k for r in df.select(views.domain_key("t", F.col("t")).alias("k")).collect()] == ["a|a", "missing|missing", "missing|missing"]
    old, new = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    with pytest.raises(ValueError):
        views.merged_registry(old, new, "k")
    assert {tuple(r) for r in views.merged_registry(old, new, "k", replace=True).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    path = scratch.root + "/store"
    key = tables.registry_key("UTS (MPa)", "process only")
    tables.store_artifact(old, path, key)
    with pytest.raises(ValueError):
        tables.store_artifact(new, path, key)
    tables.store_artifact(new, path, key, replace=True)
    assert tables.load_artifact(spark, path, key).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load_artifact(spark, path, "other")
    with pytest.raises(ValueError):
        tables.archive(spark, path, path + "-old", ["../x"])


def test_interpolation_is_numpys(spark, scratch):
    rng = random.Random(3)
    rows = [("g", float(rng.randint(0, 60)), int(rng.random() < i / 200)) for i in range(200)]
    steps = curves.isotonic(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y", scratch)
    points = curves.break_points(steps, ["g"], "s")
    (known,) = points.collect()
    at = [-5.0, 0.0, 3.3, 17.5, 41.0, 59.9, 99.0]
    got = points.crossJoin(spark.createDataFrame([(a,) for a in at], "a double")).select("a", curves.interpolated(F.col("points"), F.col("a")).alias("v")).collect()
    assert {r.a: pytest.approx(r.v) for r in got} == dict(zip(at, np.interp(at, [p.x for p in known.points], [p.y for p in known.points])))


def test_names(spark):
    df = spark.createDataFrame([(' A:B / "c"?. ', "Journal of Layered Metals", "2019.0", "x"), (" .. ", "", None, "of 1987 and 2001"), (None, None, None, None)], "t string, j string, y string, d string")
    got = [tuple(r) for r in df.select(C.safe_filename("t"), C.initials("j"), C.year_of(F.col("y"), F.col("d"))).collect()]
    assert got == [("A B c", "jolm", "2019"), ("untitled_paper", "unknownjournal", "1987"), ("untitled_paper", "unknownjournal", "unknownyear")]
