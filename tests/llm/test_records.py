"""Capping, canonical values, overlaps and survivors against brute force."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm.canonical import canonicalise
from evispark.llm.capping import cap_contributors
from evispark.llm.overlaps import FullTextIndex, split_overlaps
from evispark.llm.results import result_groups
from evispark.llm.survivors import COMPLETENESS, _layers, skyline_survivors
from evispark.llm.text import source_key

CAP = "row_id long, source_id string, confidence double, extracted_at timestamp, topic string, rank long, kept string"


def cap_rows(n, seed):
    rng = random.Random(seed)
    conf = [None, float("nan"), 1.5, -0.1, 0.0, 0.5, 0.9, 0.9, 1.0]
    when = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    return [(i, rng.choice(["a", " A", "b", "c", None]), rng.choice(conf), rng.choice(when), rng.choice(["x", "y", "z", None]), 0, "") for i in range(n)]


def order(r):
    q = r[2] if r[2] is not None and 0 <= r[2] <= 1 else -1
    return (-q, -(r[3].timestamp() if r[3] else -1e12), r[0])


def test_cap_is_the_ranking(spark):
    rows = cap_rows(400, 1)
    got = {r.row_id for r in cap_contributors(spark.createDataFrame(rows, CAP), source_key("source_id"), 25).where("not kept").collect()}
    by = defaultdict(list)
    for r in rows:
        if r[1]:
            by[r[1].strip().lower()].append(r)
    assert got == {r[0] for g in by.values() for r in sorted(g, key=order)[25:]}
    assert cap_contributors(spark.createDataFrame([], CAP), source_key("source_id"), 25).count() == 0


def quotas(counts, cap, weights):
    """By hand: largest remainders, or one slot after another to whoever has fewest and still rows."""
    total = sum(counts.values())
    if total <= cap:
        return dict(counts)
    key = lambda s: (-counts[s], s is None, s or "")
    if weights == "proportional":
        out = {s: cap * n // total for s, n in counts.items()}
        for s in sorted(counts, key=lambda s: (-(cap * counts[s] % total), *key(s)))[: cap - sum(out.values())]:
            out[s] += 1
        return out
    out = dict.fromkeys(counts, 0)
    level = 0
    while sum(min(n, level + 1) for n in counts.values()) <= cap:
        level += 1
    out = {s: min(n, level) for s, n in counts.items()}
    for s in sorted((s for s in counts if counts[s] > level), key=key)[: cap - sum(out.values())]:
        out[s] += 1
    return out


@pytest.mark.parametrize("weights", ["proportional", "equal"])
def test_strata(spark, weights):
    rows = cap_rows(300, 2) + [(1000 + i, "d", 0.5, None, "x" if i < 200 else f"t{i % 3}", 0, "") for i in range(204)]
    got = Counter((r.contributor, r.stratum) for r in cap_contributors(spark.createDataFrame(rows, CAP), source_key("source_id"), 25, F.col("topic"), weights).where("kept and contributor is not null").collect())
    counts = defaultdict(Counter)
    for r in rows:
        if r[1]:
            counts[r[1].strip().lower()][r[4]] += 1
    want = Counter({(c, s): n for c, by in counts.items() for s, n in quotas(by, 25, weights).items() if n})
    assert got == want


TERMS = "term_id long, field_name string, canonical_label string, known_forms string, value string"
LIST = [(1, "alloy", "Ti-6Al-4V", "Ti64; Ti grade 23", "v"), (2, "alloy", "Inconel 718", "IN718", "v"), (3, "surface_condition", "Machined and polished", "M&P", "v"), (4, "surface_condition", "Shot peened", None, "v"), (4, None, None, None, None)]
FIELDS = "row_id long, alloy string, am_process string, surface_condition string, heat_treatment string, value string, term_id long"


def test_canonical_values(spark, scratch):
    given = {
        "Ti-6Al-4V": 1, "ti 6al 4v": 1, '"Ti64"': 1, "Ti64 [12]": 1, "approx. Ti64": 1, "aprpox. Ti64": 1, "TiAl6V4": 1, "TiAl6V4 (Ti-6Al-4V)": 1, "Inconell 718": 2, "Inconel 713": 0, "Inocnel‐718 *": 2,
        "(Inconel 718)": 2, "n/a": 0, "?": 0, "Tungsten": 0, "x" * 5000: 0, "IN-718 (nominal)": 2,
    }
    given |= {"over-rolled In718": 2, "In718 Ti64": 0, "In718 with 5 % copper": 0, "Inconel 939": 0}
    rows = [(i, v, None, "mach. & polished" if i == 0 else "machined + polished" if i == 1 else "Shot peneed" if i == 2 else " ", "", None, 0) for i, v in enumerate(given)]
    rows += [(100 + i, "TiAl6V4 (Ti-6Al-4V)", None, "Shot peened", None, None, 0) for i in range(30)] + [(200 + i, "Inconel 718", None, None, None, None, 0) for i in range(30)] + [(5, None, None, None, None, None, 0)]
    out = canonicalise(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(LIST, TERMS), scratch).collect()
    got = {(r.row_id, r.field_name): r.term_id for r in out}
    for i, v in enumerate(given):
        assert got[i, "alloy"] == given[v], v
    assert got[1, "surface_condition"] == 3 and got[2, "surface_condition"] == 4 and (3, "surface_condition") not in got
    assert {r.how for r in out} == {"label", "form", "hint", "near", "none"} and (0, "heat_treatment") not in got
    assert canonicalise(spark.createDataFrame([], FIELDS), spark.createDataFrame(LIST, TERMS), scratch).count() == 0
    assert {r.term_id for r in canonicalise(spark.createDataFrame(rows, FIELDS), spark.createDataFrame([], TERMS), scratch).collect()} == {0}


def test_forms_that_the_list_implies(spark, scratch):
    """Grades in Roman digits, element names, and short names that two entries of the list have."""
    terms = [*LIST, (5, "alloy", "Inconel 625", "IN625", "v"), (6, "alloy", "Inconel 939", None, "v"), (7, "alloy", "CuCrZr", None, "v"), (8, "alloy", "CP titanium grade 2", "cp-Ti Gr.2", "v")]
    given = {"IN939": 6, "IN-939": 6, "copper chromium zirconium": 7, "cp-ti gr.II": 8, "CP titanium grade III": 0, "copper": 0}
    df = spark.createDataFrame([(i, v, None, None, None, None, 0) for i, v in enumerate(given)], FIELDS)
    got = {r.value: r.term_id for r in canonicalise(df.drop("value", "term_id"), spark.createDataFrame(terms, TERMS), scratch).collect()}
    assert got == given


def test_misspellings_are_weighed_by_sources_and_entries(spark, scratch):
    """One source that repeats its misspelling hides none, and an entry counts in all its forms."""
    rows = [(i, "Inconell 718", "big") for i in range(50)] + [(100 + i, "IN718", f"s{i}") for i in range(10)] + [(200 + i, "Inconel 719a", f"s{i}") for i in range(5)]
    df = spark.createDataFrame([(i, v, None, None, None, s) for i, v, s in rows], "row_id long, alloy string, am_process string, surface_condition string, heat_treatment string, source_id string")
    got = {r.row_id: r.term_id for r in canonicalise(df, spark.createDataFrame(LIST, TERMS), scratch).collect()}
    assert got == {i: 0 if i >= 200 else 2 for i, _, _ in rows}


def test_full_text_index_is_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc:") for _ in range(rng.randint(1, 12))).encode() for _ in range(150)]
    asked = [rng.choice(texts) for _ in range(60)] + ["".join(rng.choice("abcd:") for _ in range(rng.randint(1, 12))).encode() for _ in range(60)] + [b""]
    least = [rng.randint(1, 5) for _ in asked]
    want = {}
    for i, p in enumerate(asked):
        for j, t in enumerate(texts):
            n = max(n for n in range(len(p) + 1) if p[:n] in t)
            if n >= least[i]:
                want[i, j] = n
    index = FullTextIndex(texts)
    for x in (index, FullTextIndex.unpacked(index.packed())):
        assert {(i, j): n for i, j, n in zip(*x.matches(asked, np.array(least), batch=50))} == want
    assert len(want) > 500


VIEW = "view_row_id long, split_name string, source_id string, record_id string, record_fingerprint string, pub string, yield_strength_mpa double, uts_mpa double, elongation_percent double, hardness_hv double, stress_amplitude_mpa double, r_ratio double, frequency_hz double, log10_fatigue_life_cycles double, spans long"
MEASURES = ("yield_strength_mpa", "uts_mpa", "elongation_percent", "hardness_hv", "stress_amplitude_mpa", "r_ratio", "frequency_hz", "log10_fatigue_life_cycles")
SLACK = dict(zip(MEASURES, (0.5, 0.5, 0.05, 0.5, 0.5, 0, 0, 0.005)))


def alike(a, b, measures, start):
    ok = False
    for i, m in enumerate(measures):
        x, y = a[start + i], b[start + i]
        if x is None or y is None or math.isnan(x) or math.isnan(y):
            continue
        if abs(x - y) > SLACK[m] + 1e-6:
            return False
        ok |= m in ("uts_mpa", "stress_amplitude_mpa")
    return ok


def view_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tensile = rng.random() < 0.5
        u = rng.choice([700.4, 700.0, 700.5, 701.0, 702.0, float("nan"), None]) if tensile else None
        s = None if tensile else rng.choice([300.0, 300.3, 301.1, None])
        rows.append((i, rng.choice(["train", "Train ", "validation", "test", "other", None]), rng.choice(["s1", "s2"]), None, rng.choice([None, "", "f1", "f2", f"q{i}"]), rng.choice(["p1", "p2", None]),
                     rng.choice([None, 600.0, 600.4]) if tensile else None, u, None, rng.choice([None, 200.0]), s, rng.choice([None, 0.1, -1.0]) if s else None, None, rng.choice([None, 5.44, 5.442]) if s else None, 7))
    return rows


def test_overlaps_are_all_pairs(spark, scratch):
    rows = view_rows(160, 6)
    got = {(r.train_id, r.held_id) for r in split_overlaps(spark.createDataFrame(rows, VIEW), scratch).collect()}
    side = lambda r: (r[1] or "").strip().lower()
    want = {
        (a[0], b[0]) for a in rows for b in rows if side(a) == "train" and side(b) in ("validation", "test")
        and ((a[4] and a[4] == b[4]) or (a[5] and a[5] == b[5] and alike(a, b, MEASURES, 6)))
    }
    assert got == want and len(want) > 50
    assert split_overlaps(spark.createDataFrame([], VIEW), scratch).count() == 0
    assert split_overlaps(spark.createDataFrame([r for r in rows if side(r) == "train"], VIEW), scratch).count() == 0


def test_pairs_come_from_the_index(spark, scratch, monkeypatch):
    """Without its partial matches pairs are lost that no equal text has; without any match all are."""
    rows = view_rows(160, 6)
    df = spark.createDataFrame(rows, VIEW)
    whole = {(r.train_id, r.held_id) for r in split_overlaps(df, scratch).collect()}
    equal_only = lambda train, indexes, shards: train.select("id", F.col("id").alias("held_id"), F.length("text").cast("bigint").alias("letters")).distinct()
    monkeypatch.setattr("evispark.llm.overlaps.text_matches", equal_only)
    fewer = {(r.train_id, r.held_id) for r in split_overlaps(df, scratch).collect()}
    assert fewer < whole
    monkeypatch.setattr("evispark.llm.overlaps.text_matches", lambda *a: equal_only(*a).limit(0))
    assert split_overlaps(df, scratch).count() == 0


def test_groups_are_components_of_alike_rows(spark, scratch):
    rows = [(r[0], r[5], *r[6:14]) for r in view_rows(150, 8)]
    schema = "row_id long, pub string, " + ", ".join(f"{m} double" for m in MEASURES)
    got = defaultdict(set)
    for r in result_groups(spark.createDataFrame(rows, schema), scratch).collect():
        got[r.g].add(r.row_id)
    filled = [r for r in rows if r[1] and any(r[i] is not None and not math.isnan(r[i]) for i in (3, 6))]
    parent = {r[0]: r[0] for r in filled}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in filled:
        for b in filled:
            if a[0] < b[0] and a[1] == b[1] and alike(a, b, MEASURES, 2):
                parent[find(b[0])] = find(a[0])
    want = defaultdict(set)
    for r in filled:
        want[find(r[0])].add(r[0])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_layers_are_peeled():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 6, 120))
    x = rng.integers(0, 4, (120, 3)).astype(float)
    left, want, depth = set(range(120)), {}, 1
    while left:
        top = {i for i in left if not any(group[j] == group[i] and (x[j] >= x[i]).all() and (x[j] > x[i]).any() for j in left)}
        want.update(dict.fromkeys(top, depth))
        left -= top
        depth += 1
    assert _layers(group, x).tolist() == [want[i] for i in range(120)]


@pytest.mark.parametrize("large", [5_000, 1])
def test_survivors(spark, scratch, monkeypatch, large):
    monkeypatch.setattr("evispark.llm.survivors.LARGE_GROUP", large)
    kinds = {c: "string" if c in ("doi", "post_processing") else "double" for c in COMPLETENESS}
    schema = "row_id long, confidence double, extracted_at timestamp, alloy string, g long, " + ", ".join(f"{c} {k}" for c, k in kinds.items())
    day = lambda d: dt.datetime(2024, 1, d)

    def row(i, conf, at, alloy, **given):
        return (i, conf, at, alloy, 0, *(given.get(c) for c in COMPLETENESS))

    rows = [
        row(1, 0.9, day(1), None, uts_mpa=700.0, doi="d"), row(2, 0.9, day(2), "A", uts_mpa=700.0, doi=" "), row(3, 0.95, day(3), "B", uts_mpa=700.0, laser_power_w=float("nan")), row(4, 0.9, day(1), None, uts_mpa=700.0, doi="e"),
        row(5, None, None, "C", stress_amplitude_mpa=3.0), row(6, 7.0, None, "D", stress_amplitude_mpa=3.0),
    ]
    groups = spark.createDataFrame([(i, "x", 4) for i in (1, 2, 3, 4)] + [(5, "y", 2), (6, "y", 2)], "row_id long, g string, n long")
    df = spark.createDataFrame(rows, schema)
    out = {r.g: r for r in skyline_survivors(df, groups, scratch, fields=("doi", "alloy", "uts_mpa")).collect()}
    assert out["x"].survivor == 1 and out["x"].doi == "d" and out["x"].alloy == "B" and out["x"].n_records == 4
    assert out["y"].survivor == 5 and out["y"].alloy == "C"
    assert skyline_survivors(df, groups.limit(0), scratch).count() == 0


@pytest.mark.parametrize("large", [5_000, 1])
def test_records_that_give_nothing_still_make_layers(spark, scratch, monkeypatch, large):
    monkeypatch.setattr("evispark.llm.survivors.LARGE_GROUP", large)
    many = list(COMPLETENESS[3:])

    def row(i, conf, day, *given, alloy=None):
        return (i, conf, dt.datetime(2024, 1, day), alloy, *(1.0 if c in given else None for c in many))

    # s beats r, which is filled alike and beats x; y is beaten by s only.
    rows = [row(1, 0.9, 9, *many[:8]), row(2, 0.8, 8, *many[:8]), row(3, 0.7, 7, *many[1:8], alloy="x"), row(4, 0.85, 6, *many[2:8], alloy="y")]
    df = spark.createDataFrame(rows, "row_id long, confidence double, extracted_at timestamp, alloy string, " + ", ".join(f"{c} double" for c in many))
    groups = spark.createDataFrame([(i, "g", 4) for i in range(1, 5)], "row_id long, g string, n long")
    (out,) = skyline_survivors(df, groups, scratch, fields=("alloy",)).collect()
    assert (out.survivor, out.n_layers, out.alloy) == (1, 3, "y")
