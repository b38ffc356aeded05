import itertools
import random

from pyspark.sql import functions as F

from evispark.llm.components import connected_components
from evispark.llm.publications import publication_splits, publications, same_publication_pairs
from evispark.llm.queries import QUERIES
from evispark.llm.text import doi_key, osa, source_key

RECORDS = "row_id long, source_id string, record_id string, source_title string, doi string, alloy string, am_process string, key string, pub string"
TERMS = "term_id long, field_name string, canonical_label string, known_forms string"
LIST = [(1, "alloy", "17-4PH stainless steel", "17/4PH; 1.4542"), (2, "am_process", "Wire arc additive manufacturing", "WAAM"), (3, "alloy", "AlSi10Mg", None)]


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_are_those_of_union_find(spark, scratch):
    rng = random.Random(1)
    sets = [
        [(f"n{rng.randint(0, 150):03}", f"n{rng.randint(0, 150):03}") for _ in range(110)],
        [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)],  # a path
        [("hub", f"x{i}") for i in range(300)] * 2,  # a hot node, repeated
        [("a", "a"), (None, "b"), ("c", None)],
        [],
    ]
    for edges in sets:
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string"), scratch).collect()}
        want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
        assert got == want


def run(spark, scratch, rows):
    df = spark.createDataFrame([(i, s, r, t, d, None, None, "k", "p") for i, (s, t, d, r) in enumerate(rows)], RECORDS)
    pubs = publications(df, spark.createDataFrame(LIST, TERMS), scratch).cache()
    return df, pubs, {(r.source_id_a, r.source_id_b) for r in same_publication_pairs(pubs).collect()}


BASE = "Fatigue of 17-4PH stainless steel bolt blanks made by wire arc additive manufacturing under torsion"


def test_titles_however_written(spark, scratch):
    filler = [(f"f{i}", f"Fatigue response number {i} of stainless steel blanks made by wire arc additive manufacturing under torsion" + (" of a bolt in a wide tool" if i % 2 else ""), None, f"x{i}") for i in range(40)]
    forms = [
        BASE, f"{BASE}: first results", f"{BASE}  first results", f"[Preprint] {BASE.upper()} ®", BASE.replace("17-4PH stainless steel", "17/4PH").replace("wire arc additive manufacturing", "WAAM"),
        BASE.replace(" ", "_"), BASE.replace("stainless", "stainlses"), f"Title: {BASE} &amp;#8212; first results", f"{BASE} | Journal of Layers", BASE.replace("-", "‐"), BASE.replace("Fatigue", "Fátigue") + " (accepted version)",
        BASE.replace("bolt", "botl"), BASE.replace("bolt", "bolt").replace("wire arc", "wier arc"), BASE.replace("17-4PH", "17 – 4PH"),
    ]
    rows = [(f"s{i:02}", t, None, f"r{i}") for i, t in enumerate(forms)]
    other = [("t1", BASE.replace("bolt", "gear"), None, "u1"), ("t2", f"{BASE}, part 1", None, "u2"), ("t3", f"{BASE}, part 2", None, "u3")]
    _, pubs, pairs = run(spark, scratch, rows + other + filler)
    assert pairs == set(itertools.combinations([f"s{i:02}" for i in range(len(forms))], 2))


def test_dois_records_placeholders_collections(spark, scratch):
    rows = [
        (" A1 ", None, "https://doi.example/10.99101/X.1", None), ("a1", "Untitled", None, "r1"), ("b1", "Untitled", "10.99101 / x.1.", None), ("b1", None, None, "r2"),
        ("c1", "n/a", None, "R2"), ("d1", None, None, None), (None, BASE, "10.99101/x.1", "r1"), ("  ", BASE, None, None),
        *((f"big", f"{BASE} {i}", f"10.99101/big.{i}", None) for i in range(9)), ("e1", None, "10.99101/big.3", None),
    ]
    _, pubs, pairs = run(spark, scratch, rows + rows)
    assert pairs == {("a1", "b1"), ("a1", "c1"), ("b1", "c1")}
    assert {r.s for r in pubs.where("many").collect()} == {"big"}


def test_empty(spark, scratch):
    df, pubs, pairs = run(spark, scratch, [])
    assert pairs == set() and pubs.count() == 0


def test_splits_keep_publications_together_and_shares(spark, scratch):
    rng = random.Random(2)
    sizes = [600] + [rng.randint(1, 30) for _ in range(400)]
    rows = [(f"s{k}", None, None, None) for k, n in enumerate(sizes) for _ in range(n)] + [(None, None, None, None)] * 5
    df, pubs, _ = run(spark, scratch, rows)
    plan = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, row_share double")
    out = publication_splits(df, pubs, plan)
    assert out.count() == len(rows) and out.groupBy("pub").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    share = {r.split_name: r["count"] / len(rows) for r in out.groupBy("split_name").count().collect()}
    assert abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.05 and abs(share["validation"] - 0.1) < 0.05


def test_rows_without_source_follow_their_doi(spark, scratch):
    rows = [("a", None, "10.99101/x.1", None)] * 3 + [(None, None, "doi:10.99101/X.1", None), (" ", None, "10.99101/y.2", None), (None, None, "10.99101/y.2", None), (None, None, None, None)]
    df, pubs, _ = run(spark, scratch, rows)
    plan = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, row_share double")
    got = {r.row_id: r.pub for r in publication_splits(df, pubs, plan).collect()}
    assert len(got) == len(rows) and got[3] == got[0] == "a" and got[4] == got[5] != "a" and got[6] not in {got[0], got[4]}


def test_collections_and_placeholders_are_told_by_shares(spark, scratch):
    """Misread DOIs of some rows make no collection, at any size."""
    for times in (1, 30):
        rows = [("p", f"{BASE} one", "10.99101/p.1", None)] * 20 * times + [("p", None, f"10.99101/p.1{i}", None) for i in range(6 * times)] + [("q", f"{BASE} one", None, None)]
        rows += [("big", None, f"10.99101/b.{i}", None) for i in range(9 * times)]
        _, pubs, pairs = run(spark, scratch, rows)
        assert pairs == {("p", "q")} and {r.s for r in pubs.where("many").collect()} == {"big"}


def test_keys(spark):
    df = spark.createDataFrame([(" 10.99101%2FABC.1) ", "\t Ab\n"), ("doi:10.99101/abc.1;", " "), ("none", None), (None, "ab")], "d string, s string")
    assert [tuple(r) for r in df.select(doi_key("d"), source_key("s")).collect()] == [("10.99101/abc.1", "ab"), ("10.99101/abc.1", None), (None, None), (None, "ab")]
    assert osa("made", "mdae", 1) == 1 and osa("made", "mdae", 1, swap=0.8) == 0.8 and osa("abc", "xyz", 2) == 3


def test_registered_splits(spark):
    """On the dirty tables: every record once, no DOI of a publication and no record_id in two splits, shares near the plan."""
    sf = "/root/testdata/sf0.01"
    records = spark.read.parquet(f"{sf}/extraction_records.parquet").select("row_id", "record_id", source_key("source_id").alias("s"), doi_key("doi").alias("d"))
    out = records.join(QUERIES["p1_splits"](spark, sf), "row_id").cache()
    assert out.count() == records.count()
    for c in ("pub", "s", "record_id", "d"):
        assert out.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    share = {r.split_name: r["count"] / records.count() for r in out.groupBy("split_name").count().collect()}
    for r in spark.read.parquet(f"{sf}/split_plan.parquet").collect():
        assert abs(share[r.split_name] - r.row_share) < 0.03


def test_forms_beyond_the_broadcast_ones_count_too(spark, scratch, monkeypatch):
    """A title with any learnt form of an entry has the key of the same title with the entry's name."""
    forms = ["sparkmet", "zetalloy", "quorbic"]
    title = "Fatigue life of {} brackets in moist air"
    rows = [(f"s{i}", title.format(name)) for i, name in enumerate(["AlSi10Mg", *forms])]
    records = [(i, s, f"r{i}", t, None, None, None) for i, (s, t) in enumerate(rows)]
    records += [(100 + i, f"x{i}", f"x{i}", None, None, f"{f} (AlSi10Mg)", None) for f in forms for i in range(2)]
    df = spark.createDataFrame(records, RECORDS.split(", key")[0])
    terms = spark.createDataFrame(LIST, TERMS)
    for most in (200, 1):
        for module in ("canonical", "publications"):
            monkeypatch.setattr(f"evispark.llm.{module}.MOST_FORMS", most, raising=False)
        pubs = {r.s: r.pub for r in publications(df, terms, scratch).collect()}
        assert {pubs[s] for s, _ in rows} == {"s0"}
