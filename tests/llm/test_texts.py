"""Tokens, containers and spam pages."""

import base64
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import spam
from evispark.llm.packing import SPREAD, best_fit, conflicts, pack_bucket, pack_documents, unused_space
from evispark.llm.queries import QUERIES
from evispark.llm.spam import Batch, Corpus, Rules, Sorted, hashed_words, page_scores
from evispark.llm.tokens import PATTERN, TOKENIZERS, encoded, tokenizer


@pytest.fixture(scope="module")
def public():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "\n\n  x ", "a" * 3000, "ab" * 2000, "<|endoftext|>", "🙂🙂 été 　x", "'s'll we'LL 3.14 °C µm", "​﻿", "x́y", "الاختبار 疲労 試験", "	tab\tseparated\r\n"]


def test_ids_are_those_of_the_public_library(public):
    assert tokenizer().encode([*HARD, None]) == [*map(public.encode_ordinary, HARD), []]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ids = tokenizer().encode([text])[0]
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    assert b"".join(back[i] for i in ids).decode() == text


def test_query_form(spark, public):
    rows = [(i, t, "x") for i, t in enumerate([*HARD, None, "twice", "twice"])]
    got = {r.doc_id: r.ids for r in spark.createDataFrame(rows, "doc_id long, text string, ids string").select("doc_id", encoded(F.col("text")).alias("ids")).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t, _ in rows}


def bucket(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(9000, rng.lognormal(5, 1.2, n).astype(int))
    cluster = np.arange(n) + 1000
    cluster[:copies], sizes[:copies] = 7, 90
    return pd.DataFrame({"doc_id": np.arange(n), "n": sizes, "cluster": cluster, "source": [f"s{i % 5}" for i in range(n)]})


@pytest.mark.parametrize("capacity", [512, 2048])
def test_containers(capacity):
    items = bucket(3000, 1, copies=60)
    out = pack_bucket(items, capacity)
    used = out.groupby("container")["n_tokens"].sum()
    assert used.max() <= capacity
    assert 1 - used.sum() / (len(used) * capacity) < 0.02
    size = dict(zip(items["doc_id"], items["n"]))
    for d, pieces in out.sort_values("first_token").groupby("doc_id"):
        assert pieces["n_tokens"].sum() == size[d] and (len(pieces) == 1) == (size[d] <= capacity)
        assert pieces["first_token"].tolist() == np.r_[0, pieces["n_tokens"].cumsum()[:-1]].tolist()
    assert out[out["doc_id"] < 60].groupby("container").size().max() == 1  # copies apart
    # No more of a source in a container than its shares of half the containers that are needed.
    last = out.sort_values("piece").groupby("doc_id").tail(1)
    fewest = -(-last["n_tokens"].sum() // capacity)
    last = last[last["n_tokens"] > 0].merge(items[["doc_id", "source"]])
    shares = -(-last.groupby("source").size() // max(1, fewest // SPREAD))
    most = last.groupby(["container", "source"]).size().groupby("source").max()
    assert (most <= shares).all()


def test_sources_are_as_far_apart_as_space_allows():
    """Many small documents of twenty sources: no more of one in a container than its even part, without a container more."""
    rng = np.random.default_rng(5)
    items = pd.DataFrame({"doc_id": np.arange(4000), "n": rng.integers(20, 60, 4000), "cluster": np.arange(4000), "source": np.arange(4000) % 20})
    out = pack_bucket(items, 2048).merge(items[["doc_id", "source"]])
    fewest = -(-items["n"].sum() // 2048)
    assert out["container"].nunique() <= fewest + 1
    assert out.groupby(["container", "source"]).size().max() <= 2 * -(-200 // fewest)


def test_more_copies_than_containers():
    """A third of all rows is one text: every container gets its copies as evenly as it can."""
    items = bucket(900, 2)
    items.loc[:299, ["cluster", "n"]] = (7, 100)
    out = pack_bucket(items, 2048)
    per = out[out["doc_id"] < 300].groupby("container").size()
    fewest = -(-out["n_tokens"].sum() // 2048)
    assert per.max() <= -(-300 // fewest) + 1
    used = out.groupby("container")["n_tokens"].sum()
    assert 1 - used.sum() / (len(used) * 2048) < 0.05


def test_best_fit_is_the_tightest_compatible():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 60) for _ in range(200)), reverse=True)
    clusters = [1 << rng.randint(0, 3) if rng.random() < 0.3 else 0 for _ in sizes]
    sources = [1 << rng.randint(0, 30) if rng.random() < 0.6 else 0 for _ in sizes]
    got = best_fit(sizes, clusters, sources, 100)
    left, held, of = [], [], []
    for size, cluster, source, b in zip(sizes, clusters, sources, got):
        fits = [left[i] for i in range(len(left)) if left[i] >= size and not held[i] & cluster and not of[i] & source]
        if b == len(left):
            assert not fits
            left.append(100)
            held.append(0)
            of.append(0)
        else:
            assert left[b] == min(fits) and not held[b] & cluster and not of[b] & source
        left[b] -= size
        held[b] |= cluster
        of[b] |= source


def test_packing_in_spark(spark, scratch):
    docs = spark.createDataFrame([(1, "word " * 700, "a", "c"), (2, "short", None, "c"), (3, None, "a", "c"), (4, "", "a", "c"), (5, "short", "a", "c")], "doc_id long, text string, source string, capacity_tokens string")
    specs = spark.createDataFrame([(1, "small", 512), (2, "none", None), (3, "bad", 0)], "spec_id long, spec_name string, capacity_tokens long")
    out = pack_documents(docs, specs, scratch).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5} and {r.spec_id for r in out} == {1}
    assert sorted(r.n_tokens for r in out if r.doc_id == 1)[-1] == 512
    assert pack_documents(docs.limit(0), specs, scratch).count() == 0
    assert pack_documents(docs, specs.limit(0), scratch).count() == 0
    assert unused_space(pack_documents(docs, specs, scratch)).count() == 1
    met = {r.what: (r.n_meetings, r.most) for r in conflicts(pack_documents(docs, specs, scratch), docs).collect()}
    assert set(met) == {"text", "source"} and all(most == n + 1 for n, most in met.values())  # few documents, two containers


def test_little_is_left_unused(spark, scratch):
    """The registered queries on the whole smaller tables: every document once in full, little space left."""
    sf = "/root/testdata/sf0.01"
    out = QUERIES["p9_containers"](spark, sf).cache()
    sized = {r.doc_id: r.n for r in QUERIES["p8_ids"](spark, sf).select("doc_id", F.size("ids").alias("n")).collect()}
    for spec in (r.spec_id for r in out.select("spec_id").distinct().collect()):
        assert {r.doc_id: r.n for r in out.where(F.col("spec_id") == spec).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == sized
    assert out.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.first("capacity_tokens").alias("c")).where("n > c").count() == 0
    assert all(r.unused_share < (0.005 if r.capacity_tokens < 8000 else 0.03) for r in unused_space(out).collect())
    assert all(r.n_meetings == 0 for r in conflicts(out, spark.read.parquet(f"{sf}/documents.parquet")).where("what = 'text' and capacity_tokens < 1000").collect())


NORMAL = "the fatigue strength of the welded bar was lower than that of the plate after {} cycles because a pore near the edge started the crack and the {} specimen failed".split()


def corpus():
    rng = random.Random(9)
    good = [" ".join(NORMAL).format(rng.randint(1, 99), rng.choice(["first", "second"])) + f". Sample {i} held {rng.randint(100, 900)} MPa" for i in range(200)]
    words = ["cheap powder", "metal prints", "buy nozzle", "fast quote", "near me"]
    stuffed = [" ".join(f"{rng.choice(words)} {words[0]}" for _ in range(30)) for _ in range(12)]
    links = ["\n".join(f"[{rng.choice(words)}](https://shop.test/{rng.randint(1, 999)})" for _ in range(15)) for _ in range(8)]
    bare = ["\n".join(f"https://shop.test/{rng.randint(1, 999)}" for _ in range(9))]
    logs = ["\n".join(f"2024-01-{k:02} layer {rng.randint(1, 999)} laser on" for k in range(1, 25)) for _ in range(12)]
    return good + logs, stuffed + links + bare


def test_pages(spark, scratch):
    good, bad = corpus()
    texts = good + bad + [None, "", " \n", "one", "powder " * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    found = {r.doc_id for r in page_scores(df, scratch).where("found").collect()}
    assert found == set(range(len(good), len(good) + len(bad)))
    assert page_scores(df.limit(0), scratch).count() == 0
    assert page_scores(df.where(f"doc_id < {len(good)}"), scratch).where("found").count() == 0


def test_counts_and_pmi_are_those_by_hand():
    texts = ["a b a b 12 c", "b a 7 8", "", "c c c"]
    b = Batch.of([hashed_words(t) for t in texts])
    counts = b.counts().set_index("feature")
    word = lambda w: hashed_words(w)[0]
    assert counts.loc[word("a")].tolist() == [3, 2] and counts.loc[word("c")].tolist() == [4, 2] and counts.loc[0].tolist() == [3, 2]
    ab, ba = (int(Batch.mixed(np.array([word(x)]), np.array([word(y)]))[0]) for x, y in ("ab", "ba"))
    assert counts.loc[ab].tolist() == [2, 1] and counts.loc[ba].tolist() == [2, 2]
    assert b.held_by(np.array([True, False, False, False])).set_index("feature").loc[ab].tolist() == [0, 1]
    shared = counts[counts["df"] >= 2].reset_index()
    corpus = Corpus(len(b.word), 4, Sorted(shared, "n", "df"), 2)
    n, total = counts["n"], len(b.word)
    chance = n[word("a")] * n[word("b")] / total
    # The pair ab is of this page alone, so it has one smoothed occurrence each time; ba is shared.
    want = np.mean([-np.log1p(chance)] * 2 + [np.log(n[ba] / chance)])
    for known, rare in ((corpus, None), (Corpus(len(b.word), 4, Sorted(shared[:0], "n", "df"), 9), shared.assign(df_suspect=0))):
        assert known.judge(b, Rules(), rare)[1][0] == pytest.approx(want)
    assert Batch.stored(b.store()).counts().equals(b.counts())


def test_without_pmi_nothing_is_found(spark, scratch):
    """Each of the two uses of PMI finds pages that the others don't."""
    good, bad = corpus()
    salad = " ".join(random.Random(3).choices([w for w in NORMAL if w != "{}"] + ["laser", "layer", "sample"], k=60))
    df = spark.createDataFrame(list(enumerate([*good, *bad, salad])), "doc_id long, text string")
    found = lambda **kw: {r.doc_id for r in page_scores(df, scratch, Rules(**kw)).where("found").collect()}
    everything = set(range(len(good), len(good) + len(bad) + 1))
    assert found() == everything
    assert found(collocation=np.inf, deviations=np.inf) == set()
    assert found(deviations=np.inf) == everything - {max(everything)}
    assert found(collocation=np.inf) < everything


def test_pages_stuffed_with_their_own_words(spark, scratch, monkeypatch):
    """However rare the words are, and wherever the broadcast counts end."""
    good, _ = corpus()
    own = [" ".join(["zintor blade", "qualit zintor"] * 20), "\n".join(f"[vorn{i} mask{i}](https://shop.test/{i})" for i in range(15))]
    shared = [" ".join(f"kelmo {w} trask" for w in "ab cd ef gh ij kl mn op qr st uv wx".split() * 3)] * 3
    quote = ["kelmo ab trask kelmo cd trask kelmo ef trask kelmo gh trask"]  # of a suspect's words, too short to be suspect itself
    df = spark.createDataFrame(list(enumerate(good + own + shared + quote)), "doc_id long, text string")
    want = set(range(len(good), len(good) + 6))
    for most in (1_000_000, 40, 0):
        monkeypatch.setattr("evispark.llm.spam.MOST_LISTED", most)
        assert {r.doc_id for r in page_scores(df, scratch).where("found").collect()} == want


def test_stored_batches_are_small(spark, scratch, monkeypatch):
    """Short files of the words alone; rare counts as bytes, not as lists of rows."""
    monkeypatch.setattr(spam, "BATCH_WORDS", 40)
    good, bad = corpus()
    texts = [t for t in good + bad if len(hashed_words(t)) > 40]
    df = spark.createDataFrame(list(enumerate(texts * 10)), "doc_id long, text string").coalesce(1)
    stored = spam.batches(df, scratch)
    assert max(r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()) <= 16 < stored.count()
    assert set(stored.columns) == {"batch", "ids", "sizes", "words", "word"}
    counts = scratch.keep(spam._counted(stored))
    known = spark.sparkContext.broadcast(Corpus(1, 1, Sorted(counts.limit(0).toPandas(), "n", "df"), 1_000_000))
    rare = spam._with_rare(stored, counts, None, known, scratch)
    assert dict(rare.dtypes)["rare"] == "binary" and rare.count() == stored.count()
    row = rare.first().asDict()
    want = {r.feature: (r.n, r.df) for r in counts.where("df >= 2 and feature >= 0").collect()}
    got = {r.feature: (r.n, r.df) for r in spam._rare_of(row).itertuples()}
    assert got == {f: want[f] for f in Batch.stored(row).features.tolist() if f in want} and got


def test_word_salad_without_suspects(spark, scratch):
    good, _ = corpus()
    rng = random.Random(3)
    words = [w for w in NORMAL if w != "{}"] + ["laser", "layer", "sample"]
    salad = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    foreign = " ".join(f"wort{i}" for i in range(60))  # nothing is known of its words
    df = spark.createDataFrame(list(enumerate([*good, *salad, foreign])), "doc_id long, text string")
    assert {r.doc_id for r in page_scores(df, scratch).where("found").collect()} == set(range(len(good), len(good) + 3))
