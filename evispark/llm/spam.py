"""Problem 10: keyword-stuffed and link-list pages.

Words and pairs of neighbouring words are counted over the whole corpus. From these counts come the pointwise mutual
information (PMI) of neighbours. A page is found when

 * its mean PMI is low: incoherent word salad, or
 * much of it is collocations (pairs of high PMI) that it repeats in excess, or
 * most of its pairs are at home in pages found so: their log-odds, from counts of the pages found by the first two, and
   then twice more with the pages that these odds find. Without PMI no page is found, so no pair has odds.

An address, or a link with its text, is one word that stands for all of them, so is a hash tag: a list of them is one
collocation repeated.
Numbers stand for one another too, but pairs with a number are never collocations, so tables and logs, whose phrases repeat
around numbers, are no repetition.

All counts are used, however rare the word or pair: at most MOST_LISTED of the most frequent are broadcast, the rarer ones
joined to the batches of documents that hold them. What one page alone holds needs no join: its counts are the page's own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.tokens import spread
from evispark.session import Scratch

#: The words that stand for addresses and for tags; letters that no text is likely to hold alone.
_ADDRESS, _HASH = " ꙮ ", " Ꙭ "
_URL = re.compile(r"(?:https?://|www\.)[^\s)\"'<>\]]+", re.I)
_CONTENT = re.compile(r"content=\"([^\"]*)\"")
_TAG = re.compile(r"<[^>]{0,300}>")
#: A link with its text, in markup and in markdown; an opening tag whose end is missing.
_LINKED = re.compile(r"<a\s[^<>]{0,400}>[^<>]{0,200}</a>", re.I)
_MARKDOWN = re.compile(r"\[[^\[\]]{0,200}\]\((?:https?://|www\.|/)[^\s()]{0,400}\)", re.I)
_LINK = re.compile(r"<a\s", re.I)
_HASHTAG = re.compile(r"(?<!\S)#[^\W\d_][\w-]+|(?<!\S)#\d+[\w-]*[^\W\d_][\w-]*")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+[a-z]{0,2}")
_MASK = (1 << 62) - 1
MOST_CACHED = 300_000

#: Words of a batch of documents, batches of a stored file, and words and pairs that are broadcast at most; the others are
#: joined. Layout only. A writer holds a hundred rows before it looks at their size, so files are kept short.
BATCH_WORDS, FILE_BATCHES, MOST_LISTED = 250_000, 16, 1_000_000


@dataclass(frozen=True)
class Rules:
    """collocation: the PMI from which a pair is one. repeats, repeat_share: how often, and for what part of the page's
    pairs, a collocation is repeated in excess. stuffed: the part of the pairs from which a page of at least words words is
    made of them, with at most the part numbers of numbers. deviations: how many below the mean of all pages a mean PMI is
    low, if at least the part judged of the pairs is of words that other pages know. odds, most: the log-odds from which a
    pair, and the part of pairs from which a page of at least few words, is spam. rounds: of counting with what is found."""

    collocation: float = 2.0
    repeats: int = 3
    repeat_share: float = 0.01
    stuffed: float = 0.5
    numbers: float = 0.03
    words: int = 30
    deviations: float = 2.0
    judged: float = 0.5
    odds: float = 0.7
    most: float = 0.4
    few: int = 8
    rounds: int = 3


_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    """62 bits of a word; numbers are all 0."""
    if _NUMBER.fullmatch(word):
        h = 0
    else:
        h = (xxhash.xxh64_intdigest(word) & _MASK) | 1
    if len(_hashes) > MOST_CACHED:
        _hashes.clear()
    _hashes[word] = h
    return h


def hashed_words(text: str) -> list[int]:
    """Hashed words without markup; addresses, links and tags as the words that stand for them."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _LINK.sub(_ADDRESS + "<a ", _LINKED.sub(_ADDRESS, text))
        text = _TAG.sub(" ", _CONTENT.sub(r"> \1 <", text))
    if "](" in text:
        text = _MARKDOWN.sub(_ADDRESS, text)
    if "://" in text or "www." in text or "WWW." in text:
        text = _URL.sub(_ADDRESS, text)
    if "#" in text:
        text = _HASHTAG.sub(_HASH, text)
    known = _hashes.get
    return [h if (h := known(w)) is not None else _hash(w) for w in _WORD.findall(text.lower())]


class Batch:
    """Words and pairs of some documents in flat arrays: the distinct ones (words, pairs; together the features), the place
    of each among them, and which document holds which feature. Only the words are stored; the pairs follow from them."""

    _ARRAYS = {"sizes": "<i4", "words": "<i8", "word": "<i4"}

    @classmethod
    def of(cls, texts: list[list[int]]) -> Batch:
        b = cls.__new__(cls)
        b.sizes = np.array([len(t) for t in texts], dtype=np.int32)
        flat = np.fromiter((w for t in texts for w in t), dtype=np.int64, count=int(b.sizes.sum()))
        b.word, b.words = pd.factorize(flat)
        b._places()
        return b

    def store(self) -> dict[str, bytes]:
        """The arrays as bytes: cheaper to write and read than lists of numbers."""
        return {k: getattr(self, k).astype(t).tobytes() for k, t in self._ARRAYS.items()}

    @classmethod
    def stored(cls, row) -> Batch:
        b = cls.__new__(cls)
        for k, t in cls._ARRAYS.items():
            setattr(b, k, np.frombuffer(row[k], dtype=t).astype(np.int64))
        b._places()
        return b

    def _places(self) -> None:
        self.docs = len(self.sizes)
        self.doc = np.repeat(np.arange(self.docs), self.sizes)
        number = self.words[self.word] == 0 if len(self.words) else np.zeros(0, dtype=bool)
        self.numbers = np.bincount(self.doc[number], minlength=self.docs) / np.maximum(1, self.sizes)
        real = (self.doc[:-1] == self.doc[1:]) & ~(number[:-1] & number[1:])
        self.left, self.right, self.pair_doc = self.word[:-1][real], self.word[1:][real], self.doc[:-1][real]
        self.verbal = ~(number[:-1] | number[1:])[real]
        self.pairs_in = np.bincount(self.pair_doc, minlength=self.docs)
        self.pair, distinct = pd.factorize(self.left * max(1, len(self.words)) + self.right)
        x, y = np.divmod(distinct, max(1, len(self.words)))
        self.pairs = self.mixed(self.words[x], self.words[y])

    @cached_property
    def _holding(self) -> tuple[np.ndarray, np.ndarray]:
        """The features that documents hold, each once a document, and the documents."""
        each = pd.unique(np.r_[self.word * self.docs + self.doc, (self.pair + len(self.words)) * self.docs + self.pair_doc])
        return np.divmod(each, max(1, self.docs))

    @staticmethod
    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        return (mixed & np.uint64(_MASK)).astype(np.int64) & ~np.int64(1)  # even: never a word

    @property
    def features(self) -> np.ndarray:
        return np.r_[self.words, self.pairs]

    def own(self) -> np.ndarray:
        """How often each feature stands in the batch."""
        return np.r_[np.bincount(self.word, minlength=len(self.words)), np.bincount(self.pair, minlength=len(self.pairs))]

    def share(self, what: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_doc, weights=what, minlength=self.docs) / np.maximum(1, self.pairs_in)

    def repeated(self, rules: Rules) -> np.ndarray:
        """Whether a document repeats the pair that stands at each place in excess; pairs with a number never."""
        place, _ = pd.factorize(self.pair_doc * max(1, len(self.pairs)) + self.pair)
        times = np.bincount(place)[place] if len(place) else np.zeros(0)
        return (times >= rules.repeats) & (times >= rules.repeat_share * self.pairs_in[self.pair_doc]) & self.verbal

    def counts(self) -> pd.DataFrame:
        """(feature, n, df) of words and pairs."""
        features = self.features
        return pd.DataFrame({"feature": features, "n": self.own(), "df": np.bincount(self._holding[0], minlength=len(features))})

    def held_by(self, docs: np.ndarray) -> pd.DataFrame:
        """(feature, n, df): of the features that some documents hold, the number of these documents as df."""
        held, holder = self._holding
        df = np.bincount(held[docs[holder]], minlength=len(self.words) + len(self.pairs))
        some = df > 0
        return pd.DataFrame({"feature": self.features[some], "n": 0, "df": df[some]})


class Sorted:
    """Values by feature, sorted for binary search."""

    def __init__(self, rows: pd.DataFrame, *columns: str):
        rows = rows.sort_values("feature")
        self.feature = rows["feature"].to_numpy(dtype=np.int64)
        self.values = [rows[c].to_numpy(dtype="float64") for c in columns]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(whether listed, each value or 0) of the keys."""
        if not len(self.feature):
            return (np.zeros(len(keys), dtype=bool), *(np.zeros(len(keys)) for _ in self.values))
        at = np.minimum(np.searchsorted(self.feature, keys), len(self.feature) - 1)
        hit = self.feature[at] == keys
        return (hit, *(np.where(hit, v[at], 0.0) for v in self.values))


@dataclass
class Corpus:
    """What is known of all documents. least: features in at least so many documents are listed in counts; what fewer but
    more than one hold comes with each batch. suspects: documents by listed feature, of_suspects in all. pmi: the mean and
    deviation of the pages' mean PMI, once known."""

    words: int
    docs: int
    counts: Sorted
    least: float
    suspects: Sorted | None = None
    of_suspects: int = 0
    pmi: tuple[float, float] | None = None

    def judge(self, b: Batch, rules: Rules, rare: pd.DataFrame | None = None) -> tuple[np.ndarray, ...]:
        """(share of spam pairs, mean PMI, excess, low, odds) of each document; the last three say whether it is found so."""
        features = b.features
        shared, n, df = self.counts.find(features)
        bad = self.suspects.find(features)[1] if self.suspects else np.zeros(len(features))
        if rare is not None and len(rare):
            more, m, d, s = Sorted(rare, "n", "df", "df_suspect").find(features)
            shared, n, df, bad = shared | more, np.where(more, m, n), np.where(more, d, df), np.where(more, s, bad)
        # What no other document holds stands here only.
        n = np.where(shared, n, b.own())
        words = len(b.words)
        lone, pair_n, word_n = ~shared[words:][b.pair], n[words:][b.pair], n[:words]
        chance = word_n[b.left] * word_n[b.right] / max(1, self.words)
        pmi = np.log(pair_n / chance)
        excess = b.repeated(rules) & (pmi >= rules.collocation)
        enough = b.sizes >= rules.words
        stuffed = (b.share(excess) > rules.stuffed) & (b.numbers < rules.numbers) & (b.sizes >= rules.few)
        # In the mean, a pair of this page alone has one smoothed occurrence, if other pages know both of its words.
        judged = shared[:words][b.left] & shared[:words][b.right] & b.verbal
        smoothed = np.where(judged, np.where(lone, -np.log1p(chance), pmi), 0.0)
        seen, of = (np.bincount(b.pair_doc, weights=x, minlength=b.docs) for x in (judged, b.verbal))
        mean = np.bincount(b.pair_doc, weights=smoothed, minlength=b.docs) / np.maximum(1, seen)
        mean = np.where((seen > 0) & (seen >= rules.judged * of), mean, np.nan)
        low = (mean < self.pmi[0] - rules.deviations * self.pmi[1]) & enough if self.pmi else np.zeros(b.docs, dtype=bool)
        share = np.zeros(b.docs)
        if self.of_suspects:
            # One document's worth of pseudo-counts, shared as the documents are: nothing known means no odds.
            good, s, o, total = df - bad, self.of_suspects, self.docs - self.of_suspects, max(1, self.docs)
            odds = np.log((bad + s / total) / (s + 1)) - np.log((good + o / total) / (o + 1))
            x, y = (np.where(shared[:words], odds[:words], 0.0)[side] for side in (b.left, b.right))
            by_words = np.where(np.minimum(x, y) > 0, np.maximum(x, y), np.minimum(x, y))
            spam = np.where(lone, by_words, odds[words:][b.pair]) > rules.odds
            share = b.share(spam | (lone & stuffed[b.pair_doc]))
        return share, mean, stuffed, low, (share > rules.most) & (b.sizes >= rules.few)


#: Features of totals: documents and words; suspects; the pages that have a mean PMI, and sums of it and its square, in millionths.
_TOTAL, _SUSPECT, _PMI, _PMI2 = -1, -2, -3, -4
_COUNTS = "feature bigint, n bigint, df bigint"


def _merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of several batches added up before they leave the task."""
    held, rows = [], 0
    for p in parts:
        held.append(p)
        rows += len(p)
        if rows > 2_000_000:
            yield pd.concat(held).groupby("feature", as_index=False, sort=False).sum()
            held, rows = [], 0
    if held:
        yield pd.concat(held).groupby("feature", as_index=False, sort=False).sum()


def batches(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(batch, ids, arrays...): the documents by some hundred thousand words, one row each, hashed and paired once."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            ids, texts, words = [], [], 0
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids.append(i)
                texts.append(hashed_words(t) if isinstance(t, str) else [])
                words += len(texts[-1])
                if words > BATCH_WORDS:
                    yield one(ids, texts)
                    ids, texts, words = [], [], 0
            if ids:
                yield one(ids, texts)

    def one(ids: list[int], texts: list[list[int]]) -> pd.DataFrame:
        b = Batch.of(texts)
        return pd.DataFrame([{"ids": np.array(ids, dtype="<i8").tobytes(), **b.store()}])

    shape = ", ".join(f"{k} binary" for k in ("ids", *Batch._ARRAYS))
    made = spread(documents.select("doc_id", "text")).mapInPandas(run, shape)
    return scratch.keep(made.select(F.monotonically_increasing_id().alias("batch"), "*"), FILE_BATCHES)


def _counted(stored: DataFrame) -> DataFrame:
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for row in pdf.to_dict("records"):
                    b = Batch.stored(row)
                    yield pd.DataFrame({"feature": [_TOTAL], "n": [len(b.word)], "df": [b.docs]})
                    yield b.counts()

        yield from _merged(parts())

    return stored.mapInPandas(run, _COUNTS).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


_RARE = ["feature", "n", "df", "df_suspect"]


def _rare_of(row: dict) -> pd.DataFrame | None:
    rare = row.get("rare")
    return pd.DataFrame(np.frombuffer(rare, dtype="<i8").reshape(-1, len(_RARE)), columns=_RARE) if rare else None


def _suspected(stored: DataFrame, corpus, rules: Rules) -> DataFrame:
    """(feature, n, df) of the pages found so far, and the totals."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Corpus = corpus.value

        def parts() -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                for row in pdf.to_dict("records"):
                    b = Batch.stored(row)
                    _, mean, stuffed, low, odds = known.judge(b, rules, _rare_of(row))
                    found = stuffed | low | odds
                    m = mean[(b.sizes >= rules.words) & ~np.isnan(mean)]
                    yield pd.DataFrame({
                        "feature": [_SUSPECT, _PMI, _PMI2], "n": [0, round(m.sum() * 1e6), round((m * m).sum() * 1e6)], "df": [int(found.sum()), len(m), 0],
                    })
                    yield b.held_by(found)

        yield from _merged(parts())

    return stored.mapInPandas(run, _COUNTS).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _with_rare(stored: DataFrame, counts: DataFrame, suspected: DataFrame | None, corpus, scratch: Scratch) -> DataFrame:
    """The batches with the counts of their words and pairs that several documents hold, but too few to be listed."""
    least = corpus.value.least
    if least <= 2:
        return stored

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                keys = Batch.stored(row).features
                yield pd.DataFrame({"batch": row["batch"], "feature": keys[~corpus.value.counts.find(keys)[0]]})

    rare = counts.where((F.col("feature") >= 0) & (F.col("df") >= 2) & (F.col("df") < least))
    bad = F.lit(0).cast("bigint")
    if suspected is not None:
        rare = rare.join(suspected.select("feature", F.col("df").alias("bad")), "feature", "left")
        bad = F.coalesce("bad", bad)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": pdf["batch"].iloc[:1], "rare": [pdf[_RARE].to_numpy(dtype="<i8").tobytes()]})

    asked = stored.select("batch", *Batch._ARRAYS).mapInPandas(run, "batch bigint, feature bigint")
    each = asked.join(rare.select("feature", "n", "df", bad.alias("df_suspect")), "feature")
    # As bytes: lists of rows would become objects, for all batches of a task at once.
    lists = each.groupBy("batch").applyInPandas(packed, "batch bigint, rare binary")
    return scratch.keep(stored.join(lists, "batch", "left"), FILE_BATCHES)


def _least(counts: DataFrame) -> int:
    """The least number of documents, a power of two, from which at most MOST_LISTED features are."""
    by = counts.where("feature >= 0 and df >= 2").groupBy(F.floor(F.log2("df")).cast("int").alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect()
    listed = 0
    for r in by:
        listed += r.n
        if listed > MOST_LISTED:
            return 2 << r.p
    return 2


def page_scores(documents: DataFrame, scratch: Scratch, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_words, spam_share, mean_pmi, found, why) of every document.

    why: "salad" (low mean PMI), "collocations" (repeated in excess) or "odds" (most of its pairs are those of pages found
    so), the first that holds; null where not found. Null, empty and blank texts have no words and are not found; repeated
    rows count as documents each. mean_pmi is NaN where too few pairs are of words that other pages know."""
    spark = documents.sparkSession
    stored = batches(documents, scratch)
    counts = scratch.keep(_counted(stored))
    total = counts.where(F.col("feature") == _TOTAL).first()
    least = _least(counts)
    listed = counts.where((F.col("feature") >= 0) & (F.col("df") >= least)).toArrow().to_pandas()
    known = Corpus(total.n if total else 0, total.df if total else 0, Sorted(listed, "n", "df"), least)
    suspected = None
    for _ in range(rules.rounds):
        corpus = spark.sparkContext.broadcast(known)
        with_rare = _with_rare(stored, counts, suspected, corpus, scratch)
        suspected = scratch.keep(_suspected(with_rare, corpus, rules))
        if with_rare is not stored:
            scratch.drop(with_rare)
        totals = {r.feature: r for r in suspected.where("feature < 0").collect()}
        # Of what is broadcast already: no more rows than that.
        bad = suspected.where("feature >= 0").join(counts.where(F.col("df") >= least).select("feature"), "feature", "left_semi").toArrow().to_pandas()
        pages = totals[_PMI].df if totals else 0
        mean = totals[_PMI].n / 1e6 / pages if pages else 0.0
        pmi = (mean, max(0.0, totals[_PMI2].n / 1e6 / pages - mean * mean) ** 0.5) if pages else None
        known = Corpus(known.words, known.docs, known.counts, least, Sorted(bad, "df"), totals[_SUSPECT].df if totals else 0, pmi)
    corpus = spark.sparkContext.broadcast(known)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                b = Batch.stored(row)
                share, mean, stuffed, low, odds = corpus.value.judge(b, rules, _rare_of(row))
                yield pd.DataFrame({
                    "doc_id": np.frombuffer(row["ids"], dtype="<i8"), "n_words": b.sizes, "spam_share": share, "mean_pmi": mean, "found": stuffed | low | odds,
                    "why": np.select([low, stuffed, odds], ["salad", "collocations", "odds"], None),
                })

    final = _with_rare(stored, counts, suspected, corpus, scratch)
    return final.mapInPandas(run, "doc_id bigint, n_words bigint, spam_share double, mean_pmi double, found boolean, why string")
