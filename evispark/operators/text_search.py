"""Chunks, and a relational TF-IDF index with ranked queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are left out of the index; a parameter. Short and general, not a language's full list.
STOP = ("the", "and", "of", "to", "in", "is", "was", "for", "with", "by", "at", "on", "from", "after", "that", "this", "are", "were", "be", "as", "an", "or", "it")


def chunks(df: DataFrame, key: str, text: str, size: int = 3500, overlap: int = 300) -> DataFrame:
    """(key, chunk_index, chunk): pieces of ``size`` letters, each starting ``overlap`` before the last one's end, trimmed;
    empty ones are dropped."""
    if size <= overlap:
        raise ValueError("the size must be larger than the overlap")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = df.where(F.col(text).isNotNull()).select(key, text, F.posexplode(starts).alias("chunk_index", "_at"))
    piece = F.regexp_replace(F.substring(F.col(text), F.col("_at") + 1, F.lit(size)), r"^\s+|\s+$", "")
    return cut.select(key, "chunk_index", piece.alias("chunk")).where("chunk <> ''")


def words(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Words of two letters or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop))


def terms(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, term): the words of each text and the pairs of neighbours left.

    The words are a column of their own before they are paired: inside the pairing they would be found again for each."""
    split = df.select(*keys, F.posexplode(words(text)).alias("at", "word"))
    after = split.select(*keys, (F.col("at") - 1).alias("at"), F.col("word").alias("next"))
    pairs = split.join(after, [*keys, "at"]).select(*keys, F.concat_ws(" ", "word", "next").alias("term"))
    return split.select(*keys, F.col("word").alias("term")).unionAll(pairs)


def _weighted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, w, idf): raw counts times smooth idf."""
    listed = df.select(key, words(F.col(text)).alias("_words"))
    paired = F.transform(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, 1 << 30).alias("b")), lambda x: F.when(x["b"].isNotNull(), F.concat_ws(" ", x["a"], x["b"])))
    listed = listed.select(key, F.explode(F.concat("_words", F.array_compact(paired))).alias("term"))
    counts = listed.groupBy(key, "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("_n"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"), "idf")


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight, idf): the index, of length 1 for each document."""
    raw = _weighted(df, key, text)
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("_norm")).alias("weight"), "idf")


def search(df: DataFrame, key: str, text: str, query: str, k: int | None = None) -> DataFrame:
    """(key, score): the k documents with the highest cosine to the query, ties by key; every document that holds a term of
    it without k, in no order.

    The terms of all documents are counted once; beside their norms only the postings of the query's terms are kept."""
    if k is not None and k <= 0:
        return df.select(key, F.lit(0.0).alias("score")).where("false")
    asked = terms(df.sparkSession.range(1), F.lit(query), "id").groupBy("term").agg(F.count("*").alias("qtf"))  # one line of text
    weighted = _weighted(df, key, text).join(F.broadcast(asked), "term", "left")
    dot = F.col("w") * F.col("qtf") * F.col("idf")
    per = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"), F.sum(dot).alias("_s"), F.collect_set(F.when(F.col("qtf").isNotNull(), F.struct("term", "qtf", "idf"))).alias("_q"))
    hits = per.where("_s is not null")
    parts = hits.select(F.explode("_q").alias("q")).select("q.*").distinct()  # the query's terms
    norm = parts.agg(F.sqrt(F.sum(F.col("qtf") * F.col("idf") * F.col("qtf") * F.col("idf"))).alias("_qn"))
    scored = hits.select(key, "_norm", "_s").crossJoin(F.broadcast(norm)).select(key, F.round(F.col("_s") / F.col("_norm") / F.col("_qn"), 6).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)


def per_source(scored: DataFrame, source: str, key: str, k: int) -> DataFrame:
    """At most k of each source, then all by score."""
    w = Window.partitionBy(source).orderBy(F.desc("score"), key)
    return scored.withColumn("source_rank", F.row_number().over(w)).where(F.col("source_rank") <= k)
