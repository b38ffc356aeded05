"""Incremental ingestion: the same cleaning as in batch, once for each row, late rows kept until the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(rows: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Rows delivered again within the watermark are dropped; state is kept for that long only."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_counts(rows: DataFrame, at: str, by: str, late: str = "30 days") -> DataFrame:
    """(day, by, n_rows): counts of tumbling days; a day is final when the watermark has passed it."""
    return (
        rows.withWatermark(at, late).groupBy(F.window(at, "1 day"), by).agg(F.count("*").alias("n_rows"))
        .select(F.col("window.start").alias("day"), by, "n_rows")
    )


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result; for checks and small reports."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there into Parquet files, whose commit log makes a retried batch count once."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_last(path: str, keys: list[str], order: str, buckets: int = 64):
    """A foreachBatch sink that keeps the last row of each key in a table of buckets by the keys' hash.

    Only the buckets that a batch touches are merged and overwritten. A retried batch merges to the same rows, so it counts
    once; the merged buckets are written beside the table first, because it is read for them."""
    from evispark.operators.selection import keep_last
    from evispark.session import Scratch
    from evispark.sources.tables import exists

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scratch = Scratch(spark)
        new = scratch.keep(batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        both = new
        if exists(spark, path):
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most the buckets
            both = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).unionByName(new, allowMissingColumns=True)
        merged = scratch.keep(keep_last(both, keys, order))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    return sink
