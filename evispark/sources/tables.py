"""Readers and writers: late-typed CSV, sheets of cells with header detection, JSON envelopes, inventories, safe replacing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions.cleaning import header_name, numeric
from evispark.session import _path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """A CSV read as text and typed column by column; what doesn't parse is null. Missing columns are null, others dropped.

    optional: a missing file is an empty table."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return to_schema(raw, schema)


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema in its order: numbers by the lenient parser, missing columns as null."""
    have = {c.lstrip("﻿"): c for c in df.columns}

    def one(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f"`{have[f.name]}`")
        if isinstance(f.dataType, T.NumericType) and isinstance(df.schema[have[f.name]].dataType, T.StringType):
            return numeric(c).cast(f.dataType).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return df.select(*(one(f) for f in schema.fields))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def header_rows(cells: DataFrame, aliases: DataFrame, look: int = 20) -> DataFrame:
    """(sheet, row_no, score): the header of each sheet of (sheet, row_no, cells array).

    Among the first ``look`` rows that hold anything: 100 for each cell that is an alias, plus up to 50 for cells filled;
    the first best wins."""
    filled = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    rows = cells.withColumn("_filled", filled).where("_filled > 0")
    early = rows.withColumn("_k", F.row_number().over(Window.partitionBy("sheet").orderBy("row_no"))).where(F.col("_k") <= look)
    known = aliases.select(F.col("alias").alias("_alias")).distinct()
    named = early.select("sheet", "row_no", "_filled", F.explode("cells").alias("c")).withColumn("_alias", header_name("c"))
    mapped = named.join(known.withColumn("_hit", F.lit(1)), "_alias", "left").groupBy("sheet", "row_no").agg(
        (100 * F.coalesce(F.sum("_hit"), F.lit(0)) + F.least(F.first("_filled"), F.lit(50))).alias("score")
    )
    best = Window.partitionBy("sheet").orderBy(F.desc("score"), "row_no")
    return mapped.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("sheet", "row_no", "score")


def unique_names(names: list[str | None]) -> list[str]:
    """Names with .1, .2 added to repeated ones; blank ones by their place."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"unnamed_column_{i}"
        out.append(n if n not in seen else f"{n}.{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


def json_records(df: DataFrame, key: str, text: str, record: T.StructType) -> DataFrame:
    """(key, record_no, record fields..., error): one row for each record of {"records": [...]}; a text that isn't such an
    envelope has one row with its error."""
    envelope = T.StructType([T.StructField("records", T.ArrayType(record)), T.StructField("_bad", T.StringType())])
    parsed = df.select(key, F.from_json(text, envelope, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("j"))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | F.col("j.records").isNull()
    flat = parsed.select(key, F.when(bad, "malformed").alias("error"), F.posexplode_outer(F.when(~bad, F.col("j.records"))).alias("record_no", "r"))
    return flat.where("error is not null or record_no is not null").select(key, "record_no", *(F.col(f"r.{f.name}").alias(f.name) for f in record.fields), "error")


def json_envelopes(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, envelope): the records of each key as one JSON text, in the order of their fields."""
    return df.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"))).alias("envelope"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256) of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def skip_list(spark: SparkSession, path: str) -> DataFrame:
    """(stem) of a list of files to skip: comments and blank lines left out, .pdf removed."""
    t = F.trim("value")
    return spark.read.text(path).select(t.alias("stem")).where((t != "") & ~t.startswith("#")).select(F.regexp_replace("stem", r"(?i)\.pdf$", "").alias("stem")).distinct()


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be moved to {target}")


def replace_table(df: DataFrame, path: str, keep_old: bool = True) -> str | None:
    """Writes beside the table, then swaps by two renames. Returns where the old table is kept.

    A reader that looks between the two finds no table and has to look again; it never finds a part of one. If the second
    rename fails, the old table is put back."""
    spark = df.sparkSession
    staged = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    target, fs = _path(spark, path)
    archived = None
    if fs.exists(target):
        archived = f"{path}.old-{uuid.uuid4().hex}"
        _moved(fs, target, _path(spark, archived)[0])
    try:
        _moved(fs, _path(spark, staged)[0], target)
    except Exception:
        if archived:
            _moved(fs, _path(spark, archived)[0], target)
        raise
    if archived and not keep_old:
        fs.delete(_path(spark, archived)[0], True)
        archived = None
    return archived


def export_csv(df: DataFrame, path: str, parts: int | None = 1) -> None:
    """CSV for people to open: one file, for reports of bounded size; parts=None leaves the files as the tasks write them."""
    out = df if parts is None else df.coalesce(parts)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def archive(spark: SparkSession, root: str, to: str, names: list[str]) -> DataFrame:
    """(name, n_files, length, modified, archived_to) of what was moved from a folder into its archive.

    Names must stay inside the folder; what isn't there is left out."""
    done = []
    for name in names:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} is outside {root}")
        source, fs = _path(spark, f"{root}/{name}")
        if not fs.exists(source):
            continue
        size = fs.getContentSummary(source)
        # Hidden files are the writers' own.
        files = [f for f in (fs.listStatus(source) if fs.getFileStatus(source).isDirectory() else [fs.getFileStatus(source)]) if not f.getPath().getName().startswith(("_", "."))]
        modified = max((f.getModificationTime() for f in files), default=0)
        target = _path(spark, f"{to}/{name}")[0]
        fs.mkdirs(target.getParent())
        _moved(fs, source, target)
        done.append((name, len(files), size.getLength(), modified, f"{to}/{name}"))
    return spark.createDataFrame(done, "name string, n_files int, length bigint, modified bigint, archived_to string")


def append_ledger(df: DataFrame, path: str) -> None:
    """Rows added to a ledger of JSON lines; what is there is never rewritten."""
    df.write.mode("append").json(path)


def registry_key(*parts: str) -> str:
    """The parts of a model's name as one path-safe key."""
    return "__".join("".join(c if c.isalnum() else "_" for c in p.strip().lower()) for p in parts)


def store_artifact(df: DataFrame, store: str, key: str, replace: bool = False) -> None:
    """A table under its key; a key that is there is an error unless replaced."""
    path = f"{store}/{key}"
    if exists(df.sparkSession, path) and not replace:
        raise ValueError(f"{key} is stored already")
    replace_table(df, path, keep_old=False)


def load_artifact(spark: SparkSession, store: str, key: str) -> DataFrame:
    if not exists(spark, f"{store}/{key}"):
        raise FileNotFoundError(f"{key} isn't in {store}")
    return spark.read.parquet(f"{store}/{key}")
