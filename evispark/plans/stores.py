"""Queries of readers, writers and stores: what is written comes back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions import cleaning as C
from evispark.plans.registry import query
from evispark.session import Scratch, read
from evispark.sources import tables

_TYPED = T.StructType().add("decision_id", T.LongType()).add("source_id", T.StringType()).add("review_priority", T.IntegerType()).add("audit_reason", T.StringType()).add("reviewer_note", T.StringType())


@query("SELECT decision_id, source_id, review_priority, nullif(audit_reason, '') AS audit_reason, NULL::VARCHAR AS reviewer_note FROM audit_decisions")
def s1_csv_late_typing(spark, sf):
    """Written as text, read without types and typed column by column; a column that lacks is null. Blank text is null."""
    path = f"{Scratch(spark).root}/decisions"
    tables.export_csv(read(spark, sf, "audit_decisions").select("decision_id", "source_id", "review_priority", "audit_reason", "audit_status"), path, parts=None)
    return tables.read_csv(spark, path, _TYPED)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2_first_existing(spark, sf):
    path = tables.first_existing(spark, f"{sf}/nations.parquet", f"{sf}/country.parquet", f"{sf}/nation.parquet", f"{sf}/region.parquet")
    return spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@query("""WITH n AS (SELECT column_name, row_number() OVER () - 1 AS i, regexp_extract(column_name, '[^_]+$') AS last FROM (DESCRIBE extraction_records)), k AS (SELECT *, row_number() OVER (PARTITION BY last ORDER BY i) - 1 AS k FROM n)
SELECT column_name AS original, CASE WHEN k = 0 THEN last ELSE last || '.' || k END AS name FROM k""")
def s5_unique_names(spark, sf):
    """The last words of the table's column names, made unique in their order."""
    names = read(spark, sf, "extraction_records").columns
    return spark.createDataFrame(list(zip(names, tables.unique_names([n.rsplit("_", 1)[-1] for n in names]))), "original string, name string")


@query()
def s8_inventory(spark, sf):
    """Every file of the data folder with its size and hash; files are hashed as they are read, one task each."""
    return tables.inventory(spark, sf).select(F.regexp_replace("path", "^.*/", "").alias("file"), "length", "sha256")


@query("""SELECT doc_id, source_file FROM documents WHERE source_file IS NULL OR regexp_replace(trim(source_file), '\\.pdf$', '', 'i') NOT IN (SELECT regexp_replace(trim(local_pdf_filename), '\\.pdf$', '', 'i') FROM literature_manifest WHERE processing_status = 'skipped' AND trim(local_pdf_filename) <> '' AND NOT starts_with(trim(local_pdf_filename), '#'))""")
def s10_skip_list(spark, sf):
    """Documents but those of a list of files to skip, which is a text with comments."""
    path = f"{Scratch(spark).root}/skipped"
    names = read(spark, sf, "literature_manifest").where("processing_status = 'skipped' and local_pdf_filename is not null").select(F.col("local_pdf_filename").alias("value"))
    names.unionAll(spark.createDataFrame([("# files to skip",), ("",), ("  ",)], "value string")).write.text(path)
    skip = tables.skip_list(spark, path)
    docs = read(spark, sf, "documents").select("doc_id", "source_file", F.regexp_replace(F.trim("source_file"), r"(?i)\.pdf$", "").alias("stem"))
    return docs.join(skip, "stem", "left_anti").select("doc_id", "source_file")


@query("SELECT term_id, field_name, canonical_label, 2 AS version FROM canonical_terms UNION ALL SELECT term_id, field_name, canonical_label, 1 FROM canonical_terms")
def s12_replace_and_archive(spark, sf):
    """A table replaced by its next version: what stands there now, and what was archived."""
    path = f"{Scratch(spark).root}/terms"
    terms = read(spark, sf, "canonical_terms").select("term_id", "field_name", "canonical_label")
    tables.replace_table(terms.withColumn("version", F.lit(1)), path)
    old = tables.replace_table(terms.withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).unionAll(spark.read.parquet(old))


@query("SELECT spec_name AS file, 1 AS n_files, true AS moved FROM container_specs")
def s13_archive_with_manifest(spark, sf):
    """Files moved into an archive, with a manifest of what was moved; a path outside the folder is an error."""
    root = f"{Scratch(spark).root}/run"
    for r in read(spark, sf, "container_specs").collect():  # three rows, by definition
        spark.range(1).select(F.lit(str(r.capacity_tokens)).alias("value")).coalesce(1).write.text(f"{root}/{r.spec_name}")
    moved = tables.archive(spark, root, f"{root}-archive", [r.spec_name for r in read(spark, sf, "container_specs").collect()])
    here = tables.exists
    done = [(r.name, r.n_files, here(spark, f"{root}-archive/{r.name}") and not here(spark, f"{root}/{r.name}")) for r in moved.collect()]
    return spark.createDataFrame(done, "file string, n_files int, moved boolean")


@query("SELECT event_type, 'January' AS step, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1 UNION ALL SELECT event_type, 'rest', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1")
def s15_ledger(spark, sf):
    """An append-only ledger in JSON lines: two steps, both there."""
    path = f"{Scratch(spark).root}/ledger"
    rows = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for step, part in (("January", rows.where(early)), ("rest", rows.where(~early))):
        tables.append_ledger(part.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("step", F.lit(step)), path)
    return spark.read.schema("event_type string, n bigint, step string").json(path).select("event_type", "step", "n")


@query("""WITH r AS (SELECT alloy_family, row_id, CASE WHEN isfinite(hardness_hv) THEN hardness_hv END AS x, CASE WHEN isfinite(uts_mpa) THEN uts_mpa END AS y FROM extraction_records WHERE alloy_family IS NOT NULL), c AS (SELECT alloy_family, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r GROUP BY 1)
SELECT row_id, round(a * x + b, 4) AS prediction FROM r JOIN c USING (alloy_family) WHERE x IS NOT NULL AND a IS NOT NULL""")
def s14_stored_curves(spark, sf):
    """Curves fitted, stored under a registry key, loaded by it and applied."""
    store = f"{Scratch(spark).root}/curves"
    rows = read(spark, sf, "extraction_records").where("alloy_family is not null").select("alloy_family", "row_id", C.finite("hardness_hv").alias("x"), C.finite("uts_mpa").alias("y"))
    fitted = rows.groupBy("alloy_family").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b")).where("a is not null")
    key = tables.registry_key("uts_mpa", "process only", "linear")
    tables.store_artifact(fitted, store, key)
    loaded = tables.load_artifact(spark, store, key)
    return rows.join(F.broadcast(loaded), "alloy_family").where("x is not null").select("row_id", F.round(F.col("a") * F.col("x") + F.col("b"), 4).alias("prediction"))


@query("""SELECT source_id, article_number, listed_at, CASE WHEN doi IS NOT NULL AND trim(doi) <> '' THEN 'doi' WHEN title_verified THEN 'title' ELSE 'none' END AS matched_by, coalesce(nullif(trim(title), ''), replace(source_id, '_', ' ')) AS title, coalesce(title_verified, false) OR (doi IS NOT NULL AND trim(doi) <> '') AS verified FROM literature_manifest WHERE source_id IS NOT NULL""")
def s19_manifest_rows(spark, sf):
    """Manifest rows built from what is known, by precedence of the fields, with how they were matched."""
    has_doi = F.coalesce(F.trim("doi") != "", F.lit(False))
    by = F.when(has_doi, "doi").when(F.col("title_verified"), "title").otherwise("none")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.replace("source_id", F.lit("_"), F.lit(" ")))
    rows = read(spark, sf, "literature_manifest").where("source_id is not null")
    return rows.select("source_id", "article_number", "listed_at", by.alias("matched_by"), title.alias("title"), (F.coalesce("title_verified", F.lit(False)) | has_doi).alias("verified"))


@query("""SELECT max(try_cast(regexp_extract(local_pdf_filename, '^([0-9]+)', 1) AS BIGINT)) + 1 AS next_number, count(DISTINCT lower(trim(source_id))) AS n_sources FROM literature_manifest""")
def s20_next_number(spark, sf):
    """The number that the next file gets, and how many sources have files."""
    number = F.regexp_extract("local_pdf_filename", "^([0-9]+)", 1).try_cast("bigint")
    return read(spark, sf, "literature_manifest").agg((F.max(number) + 1).alias("next_number"), F.countDistinct(F.lower(F.trim("source_id"))).alias("n_sources"))


@query("""WITH r AS (SELECT source_id, processing_status, listed_at, row_number() OVER (PARTITION BY source_id ORDER BY listed_at DESC, article_number DESC) AS k FROM literature_manifest WHERE processing_status IS NOT NULL AND content_sha256 IS NOT NULL AND source_id IS NOT NULL) SELECT source_id, processing_status, listed_at FROM r WHERE k = 1""")
def s21_latest_complete(spark, sf):
    """For each source the latest listing that has everything that is asked for."""
    rows = read(spark, sf, "literature_manifest").where("processing_status is not null and content_sha256 is not null and source_id is not null")
    last = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("listed_at"), F.desc("article_number")))
    return rows.withColumn("k", last).where("k = 1").select("source_id", "processing_status", "listed_at")
