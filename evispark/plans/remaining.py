"""Queries of the smaller operators: useful rows, usable texts, scores by level, routes, counters, suffixes, imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.operators import selection as S
from evispark.plans.registry import query
from evispark.session import read


@query("""SELECT row_id, (uts_mpa IS NOT NULL)::INT + (yield_strength_mpa IS NOT NULL)::INT + (stress_amplitude_mpa IS NOT NULL)::INT AS n_targets FROM extraction_records WHERE uts_mpa IS NOT NULL OR yield_strength_mpa IS NOT NULL OR (stress_amplitude_mpa BETWEEN 1 AND 3000 AND fatigue_life_cycles IS NOT NULL)""")
def f28_useful_rows(spark, sf):
    rows = read(spark, sf, "extraction_records").where("uts_mpa is not null or yield_strength_mpa is not null or (stress_amplitude_mpa between 1 and 3000 and fatigue_life_cycles is not null)")
    return rows.select("row_id", C.information_score("uts_mpa", "yield_strength_mpa", "stress_amplitude_mpa").alias("n_targets"))


@query("""SELECT doc_id, length(trim(regexp_replace(text, '--- Page [0-9]+ ---', '', 'g'), ' ' || chr(10) || chr(9) || chr(13))) >= 80 AS usable FROM documents WHERE text IS NOT NULL""")
def f29_usable_text(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("text", "--- Page [0-9]+ ---", ""), r"^[ \n\t\r]+|[ \n\t\r]+$", "")
    return read(spark, sf, "documents").where("text is not null").select("doc_id", (F.length(bare) >= 80).alias("usable"))


@query("""SELECT row_id, alloy_family, nullif(regexp_replace(regexp_replace(lower(trim(source_file)), '^.*[/\\\\]', ''), '(\\.pdf)+$', '.pdf'), '') AS file FROM extraction_records""")
def f30_file_provenance(spark, sf):
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim("source_file")), r"^.*[/\\]", ""), r"(\.pdf)+$", ".pdf")
    return read(spark, sf, "extraction_records").select("row_id", "alloy_family", F.nullif(name, F.lit("")).alias("file"))


@query("""WITH r AS (SELECT alloy_family, confidence AS p, CASE WHEN a.audit_status IS NULL THEN NULL WHEN lower(trim(a.audit_status)) = 'approved' THEN 1 ELSE 0 END AS y FROM extraction_records e JOIN audit_decisions a ON a.source_id = e.source_id AND a.record_id = e.record_id WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence))
SELECT alloy_family, count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg(pow(p - y, 2)), 6) AS brier FROM r WHERE y IS NOT NULL GROUP BY GROUPING SETS ((alloy_family), ()) HAVING sum(y) >= 2""")
def a15_brier(spark, sf):
    """Squared error of the confidence against the audit, for each family and over all."""
    label = F.when(F.col("audit_status").isNotNull(), (F.lower(F.trim("audit_status")) == "approved").cast("int"))
    decisions = read(spark, sf, "audit_decisions").select("source_id", "record_id", label.alias("y"))
    rows = read(spark, sf, "extraction_records").where("confidence between 0 and 1 and not isnan(confidence)").select("source_id", "record_id", "alloy_family", "confidence")
    scored = rows.join(decisions, ["source_id", "record_id"]).where("y is not null")
    out = scored.groupingSets([[F.col("alloy_family")], []], "alloy_family").agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.round(F.avg(F.pow(F.col("confidence") - F.col("y"), 2)), 6).alias("brier"))
    return out.where("n_positive >= 2")


@query("""WITH r AS (SELECT test_type, extraction_method, count(*) AS n, round(avg(confidence), 6) AS c FROM extraction_records WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) AND test_type IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY test_type ORDER BY c DESC, n DESC, extraction_method NULLS FIRST) = 1 AS selected FROM r""")
def a30_route_select(spark, sf):
    """The extraction method of highest mean confidence for each test type."""
    rows = read(spark, sf, "extraction_records").where("confidence between 0 and 1 and not isnan(confidence) and test_type is not null")
    means = rows.groupBy("test_type", "extraction_method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("c"))
    order = Window.partitionBy("test_type").orderBy(F.desc("c"), F.desc("n"), F.asc_nulls_first("extraction_method"))
    return means.withColumn("selected", F.row_number().over(order) == 1)


@query("""SELECT decision_id, row_number() OVER (PARTITION BY source_id, record_id ORDER BY reviewed_at NULLS FIRST, decision_id) - 1 AS nth FROM audit_decisions""")
def w6_running_count(spark, sf):
    from evispark.session import Scratch

    rows = read(spark, sf, "audit_decisions").select("decision_id", "source_id", "record_id", "reviewed_at")
    return S.ranked(rows, ["source_id", "record_id"], ["reviewed_at", "decision_id"], Scratch(spark)).select("decision_id", F.col("_i").alias("nth"))


@query("""WITH n AS (SELECT source_id, article_number, listed_at, coalesce(nullif(trim(local_pdf_filename), ''), 'unnamed.pdf') AS f FROM literature_manifest), r AS (SELECT *, row_number() OVER (PARTITION BY lower(f) ORDER BY listed_at, source_id, article_number) AS k FROM n)
SELECT source_id, article_number, listed_at, CASE WHEN k = 1 THEN f ELSE regexp_replace(f, '(\\.[A-Za-z0-9]+)?$', '') || '_' || k || coalesce(regexp_extract(f, '(\\.[A-Za-z0-9]+)$', 1), '') END AS target FROM r""")
def w13_unique_targets(spark, sf):
    """File names with _2, _3 before the extension where they are taken."""
    f = F.coalesce(F.nullif(F.trim("local_pdf_filename"), F.lit("")), F.lit("unnamed.pdf"))
    rows = read(spark, sf, "literature_manifest").select("source_id", "article_number", "listed_at", f.alias("f"))
    k = F.row_number().over(Window.partitionBy(F.lower("f")).orderBy("listed_at", "source_id", "article_number"))
    stem, end = F.regexp_replace("f", r"(\.[A-Za-z0-9]+)?$", ""), F.regexp_extract("f", r"(\.[A-Za-z0-9]+)$", 1)
    name = F.when(F.col("k") == 1, F.col("f")).otherwise(F.concat(stem, F.lit("_"), F.col("k").cast("string"), end))
    return rows.withColumn("k", k).select("source_id", "article_number", "listed_at", name.alias("target"))


_WORD = {"high": 0.9, "medium": 0.7, "low": 0.5}
_DOI_SQL = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(doi), '\\s+', '', 'g'), '^(https?://)?(dx\\.)?doi\\.[a-z]+/|^doi:?', ''), '[.,;:)\\]}]+$', ''), '')"


@query(f"""SELECT {_DOI_SQL} AS doi, count(*) AS n_records, round(sum(CASE WHEN isfinite(hatch_spacing_um) THEN hatch_spacing_um END), 3) AS hatch_um, max(CASE WHEN confidence >= 0.8 THEN 0.9 WHEN confidence >= 0.5 THEN 0.7 WHEN confidence >= 0 THEN 0.5 END::DOUBLE) AS confidence
FROM extraction_records WHERE {_DOI_SQL} IS NOT NULL AND coalesce(NOT isnan(confidence), true) GROUP BY 1""")
def s18_manual_import(spark, sf):
    """Typed rows in millimetres and words of confidence, brought to the record form and grouped by DOI."""
    c = F.col("confidence")
    word = F.when(c >= 0.8, "high").when(c >= 0.5, " Medium").when(c >= 0, "LOW ")
    hatch = F.when(C.finite("hatch_spacing_um").isNotNull(), F.format_string("%.9f", F.col("hatch_spacing_um") / 1000))
    typed = read(spark, sf, "extraction_records").where("coalesce(not isnan(confidence), true)").select("doi", hatch.alias("hatch_mm"), word.alias("confidence"))
    said = F.lower(F.trim("confidence"))
    trust = F.lit(None).cast("double")
    for w, v in _WORD.items():
        trust = F.when(said == w, v).otherwise(trust)
    clean = typed.select(C.doi("doi").alias("doi"), (C.numeric("hatch_mm") * 1000).alias("hatch_um"), trust.alias("confidence")).where("doi is not null")
    return clean.groupBy("doi").agg(F.count("*").alias("n_records"), F.round(F.sum("hatch_um"), 3).alias("hatch_um"), F.max("confidence").alias("confidence"))
