"""Queries of views, registries, manifests, roll-ups and survival models."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.operators import curves as K
from evispark.operators import joins as J
from evispark.operators import selection as S
from evispark.operators import statistics as A
from evispark.operators import survival as V
from evispark.operators import views as W
from evispark.plans.registry import query
from evispark.session import Scratch, read

_KEY = "coalesce(nullif(trim(record_id), ''), 'row_' || row_id)"


def _record_key():
    return F.coalesce(F.nullif(F.trim("record_id"), F.lit("")), F.concat(F.lit("row_"), F.col("row_id").cast("string")))


def _num(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


_STATIC = {"uts": ["uts_mpa"], "elongation_yield": ["elongation_percent", "yield_strength_mpa"], "elastic_modulus": ["youngs_modulus_gpa"]}
_INFORMATION = ["laser_power_w", "scan_speed_mm_s", "hatch_spacing_um", "layer_thickness_um", "relative_density_percent", "uts_mpa", "yield_strength_mpa", "elongation_percent", "hardness_hv"]
_SCORE = " + ".join(f"(({_num(c)}) IS NOT NULL)::INT" for c in _INFORMATION)


@query(" UNION ALL ".join(
    f"""SELECT row_id, k AS record_key, score, '{n}' AS view_name, 1.0::DOUBLE AS sample_weight FROM (SELECT row_id, {_KEY} AS k, {_SCORE} AS score, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_SCORE} DESC, row_id) AS r
    FROM extraction_records WHERE coalesce({', '.join(_num(t) for t in targets)}) IS NOT NULL) WHERE r = 1""" for n, targets in _STATIC.items()
))
def v1_static_views(spark, sf):
    """The three views of static properties: for each record the row with most information that has a target."""
    rows = read(spark, sf, "extraction_records").select("row_id", _record_key().alias("record_key"), *{*_INFORMATION, *(t for ts in _STATIC.values() for t in ts)})
    parts = [W.static_view(rows, n, targets, ["record_key"], _INFORMATION, F.asc("row_id")) for n, targets in _STATIC.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("row_id", "record_key", F.col("score").cast("int").alias("score"), "view_name", "sample_weight")


@query(f"""WITH r AS (SELECT row_id, coalesce(nullif(lower(trim(source_id)), ''), 'row_' || row_id) AS g, CASE WHEN ({_num('fatigue_life_cycles')}) > 0 THEN log10(fatigue_life_cycles) END AS l, coalesce({_num('stress_amplitude_mpa')}, {_num('max_stress_mpa')}) AS x FROM extraction_records),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, row_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM r WHERE l IS NOT NULL AND x IS NOT NULL),
e AS (SELECT * FROM n WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda j: round_even(j * (n - 1) / 9.0::DOUBLE, 0)::INT), i::INT))
SELECT row_id, g AS modelling_group_id, round(l, 6) AS log_life, x AS load, round((SELECT count(*) FROM e) / (count(*) OVER (PARTITION BY g) * (SELECT count(DISTINCT g) FROM e)), 6) AS sample_weight, 'sn_fatigue' AS view_name FROM e""")
def v2_sn_view(spark, sf):
    group = F.coalesce(F.nullif(F.lower(F.trim("source_id")), F.lit("")), F.concat(F.lit("row_"), F.col("row_id").cast("string")))
    out = W.sn_view(read(spark, sf, "extraction_records"), "row_id", group, "fatigue_life_cycles", ["stress_amplitude_mpa", "max_stress_mpa"], Scratch(spark))
    return out.select("row_id", "modelling_group_id", F.round("log_life", 6).alias("log_life"), "load", F.round("sample_weight", 6).alias("sample_weight"), "view_name")


@query("""SELECT source_id, decision_id, audit_method FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY reviewed_at DESC NULLS LAST, decision_id) AS k FROM audit_decisions WHERE lower(trim(audit_status)) = 'approved' AND NOT coalesce(review_blocking, false)) WHERE k = 1""")
def v3_selected_row(spark, sf):
    """The row that conditions select for each source, the latest first; sources without one have no row."""
    rows = read(spark, sf, "audit_decisions").where((F.lower(F.trim("audit_status")) == "approved") & ~F.coalesce("review_blocking", F.lit(False)))
    return S.best_per_key(rows, ["source_id"], F.desc_nulls_last("reviewed_at"), F.asc("decision_id")).select("source_id", "decision_id", "audit_method")


@query("""SELECT view_row_id, am_process AS process_as_written, coalesce(nullif(trim(alloy), ''), 'missing') || '|' || coalesce(nullif(trim(am_process), ''), 'missing') || '|' || coalesce(nullif(trim(surface_condition), ''), 'missing') AS exact_key,
coalesce(nullif(trim(alloy_family), ''), 'missing') || '|' || coalesce(nullif(trim(am_process), ''), 'missing') AS family_key FROM view_rows WHERE nullif(trim(alloy), '') IS NOT NULL""")
def v4_domain_keys(spark, sf):
    rows = read(spark, sf, "view_rows").where(F.nullif(F.trim("alloy"), F.lit("")).isNotNull())
    return rows.select("view_row_id", F.col("am_process").alias("process_as_written"), W.domain_key("alloy", "am_process", "surface_condition").alias("exact_key"), W.domain_key("alloy_family", "am_process").alias("family_key"))


@query("""WITH d AS (SELECT alloy, am_process FROM view_rows WHERE alloy IS NOT NULL AND am_process IS NOT NULL GROUP BY 1, 2 ORDER BY count(*) DESC, alloy, am_process LIMIT 5)
SELECT view_row_id, v.alloy, v.am_process, try_cast(v.hardness_hv AS INTEGER) AS hardness FROM view_rows v JOIN d ON d.alloy = v.alloy AND d.am_process = v.am_process WHERE isfinite(v.hardness_hv)""")
def v5_domain_filter(spark, sf):
    """The rows of the five largest domains (a top-k report)."""
    rows = read(spark, sf, "view_rows")
    top = rows.where("alloy is not null and am_process is not null").groupBy("alloy", "am_process").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "alloy", "am_process").limit(5)
    return rows.join(top.drop("n"), ["alloy", "am_process"]).where(C.finite("hardness_hv").isNotNull()).select("view_row_id", "alloy", "am_process", F.rint("hardness_hv").cast("int").alias("hardness"))


_ALIASES = [("row id", "row_id"), ("uts mpa", "ultimate_strength_mpa"), ("doi", "doi"), ("laser power w", "laser_power_w"), ("r ratio", "stress_ratio"), ("alloy", "alloy")]


@query("SELECT column_name AS original, trim(regexp_replace(lower(column_name), '[^a-z0-9]+', ' ', 'g')) AS normalised, coalesce(s, '') AS mapped, s IS NOT NULL AS is_mapped FROM (DESCRIBE extraction_records) LEFT JOIN (VALUES "
       + ", ".join(f"('{a}', '{s}')" for a, s in _ALIASES) + ") AS t(a, s) ON a = trim(regexp_replace(lower(column_name), '[^a-z0-9]+', ' ', 'g'))")
def f31_mapping_report(spark, sf):
    """Which of the table's own headers the alias list knows."""
    headers = spark.createDataFrame([(c,) for c in read(spark, sf, "extraction_records").columns], "original string")
    return W.mapping_report(headers, spark.createDataFrame(_ALIASES, "alias string, standard string"))


@query("SELECT row_id, coalesce(stress_amplitude_mpa, max_stress_mpa, uts_mpa) AS stress, coalesce(doi, source_file) AS origin FROM extraction_records")
def f32_coalesce_duplicates(spark, sf):
    rows = read(spark, sf, "extraction_records").toDF(*read(spark, sf, "extraction_records").columns)
    named = {"row_id": "row_id", "stress": "stress_amplitude_mpa", "origin": "doi", "stress.1": "max_stress_mpa", "origin.1": "source_file", "stress.2": "uts_mpa"}
    return W.coalesced(rows.select(*(F.col(c).alias(n) for n, c in named.items())))


@query(f"""SELECT row_id, CASE WHEN coalesce({_num('fatigue_life_cycles')}, {_num('stress_amplitude_mpa')}, {_num('max_stress_mpa')}) IS NOT NULL THEN 'sn_fatigue' WHEN coalesce({', '.join(_num(c) for c in ('uts_mpa', 'yield_strength_mpa', 'elongation_percent', 'youngs_modulus_gpa', 'hardness_hv'))}) IS NOT NULL THEN 'static_tensile' ELSE 'unknown' END AS task,
CASE WHEN contains(s, 'parameter') THEN 'parameter_static' WHEN contains(s, 'sn') OR contains(s, 's-n') THEN 'sn_fatigue' WHEN contains(s, 'en') OR contains(s, 'e-n') OR contains(s, 'strain') THEN 'strain_life_fatigue' WHEN contains(s, 'dadn') OR contains(s, 'da/dn') OR contains(s, 'crack') THEN 'crack_growth' ELSE 'fatigue_' || s END AS sheet_task
FROM (SELECT *, lower(trim(source_sheet)) AS s FROM extraction_records)""")
def f33_task_type(spark, sf):
    task = W.task_type((), ("fatigue_life_cycles", "stress_amplitude_mpa", "max_stress_mpa"), ("uts_mpa", "yield_strength_mpa", "elongation_percent", "youngs_modulus_gpa", "hardness_hv"))
    return read(spark, sf, "extraction_records").select("row_id", task.alias("task"), W.sheet_task("source_sheet").alias("sheet_task"))


@query("SELECT row_id, 'uts_mpa' AS target, uts_mpa AS value FROM extraction_records WHERE uts_mpa BETWEEN 50 AND 2500 UNION ALL SELECT row_id, 'elongation_percent', elongation_percent FROM extraction_records WHERE elongation_percent BETWEEN 0 AND 100")
def f34_target_bounds(spark, sf):
    """Targets within their bounds, ends included; NaN and null are none."""
    rows = read(spark, sf, "extraction_records")
    part = lambda c, lo, hi: rows.where(C.finite(c).between(lo, hi)).select("row_id", F.lit(c).alias("target"), F.col(c).alias("value"))
    return part("uts_mpa", 50, 2500).unionAll(part("elongation_percent", 0, 100))


@query("SELECT view_row_id, CASE WHEN regexp_full_match(trim(build_orientation), '[0-9]+(\\.[0-9]+)?') THEN trim(build_orientation)::DOUBLE END AS size FROM view_rows")
def f35_single_number(spark, sf):
    return read(spark, sf, "view_rows").select("view_row_id", C.single_number("build_orientation").alias("size"))


@query("WITH s AS (SELECT test_type, count(*) AS n_rows FROM extraction_records GROUP BY 1), m AS (SELECT test_type, round(avg(confidence), 6) AS confidence FROM extraction_records WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) AND test_type <> 'tensile' GROUP BY 1) SELECT s.test_type, n_rows, confidence FROM s LEFT JOIN m USING (test_type)")
def j15_summary_metrics(spark, sf):
    """A summary with the metrics of those groups that have any."""
    rows = read(spark, sf, "extraction_records")
    metrics = rows.where("confidence between 0 and 1 and not isnan(confidence) and test_type <> 'tensile'").groupBy("test_type").agg(F.round(F.avg("confidence"), 6).alias("confidence"))
    return rows.groupBy("test_type").agg(F.count("*").alias("n_rows")).join(metrics, "test_type", "left")


@query("SELECT event_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, any_value(user_id) AS user_id FROM events GROUP BY event_id")
def j16_pieces_by_row(spark, sf):
    """Pieces of one row side by side: pivoted by kind, then joined to the row."""
    rows = read(spark, sf, "events")
    pieces = rows.groupBy("event_id").pivot("event_type", ["click", "view"]).agg(F.max("value"))
    return rows.select("event_id", "user_id").join(pieces, "event_id").select("event_id", "click", "view", "user_id")


_BLOCK = ("alloy_family", "am_process", "build_orientation", "surface_condition", "heat_treatment")
_BLOCK_SQL = ", ".join(f"coalesce(nullif(trim({c}), ''), 'missing') AS {c}" for c in _BLOCK)


@query(f"""WITH t AS (SELECT DISTINCT {_BLOCK_SQL} FROM view_rows WHERE split_name = 'train'), h AS (SELECT view_row_id, {_BLOCK_SQL} FROM view_rows WHERE split_name <> 'train') SELECT {', '.join('h.' + c for c in _BLOCK)}, count(*) AS n_rows, count(t.alloy_family) AS n_in_training FROM h LEFT JOIN t USING ({', '.join(_BLOCK)}) GROUP BY {', '.join('h.' + c for c in _BLOCK)}""")
def j17_block_match(spark, sf):
    """Held-out rows by block of conditions, and how many of them stand in a block that training has too."""
    rows = read(spark, sf, "view_rows").select("view_row_id", "split_name", *(F.coalesce(C.filled(c), F.lit("missing")).alias(c) for c in _BLOCK))
    train = rows.where("split_name = 'train'").select(*_BLOCK).distinct().withColumn("hit", F.lit(1))
    return rows.where("split_name <> 'train'").join(train, list(_BLOCK), "left").groupBy(*_BLOCK).agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_in_training"))


@query(f"""WITH r AS (SELECT alloy_family, {_num('uts_mpa')} AS y, 3.2::DOUBLE * ({_num('hardness_hv')}) AS p, 60 + coalesce({_num('elongation_percent')}, 0) AS w FROM extraction_records WHERE alloy_family IS NOT NULL), g AS (SELECT alloy_family, avg(abs(y - p)) AS mae, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, avg((abs(y - p) <= w)::INT) AS hit, median(w) AS half FROM r WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1)
SELECT alloy_family, round(mae, 5) AS mae, round(mae / iqr, 6) AS nmae, round(hit, 6) AS hit_rate, round(half, 6) AS half_width, round(2 * half / iqr, 6) AS width_over_iqr FROM g""")
def a20_metric_parts(spark, sf):
    rows = read(spark, sf, "extraction_records").where("alloy_family is not null").select("alloy_family", C.finite("uts_mpa").alias("y"), (3.2 * C.finite("hardness_hv")).alias("p"), (60 + F.coalesce(C.finite("elongation_percent"), F.lit(0.0))).alias("w"))
    out = W.metric_parts(rows, ["alloy_family"], "y", "p", "w")
    return out.select("alloy_family", F.round("mae", 5).alias("mae"), *(F.round(c, 6).alias(c) for c in ("nmae", "hit_rate", "half_width", "width_over_iqr")))


_PARTS = ("laser_power_w", "scan_speed_mm_s", "layer_thickness_um")


@query("WITH l AS (" + " UNION ALL ".join(f"SELECT view_row_id, '{c}' AS feature, {c} - avg({c}) OVER () AS v FROM view_rows WHERE isfinite({c})" for c in _PARTS) + "), g AS (SELECT feature, avg(abs(v)) AS mean_abs, avg(v) AS mean, count(DISTINCT view_row_id) AS n_rows FROM l GROUP BY 1) SELECT feature, round(mean_abs, 5) AS mean_abs, round(abs(mean), 3) AS mean, n_rows, round(mean_abs / sum(mean_abs) OVER (), 6) AS fraction FROM g")
def a26_attribution_rollup(spark, sf):
    """Attributions (here, to a sum of the features, their difference from the mean) rolled up by feature."""
    rows = read(spark, sf, "view_rows").select("view_row_id", *(C.finite(c).alias(c) for c in _PARTS))
    long = rows.select("view_row_id", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in _PARTS))).alias("s")).select("view_row_id", "s.*").where("x is not null")
    means = long.groupBy("feature").agg(F.avg("x").alias("m"))
    v = F.col("x") - F.col("m")
    g = long.join(F.broadcast(means), "feature").groupBy("feature").agg(F.avg(F.abs(v)).alias("mean_abs"), F.avg(v).alias("mean"), F.countDistinct("view_row_id").alias("n_rows")).withColumn("all", F.lit(1))
    return A.normalised(g, ["all"], "mean_abs").select("feature", F.round("mean_abs", 5).alias("mean_abs"), F.round(F.abs("mean"), 3).alias("mean"), "n_rows", F.round("fraction", 6).alias("fraction"))


@query(f"""WITH r AS (SELECT alloy_family, {_num('stress_amplitude_mpa')} AS x, CASE WHEN ({_num('fatigue_life_cycles')}) > 0 THEN log10(fatigue_life_cycles) END AS y FROM extraction_records WHERE alloy_family IS NOT NULL), k AS (SELECT alloy_family, regr_slope(y, log10(x)) AS a, regr_intercept(y, log10(x)) AS b, count(*) AS n FROM r WHERE x > 0 AND y IS NOT NULL GROUP BY 1),
q AS (SELECT alloy_family, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q, unnest(quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM r WHERE x > 0 GROUP BY 1 HAVING count(*) >= 20 AND count(DISTINCT x) >= 3),
d AS (SELECT DISTINCT alloy_family, v FROM q), m AS (SELECT alloy_family, v, b + a * log10(v) AS p FROM d JOIN k USING (alloy_family))
SELECT alloy_family, row_number() OVER (PARTITION BY alloy_family ORDER BY v) - 1 AS value_order, round(v, 4) AS stress, round(p, 5) AS prediction, CASE WHEN last_value(p) OVER w > first_value(p) OVER w THEN 'increasing' WHEN last_value(p) OVER w < first_value(p) OVER w THEN 'decreasing' ELSE 'flat' END AS direction FROM m WINDOW w AS (PARTITION BY alloy_family ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def a27_sensitivity(spark, sf):
    """A curve's response at five quantiles of the stress, and its direction from the first to the last."""
    rows = read(spark, sf, "extraction_records").where("alloy_family is not null").select("alloy_family", C.finite("stress_amplitude_mpa").alias("x"), C.log_life(F.col("fatigue_life_cycles")).alias("y")).where("x > 0")
    curve = rows.where("y is not null").groupBy("alloy_family").agg(F.regr_slope("y", F.log10("x")).alias("a"), F.regr_intercept("y", F.log10("x")).alias("b"))
    levels = rows.groupBy("alloy_family").agg(F.array_sort(F.array_distinct(F.percentile("x", F.array(*(F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)))))).alias("v"), F.count("*").alias("n"), F.countDistinct("x").alias("d")).where("n >= 20 and d >= 3")
    at = lambda v: F.col("b") + F.col("a") * F.log10(v)
    first, last = at(F.get("v", F.lit(0))), at(F.element_at("v", -1))
    direction = F.when(last > first, "increasing").when(last < first, "decreasing").otherwise("flat")
    out = levels.join(curve, "alloy_family").select("alloy_family", "a", "b", direction.alias("direction"), F.posexplode("v").alias("value_order", "s"))
    return out.select("alloy_family", F.col("value_order").cast("bigint").alias("value_order"), F.round("s", 4).alias("stress"), F.round(at(F.col("s")), 5).alias("prediction"), "direction")


@query("""WITH r AS (SELECT source_id, coalesce(nullif(alloy, ''), 'missing') AS alloy, coalesce(nullif(am_process, ''), 'missing') AS am_process, coalesce(nullif(surface_condition, ''), 'missing') AS surface_condition FROM view_rows)
SELECT alloy, am_process, surface_condition, count(*) AS n_rows, count(DISTINCT source_id) AS n_groups FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT source_id) >= 2 AND count(*) < 0.5 * (SELECT count(*) FROM r) ORDER BY n_rows DESC, n_groups DESC, alloy, am_process, surface_condition LIMIT 1""")
def a28_combination_holdout(spark, sf):
    return W.combination_holdout(read(spark, sf, "view_rows"), ["alloy", "am_process", "surface_condition"], "source_id", least=3)


@query("""WITH p AS (SELECT d.doc_id, d.source, d.n_chars FROM documents d WHERE d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM literature_manifest m WHERE lower(trim(m.local_pdf_filename)) = lower(trim(d.source_file)) AND m.processing_status = 'active'))
SELECT doc_id, source, n_chars FROM p ORDER BY n_chars DESC, doc_id LIMIT 25""")
def t3_head_of_pending(spark, sf):
    """The first 25 of what is still to be done, longest first: the limit holds for the pending only."""
    done = read(spark, sf, "literature_manifest").where("processing_status = 'active'").select(F.lower(F.trim("local_pdf_filename")).alias("f"))
    docs = read(spark, sf, "documents").where("text is not null").withColumn("f", F.lower(F.trim("source_file")))
    return docs.join(done, "f", "left_anti").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT decision_id, audit_status, CASE lower(trim(audit_status)) WHEN 'approved' THEN 0 WHEN 'human_review_required' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END AS status_rank FROM audit_decisions ORDER BY status_rank, decision_id")
def t4_status_rank(spark, sf):
    t = F.lower(F.trim("audit_status"))
    rank = F.when(t == "approved", 0).when(t == "human_review_required", 1).when(t == "rejected", 2).otherwise(3)
    return read(spark, sf, "audit_decisions").select("decision_id", "audit_status", rank.alias("status_rank")).orderBy("status_rank", "decision_id")


@query("""WITH l AS (SELECT source_id, title, journal, listed_at, row_number() OVER (PARTITION BY source_id ORDER BY listed_at, article_number, title, journal) AS k FROM literature_manifest WHERE source_id IS NOT NULL), f AS (SELECT * FROM l WHERE k = 1), s AS (SELECT * FROM l WHERE k = 2)
SELECT source_id, title, journal FROM s UNION ALL SELECT source_id, title, journal FROM f WHERE source_id NOT IN (SELECT source_id FROM s)""")
def u5_registry_merge(spark, sf):
    """The manifest's first listings, replaced by the second ones where there are."""
    rows = S.top_per_key(read(spark, sf, "literature_manifest").where("source_id is not null"), ["source_id"], 2, F.asc_nulls_last("listed_at"), F.asc_nulls_last("article_number"), F.asc_nulls_last("title"), F.asc_nulls_last("journal"), rank="k")
    part = lambda k: rows.where(F.col("k") == k).select("source_id", "title", "journal")
    return W.merged_registry(part(1), part(2), "source_id", replace=True)


@query("""SELECT lower(trim(source_id)) AS source_id, article_number::VARCHAR AS article_number, try_cast(pub_year AS INTEGER) AS pub_year, coalesce(title_verified, false) AS title_verified, nullif(trim(title), '') IS NULL AS lacks_title FROM literature_manifest WHERE nullif(trim(source_id), '') IS NOT NULL""")
def r5_manifest_validation(spark, sf):
    """The manifest in the types that are asked for, with what it lacks; a missing column would be an error."""
    rows = read(spark, sf, "literature_manifest")
    if lacks := {"source_id", "article_number", "pub_year", "title", "title_verified"} - set(rows.columns):
        raise ValueError(f"the manifest lacks {sorted(lacks)}")
    rows = rows.where(F.nullif(F.trim("source_id"), F.lit("")).isNotNull())
    year = F.rint(C.finite("pub_year")).cast("int")
    return rows.select(F.lower(F.trim("source_id")).alias("source_id"), F.col("article_number").cast("string"), year.alias("pub_year"), F.coalesce("title_verified", F.lit(False)).alias("title_verified"), F.nullif(F.trim("title"), F.lit("")).isNull().alias("lacks_title"))


@query("""SELECT doc_id, source_file FROM documents WHERE source_file IS NOT NULL AND regexp_replace(lower(trim(source_file)), '^.*[/\\\\]', '') NOT IN (SELECT lower(trim(local_pdf_filename)) FROM literature_manifest WHERE local_pdf_filename IS NOT NULL)""")
def r6_stale_derivatives(spark, sf):
    """Documents made from a file that the manifest doesn't list any more."""
    docs = read(spark, sf, "documents").where("source_file is not null").select("doc_id", "source_file")
    files = read(spark, sf, "literature_manifest").where("local_pdf_filename is not null")
    return J.semi_by(docs, files, F.regexp_replace(F.lower(F.trim("source_file")), r"^.*[/\\]", ""), F.lower(F.trim("local_pdf_filename")), keep=False)


_AFT = ["log_stress", "ratio"]


def _fatigue(spark, sf):
    stress = C.finite("stress_amplitude_mpa")
    rows = read(spark, sf, "extraction_records").select("row_id", C.alloy_family("alloy").alias("domain"), C.finite("fatigue_life_cycles").alias("n"), C.truth("runout").alias("runout"), stress.alias("stress"), F.coalesce(C.finite("r_ratio"), F.lit(0.0)).alias("ratio"))
    lower, _, event = V.bounds(F.col("n"), F.coalesce("runout", F.lit(False)))
    rows = rows.where("n > 0 and stress between 1 and 3000")
    return rows.select("row_id", F.coalesce("domain", F.lit("missing")).alias("domain"), F.log(lower).alias("y"), event.alias("event"), F.log10(F.col("stress") / 300).alias("log_stress"), "ratio")


@query()
def m8_survival_grid(spark, sf):
    """Three error laws by three scales over all rows, with their negative log-likelihood; stress never lengthens a life."""
    rows = _fatigue(spark, sf).withColumn("domain", F.lit("all"))
    return V.fit(rows, _AFT, Scratch(spark), falling=("log_stress",))[0].select("law", "scale", "n", *(F.round(c, 5).alias(c) for c in ("nll", "intercept", *_AFT)))


@query()
def m9_survival_by_domain(spark, sf):
    """The best law and scale of each alloy family with enough rows."""
    rows = _fatigue(spark, sf)
    support = rows.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct(F.round("log_stress", 6)).alias("d")).where("n >= 150 and d >= 4").select("domain")
    models = V.fit(rows.join(support, "domain", "left_semi"), _AFT, Scratch(spark), falling=("log_stress",))[0]
    return S.best_per_key(models, ["domain"], F.asc("nll"), F.asc("law"), F.asc("scale")).select("domain", "law", "scale", "n", *(F.round(c, 5).alias(c) for c in ("nll", "intercept", *_AFT)))


@query()
def m13_scenarios(spark, sf):
    """Each fatigue row of the views as a scenario: life quantiles and survival at two lives by the best law of its alloy
    family, put in order, with the warnings of the training range."""
    scratch = Scratch(spark)
    rows = scratch.keep(_fatigue(spark, sf))
    models = V.fit(rows, _AFT, scratch, falling=("log_stress",))[0]
    best = S.best_per_key(models, ["domain"], F.asc("nll"), F.asc("law"), F.asc("scale"))
    seen = rows.agg(F.min("log_stress").alias("low"), F.max("log_stress").alias("high"))
    stress = C.finite("stress_amplitude_mpa")
    cases = read(spark, sf, "view_rows").where(stress > 0).select("view_row_id", F.coalesce(C.alloy_family("alloy"), F.lit("missing")).alias("domain"), F.log10(stress / 300).alias("log_stress"), F.coalesce(C.finite("r_ratio"), F.lit(0.0)).alias("ratio"))
    scored = V.scenario_scores(V.location(best, cases, _AFT)).crossJoin(F.broadcast(seen))
    warning = F.when(F.col("log_stress") < F.col("low"), "below_training_range:stress").when(F.col("log_stress") > F.col("high"), "above_training_range:stress").otherwise("")
    return scored.select("view_row_id", "domain", "law", "scale", *(F.round(c, 5).alias(c) for c in ("p_first", "p_second")), *(F.round(c, 1).alias(c) for c in ("q10", "q50", "q90")), warning.alias("warnings"))


_EXTRA = ("laser_power_w", "layer_thickness_um", "relative_density_percent", "hardness_hv")


@query()
def m7_curve_residual(spark, sf):
    """Errors of log-log curves by level alone and with boosted trees for what they leave, both on groups left out."""
    from evispark.operators import models as M

    scratch = Scratch(spark)
    life = C.log_life(F.col("fatigue_life_cycles"))
    rows = read(spark, sf, "extraction_records").select("row_id", F.lower(F.trim("source_id")).alias("s"), C.alloy_family("alloy").alias("alloy_family"), C.ratio_bin("r_ratio").alias("bin"), C.finite("stress_amplitude_mpa").alias("stress"), life.alias("y"), *(C.finite(c).alias(c) for c in _EXTRA), "test_type")
    rows = scratch.keep(rows.where("s is not null and y is not null and stress > 0"))
    test = S.holdout(rows, "s")
    split = scratch.keep(rows.join(test, "s"))
    train = split.where("not is_test")
    curves = scratch.keep(K.hierarchical_curves(train, "alloy_family", "bin", F.log10("stress"), F.col("y")).where("usable"))
    level = lambda n: curves.where(F.col("level") == n).select(F.col("family").alias("alloy_family"), F.col("ratio").alias("bin"), F.struct("slope", "intercept").alias("curve"))
    placed = J.by_level(split.withColumn("alloy_family", F.coalesce("alloy_family", F.lit("missing"))), [("family_ratio", level("family_ratio"), ["alloy_family", "bin"]), ("family", level("family").drop("bin"), ["alloy_family"]), ("global", level("global").select("curve"), [])], "curve")
    placed = placed.withColumn("base", F.col("curve.intercept") + F.col("curve.slope") * F.log10("stress")).where("base is not null").withColumn("residual", F.col("y") - F.col("base")).drop("curve", "level")
    data = scratch.keep(M.clean_features(placed, ["stress", "base", *_EXTRA], ["bin", "test_type"]))
    numbers = ["stress", "base", *M.usable(data.where("not is_test"), list(_EXTRA))]
    model = M.pipeline(numbers, ["bin", "test_type"], "gbt", "residual", boosts=30).fit(data.where("not is_test"))
    scored = model.transform(data.where("is_test")).select("y", F.explode(F.array(F.struct(F.lit("curve").alias("candidate"), F.col("base").alias("p")), F.struct(F.lit("curve_and_residual").alias("candidate"), (F.col("base") + F.col("prediction")).alias("p")))).alias("c")).select("y", "c.*")
    return A.regression_metrics(scored, ["candidate"], "y", "p")


@query("""SELECT source_id, article_number, listed_at, rtrim(substr(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled_paper'), 1, 170), ' .') AS file_name,
coalesce(nullif(substr(array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(journal), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: substr(w, 1, 1)), ''), 1, 12), ''), 'unknownjournal') AS journal_code,
coalesce(nullif(regexp_extract(CAST(CASE WHEN isfinite(pub_year) THEN pub_year::BIGINT END AS VARCHAR), '\\b((?:19|20)\\d{2})\\b', 1), ''), nullif(regexp_extract(doi, '\\b((?:19|20)\\d{2})\\b', 1), ''), 'unknownyear') AS year FROM literature_manifest""")
def f36_names(spark, sf):
    rows = read(spark, sf, "literature_manifest")
    year = C.year_of(F.rint(C.finite("pub_year")).cast("bigint"), F.col("doi"))
    return rows.select("source_id", "article_number", "listed_at", C.safe_filename("title").alias("file_name"), C.initials("journal").alias("journal_code"), year.alias("year"))


_YES = "'true', '1', 'yes', 'runout', 'run-out', 'run out', 'run-out samples', 'run out samples', 'survived'"
_NO = "'false', '0', 'no', 'failure', 'failed'"


@query(f"""SELECT row_id, CASE WHEN t IN ({_YES}, 'y') THEN true WHEN t IN ({_NO}, 'n') THEN false END AS with_short, CASE WHEN t IN ({_YES}) THEN true WHEN t IN ({_NO}) THEN false END AS strict,
coalesce(CASE WHEN t IN ({_YES}, 'y') THEN 'true' WHEN t IN ({_NO}, 'n') THEN 'false' END, runout) AS kept FROM (SELECT row_id, runout, lower(trim(runout)) AS t FROM extraction_records)""")
def f37_runout_variants(spark, sf):
    """Run-out words with and without single letters, and with unknown words kept as they are."""
    short = C.truth("runout")
    return read(spark, sf, "extraction_records").select("row_id", short.alias("with_short"), C.truth("runout", short=False).alias("strict"), F.coalesce(short.cast("string"), "runout").alias("kept"))


@query()
def m12_calibrated(spark, sf):
    """The chance to live a million cycles by stress, by the isotonic steps of the alloy family or, where it has none, of
    all, interpolated between them; for every fatigue row of the views."""
    scratch = Scratch(spark)
    label = F.when(F.col("fatigue_life_cycles") >= 1e6, 1).when(F.col("fatigue_life_cycles") < 1e6, 0)
    rows = read(spark, sf, "extraction_records").select("alloy_family", (-C.finite("stress_amplitude_mpa")).alias("score"), label.alias("label")).where("score is not null and label is not null")
    rows = scratch.keep(rows.withColumn("all", F.lit("all")))
    own = K.break_points(K.isotonic(rows.where("alloy_family is not null"), ["alloy_family"], "score", "label", scratch), ["alloy_family"], "score")
    whole = K.break_points(K.isotonic(rows, ["all"], "score", "label", scratch), ["all"], "score").select("points")
    cases = read(spark, sf, "view_rows").select("view_row_id", "alloy_family", (-C.finite("stress_amplitude_mpa")).alias("score")).where("score is not null")
    out = J.by_level(cases, [("family", own, ["alloy_family"]), ("global", whole, [])], "points")
    return out.select("view_row_id", "level", F.round(K.interpolated(F.col("points"), F.col("score")), 6).alias("p"))
