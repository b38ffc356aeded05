"""Queries of aggregations, curves, calibration and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.operators import curves as K
from evispark.operators import statistics as A
from evispark.operators import text_search as R
from evispark.plans.registry import query
from evispark.session import Scratch, read


def _pairs(spark, sf):
    """Strength and a plain stand-in for its prediction from the hardness."""
    u, h = C.finite("uts_mpa"), C.finite("hardness_hv")
    return read(spark, sf, "extraction_records").select("row_id", "alloy_family", "test_type", u.alias("y"), (h * 3.2).alias("p"))


_PAIRS = "WITH q AS (SELECT row_id, alloy_family, test_type, CASE WHEN isfinite(uts_mpa) THEN uts_mpa END AS y, CASE WHEN isfinite(hardness_hv) THEN hardness_hv END * 3.2::DOUBLE AS p FROM extraction_records)"


@query("""SELECT view_name, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, count(DISTINCT doi) AS n_dois, count(uts_mpa) AS n_uts, count(stress_amplitude_mpa) AS n_stress FROM view_rows GROUP BY view_name""")
def a1_view_summary(spark, sf):
    return read(spark, sf, "view_rows").groupBy("view_name").agg(
        F.count("*").alias("n_rows"), F.countDistinct("source_id").alias("n_sources"), F.countDistinct("doi").alias("n_dois"), F.count("uts_mpa").alias("n_uts"), F.count("stress_amplitude_mpa").alias("n_stress")
    )


@query("""SELECT alloy_family, count(*) AS n, round(avg(hardness_hv), 6) AS mean, round(stddev_samp(hardness_hv), 6) AS std FROM extraction_records WHERE hardness_hv IS NOT NULL AND NOT isnan(hardness_hv) GROUP BY alloy_family""")
def a3_mean_std(spark, sf):
    return read(spark, sf, "extraction_records").where("hardness_hv is not null and not isnan(hardness_hv)").groupBy("alloy_family").agg(F.count("*").alias("n"), F.round(F.avg("hardness_hv"), 6).alias("mean"), F.round(F.stddev_samp("hardness_hv"), 6).alias("std"))


@query(f"""{_PAIRS} SELECT alloy_family, count(*) AS n, round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END, 5) AS r2 FROM q WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY alloy_family""")
def a4_regression_metrics(spark, sf):
    out = A.regression_metrics(_pairs(spark, sf), ["alloy_family"], "y", "p")
    return out.select("alloy_family", "n", *(F.round(c, 5).alias(c) for c in ("mae", "rmse", "r2")))


@query(f"""{_PAIRS}, r AS (SELECT alloy_family, abs(y - p) AS r, row_number() OVER (PARTITION BY alloy_family ORDER BY abs(y - p)) AS k, count(*) OVER (PARTITION BY alloy_family) AS n FROM q WHERE y IS NOT NULL AND p IS NOT NULL AND alloy_family IS NOT NULL)
SELECT alloy_family, n, round(r, 6) AS radius FROM r WHERE k = ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1)) + 1""")
def a5_conformal_radius(spark, sf):
    rows = _pairs(spark, sf).where("alloy_family is not null")
    return A.conformal_radius(rows, ["alloy_family"], F.col("y") - F.col("p"), Scratch(spark)).withColumn("radius", F.round("radius", 6))


@query("""WITH r AS (SELECT row_id, alloy_family, fatigue_life_cycles AS t, lower(trim(runout)) IN ('no', 'false', '0', 'n', 'failed', 'failure') AS e, -stress_amplitude_mpa AS h FROM extraction_records WHERE alloy_family IS NOT NULL AND isfinite(fatigue_life_cycles) AND isfinite(stress_amplitude_mpa)),
p AS (SELECT a.alloy_family, CASE WHEN b.h < a.h THEN 1.0 WHEN b.h = a.h THEN 0.5 ELSE 0.0 END AS c FROM r a JOIN r b ON a.alloy_family = b.alloy_family AND coalesce(a.e, false) AND b.t > a.t)
SELECT alloy_family, count(c) AS n_pairs, round(avg(c)::DOUBLE, 6) AS c_index FROM (SELECT DISTINCT alloy_family FROM r) LEFT JOIN p USING (alloy_family) GROUP BY alloy_family""")
def a6_concordance(spark, sf):
    event = F.coalesce(F.lower(F.trim("runout")).isin("no", "false", "0", "n", "failed", "failure"), F.lit(False))
    rows = read(spark, sf, "extraction_records").where("alloy_family is not null").select("alloy_family", C.finite("fatigue_life_cycles").alias("t"), event.alias("e"), (-C.finite("stress_amplitude_mpa")).alias("h"))
    out = A.concordance(rows, ["alloy_family"], "t", "e", "h", Scratch(spark))
    return out.withColumn("c_index", F.round("c_index", 6))


@query("""SELECT test_type, extraction_method, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, count(*) FILTER (frequency_hz > 1000) AS n_fast, min(stress_amplitude_mpa) AS low, max(stress_amplitude_mpa) AS high FROM extraction_records GROUP BY test_type, extraction_method""")
def a7_regime_summary(spark, sf):
    return read(spark, sf, "extraction_records").groupBy("test_type", "extraction_method").agg(
        F.count("*").alias("n_rows"), F.countDistinct("source_id").alias("n_sources"), F.count_if(F.col("frequency_hz") > 1000).alias("n_fast"), F.min("stress_amplitude_mpa").alias("low"), F.max("stress_amplitude_mpa").alias("high")
    )


@query("""SELECT coalesce(alloy_family, 'missing') AS family, coalesce(test_type, 'missing') AS test, count(*) AS n_rows, count(DISTINCT source_id) AS n_sources, CASE WHEN count(*) >= 30 AND count(DISTINCT source_id) >= 3 THEN 'adequate' WHEN count(*) >= 10 AND count(DISTINCT source_id) >= 2 THEN 'limited' ELSE 'sparse' END AS level FROM extraction_records GROUP BY 1, 2""")
def a8_combination_coverage(spark, sf):
    g = read(spark, sf, "extraction_records").groupBy(F.coalesce("alloy_family", F.lit("missing")).alias("family"), F.coalesce("test_type", F.lit("missing")).alias("test")).agg(F.count("*").alias("n_rows"), F.countDistinct("source_id").alias("n_sources"))
    level = F.when((F.col("n_rows") >= 30) & (F.col("n_sources") >= 3), "adequate").when((F.col("n_rows") >= 10) & (F.col("n_sources") >= 2), "limited").otherwise("sparse")
    return g.withColumn("level", level)


@query("""SELECT * FROM (PIVOT (SELECT alloy_family, split_name, uts_mpa FROM view_rows) ON split_name IN ('train', 'validation', 'test') USING max(uts_mpa) GROUP BY alloy_family)""")
def a9_pivot(spark, sf):
    return read(spark, sf, "view_rows").groupBy("alloy_family").pivot("split_name", ["train", "validation", "test"]).agg(F.max("uts_mpa"))


_COVERED = ("alloy", "heat_treatment", "build_orientation")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_filled, round(count({c}) / count(*), 6) AS share, count(DISTINCT {c}) AS n_values, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN source_id END) AS n_sources FROM extraction_records" for c in _COVERED))
def a10_feature_coverage(spark, sf):
    return A.coverage(read(spark, sf, "extraction_records"), list(_COVERED), "source_id").withColumn("share", F.round("share", 6))


@query(f"""{_PAIRS}, f AS (SELECT * FROM q WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT 'alloy_family' AS group_column, alloy_family AS group_value, count(*) AS n_rows, round(avg(abs(y - p)), 6) AS mae FROM f WHERE alloy_family IS NOT NULL GROUP BY alloy_family HAVING count(*) >= 5
UNION ALL SELECT 'test_type', test_type, count(*), round(avg(abs(y - p)), 6) FROM f WHERE test_type IS NOT NULL GROUP BY test_type HAVING count(*) >= 5""")
def a11_grouped_errors(spark, sf):
    rows = _pairs(spark, sf).where("y is not null and p is not null")
    return A.single_column_sets(rows, ["alloy_family", "test_type"], F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae"), least=5)


@query("""SELECT alloy_family, round(median(uts_mpa), 6) AS m FROM extraction_records WHERE uts_mpa IS NOT NULL AND NOT isnan(uts_mpa) GROUP BY GROUPING SETS ((alloy_family), ())""")
def a12_family_median(spark, sf):
    rows = read(spark, sf, "extraction_records").where("uts_mpa is not null and not isnan(uts_mpa)")
    return rows.groupingSets([[F.col("alloy_family")], []], "alloy_family").agg(F.round(F.median("uts_mpa"), 6).alias("m"))


_CURVE = """WITH r AS (SELECT coalesce(alloy_family, 'missing') AS family, CASE WHEN r_ratio < 0 THEN 'reversed' WHEN r_ratio >= 0 THEN 'pulsating' ELSE 'missing' END AS ratio, log10(stress_amplitude_mpa) AS x, log10(fatigue_life_cycles) AS y FROM extraction_records
WHERE isfinite(stress_amplitude_mpa) AND stress_amplitude_mpa > 0 AND isfinite(fatigue_life_cycles) AND fatigue_life_cycles > 0),
c AS (SELECT CASE WHEN grouping(family) = 1 THEN 'global' WHEN grouping(ratio) = 1 THEN 'family' ELSE 'family_ratio' END AS level, family, ratio, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(DISTINCT x) AS nx FROM r GROUP BY GROUPING SETS ((), (family), (family, ratio)))"""


def _curves(spark, sf):
    ratio = F.when(F.col("r_ratio") < 0, "reversed").when(F.col("r_ratio") >= 0, "pulsating")
    rows = read(spark, sf, "extraction_records").withColumn("_ratio", ratio)
    s, n = C.finite("stress_amplitude_mpa"), C.finite("fatigue_life_cycles")
    return K.hierarchical_curves(rows, "alloy_family", "_ratio", F.when(s > 0, F.log10(s)), F.when(n > 0, F.log10(n)))


@query(f"""{_CURVE} SELECT level, family, ratio, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept, n >= CASE level WHEN 'global' THEN 100 WHEN 'family' THEN 50 ELSE 30 END AND nx >= 3 AND slope < 0 AS usable FROM c""")
def a13_hierarchical_curves(spark, sf):
    return _curves(spark, sf).withColumns({c: F.round(c, 5) for c in ("slope", "intercept")})


@query(f"""{_CURVE}, u AS (SELECT * FROM c WHERE n >= CASE level WHEN 'global' THEN 100 WHEN 'family' THEN 50 ELSE 30 END AND nx >= 3 AND slope < 0)
SELECT level, family, ratio, step, round(100 * exp(step * ln(8) / 9), 4) AS stress, round(intercept + slope * log10(100 * exp(step * ln(8) / 9)), 4) AS log_life FROM u CROSS JOIN (SELECT unnest(range(0, 10)) AS step)""")
def m20_stress_scan(spark, sf):
    scan = K.stress_scan(_curves(spark, sf).where("usable"), 100.0, 800.0, 10)
    return scan.select("level", "family", "ratio", "step", F.round("stress", 4).alias("stress"), F.round("log_life", 4).alias("log_life"))


@query("""SELECT alloy_family, am_process, count(*) >= 150 AND count(DISTINCT source_id) >= 20 AND count(DISTINCT round(stress_amplitude_mpa, 6)) >= 4 AS supported, grouping(am_process) = 1 AS is_family, count(*) AS n FROM extraction_records WHERE stress_amplitude_mpa IS NOT NULL GROUP BY GROUPING SETS ((alloy_family, am_process), (alloy_family))""")
def a14_domain_support(spark, sf):
    rows = read(spark, sf, "extraction_records").where("stress_amplitude_mpa is not null")
    g = rows.groupingSets([[F.col("alloy_family"), F.col("am_process")], [F.col("alloy_family")]], "alloy_family", "am_process").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("s"), F.countDistinct(F.round("stress_amplitude_mpa", 6)).alias("k"), (F.grouping("am_process") == 1).alias("is_family"))
    return g.select("alloy_family", "am_process", "n", "is_family", ((F.col("n") >= 150) & (F.col("s") >= 20) & (F.col("k") >= 4)).alias("supported"))


@query("""SELECT alloy_family, round(CASE WHEN w > 0 THEN w WHEN s > 0 THEN s ELSE 1 END, 6) AS iqr FROM (SELECT alloy_family, quantile_cont(hardness_hv, 0.75) - quantile_cont(hardness_hv, 0.25) AS w, stddev_pop(hardness_hv) AS s FROM extraction_records WHERE hardness_hv IS NOT NULL AND NOT isnan(hardness_hv) GROUP BY alloy_family)""")
def a16_iqr(spark, sf):
    rows = read(spark, sf, "extraction_records").where("hardness_hv is not null and not isnan(hardness_hv)")
    return A.iqr(rows, ["alloy_family"], "hardness_hv").withColumn("iqr", F.round("iqr", 6))


@query("""WITH r AS (SELECT row_id, alloy_family, CASE WHEN isfinite(laser_power_w) THEN laser_power_w END AS a, CASE WHEN isfinite(layer_thickness_um) THEN layer_thickness_um END AS b FROM extraction_records WHERE alloy_family IS NOT NULL),
m AS (SELECT alloy_family, median(a) AS ma, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS wa, median(b) AS mb, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS wb FROM r GROUP BY alloy_family),
d AS (SELECT row_id, alloy_family, round(pow(coalesce((a - ma) / CASE WHEN wa > 0 THEN wa ELSE 1 END, 0), 2) + pow(coalesce((b - mb) / CASE WHEN wb > 0 THEN wb ELSE 1 END, 0), 2), 9) AS d FROM r JOIN m USING (alloy_family))
SELECT alloy_family, arg_min(row_id, (d, row_id)) AS row_id, round(min(d), 6) AS distance FROM d GROUP BY alloy_family""")
def a17_medoid(spark, sf):
    rows = read(spark, sf, "extraction_records").where("alloy_family is not null").select("row_id", "alloy_family", C.finite("laser_power_w").alias("a"), C.finite("layer_thickness_um").alias("b"))
    return A.medoid(rows, ["alloy_family"], ["a", "b"], "row_id").withColumn("distance", F.round("distance", 6))


@query("""SELECT alloy_family, round(coalesce(max(n) / nullif(sum(n), 0), 1), 6) AS dominance FROM (SELECT alloy_family, source_id, count(source_id) AS n FROM extraction_records GROUP BY alloy_family, source_id) GROUP BY alloy_family""")
def a18_source_dominance(spark, sf):
    return A.dominance(read(spark, sf, "extraction_records"), ["alloy_family"], "source_id").withColumn("dominance", F.round("dominance", 6))


@query(f"""{_PAIRS}, f AS (SELECT * FROM q WHERE y IS NOT NULL AND p IS NOT NULL), k AS (SELECT alloy_family, rank() OVER (PARTITION BY alloy_family ORDER BY y) + (count(*) OVER (PARTITION BY alloy_family, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY alloy_family ORDER BY p) + (count(*) OVER (PARTITION BY alloy_family, p) - 1) / 2 AS rp FROM f)
SELECT alloy_family, count(*) AS n, round(corr(ry, rp), 6) AS rho FROM k GROUP BY alloy_family HAVING count(*) >= 5""")
def a24_spearman(spark, sf):
    return A.spearman(_pairs(spark, sf), ["alloy_family"], "y", "p", Scratch(spark)).withColumn("rho", F.round("rho", 6))


@query("""WITH g AS (SELECT source, lang, count(*) AS v FROM documents GROUP BY source, lang) SELECT source, lang, round(v / sum(v) OVER (PARTITION BY source), 6) AS fraction FROM g""")
def a25_normalised_share(spark, sf):
    g = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("v"))
    return A.normalised(g, ["source"], "v").select("source", "lang", F.round("fraction", 6).alias("fraction"))


@query("""SELECT count(*) AS n_rows, count(*) - count(DISTINCT record_id) AS n_repeated, count(*) FILTER (source_id IS NULL OR trim(source_id) = '') AS n_no_source, count(*) FILTER (doi IS NULL) AS n_no_doi, count(*) FILTER (uts_mpa IS NULL AND stress_amplitude_mpa IS NULL) AS n_no_target FROM extraction_records""")
def a33_table_validation(spark, sf):
    return read(spark, sf, "extraction_records").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("record_id")).alias("n_repeated"), F.count_if(~F.coalesce(F.trim("source_id") != "", F.lit(False))).alias("n_no_source"),
        F.count_if(F.col("doi").isNull()).alias("n_no_doi"), F.count_if(F.col("uts_mpa").isNull() & F.col("stress_amplitude_mpa").isNull()).alias("n_no_target"),
    )


@query("""SELECT alloy_family, min(laser_power_w) AS low, max(laser_power_w) AS high, list_sort(list(DISTINCT test_type) FILTER (test_type IS NOT NULL)) AS tests FROM extraction_records WHERE laser_power_w IS NOT NULL AND NOT isnan(laser_power_w) GROUP BY alloy_family""")
def a34_feature_domain(spark, sf):
    rows = read(spark, sf, "extraction_records").where("laser_power_w is not null and not isnan(laser_power_w)")
    return rows.groupBy("alloy_family").agg(F.min("laser_power_w").alias("low"), F.max("laser_power_w").alias("high"), F.array_sort(F.collect_set("test_type")).alias("tests"))


@query("""WITH r AS (SELECT lower(trim(source_id)) AS s, stress_amplitude_mpa AS x, avg(fatigue_life_cycles) AS y FROM extraction_records WHERE isfinite(stress_amplitude_mpa) AND isfinite(fatigue_life_cycles) GROUP BY 1, 2), d AS (SELECT s, y - lag(y) OVER (PARTITION BY s ORDER BY x) > 1e-12 AS bad FROM r)
SELECT s, count(*) AS n, NOT coalesce(bool_or(bad), false) AS monotone FROM d GROUP BY s""")
def w10_monotone_check(spark, sf):
    rows = read(spark, sf, "extraction_records").where("stress_amplitude_mpa is not null and fatigue_life_cycles is not null and not isnan(stress_amplitude_mpa) and not isnan(fatigue_life_cycles)")
    means = rows.groupBy(F.lower(F.trim("source_id")).alias("s"), F.col("stress_amplitude_mpa").alias("x")).agg(F.avg("fatigue_life_cycles").alias("y"))
    return K.monotone(means, ["s"], "x", "y", Scratch(spark))


@query("""SELECT row_id, round(1 / (1 + exp((ln(1e7) - ln(n)) / 0.8)), 6) AS p_logistic, round(exp(-exp((ln(1e7) - ln(n)) / 0.8)), 6) AS p_extreme, round(exp(ln(n) + 0.8 * ln(0.1 / 0.9)), 2) AS q10, CASE WHEN n >= 1e7 THEN 1 WHEN e AND n < 1e7 THEN 0 END AS label
FROM (SELECT row_id, fatigue_life_cycles AS n, coalesce(lower(trim(runout)) IN ('false', 'no', 'n', '0', 'failure', 'failed'), false) AS e FROM extraction_records WHERE isfinite(fatigue_life_cycles) AND fatigue_life_cycles > 0)""")
def m10_survival(spark, sf):
    n = F.col("fatigue_life_cycles")
    rows = read(spark, sf, "extraction_records").where("fatigue_life_cycles > 0 and not isnan(fatigue_life_cycles)")
    failed = F.coalesce(~C.truth("runout"), F.lit(False))
    return rows.select(
        "row_id", F.round(K.survival_probability(n, 0.8, 1e7, "logistic"), 6).alias("p_logistic"), F.round(K.survival_probability(n, 0.8, 1e7, "extreme"), 6).alias("p_extreme"),
        F.round(K.life_quantile(n, 0.8, 0.1, "logistic"), 2).alias("q10"), K.threshold_label(n, failed, 1e7).alias("label"),
    )


@query()
def m10_survival_normal(spark, sf):
    rows = read(spark, sf, "extraction_records").where("fatigue_life_cycles > 0 and not isnan(fatigue_life_cycles)")
    return rows.select("row_id", F.round(K.survival_probability(F.col("fatigue_life_cycles"), 0.8, 1e7, "normal"), 6).alias("p_normal"))


@query()
def m12_isotonic(spark, sf):
    label = F.when(F.col("fatigue_life_cycles") >= 1e6, 1).when(F.col("fatigue_life_cycles") < 1e6, 0)
    rows = read(spark, sf, "extraction_records").select("alloy_family", (-F.round("stress_amplitude_mpa", 0)).alias("score"), label.alias("label"))
    return K.isotonic(rows.where("alloy_family is not null and score is not null and label is not null"), ["alloy_family"], "score", "label", Scratch(spark))


@query("""SELECT doc_id, CAST(i / 3200 AS INT) AS chunk_index, regexp_replace(substr(text, i + 1, 3500), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(length(text) - 301, 0) + 1 AS BIGINT), 3200)) AS i FROM documents WHERE text IS NOT NULL)
WHERE regexp_replace(substr(text, i + 1, 3500), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') <> ''""")
def r1_chunk(spark, sf):
    return R.chunks(read(spark, sf, "documents"), "doc_id", "text")


_STOP = ", ".join(f"'{w}'" for w in R.STOP)
_TFIDF = f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM t)),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w, idf FROM c JOIN d USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(['surface', 'roughness', 'fatigue', 'strength', 'surface roughness', 'roughness fatigue', 'fatigue strength']) AS term) GROUP BY term),
k AS (SELECT term, qtf * idf AS qw FROM q JOIN d USING (term)), s AS (SELECT doc_id, sum(w / n * qw) / (SELECT sqrt(sum(qw * qw)) FROM k) AS s FROM w JOIN n USING (doc_id) JOIN k USING (term) GROUP BY doc_id)"""


@query(f"{_TFIDF} SELECT doc_id, round(s, 6) AS score FROM s ORDER BY round(s, 6) DESC, doc_id LIMIT 20")
def r3_tfidf_topk(spark, sf):
    return R.search(read(spark, sf, "documents"), "doc_id", "text", "surface roughness of fatigue strength", 20)


@query(f"{_TFIDF}, k2 AS (SELECT doc_id, source, round(s, 6) AS score FROM s JOIN documents USING (doc_id)) SELECT doc_id, source, score, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS source_rank FROM k2) WHERE source_rank <= 2")
def r4_per_source_topk(spark, sf):
    docs = read(spark, sf, "documents")
    scored = R.search(docs, "doc_id", "text", "surface roughness of fatigue strength")
    return R.per_source(scored.join(docs.select("doc_id", "source"), "doc_id"), "source", "doc_id", 2)


@query("""SELECT p_brand, p_type, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_sources, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue,
CASE WHEN count(*) >= 30 AND count(DISTINCT l_suppkey) >= 3 THEN 'adequate' ELSE 'limited' END AS level FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY p_brand, p_type""")
def a21_evidence_by_domain(spark, sf):
    rows = read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = rows.groupBy("p_brand", "p_type").agg(
        F.count("*").alias("n_rows"), F.countDistinct("l_suppkey").alias("n_sources"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("revenue")
    )
    return g.withColumn("level", F.when((F.col("n_rows") >= 30) & (F.col("n_sources") >= 3), "adequate").otherwise("limited"))
