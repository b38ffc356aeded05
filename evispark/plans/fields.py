"""Queries of the cleaning and feature expressions, over the evidence records."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.plans.registry import query
from evispark.session import read


@query("""SELECT DISTINCT p_type AS header, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS normalised FROM part
UNION SELECT h, n FROM (VALUES ('Laser Power (W)', 'laser power w'), ('Hatch [μm]', 'hatch um'), ('σa / MPa', 'sigmaa mpa'), ('Δσ', 'deltasigma'), ('T (°C)', 't c')) AS t(h, n)""")
def f1_header_normalise(spark, sf):
    given = spark.createDataFrame([("Laser Power (W)",), ("Hatch [μm]",), ("σa / MPa",), ("Δσ",), ("T (°C)",)], "header string")
    return read(spark, sf, "part").select(F.col("p_type").alias("header")).distinct().unionAll(given).select("header", C.header_name("header").alias("normalised"))


ALIASES = (("uts mpa", "uts_mpa"), ("rm mpa", "uts_mpa"), ("laser power w", "laser_power_w"), ("p w", "laser_power_w"), ("hatch um", "hatch_spacing_um"))


@query("""WITH h(header) AS (VALUES ('UTS (MPa)'), ('Rm [MPa]'), ('Laser power / W'), ('Comment'), ('Hatch (μm)'), ('Vickers hardness')),
n AS (SELECT header, trim(regexp_replace(replace(lower(header), 'μ', 'u'), '[^a-z0-9]+', ' ', 'g')) AS normalised FROM h),
a(alias, name) AS (VALUES ('uts mpa', 'uts_mpa'), ('rm mpa', 'uts_mpa'), ('laser power w', 'laser_power_w'), ('p w', 'laser_power_w'), ('hatch um', 'hatch_spacing_um'))
SELECT header, normalised, coalesce(name, CASE WHEN contains(normalised, 'hardness') THEN 'hardness_hv' WHEN contains(normalised, 'density') THEN 'relative_density_percent' END) AS column_name,
coalesce(name, CASE WHEN contains(normalised, 'hardness') THEN 'hardness_hv' WHEN contains(normalised, 'density') THEN 'relative_density_percent' END) IS NOT NULL AS is_mapped
FROM n LEFT JOIN a ON a.alias = n.normalised""")
def f2_alias_mapping(spark, sf):
    headers = spark.createDataFrame([(h,) for h in ("UTS (MPa)", "Rm [MPa]", "Laser power / W", "Comment", "Hatch (μm)", "Vickers hardness")], "header string")
    aliases = spark.createDataFrame(list(ALIASES), "normalised string, name string")
    n = headers.withColumn("normalised", C.header_name("header")).join(F.broadcast(aliases), "normalised", "left")  # a literal list
    rule = F.when(F.contains("normalised", F.lit("hardness")), "hardness_hv").when(F.contains("normalised", F.lit("density")), "relative_density_percent")
    return n.select("header", "normalised", F.coalesce("name", rule).alias("column_name"), F.coalesce("name", rule).isNotNull().alias("is_mapped"))


@query("""SELECT row_id, try_cast(regexp_replace(trim(replace(evidence_text, chr(10), ' ')), '[,%]', '', 'g') AS DOUBLE) AS as_number,
try_cast(regexp_replace(format('{:,}', CAST(round(fatigue_life_cycles) AS BIGINT)), '[,%]', '', 'g') AS DOUBLE) AS life FROM extraction_records WHERE fatigue_life_cycles IS NOT NULL AND NOT isnan(fatigue_life_cycles)""")
def f3_numeric_clean(spark, sf):
    life = F.format_number(F.round("fatigue_life_cycles").cast("bigint"), 0)
    rows = read(spark, sf, "extraction_records").where("fatigue_life_cycles is not null and not isnan(fatigue_life_cycles)")
    return rows.select("row_id", C.numeric("evidence_text").alias("as_number"), C.numeric(life).alias("life"))


@query("""SELECT row_id, CASE WHEN lower(trim(runout)) IN ('true','yes','y','1','runout','run-out','run out','run-out samples','run out samples','survived') THEN true
WHEN lower(trim(runout)) IN ('false','no','n','0','failure','failed') THEN false END AS ran_out,
CASE WHEN lower(trim(runout)) IN ('true','yes','1','runout','run-out','run out','run-out samples','run out samples','survived') THEN true
WHEN lower(trim(runout)) IN ('false','no','0','failure','failed') THEN false END AS ran_out_strict FROM extraction_records""")
def f4_boolean_parse(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.truth("runout").alias("ran_out"), C.truth("runout", short=False).alias("ran_out_strict"))


@query("""SELECT row_id, alloy IS NULL OR trim(regexp_replace(alloy, '\\s+', ' ', 'g')) = '' OR lower(trim(regexp_replace(alloy, '\\s+', ' ', 'g'))) IN ('missing','nan','none','<na>','unknown') AS alloy_missing,
test_type IS NULL OR lower(trim(test_type)) IN ('','missing','nan','none','<na>','unknown') AS test_missing FROM extraction_records""")
def f5_missing_predicate(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.is_missing("alloy").alias("alloy_missing"), C.is_missing("test_type").alias("test_missing"))


_NAME = """CASE WHEN k IN ('ti64','ti6al4v','ti6al4veli','ti6al4velis') THEN 'Ti-6Al-4V' WHEN k IN ('316l','ss316l','316lstainlesssteel') THEN '316L stainless steel'
WHEN k IN ('in718','inconel718','alloy718') THEN 'Inconel 718' WHEN k IN ('in625','inconel625','alloy625') THEN 'Inconel 625' WHEN k = 'hastelloyx' THEN 'Hastelloy X' WHEN k = 'alsi10mg' THEN 'AlSi10Mg' ELSE t END"""


@query(f"""WITH a AS (SELECT row_id, nullif(regexp_replace(alloy, '^\\s+|\\s+$', '', 'g'), '') AS t FROM extraction_records),
b AS (SELECT row_id, t, lower(regexp_replace(t, '[\\s_\\-]', '', 'g')) AS k, lower(t) AS l FROM a)
SELECT row_id, {_NAME} AS alloy_name, CASE WHEN starts_with(l, 'ti') OR contains(l, 'ti-') OR contains(l, 'titanium') THEN 'Ti alloy'
WHEN contains(l, '316') OR contains(l, 'steel') OR contains(l, 'ss') THEN 'Steel'
WHEN contains(l, 'inconel') OR contains(l, 'hastelloy') OR contains(l, 'nickel') OR regexp_matches(l, '^in(718|625| )') THEN 'Ni alloy'
WHEN starts_with(l, 'al') OR contains(l, 'alsi') OR contains(l, 'aluminium') THEN 'Al alloy' WHEN l IS NOT NULL THEN 'Other' END AS family FROM b""")
def f6_alloy_canonical(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.alloy_name("alloy").alias("alloy_name"), C.alloy_family("alloy").alias("family"))


@query("""WITH f AS (SELECT row_id, lower(nullif(trim(failure_mode), '')) AS t FROM extraction_records)
SELECT row_id, CASE WHEN (contains(t, 'lack') AND contains(t, 'fusion')) OR t = 'lof' THEN 'lack_of_fusion' WHEN contains(t, 'keyhole') THEN 'keyhole_pore'
WHEN contains(t, 'gas') AND (contains(t, 'pore') OR contains(t, 'porosity')) THEN 'gas_pore' WHEN contains(t, 'pore') OR contains(t, 'porosity') THEN 'pore'
WHEN contains(t, 'crack') THEN 'crack' WHEN contains(t, 'inclusion') THEN 'inclusion' ELSE replace(t, ' ', '_') END AS defect FROM f""")
def f7_defect_class(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.defect_class("failure_mode").alias("defect"))


@query("""WITH a AS (SELECT row_id, nullif(regexp_replace(am_process, '^\\s+|\\s+$', '', 'g'), '') AS t FROM extraction_records),
b AS (SELECT row_id, CASE WHEN lower(t) <> 'missing' THEN t END AS t FROM a), c AS (SELECT row_id, t, regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM b)
SELECT row_id, CASE WHEN k IN ('lpbf','lbpbf','pbflb','pbflbm','laserpowderbedfusion','laserpowderbedfusionlpbf','selectivelasermelting','selectivelasermeltingslm','slm') THEN 'L-PBF'
WHEN k IN ('epbf','ebpbf','electronbeammelting') THEN 'E-PBF' WHEN k IN ('waam','wirearcadditivemanufacturingwaam') THEN 'WAAM' ELSE t END AS domain FROM c""")
def f8_process_domain(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.process_domain("am_process").alias("domain"))


@query("""WITH s AS (SELECT row_id, list_transform(string_split(post_processing, ';'), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS steps, post_processing FROM extraction_records WHERE post_processing IS NOT NULL),
h AS (SELECT row_id, len(list_filter(steps, lambda x: starts_with(x, 'hip'))) > 0 AS hip, len(list_filter(steps, lambda x: starts_with(x, 'ht'))) > 0 AS ht, len(list_filter(steps, lambda x: starts_with(x, 'nht'))) > 0 AS nht FROM s)
SELECT row_id, CASE WHEN hip AND ht THEN 'hip+heat-treated' WHEN hip THEN 'hip' WHEN ht THEN 'heat-treated' WHEN nht THEN 'no-heat-treatment' END AS heat FROM h""")
def f9_heat_route(spark, sf):
    return read(spark, sf, "extraction_records").where("post_processing is not null").select("row_id", C.heat_route("post_processing").alias("heat"))


@query()
def f10_surface_route(spark, sf):
    surface, heat = C.surface_route("post_processing"), C.heat_route("post_processing")
    rows = read(spark, sf, "extraction_records").select("row_id", "post_processing", surface.alias("surface"), heat.alias("heat"))
    return rows.select("row_id", "surface", "heat", C.material_state("post_processing", "surface", "heat").alias("state"))


@query("""WITH d AS (SELECT doc_id, lower(trim(text)) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(t, 'c\\s*\\(\\s*t\\s*\\)') THEN 'compact-tension' WHEN regexp_matches(t, 'compact\\s+tension') THEN 'compact-tension' WHEN regexp_matches(t, 'circular\\s+cross') THEN 'circular-cross-section'
WHEN regexp_matches(t, 'rectangular\\s+cross') THEN 'rectangular-cross-section' WHEN regexp_matches(t, 'cruciform') THEN 'cruciform' WHEN regexp_matches(t, 'tubular|tube') THEN 'tubular'
WHEN regexp_matches(t, 'hourglass') THEN 'hourglass' WHEN regexp_matches(t, 'single.edge.notch|\\bsen[bt]?\\b') THEN 'single-edge-notch' WHEN regexp_matches(t, 'middle.tension|\\bm\\s*\\(\\s*t\\s*\\)') THEN 'middle-tension' END AS shape FROM d""")
def f11_geometry(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", C.geometry("text").alias("shape"))


@query("""SELECT row_id, round(CASE WHEN v > 0 THEN p / v END, 3) AS ved, round(CASE WHEN d BETWEEN 0 AND 100 THEN 100 - d END, 6) AS porosity, round(CASE WHEN n > 0 THEN log10(n) END, 6) AS log_life,
round(CASE WHEN n > 0 AND f > 0 THEN n / f / 3600 * 3600 * f END, 1) AS cycles
FROM (SELECT row_id, CASE WHEN NOT isnan(laser_power_w) THEN laser_power_w END AS p, CASE WHEN NOT isnan(scan_speed_mm_s) THEN scan_speed_mm_s END * CASE WHEN NOT isnan(hatch_spacing_um) THEN hatch_spacing_um END / 1000 * CASE WHEN NOT isnan(layer_thickness_um) THEN layer_thickness_um END / 1000 AS v,
CASE WHEN NOT isnan(relative_density_percent) THEN relative_density_percent END AS d, CASE WHEN NOT isnan(fatigue_life_cycles) THEN fatigue_life_cycles END AS n, CASE WHEN NOT isnan(frequency_hz) THEN frequency_hz END AS f FROM extraction_records)""")
def f12_engineered_features(spark, sf):
    c = F.col
    hours = C.finite("fatigue_life_cycles") / F.when(C.finite("frequency_hz") > 0, C.finite("frequency_hz")) / 3600
    return read(spark, sf, "extraction_records").select(
        "row_id", F.round(C.energy_density(c("laser_power_w"), c("scan_speed_mm_s"), c("hatch_spacing_um"), c("layer_thickness_um")), 3).alias("ved"),
        F.round(C.porosity(c("relative_density_percent")), 6).alias("porosity"), F.round(C.log_life(c("fatigue_life_cycles")), 6).alias("log_life"),
        F.round(C.cycles(hours, c("frequency_hz")), 1).alias("cycles"),
    )


@query("""SELECT row_id, (doi IS NOT NULL)::INT + (alloy IS NOT NULL)::INT + (am_process IS NOT NULL)::INT + (uts_mpa IS NOT NULL)::INT + (yield_strength_mpa IS NOT NULL)::INT + (stress_amplitude_mpa IS NOT NULL)::INT + (fatigue_life_cycles IS NOT NULL)::INT AS score
FROM extraction_records WHERE coalesce(uts_mpa, yield_strength_mpa, stress_amplitude_mpa, fatigue_life_cycles) IS NOT NULL""")
def f13_information_score(spark, sf):
    rows = read(spark, sf, "extraction_records").where("coalesce(uts_mpa, yield_strength_mpa, stress_amplitude_mpa, fatigue_life_cycles) is not null")
    return rows.select("row_id", C.information_score("doi", "alloy", "am_process", "uts_mpa", "yield_strength_mpa", "stress_amplitude_mpa", "fatigue_life_cycles").alias("score"))


@query("""SELECT row_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(doi), '\\s+', '', 'g'), '^(https?://)?(dx\\.)?doi\\.[a-z]+/|^doi:?', ''), '[.,;:)\\]}]+$', ''), '') AS doi FROM extraction_records""")
def f14_doi_normalise(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.doi("doi").alias("doi"))


@query("""WITH t AS (SELECT article_number, source_id, title, listed_at, list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'and', 'by', 'for', 'in', 'of', 'on', 'the', 'to', 'under', 'with')) AS w FROM literature_manifest WHERE title IS NOT NULL),
u AS (SELECT article_number, source_id, title, listed_at, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM t)
SELECT article_number, source_id, title, listed_at, array_to_string(w[1:10], '_') AS slug FROM u""")
def f15_slug(spark, sf):
    return read(spark, sf, "literature_manifest").where("title is not null").select("article_number", "source_id", "title", "listed_at", C.slug("title").alias("slug"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(substr(t, 1, 297)) || '...' END AS snippet FROM t""")
def f16_snippet(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", C.snippet("text").alias("snippet"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(0), ' '), chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS cleaned FROM documents WHERE text IS NOT NULL""")
def f17_clean_text(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", C.clean_lines("text").alias("cleaned"))


@query("""SELECT row_id, round(greatest(least(CASE WHEN c BETWEEN 0 AND 1 THEN c * 10 ELSE c END, 10), 0), 6) AS score FROM (SELECT row_id, coalesce(CASE WHEN isfinite(confidence) THEN confidence END, 0) AS c FROM extraction_records)""")
def f18_score_rescale(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", F.round(C.score_of_ten("confidence"), 6).alias("score"))


@query("""SELECT row_id, CASE WHEN r <= -0.5 THEN 'R_le_-0.5' WHEN r <= -0.05 THEN 'R_-0.5_to_-0.05' WHEN r <= 0.05 THEN 'R_near_zero' WHEN r <= 0.3 THEN 'R_0.05_to_0.3' WHEN r <= 0.7 THEN 'R_0.3_to_0.7' WHEN r > 0.7 THEN 'R_gt_0.7' ELSE 'R_missing' END AS ratio_bin
FROM (SELECT row_id, CASE WHEN isfinite(r_ratio) THEN r_ratio END AS r FROM extraction_records)""")
def f19_ratio_bin(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.ratio_bin("r_ratio").alias("ratio_bin"))


@query("""SELECT row_id, CASE WHEN contains(c, 'strain') AND NOT regexp_matches(c, 'force|load|stress') THEN 'non_e466_control' WHEN NOT (regexp_matches(c, 'force|load|stress') OR c = '') THEN 'non_e466_control' WHEN f <= 200 THEN 'e466_conventional' WHEN f >= 1000 THEN 'ultrasonic_vhcf' ELSE 'ambiguous_frequency' END AS protocol
FROM (SELECT row_id, CASE WHEN isfinite(frequency_hz) THEN frequency_hz END AS f, coalesce(lower(trim(CASE WHEN row_id % 7 = 0 THEN 'strain' WHEN row_id % 3 = 0 THEN 'Load ' END)), '') AS c FROM extraction_records)""")
def f20_protocol(spark, sf):
    control = F.when(F.col("row_id") % 7 == 0, "strain").when(F.col("row_id") % 3 == 0, "Load ")
    return read(spark, sf, "extraction_records").select("row_id", C.protocol(F.col("frequency_hz"), control, F.lit(False)).alias("protocol"))


@query("""SELECT row_id, CASE WHEN a IS NULL OR m IS NULL OR r IS NULL OR m * (1 - r) / 2 = 0 THEN 'not_checkable' WHEN abs(a - m * (1 - r) / 2) / abs(m * (1 - r) / 2) > 0.10 THEN 'review_required' ELSE 'consistent' END AS stress_check
FROM (SELECT row_id, CASE WHEN isfinite(stress_amplitude_mpa) THEN stress_amplitude_mpa END AS a, CASE WHEN isfinite(max_stress_mpa) THEN max_stress_mpa END AS m, CASE WHEN isfinite(r_ratio) THEN r_ratio END AS r FROM extraction_records)""")
def f21_stress_consistency(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.stress_check(F.col("stress_amplitude_mpa"), F.col("max_stress_mpa"), F.col("r_ratio")).alias("stress_check"))


_ISSUES = ", ".join(f"CASE WHEN isfinite({c}) AND NOT ({c} BETWEEN {lo} AND {hi:.0f}) THEN '{c}' END" if c != "test_temperature_c" else f"CASE WHEN isfinite({c}) AND NOT ({c} BETWEEN -273.15 AND 3000) THEN '{c}' END" for c, (lo, hi) in C.NUMERIC_RANGES.items())


@query(f"SELECT row_id, concat_ws(';', {_ISSUES}) AS issues FROM extraction_records")
def f22_range_audit(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.range_issues().alias("issues"))


@query("""SELECT row_id, sha256(concat_ws(chr(31), coalesce(lower(trim(source_id)), ''), coalesce(lower(trim(record_id)), ''), coalesce(lower(trim(test_type)), ''))) AS print FROM extraction_records""")
def f23_fingerprint(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.fingerprint("source_id", "record_id", "test_type").alias("print"))


@query("""SELECT row_id, CASE WHEN n < 1e7 THEN 'below_range' WHEN n <= 2e7 THEN 'within_range' WHEN n > 2e7 THEN 'above_range' END AS life_class, coalesce(u >= 500 AND u <= 1000, false) AS in_gate, coalesce(u >= 500, false) AS over_gate
FROM (SELECT row_id, CASE WHEN isfinite(fatigue_life_cycles) THEN fatigue_life_cycles END AS n, CASE WHEN isfinite(uts_mpa) THEN uts_mpa END AS u FROM extraction_records)""")
def f24_gates(spark, sf):
    u = F.col("uts_mpa")
    return read(spark, sf, "extraction_records").select(
        "row_id", C.life_class("fatigue_life_cycles").alias("life_class"), C.within_gate(u, F.lit(500.0), F.lit(1000.0)).alias("in_gate"),
        C.within_gate(u, F.lit(500.0), F.lit(None).cast("double")).alias("over_gate"),
    )


@query("""SELECT row_id, array_to_string(list_sort(list_filter([CASE WHEN p IS NULL THEN 'missing_value:laser_power_w' END, CASE WHEN p < 100 THEN 'below_training_range:laser_power_w' END, CASE WHEN p > 400 THEN 'above_training_range:laser_power_w' END,
CASE WHEN l IS NULL THEN 'missing_value:layer_thickness_um' END, CASE WHEN l < 30 THEN 'below_training_range:layer_thickness_um' END, CASE WHEN l > 60 THEN 'above_training_range:layer_thickness_um' END], lambda x: x IS NOT NULL)), ';') AS warnings
FROM (SELECT row_id, CASE WHEN isfinite(laser_power_w) THEN laser_power_w END AS p, CASE WHEN isfinite(layer_thickness_um) THEN layer_thickness_um END AS l FROM extraction_records)""")
def f25_domain_warnings(spark, sf):
    lows, highs = {"laser_power_w": 100.0, "layer_thickness_um": 30.0}, {"laser_power_w": 400.0, "layer_thickness_um": 60.0}
    return read(spark, sf, "extraction_records").select("row_id", C.warnings(lows, highs).alias("warnings"))


@query("""SELECT row_id, round_even(t / 5, 0) * 5 AS temperature, round_even(r / 0.01, 0) * 0.01 AS ratio, coalesce(regexp_replace(regexp_replace(lower(nullif(regexp_replace(build_orientation, '^\\s+|\\s+$', '', 'g'), '')), '\\s*(°|deg(rees?)?)$', ''), '\\.0+$', ''), 'missing') AS orientation
FROM (SELECT row_id, build_orientation, CASE WHEN isfinite(test_temperature_c) THEN test_temperature_c END AS t, CASE WHEN isfinite(r_ratio) THEN r_ratio END AS r FROM extraction_records)""")
def f26_condition_values(spark, sf):
    return read(spark, sf, "extraction_records").select("row_id", C.condition_value("test_temperature_c", 5).alias("temperature"), C.condition_value("r_ratio", 0.01).alias("ratio"), C.orientation("build_orientation").alias("orientation"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE value BETWEEN 1 AND 3000""")
def f27_json_field(spark, sf):
    return read(spark, sf, "events").where(F.col("value").between(1, 3000)).select("event_id", F.get_json_object("props", "$.k").alias("k"))
