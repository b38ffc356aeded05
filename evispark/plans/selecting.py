"""Queries of joins, unions and of rows chosen within groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import cleaning as C
from evispark.operators import joins as J
from evispark.operators import selection as S
from evispark.plans.registry import query
from evispark.session import Scratch, read


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, coalesce(nullif(l_returnflag, 'N'), o_orderstatus) AS status, o_orderpriority
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 3) o ON l_orderkey = o_orderkey""")
def j1_parent_child(spark, sf):
    child = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.nullif("l_returnflag", F.lit("N")).alias("status"))
    parent = read(spark, sf, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return J.parent_child(child, parent, "l_orderkey", ["status"])


@query("""SELECT row_id, source_id, record_id FROM extraction_records e WHERE EXISTS (SELECT 1 FROM audit_decisions a WHERE a.source_id = e.source_id AND a.record_id = e.record_id AND a.record_fingerprint = e.record_fingerprint AND lower(trim(a.audit_status)) = 'approved')""")
def j2_approved_merge(spark, sf):
    return J.approved_only(read(spark, sf, "extraction_records"), read(spark, sf, "audit_decisions"), ["source_id", "record_id", "record_fingerprint"], "audit_status").select("row_id", "source_id", "record_id")


@query("""SELECT row_id FROM extraction_records WHERE extraction_method IS NULL OR NOT contains(lower(extraction_method), 'llm')""")
def j3_anti_previous(spark, sf):
    return read(spark, sf, "extraction_records").where(~F.coalesce(F.contains(F.lower("extraction_method"), F.lit("llm")), F.lit(False))).select("row_id")


@query("""WITH a AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source), b AS (SELECT journal, count(*) AS n_papers FROM literature_manifest GROUP BY journal)
SELECT coalesce(source, journal) AS name, n_docs, n_papers, CASE WHEN source IS NULL THEN 'papers only' WHEN journal IS NULL THEN 'documents only' ELSE 'both' END AS support FROM a FULL JOIN b ON source = journal""")
def j4_full_compare(spark, sf):
    a = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"))
    b = read(spark, sf, "literature_manifest").groupBy("journal").agg(F.count("*").alias("n_papers"))
    full = a.join(b, F.col("source") == F.col("journal"), "full")
    return full.select(F.coalesce("source", "journal").alias("name"), "n_docs", "n_papers", F.when(F.col("source").isNull(), "papers only").when(F.col("journal").isNull(), "documents only").otherwise("both").alias("support"))


@query("""WITH k AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id), l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT coalesce(k.user_id, l.user_id) AS user_id, k.t AS before, l.t AS after, CASE WHEN k.user_id IS NULL THEN 'added' WHEN l.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM k FULL JOIN l ON k.user_id = l.user_id WHERE k.t IS DISTINCT FROM l.t OR k.user_id IS NULL OR l.user_id IS NULL""")
def j6_change_log(spark, sf):
    events, middle = read(spark, sf, "events"), F.lit("2024-01-16").cast("timestamp")
    last = lambda df: df.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    return J.change_log(last(events.where(F.col("ts") < middle)), last(events.where(F.col("ts") >= middle)), "user_id", "t")


@query("""SELECT source_file, count(*) AS n_rows FROM extraction_records WHERE lower(trim(source_id)) IN (SELECT lower(trim(source_id)) FROM literature_manifest WHERE ready_for_parsing) GROUP BY source_file""")
def j8_manifest_semi(spark, sf):
    ready = read(spark, sf, "literature_manifest").where("ready_for_parsing")
    return J.semi_by(read(spark, sf, "extraction_records"), ready, F.lower(F.trim("source_id")), F.lower(F.trim("source_id"))).groupBy("source_file").agg(F.count("*").alias("n_rows"))


@query("""SELECT row_id FROM extraction_records e WHERE NOT EXISTS (SELECT 1 FROM literature_manifest m WHERE lower(trim(m.source_id)) = lower(trim(e.source_id)) AND ready_for_parsing)""")
def j8_manifest_anti(spark, sf):
    ready = read(spark, sf, "literature_manifest").where("ready_for_parsing")
    return J.semi_by(read(spark, sf, "extraction_records"), ready, F.lower(F.trim("source_id")), F.lower(F.trim("source_id")), keep=False).select("row_id")


@query("""WITH u AS (SELECT row_id, alloy_family, am_process, uts_mpa AS u FROM extraction_records), a AS (SELECT alloy_family, am_process, round(median(u), 4) AS m FROM u WHERE u IS NOT NULL AND alloy_family IS NOT NULL AND am_process IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), b AS (SELECT alloy_family, round(median(u), 4) AS m FROM u WHERE u IS NOT NULL AND alloy_family IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), c AS (SELECT round(median(u), 4) AS m FROM u)
SELECT row_id, coalesce(a.m, b.m, c.m) AS typical, CASE WHEN a.m IS NOT NULL THEN 'exact' WHEN b.m IS NOT NULL THEN 'family' ELSE 'global' END AS level FROM u LEFT JOIN a USING (alloy_family, am_process) LEFT JOIN b ON b.alloy_family = u.alloy_family CROSS JOIN c""")
def j9_lookup_by_level(spark, sf):
    rows = read(spark, sf, "extraction_records").select("row_id", "alloy_family", "am_process", C.finite("uts_mpa").alias("u"))
    mid = F.round(F.median("u"), 4).alias("typical")

    def table(*keys: str):
        known = rows.where("u is not null").dropna(subset=list(keys)) if keys else rows.where("u is not null")
        return known.groupBy(*keys).agg(mid, F.count("*").alias("n")).where(f"n >= {5 if keys else 0}").drop("n")

    levels = [("exact", table("alloy_family", "am_process"), ["alloy_family", "am_process"]), ("family", table("alloy_family"), ["alloy_family"]), ("global", table(), [])]
    return J.by_level(rows, levels, "typical").select("row_id", "typical", "level")


@query("""WITH d AS (SELECT e.row_id, a.decision_id, a.review_priority, a.review_blocking FROM extraction_records e LEFT JOIN audit_decisions a ON a.source_id = e.source_id AND a.record_id = e.record_id)
SELECT row_id, count(decision_id) AS n_decisions, min(review_priority) AS least_priority, coalesce(bool_or(review_blocking), false) AS blocking FROM d GROUP BY row_id""")
def j11_trace_attach(spark, sf):
    decisions = read(spark, sf, "audit_decisions").groupBy("source_id", "record_id").agg(F.count("decision_id").alias("n"), F.min("review_priority").alias("least_priority"), F.bool_or("review_blocking").alias("b"))
    rows = read(spark, sf, "extraction_records").select("row_id", "source_id", "record_id").join(decisions, ["source_id", "record_id"], "left")
    return rows.select("row_id", F.coalesce("n", F.lit(0)).alias("n_decisions"), "least_priority", F.coalesce("b", F.lit(False)).alias("blocking"))


_TARGETS = [{"stress_amplitude_mpa": 300.0, "r_ratio": 0.1, "frequency_hz": 30.0}, {"stress_amplitude_mpa": 450.0, "r_ratio": -1.0, "frequency_hz": 50.0}]


@query("""WITH t(target, s, r, f) AS (VALUES (0, 300.0::DOUBLE, 0.1::DOUBLE, 30.0::DOUBLE), (1, 450.0, -1.0, 50.0)),
d AS (SELECT target, row_id, round(coalesce(pow((stress_amplitude_mpa - s) / 30.0, 2), 1) + coalesce(pow((r_ratio - r) / 0.5, 2), 1) + coalesce(pow((frequency_hz - f) / 50.0, 2), 1), 9) AS d FROM extraction_records CROSS JOIN t)
SELECT target, arg_min(row_id, (d, row_id)) AS row_id, round(sqrt(min(d)), 6) AS distance FROM d GROUP BY target""")
def j13_nearest_condition(spark, sf):
    out = J.nearest(read(spark, sf, "extraction_records"), _TARGETS, {"stress_amplitude_mpa": 30.0, "r_ratio": 0.5, "frequency_hz": 50.0}, "row_id")
    return out.withColumn("distance", F.round("distance", 6))


@query("""SELECT source_id, record_id, uts_mpa FROM (SELECT source_id, record_id, uts_mpa, record_id IN (SELECT record_id FROM extraction_records WHERE confidence >= 0.95 AND record_id IS NOT NULL AND NOT isnan(confidence)) AS replaced FROM view_rows) WHERE NOT coalesce(replaced, false)
UNION ALL SELECT source_id, record_id, uts_mpa FROM extraction_records WHERE confidence >= 0.95 AND NOT isnan(confidence)""")
def j14_replace_rows(spark, sf):
    new = read(spark, sf, "extraction_records").where("confidence >= 0.95 and not isnan(confidence)").select("source_id", "record_id", "uts_mpa")
    return J.replace_rows(read(spark, sf, "view_rows").select("source_id", "record_id", "uts_mpa"), new, ["record_id"])


@query("""SELECT row_id AS id, source_id, doi, NULL AS split_name FROM extraction_records UNION ALL SELECT view_row_id, source_id, doi, split_name FROM view_rows""")
def u1_union_missing(spark, sf):
    a = read(spark, sf, "extraction_records").select(F.col("row_id").alias("id"), "source_id", "doi")
    return a.unionByName(read(spark, sf, "view_rows").select(F.col("view_row_id").alias("id"), "source_id", "doi", "split_name"), allowMissingColumns=True)


@query("SELECT DISTINCT alloy_family, test_type, extraction_method FROM extraction_records")
def u2_distinct(spark, sf):
    return read(spark, sf, "extraction_records").select("alloy_family", "test_type", "extraction_method").distinct()


@query("""SELECT count(*) AS n_shared FROM (SELECT lower(trim(source_id)) AS s FROM view_rows WHERE split_name = 'train' INTERSECT SELECT lower(trim(source_id)) FROM view_rows WHERE split_name <> 'train')""")
def u3_shared_groups(spark, sf):
    rows = read(spark, sf, "view_rows").select(F.lower(F.trim("source_id")).alias("s"), "split_name")
    return rows.where("split_name = 'train'").select("s").intersect(rows.where("split_name <> 'train'").select("s")).agg(F.count("*").alias("n_shared"))


@query("SELECT record_id FROM extraction_records EXCEPT SELECT record_id FROM view_rows")
def u4_difference(spark, sf):
    return read(spark, sf, "extraction_records").select("record_id").subtract(read(spark, sf, "view_rows").select("record_id"))


_SCORE = "(doi IS NOT NULL)::INT + (alloy IS NOT NULL)::INT + (uts_mpa IS NOT NULL)::INT + (hardness_hv IS NOT NULL)::INT"


@query(f"""SELECT row_id, record_id FROM (SELECT row_id, record_id, row_number() OVER (PARTITION BY record_id ORDER BY {_SCORE} DESC, row_id) AS k FROM extraction_records) WHERE k = 1""")
def w1_best_row_per_key(spark, sf):
    rows = read(spark, sf, "extraction_records").select("row_id", "record_id", C.information_score("doi", "alloy", "uts_mpa", "hardness_hv").alias("score"))
    return S.best_per_key(rows, ["record_id"], F.desc("score"), F.col("row_id")).select("row_id", "record_id")


@query("""SELECT decision_id, source_id, record_id, audit_status FROM (SELECT *, row_number() OVER (PARTITION BY source_id, record_id ORDER BY reviewed_at DESC NULLS LAST, decision_id DESC) AS k FROM audit_decisions) WHERE k = 1""")
def w2_keep_last(spark, sf):
    return S.keep_last(read(spark, sf, "audit_decisions"), ["source_id", "record_id"], "reviewed_at", "decision_id").select("decision_id", "source_id", "record_id", "audit_status")


@query("""WITH r AS (SELECT row_id, lower(trim(source_id)) AS s, row_number() OVER (PARTITION BY lower(trim(source_id)) ORDER BY stress_amplitude_mpa, row_id) - 1 AS i, count(*) OVER (PARTITION BY lower(trim(source_id))) AS n FROM extraction_records WHERE stress_amplitude_mpa IS NOT NULL)
SELECT row_id, s FROM r WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda j: round_even(j * (n - 1) / 9.0::DOUBLE, 0)::INT), i::INT)""")
def w3_even_sample(spark, sf):
    rows = read(spark, sf, "extraction_records").where("stress_amplitude_mpa is not null").select("row_id", F.lower(F.trim("source_id")).alias("s"), "stress_amplitude_mpa")
    return S.even_sample(rows, ["s"], 10, ["stress_amplitude_mpa", "row_id"], Scratch(spark)).select("row_id", "s")


@query("""SELECT row_id, 'record_' || lpad(CAST(row_number() OVER (PARTITION BY lower(trim(source_id)) ORDER BY row_id) AS VARCHAR), 6, '0') AS sequence_id FROM extraction_records""")
def w4_sequential_ids(spark, sf):
    rows = read(spark, sf, "extraction_records").select("row_id", F.lower(F.trim("source_id")).alias("s"))
    return S.numbered(rows, "record", ["s"], ["row_id"], Scratch(spark)).select("row_id", "sequence_id")


@query("""WITH n AS (SELECT lower(trim(source_id)) AS s, count(*) AS n FROM extraction_records GROUP BY 1) SELECT row_id, round((SELECT sum(n) FROM n) / (n.n * (SELECT count(*) FROM n)), 6) AS weight FROM extraction_records JOIN n ON n.s IS NOT DISTINCT FROM lower(trim(source_id))""")
def w5_equal_weights(spark, sf):
    rows = read(spark, sf, "extraction_records").select("row_id", F.lower(F.trim("source_id")).alias("s"))
    return S.equal_weights(rows, "s").select("row_id", F.round("weight", 6).alias("weight"))


@query("""SELECT row_id, source_id, confidence FROM (SELECT row_id, lower(trim(source_id)) AS source_id, confidence, row_number() OVER (PARTITION BY lower(trim(source_id)) ORDER BY confidence DESC, row_id) AS k FROM extraction_records WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence)) WHERE k <= 3""")
def w7_top_per_source(spark, sf):
    rows = read(spark, sf, "extraction_records").where("confidence between 0 and 1 and not isnan(confidence)").select("row_id", F.lower(F.trim("source_id")).alias("source_id"), "confidence")
    return S.top_per_key(rows, ["source_id"], 3, F.desc("confidence"), F.col("row_id")).drop("rank")


@query("""WITH r AS (SELECT article_number, source_id, listed_at, journal, file_size_bytes AS size, row_number() OVER (PARTITION BY journal ORDER BY file_size_bytes DESC NULLS LAST, source_id, listed_at, article_number) AS k FROM literature_manifest WHERE journal IS NOT NULL)
SELECT article_number, source_id, listed_at, journal, k <= 2 AS seeded FROM r ORDER BY k <= 2 DESC, size DESC NULLS LAST, source_id, listed_at, article_number LIMIT 40""")
def w8_balanced_select(spark, sf):
    named = F.sha2(F.to_json(F.struct("article_number", "source_id", "listed_at", "file_size_bytes")), 256)
    rows = read(spark, sf, "literature_manifest").where("journal is not null").withColumn("_id", named)
    order = (F.desc_nulls_last("file_size_bytes"), F.col("source_id"), F.col("listed_at"), F.col("article_number"))
    return S.balanced(rows, "journal", 2, 40, ["_id"], *order).select("article_number", "source_id", "listed_at", "journal", "seeded")


@query("""SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS canonical_id, count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM documents WHERE text IS NOT NULL""")
def w9_duplicate_texts(spark, sf):
    hashed = read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n_copies"))
    return hashed.join(first, "h").drop("h")


@query("""SELECT row_id, coalesce(nullif(trim(doi), ''), nullif(trim(source_id), ''), 'row_' || CAST(row_id AS VARCHAR)) AS group_key FROM extraction_records""")
def w11_group_keys(spark, sf):
    row = F.concat(F.lit("row_"), F.col("row_id").cast("string"))
    return read(spark, sf, "extraction_records").select("row_id", S.group_key(F.col("doi"), F.col("source_id"), fallback=row).alias("group_key"))


@query("""SELECT row_id, uts_mpa FROM extraction_records WHERE uts_mpa IS NOT NULL AND NOT isnan(uts_mpa) ORDER BY uts_mpa DESC, row_id LIMIT 20""")
def t2_top_k(spark, sf):
    return read(spark, sf, "extraction_records").where("uts_mpa is not null and not isnan(uts_mpa)").orderBy(F.desc("uts_mpa"), "row_id").limit(20).select("row_id", "uts_mpa")


@query("SELECT row_id FROM extraction_records ORDER BY md5(concat_ws(':', CAST(row_id AS VARCHAR), '42')), row_id LIMIT 100")
def t5_seeded_sample(spark, sf):
    return S.hash_sample(read(spark, sf, "extraction_records").select("row_id"), "row_id", 100)


_RANKED = "WITH g AS (SELECT DISTINCT lower(trim(source_id)) AS s FROM extraction_records WHERE source_id IS NOT NULL), r AS (SELECT s, row_number() OVER (ORDER BY md5(concat_ws(':', s, '42')), s) AS k, count(*) OVER () AS n FROM g)"


@query(f"{_RANKED} SELECT s, k <= ceil(n * 0.15) AS is_test FROM r")
def m1_group_holdout(spark, sf):
    return S.holdout(read(spark, sf, "extraction_records").select(F.lower(F.trim("source_id")).alias("s")), "s")


@query(f"{_RANKED} SELECT s, CAST((k - 1) % 5 AS INT) AS fold FROM r")
def m2_group_folds(spark, sf):
    return S.folds(read(spark, sf, "extraction_records").select(F.lower(F.trim("source_id")).alias("s")), "s")
