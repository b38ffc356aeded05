"""Queries of sources, matching, models, explanations and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions import cleaning as C
from evispark.operators import matching, models
from evispark.operators import selection as S
from evispark.operators import statistics as A
from evispark.plans.registry import query
from evispark.session import read, scratch_dir
from evispark.sources import tables
from evispark.streaming import ingest

@query("SELECT journal AS sheet, 2 AS row_no, 303 AS score FROM literature_manifest WHERE trim(journal) <> '' GROUP BY journal")
def s4_header_detect(spark, sf):
    """Sheets of cells, one for each journal: a line of remarks, the header, and its papers. The header is found."""
    papers = read(spark, sf, "literature_manifest").where("trim(journal) <> ''")
    text = lambda *cs: F.array(*(F.col(c).cast("string") for c in cs))
    order = Window.partitionBy("journal").orderBy("listed_at", "source_id", "article_number", "title")
    data = papers.select("journal", (F.row_number().over(order) + 2).alias("row_no"), text("source_id", "pub_year", "doi").alias("cells"))
    heads = papers.select("journal").distinct().select("journal", F.explode(F.array(
        F.struct(F.lit(1).alias("row_no"), F.array(F.concat(F.lit("Papers of "), "journal"), F.lit(None), F.lit("")).alias("cells")),
        F.struct(F.lit(2).alias("row_no"), F.array(F.lit("Source ID"), F.lit("Pub. year"), F.lit("DOI")).alias("cells")),
    )).alias("h")).select("journal", "h.*")
    aliases = spark.createDataFrame([("source id",), ("pub year",), ("doi",)], "alias string")
    return tables.header_rows(heads.unionAll(data).withColumnRenamed("journal", "sheet"), aliases)


@query("""SELECT row_id AS id, source_id, confidence, CAST(NULL AS VARCHAR) AS error FROM extraction_records WHERE record_id IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, 'malformed'""")
def s9_json_flatten(spark, sf):
    """A round trip: records to envelopes, with a broken one added, and back; only envelopes that a manifest lists are read."""
    rows = read(spark, sf, "extraction_records").where("record_id is not null").select("record_id", F.col("row_id").alias("id"), "source_id", "confidence")
    envelopes = tables.json_envelopes(rows, ["record_id"], ["id", "source_id", "confidence"])
    broken = spark.createDataFrame([("broken", '{"records": [{"id": '), ("unlisted", '{"records": [{"id": 1}]}')], "record_id string, envelope string")
    active = rows.select("record_id").distinct().unionAll(spark.createDataFrame([("broken",)], "record_id string"))
    record = T.StructType().add("id", T.LongType()).add("source_id", T.StringType()).add("confidence", T.DoubleType())
    listed = envelopes.unionAll(broken).join(active, "record_id", "left_semi")
    return tables.json_records(listed, "record_id", "envelope", record).select("id", "source_id", "confidence", "error")


@query()
def j12_fuzzy_match(spark, sf):
    """Each paper of the manifest with the most similar of all titles of the records."""
    papers = read(spark, sf, "literature_manifest").where("title is not null").select(F.lower(F.trim("source_id")).alias("paper"), "title").distinct()
    titles = read(spark, sf, "extraction_records").where("source_title is not null").select(F.lower(F.trim("source_id")).alias("source"), F.col("source_title").alias("title")).distinct()
    return matching.best_titles(papers, titles, "paper", "source")


@query("""WITH o AS (SELECT DISTINCT alloy_family, stress_amplitude_mpa AS x FROM extraction_records WHERE alloy_family IS NOT NULL AND isfinite(stress_amplitude_mpa)),
t AS (SELECT alloy_family, i, quantile_cont(x, 0.2) + (quantile_cont(x, 0.8) - quantile_cont(x, 0.2)) * i / 4 AS want FROM o CROSS JOIN (SELECT unnest(range(0, 5)) AS i) GROUP BY alloy_family, i)
SELECT alloy_family, i AS level, arg_min(x, (round(abs(x - want), 6), x)) AS stress FROM o JOIN t USING (alloy_family) GROUP BY alloy_family, i""")
def w12_stress_levels(spark, sf):
    """The observed stress nearest to each of five evenly spaced levels between the second and eighth tenth."""
    x = C.finite("stress_amplitude_mpa")
    seen = read(spark, sf, "extraction_records").where("alloy_family is not null").select("alloy_family", x.alias("x")).where("x is not null").distinct()
    ends = seen.groupBy("alloy_family").agg(F.percentile("x", F.array(F.lit(0.2), F.lit(0.8))).alias("q"))
    near = seen.join(ends, "alloy_family")
    picks = []
    for i in range(5):
        want = F.get("q", F.lit(0)) + (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) * i / 4
        picks.append(F.struct(F.lit(i).alias("level"), F.min_by("x", F.struct(F.round(F.abs(F.col("x") - want), 6), F.col("x"))).alias("stress")).alias(f"l{i}"))
    out = near.groupBy("alloy_family").agg(*picks)
    return out.select("alloy_family", F.inline(F.array(*(F.col(f"l{i}") for i in range(5)))))


@query("""WITH r AS (SELECT alloy_family, uts_mpa AS y FROM extraction_records WHERE isfinite(uts_mpa)), f AS (SELECT alloy_family, median(y) AS m FROM r WHERE alloy_family IS NOT NULL GROUP BY alloy_family), g AS (SELECT avg(y) AS a, median(y) AS m FROM r)
SELECT 'mean' AS candidate, round(avg(abs(y - a)), 4) AS mae FROM r CROSS JOIN g UNION ALL SELECT 'median', round(avg(abs(y - m)), 4) FROM r CROSS JOIN g UNION ALL SELECT 'family_median', round(avg(abs(y - coalesce(f.m, g.m))), 4) FROM r LEFT JOIN f USING (alloy_family) CROSS JOIN g""")
def m4_baselines(spark, sf):
    rows = read(spark, sf, "extraction_records").select("alloy_family", C.finite("uts_mpa").alias("y")).where("y is not null")
    overall = rows.agg(F.avg("y").alias("mean"), F.median("y").alias("median"))  # one row
    family = rows.where("alloy_family is not null").groupBy("alloy_family").agg(F.median("y").alias("own"))
    scored = rows.join(family, "alloy_family", "left").crossJoin(F.broadcast(overall))
    names = {"mean": F.col("mean"), "median": F.col("median"), "family_median": F.coalesce("own", "median")}
    wide = scored.agg(*(F.round(F.avg(F.abs(F.col("y") - c)), 4).alias(n) for n, c in names.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.col(n).alias("mae")) for n in names))).alias("x")).select("x.*")


_NUMBERS, _WORDS = ["hardness_hv", "laser_power_w", "layer_thickness_um"], ["alloy_family", "test_type"]


def _training(spark, sf):
    rows = read(spark, sf, "extraction_records").where("uts_mpa is not null and not isnan(uts_mpa) and source_id is not null")
    return rows.select("row_id", F.lower(F.trim("source_id")).alias("s"), "uts_mpa", *_NUMBERS, *_WORDS)


@query()
def m6_grouped_cv(spark, sf):
    """Five folds of groups, the candidates' out-of-fold metrics, the best marked."""
    oof = models.out_of_fold(_training(spark, sf), "s", _NUMBERS, _WORDS, "uts_mpa")
    return models.best_candidate(oof, "uts_mpa")


@query()
def m5_weighted_refit(spark, sf):
    """A linear model refitted on all rows, every source weighing the same; its error by alloy family."""
    rows = models.clean_features(S.equal_weights(_training(spark, sf), "s"), _NUMBERS, _WORDS)
    model = models.pipeline(_NUMBERS, _WORDS, "linear_l2", "uts_mpa", weight="weight").fit(rows)
    return A.regression_metrics(model.transform(rows), ["alloy_family"], "uts_mpa", "prediction")


@query()
def m14_permutation(spark, sf):
    rows = models.clean_features(_training(spark, sf), _NUMBERS, _WORDS)
    model = models.pipeline(_NUMBERS, _WORDS, "random_forest", "uts_mpa").fit(rows)
    return models.permutation_importance(model, rows, [*_NUMBERS, "alloy_family"], "uts_mpa", "row_id")


@query()
def m15_shapley(spark, sf):
    """Shapley values of the forty rows chosen by hash that are explained, against medians and modes of all rows."""
    features = [*_NUMBERS, "alloy_family"]
    rows = models.clean_features(_training(spark, sf), _NUMBERS, _WORDS)
    model = models.pipeline(_NUMBERS, _WORDS, "linear_l2", "uts_mpa").fit(rows)
    return models.shapley(model, S.hash_sample(rows, "row_id", 40), models.background(rows, features), features, "row_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2")
def x1_stream_daily_counts(spark, sf):
    """The events as a stream, counted by tumbling days; equal to the batch result."""
    import uuid

    schema = read(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"daily_{uuid.uuid4().hex}"
    return ingest.run_to_memory(ingest.daily_counts(rows, "ts", "event_type"), name, f"{scratch_dir(spark)}/{name}")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def x2_stream_once_each(spark, sf):
    """The events as a stream in which every row comes twice, written once each to files."""
    import uuid

    schema = read(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{scratch_dir(spark)}/once_{uuid.uuid4().hex}"
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return ingest.run_to_files(ingest.once_each(twice, "event_id", "ts"), path, f"{path}-checkpoint").select("event_id", "user_id", "event_type")
