"""The pN_ queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm.canonical import canonicalise
from evispark.llm.capping import cap_contributors
from evispark.llm.overlaps import split_overlaps
from evispark.llm.packing import conflicts, pack_documents, unused_space
from evispark.llm.publications import publication_splits, publications, same_publication_pairs
from evispark.llm.results import result_groups, with_publication
from evispark.llm.spam import page_scores
from evispark.llm.survivors import COMPLETENESS, skyline_survivors
from evispark.llm.text import source_key
from evispark.llm.tokens import encoded, spread
from evispark.session import Scratch, read


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "extraction_records")


def _publications(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    return publications(_records(spark, sf), read(spark, sf, "canonical_terms"), scratch)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_publication_pairs(_publications(spark, sf, Scratch(spark)))


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every source_id with its publication and the number of source_ids that this has; no pairs."""
    pubs = _publications(spark, sf, Scratch(spark))
    pubs = Scratch(spark).keep(pubs)
    sizes = pubs.groupBy("pub").agg(F.count("*").alias("n_sources"))
    return pubs.join(sizes, "pub").select(F.col("s").alias("source_id"), F.col("pub").alias("publication"), "n_sources", F.col("many").alias("is_collection"))


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Each record with its split of split_plan."""
    scratch = Scratch(spark)
    pubs = scratch.keep(_publications(spark, sf, scratch))
    return publication_splits(_records(spark, sf), pubs, read(spark, sf, "split_plan"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    done = cap_contributors(_records(spark, sf), source_key("source_id"), cap=25)
    return done.where("not kept").select("row_id")


def _period() -> F.Column:
    """Five years of source_year; null where it is missing."""
    return F.when(~F.isnan("source_year"), (F.floor(F.col("source_year") / 5) * 5).cast("int"))


def p2_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """The records kept when each source's cap is shared by the five-year periods of its alloy families."""
    stratum = F.struct(F.lower(F.trim("alloy_family")).alias("family"), _period().alias("period")).cast("string")
    done = cap_contributors(_records(spark, sf), source_key("source_id"), cap=25, stratum=stratum)
    return done.where("kept").select("row_id", F.col("contributor").alias("source_id"), "stratum")


def p2_even_by_test(spark: SparkSession, sf: str) -> DataFrame:
    """The records kept when each source's cap is shared evenly by its test types, spare slots passed on."""
    done = cap_contributors(_records(spark, sf), source_key("source_id"), cap=25, stratum=F.lower(F.trim("test_type")), weights="equal")
    return done.where("kept").select("row_id", F.col("contributor").alias("source_id"), "stratum")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    done = canonicalise(_records(spark, sf), read(spark, sf, "canonical_terms"), Scratch(spark))
    return done.where("how <> 'label'").select("row_id", "field_name", "term_id")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Filled values by field and how they were mapped, with the misses."""
    done = canonicalise(_records(spark, sf), read(spark, sf, "canonical_terms"), Scratch(spark))
    return done.groupBy("field_name", "how").agg(F.count("*").alias("n_rows"), F.countDistinct("value").alias("n_values"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Publications come from the records and the view rows together: either may name a DOI the other lacks."""
    scratch = Scratch(spark)
    records, views = _records(spark, sf), read(spark, sf, "view_rows")
    named = ["source_id", "record_id", "doi", "source_title", "alloy", "am_process"]
    both = records.select(*named).unionByName(views.select(*(c for c in named if c != "source_title")), allowMissingColumns=True)
    pubs = scratch.keep(publications(both, read(spark, sf, "canonical_terms"), scratch))
    return split_overlaps(with_publication(views, pubs), scratch)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _overlaps(spark, sf)
    return pairs.select(
        F.least("train_id", "held_id").alias("view_row_id_a"), F.greatest("train_id", "held_id").alias("view_row_id_b")
    )


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping validation and test rows by split and source."""
    return _overlaps(spark, sf).groupBy("held_split", source_key("source_id").alias("source_id")).agg(
        F.count("*").alias("n_pairs"), F.countDistinct("held_id").alias("n_rows"), F.sum(F.col("same_fingerprint").cast("int")).alias("n_same_fingerprint")
    )


def _groups(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    records = _records(spark, sf)
    pubs = scratch.keep(_publications(spark, sf, scratch))
    return scratch.keep(result_groups(with_publication(records, pubs), scratch))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark)
    groups = _groups(spark, sf, scratch)
    best = skyline_survivors(_records(spark, sf), groups, scratch)
    return groups.join(best.select("g", "survivor"), "g").select("row_id", F.col("survivor").alias("survivor_row_id"))


def p5_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each group, its missing fields filled from the next dominance layers."""
    scratch = Scratch(spark)
    return skyline_survivors(_records(spark, sf), _groups(spark, sf, scratch), scratch).drop("g")


_FILLED = ("doi", "alloy", "uts_mpa", "laser_power_w", "hardness_hv")


def p5_by_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """The survivors of records with one fingerprint, five of their fields filled by layers."""
    records = _records(spark, sf)
    sizes = records.where("record_fingerprint is not null").groupBy(F.col("record_fingerprint").alias("g")).agg(F.count("*").alias("n")).where("n >= 2")
    groups = records.select("row_id", F.col("record_fingerprint").alias("g")).join(sizes, "g")
    return skyline_survivors(records, groups, Scratch(spark), fields=_FILLED)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", encoded(F.col("text")).alias("ids"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(read(spark, sf, "documents"), read(spark, sf, "container_specs"), Scratch(spark))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's container, or containers of its pieces, for each capacity."""
    return _packed(spark, sf)


def p9_unused(spark: SparkSession, sf: str) -> DataFrame:
    return unused_space(_packed(spark, sf))


def p9_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a container with another of the same text or source, by capacity."""
    return conflicts(_packed(spark, sf), read(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return page_scores(read(spark, sf, "documents"), Scratch(spark)).where("found").select("doc_id")


def p10_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pages found and their words by source."""
    documents = read(spark, sf, "documents")
    scores = page_scores(documents, Scratch(spark))
    return documents.select("doc_id", "source").join(scores, "doc_id").groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("found").cast("int")).alias("n_found"), F.sum(F.when(F.col("found"), F.col("n_words"))).alias("n_words_found")
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_members, p1_splits, p2_found, p2_by_period, p2_even_by_test, p3_found, p3_report, p4_found, p4_report, p5_found,
        p5_survivors, p5_by_fingerprint, p8_ids, p9_containers, p9_unused, p9_conflicts,
        p10_found, p10_report,
    )
}

_TRUST = "CASE WHEN confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) THEN confidence ELSE -1 END"
_SOURCE = "nullif(lower(regexp_replace(source_id, '^\\s+|\\s+$', '', 'g')), '')"
_STRATA = f"""WITH r AS (SELECT row_id, {_SOURCE} AS source_id, {{stratum}} AS stratum, {_TRUST} AS q, extracted_at AS t FROM extraction_records),
n AS (SELECT source_id, stratum, count(*) AS n, sum(count(*)) OVER (PARTITION BY source_id) AS total, count(*) OVER (PARTITION BY source_id) AS m FROM r WHERE source_id IS NOT NULL GROUP BY source_id, stratum),
k AS (SELECT r.*, row_number() OVER (PARTITION BY source_id, stratum ORDER BY q DESC, t DESC NULLS LAST, row_id) AS k FROM r)"""
_TEXTS = ("doi", "post_processing", "alloy")


def _full(c: str) -> str:
    return f"CASE WHEN regexp_replace({c}, '\\s+', '', 'g') <> '' THEN {c} END" if c in _TEXTS else f"CASE WHEN NOT isnan({c}) THEN {c} END"


_COMPLETE = " + ".join(f"(({_full(c)}) IS NOT NULL)::INT" for c in COMPLETENESS)
SQL: dict[str, str] = {
    "p2_found": f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {_SOURCE} ORDER BY {_TRUST} DESC, extracted_at DESC NULLS LAST, row_id) AS k
        FROM extraction_records WHERE {_SOURCE} IS NOT NULL) WHERE k > 25""",
    "p2_by_period": _STRATA.format(stratum="concat('{', coalesce(lower(trim(alloy_family)), 'null'), ', ', coalesce(CAST(CAST(floor(CASE WHEN NOT isnan(source_year) THEN source_year END / 5) * 5 AS INT) AS VARCHAR), 'null'), '}')")
    + """, s AS (SELECT *, 25 * n // total AS base, 25 * n % total AS rest FROM n),
    a AS (SELECT source_id, stratum, CASE WHEN total <= 25 THEN n ELSE base + CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY rest DESC, n DESC, stratum) <= 25 - sum(base) OVER (PARTITION BY source_id) THEN 1 ELSE 0 END END AS quota FROM s)
    SELECT k.row_id, k.source_id, k.stratum FROM k LEFT JOIN a ON a.source_id = k.source_id AND a.stratum IS NOT DISTINCT FROM k.stratum WHERE k.source_id IS NULL OR k.k <= a.quota""",
    "p2_even_by_test": _STRATA.format(stratum="lower(trim(test_type))")
    + """, v AS (SELECT source_id, max(i) AS level FROM (SELECT source_id, i FROM n CROSS JOIN range(0, 26) AS t(i) WHERE total > 25 GROUP BY source_id, i HAVING sum(least(n, i)) <= 25) GROUP BY source_id),
    w AS (SELECT n.source_id, stratum, least(n, level) AS base, n > level AS more, 25 - sum(least(n, level)) OVER (PARTITION BY n.source_id) AS rest, row_number() OVER (PARTITION BY n.source_id, n > level ORDER BY n DESC, stratum NULLS LAST) AS place FROM n JOIN v USING (source_id)),
    a AS (SELECT source_id, stratum, base + CASE WHEN more AND place <= rest THEN 1 ELSE 0 END AS quota FROM w)
    SELECT k.row_id, k.source_id, k.stratum FROM k LEFT JOIN a ON a.source_id = k.source_id AND a.stratum IS NOT DISTINCT FROM k.stratum WHERE a.quota IS NULL OR k.k <= a.quota""",
    "p5_by_fingerprint": f"""WITH RECURSIVE f AS (SELECT record_fingerprint AS g FROM extraction_records WHERE record_fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
    r AS (SELECT g, row_id AS k, {_COMPLETE} AS c, {_TRUST} AS q, coalesce(epoch_us(extracted_at), -9223372036854775807) AS t, {", ".join(f"{_full(c)} AS {c}" for c in _FILLED)} FROM extraction_records JOIN f ON record_fingerprint = g),
    p AS (SELECT DISTINCT g, c, q, t FROM r), d AS (SELECT a.g, a.c AS c1, a.q AS q1, a.t AS t1, b.c, b.q, b.t FROM p a JOIN p b ON a.g = b.g AND a.c >= b.c AND a.q >= b.q AND a.t >= b.t AND (a.c > b.c OR a.q > b.q OR a.t > b.t)),
    u AS (SELECT g, c, q, t, 1 AS layer FROM p UNION SELECT d.g, d.c, d.q, d.t, u.layer + 1 FROM u JOIN d ON d.g = u.g AND d.c1 = u.c AND d.q1 = u.q AND d.t1 = u.t),
    l AS (SELECT g, c, q, t, max(layer) AS layer FROM u GROUP BY ALL), z AS (SELECT r.*, layer, row_number() OVER (PARTITION BY g ORDER BY layer, c DESC, q DESC, t DESC, k) AS place FROM r JOIN l USING (g, c, q, t))
    SELECT g, arg_min(k, place) AS survivor, count(*) AS n_records, max(layer)::INT AS n_layers, {", ".join(f"arg_min({c}, place) FILTER ({c} IS NOT NULL) AS {c}" for c in _FILLED)} FROM z GROUP BY g""",
}
