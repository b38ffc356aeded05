"""Problem 1: source_ids that denote one publication, and splits that keep publications together.

Entities are a normalised DOI, a title key and a record_id. Sources sharing an entity are linked, and the components of
these links, by alternating large-star and small-star rounds, are the publications.

A title key is the title's main part (before the colon) without markup, labels, case, marks and separators, after
 * misspelt words were set right by the words of all titles (symmetric deletes, then distance and frequency),
 * names of the alloy and process lists were replaced by their entry,
 * a subtitle whose colon was lost was cut where another title has the same main part.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.canonical import MOST_FORMS, reference_forms
from evispark.llm.components import connected_components
from evispark.llm.text import delete_keys, doi_key, plain, source_key, typo_distance, words
from evispark.session import Scratch

#: Titles that name no publication, as compact text.
PLACEHOLDERS = ("researchpaper", "fulllengtharticle", "titlepage", "untitled", "na", "appendixa", "dataset", "supplementarymaterial", "articleinpress", "manuscriptfinalv3docx", "notitle", "unknown", "title", "none")
LEAST_WORDS = 4
#: A source none of whose DOIs has this share of its rows with a DOI is a collection of publications and stands for itself;
#: a title key none of whose DOIs has this share of its sources' rows with a DOI is a placeholder that the list doesn't hold.
MAIN_DOI = 0.5

_LABEL = re.compile(r"^\s*(?:\((?:pdf|html)\)|\[[^\]]{1,24}\]|(?:accepted|submitted|author) (?:manuscript|version)\s*[-:–—]|(?:title|titel|titre|titulo)\s*:|(?:preprint|pdf)\s*[-:])\s*")
_TAIL = re.compile(r"\s*(?:\((?:accepted|submitted|published|author)[^)]*\)|\|[^|]*|[®©™*†‡.…]+)\s*$")
_COLON = re.compile(r":|\s[–—]\s")
_TITLE = (
    T.StructType()
    .add("main", T.ArrayType(T.StringType()))
    .add("sub", T.ArrayType(T.StringType()))
    .add("colon", T.BooleanType())
)


def _title_parts(text: str) -> dict | None:
    t = plain(text)
    for pattern in (_LABEL, _TAIL):
        while (cut := pattern.sub("", t)) != t:
            t = cut
    if "".join(words(t.replace("_", " "))) in PLACEHOLDERS:
        return None
    t = t.replace("_", " ")
    main, *rest = _COLON.split(t, maxsplit=1)
    if rest and ":" not in t and len(words(main)) < LEAST_WORDS:  # a hyphen with blanks, not a colon
        main, rest = t, []
    return {"main": words(main), "sub": words(rest[0]) if rest else [], "colon": bool(rest)}


@F.pandas_udf(_TITLE)
def title_parts(s: pd.Series) -> pd.DataFrame:
    parts = [_title_parts(x) or {"main": [], "sub": [], "colon": False} for x in s]
    return pd.DataFrame(parts, columns=["main", "sub", "colon"])


def _corrections(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, right): words of few sources that are one or two letters from a word of many."""
    seen = scratch.keep(
        tokens.groupBy("token")
        .agg(F.approx_count_distinct("s", 0.02).alias("n"))
        .where(F.length("token") >= 3)
        .where(~F.col("token").rlike("[0-9]"))
    )
    keyed = seen.withColumn("d", F.explode(delete_keys("token")))
    right = keyed.where("n >= 8").select("d", F.col("token").alias("right"), F.col("n").alias("many"))
    pairs = keyed.join(right, "d").where("many >= 8 * n").select("token", "n", "right", "many").distinct()
    best = Window.partitionBy("token").orderBy("dist", F.desc("many"), "right")
    found = scratch.keep(
        pairs.withColumn("dist", typo_distance("token", "right"))
        .where("dist <= 1 or (dist is not null and many >= 60 * n)")
        .withColumn("k", F.row_number().over(best))
        .where("k = 1")
        .select("token", "right")
    )
    # A frequent misspelling may be nearest to a rarer one: what it is set right to counts.
    further = found.select(F.col("token").alias("right"), F.col("right").alias("further"))
    return found.join(further, "right", "left").select("token", F.coalesce("further", "right").alias("right"))


def _aliased(dictionary: dict[str, int]):
    longest = max(map(len, dictionary), default=0)
    starts = {k[:2] for k in dictionary}

    def one(tokens: list[str], own: dict[str, int]) -> list[str]:
        """own: forms in this title that the dictionary doesn't hold."""
        out, i = [], 0
        most, begins = max(longest, max(map(len, own), default=0)), starts | {k[:2] for k in own}
        while i < len(tokens):
            if tokens[i][:2] in begins or len(tokens[i]) == 1:
                n, letters = 0, 0
                while i + n < len(tokens) and letters + len(tokens[i + n]) <= most:
                    letters += len(tokens[i + n])
                    n += 1
                for n in range(n, 0, -1):
                    form = "".join(tokens[i : i + n])
                    if (hit := dictionary.get(form, own.get(form))) is not None:
                        out.append(f"<{hit}>")
                        i += n
                        break
                else:
                    out.append(tokens[i])
                    i += 1
            else:
                out.append(tokens[i])
                i += 1
        return out

    return one


def title_keys(titles: DataFrame, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, title key) of distinct (s, title). forms: (compact, term_id, k) of canonical.reference_forms; those with a k beyond
    MOST_FORMS are joined to the titles that hold them."""
    parsed = scratch.keep(
        titles.select("title").distinct().withColumn("p", title_parts("title"))
        .select(F.md5("title").alias("tid"), "title", "p.*").where(F.size("main") >= LEAST_WORDS)
    )
    per_source = titles.select("s", F.md5("title").alias("tid")).distinct()
    spots = scratch.keep(
        parsed.select("tid", "colon", F.posexplode("main").alias("pos", "token"), F.lit(0).alias("part"))
        .unionAll(parsed.select("tid", "colon", F.posexplode("sub").alias("pos", "token"), F.lit(1).alias("part")))
    )
    right = scratch.keep(_corrections(spots.join(per_source, "tid").select("s", "token"), scratch))
    fixed = (
        spots.join(right, "token", "left")
        .withColumn("token", F.coalesce("right", "token"))
        .groupBy("tid", "colon")
        .agg(*(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("pos", "token")))), lambda x: x["token"]).alias(n)
            for p, n in ((0, "main"), (1, "sub"))
        ))
    )
    forms = scratch.keep(forms.select("compact", "term_id", "k"))
    alias = _aliased({r.compact: r.term_id for r in forms.where(F.col("k") <= MOST_FORMS).collect()})
    rest = forms.where(F.col("k") > MOST_FORMS).groupBy("compact").agg(F.min("term_id").alias("term_id"))
    longest = rest.agg(F.max(F.length("compact"))).first()[0]
    own = F.lit(None).cast("array<struct<compact:string,term_id:bigint>>")
    if longest:
        fixed = scratch.keep(fixed)
        runs = F.expr("flatten(transform(sequence(1, size(main)), i -> transform(sequence(1, size(main) - i + 1), n -> concat_ws('', slice(main, i, n)))))")
        held = fixed.where("size(main) > 0").select("tid", F.explode(runs).alias("compact")).where(F.length("compact") <= longest).distinct().join(rest, "compact")
        fixed, own = fixed.join(held.groupBy("tid").agg(F.collect_list(F.struct("compact", "term_id")).alias("own")), "tid", "left"), F.col("own")

    @F.pandas_udf("main string, sub string, cuts array<struct<main:string,rest:string>>")
    def keys(main: pd.Series, sub: pd.Series, colon: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for m, s, c, o in zip(main, sub, colon, own):
            m = alias(list(m), {x["compact"]: x["term_id"] for x in o} if o is not None else {})
            cuts = [] if c else [{"main": "".join(m[:i]), "rest": "".join(m[i:])} for i in range(LEAST_WORDS, len(m))]
            rows.append(("".join(m), "".join(s), cuts))
        return pd.DataFrame(rows, columns=["main", "sub", "cuts"])

    keyed = scratch.keep(fixed.select("tid", keys("main", "sub", "colon", own).alias("k")).select("tid", "k.*"))
    # Subtitles that lost their colon: the rest starts a known subtitle and what precedes it is a known main part.
    starts = (
        keyed.where("length(sub) >= 4").select("sub").distinct()
        .select(F.explode(F.expr("transform(sequence(4, length(sub)), n -> left(sub, n))")).alias("rest")).distinct()
    )
    cuts = (
        keyed.select("tid", F.explode("cuts").alias("c")).select("tid", "c.*").where("length(rest) >= 4")
        .join(starts, "rest", "left_semi")
        .join(keyed.select("main").distinct(), "main", "left_semi")
        .groupBy("tid").agg(F.min_by("main", F.length("main")).alias("cut"))
    )
    return (
        per_source.join(keyed.select("tid", "main"), "tid").join(cuts, "tid", "left")
        .select("s", F.coalesce("cut", "main").alias("key")).distinct()
    )


def publications(records: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(s, pub, many): every source_id (trimmed, lower case) with the least source_id of its publication; many marks
    the collections.

    Null or blank source_ids have no row. Null titles, DOIs and record_ids link nothing; placeholder titles neither.
    Collections stand for themselves. Extra columns are ignored; repeated rows change nothing; empty in, empty out."""
    base = records.select(
        source_key("source_id").alias("s"), doi_key("doi").alias("doi"), F.col("source_title").alias("title"),
        F.nullif(F.trim(F.lower("record_id")), F.lit("")).alias("record"),
    ).where("s is not null")
    base = scratch.keep(base)
    dois = scratch.keep(base.where("doi is not null").groupBy("s", "doi").agg(F.count("*").alias("n")))
    main = lambda rows, by: rows.groupBy(by).agg((F.max("n") / F.sum("n")).alias("main")).where(F.col("main") < MAIN_DOI).select(by)
    many = scratch.keep(main(dois, "s"))
    single = scratch.keep(base.select("s").distinct().join(many, "s", "left_anti"))
    titles = scratch.keep(base.where("title is not null").select("s", "title").distinct().join(single, "s", "left_semi"))
    keys = scratch.keep(title_keys(titles, reference_forms(records, terms, ("alloy", "am_process")), scratch))
    vague = main(keys.join(dois, "s").groupBy("key", "doi").agg(F.sum("n").alias("n")), "key")
    entity = (
        keys.join(vague, "key", "left_anti").select("s", F.concat(F.lit("t:"), "key").alias("e"))
        .unionAll(dois.select("s", F.concat(F.lit("d:"), "doi").alias("e")))
        .unionAll(base.where("record is not null").select("s", F.concat(F.lit("r:"), "record").alias("e")).distinct())
    ).join(single, "s", "left_semi")
    entity = scratch.keep(entity)
    least = entity.groupBy("e").agg(F.min("s").alias("v"), F.max("s").alias("w")).where("v <> w").select("e", "v")
    edges = entity.join(least, "e").select(F.col("s").alias("u"), "v").where("u <> v").distinct()
    found = connected_components(edges, scratch)
    return (
        base.select("s").distinct().join(found, F.col("s") == F.col("node"), "left")
        .join(many.withColumn("many", F.lit(True)), "s", "left")
        .select("s", F.coalesce("component", "s").alias("pub"), F.coalesce("many", F.lit(False)).alias("many"))
    )


def same_publication_pairs(pubs: DataFrame) -> DataFrame:
    """(source_id_a, source_id_b) of each publication written under several source_ids."""
    a = pubs.select("pub", F.col("s").alias("source_id_a"))
    b = pubs.select("pub", F.col("s").alias("source_id_b"))
    return a.join(b, "pub").where("source_id_a < source_id_b").select("source_id_a", "source_id_b")


#: A publication with at least this share of all rows is placed by hand of its size, not by its hash.
LARGE_SHARE = 0.01


def publication_splits(records: DataFrame, pubs: DataFrame, plan: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, pub, split_name) with every publication in one split and each split near its row_share.

    Publications with 1 % of the rows or more (at most 100 by that definition) are placed first, largest first, each
    where most room is left; the others by the hash of the component over what is left of the shares. Rows without
    source_id belong to the publication of the sources that have their DOI, else to that DOI, else are publications of
    their own. An empty table gives an empty result; a plan must have a positive sum."""
    have = {c for c in ("doi",) if c in records.columns}
    rows = records.select(F.col(key), source_key("source_id").alias("s"), (doi_key("doi") if have else F.lit(None).cast("string")).alias("d")).join(pubs.select("s", "pub"), "s", "left")
    named = rows.where("pub is not null and d is not null").groupBy("d").agg(F.min("pub").alias("by_doi"))
    nameless = rows.where("pub is null").join(named, "d", "left").select(
        key, F.coalesce("by_doi", F.concat(F.lit("doi:"), "d"), F.concat(F.lit("row:"), F.col(key).cast("string"))).alias("pub")
    )
    rows = rows.where("pub is not null").select(key, "pub").unionAll(nameless)
    sizes = rows.groupBy("pub").count()
    total = records.count()
    shares = sorted((r.split_name, float(r.row_share)) for r in plan.collect() if r.row_share and r.row_share > 0)
    whole = sum(x for _, x in shares) or 1.0
    room = {n: x / whole * total for n, x in shares}
    placed = []
    for r in sizes.where(F.col("count") >= LARGE_SHARE * total).orderBy(F.desc("count"), "pub").collect() if total else []:
        split = max(room, key=lambda n: (room[n], n))
        room[split] -= r["count"]
        placed.append((r["pub"], split))
    left = sum(max(0.0, x) for x in room.values()) or 1.0
    # 53 bits of the hash as a number in [0, 1).
    at = F.shiftrightunsigned(F.xxhash64("pub"), 11).cast("double") / F.lit(float(1 << 53))
    ranged, upto = None, 0.0
    names = [n for n, _ in shares]
    for n in names[:-1]:
        upto += max(0.0, room[n]) / left
        ranged = F.when(at < upto, n) if ranged is None else ranged.when(at < upto, n)
    ranged = F.lit(names[-1]) if ranged is None else ranged.otherwise(names[-1])
    fixed = F.create_map(*(F.lit(x) for p in placed for x in p)) if placed else None
    name = ranged if fixed is None else F.coalesce(F.element_at(fixed, F.col("pub")), ranged)
    return rows.select(key, "pub", name.alias("split_name"))
