"""Problem 3: mapping free-entered values to a canonical list."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm.text import compact, deletes, osa, plain, source_key
from evispark.session import Scratch

FIELDS = ("alloy", "am_process", "surface_condition", "heat_treatment")
#: A reference list longer than this isn't one to broadcast. Of the forms learnt for an entry, those with most support are
#: broadcast, to find misspellings of them too; a value that is any other learnt form finds its entry by a join.
MOST_TERMS, MOST_FORMS = 20_000, 200

#: Forms that a caller adds to the list: (field_name, form, canonical_label).
EXTRA_FORMS: tuple[tuple[str, str, str], ...] = ()
#: Symbols of the elements that alloys are named by; a value of element names only is read as their symbols.
ELEMENTS = {
    "aluminium": "al", "aluminum": "al", "chromium": "cr", "cobalt": "co", "copper": "cu", "iron": "fe", "magnesium": "mg", "manganese": "mn",
    "molybdenum": "mo", "nickel": "ni", "niobium": "nb", "scandium": "sc", "silicon": "si", "tantalum": "ta", "tin": "sn", "titanium": "ti",
    "tungsten": "w", "vanadium": "v", "zinc": "zn", "zirconium": "zr",
}
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7"}
_GRADE = re.compile(r"\b(grade|gr|type|class)(\.?\s*)(i{1,3}|iv|vi{0,2})\b")
HEDGES = ("approx", "approximately", "mostly", "mainly", "nominally", "probably")

_NOTE = re.compile(r"\s*(?:\[\d+\]|\((?:[a-z]|\d{1,2}|nominal|approx\.?|typical|ref\.? ?\d+)\)|[†‡*§¹²³]+)\s*$")
_HEDGE = re.compile(r"^\s*(?:approx\.|approximately|cf\.|ca\.|mostly|mainly|nominally|probably|about|~)\s*")
_NAMED = re.compile(r"([a-z]{2,})(\d+)")
_QUOTES = " \t\r\n\"'`«»“”‘’„;.,:"


def bare(text: str) -> str:
    """plain without quotes, footnote marks, hedges and final punctuation; grades in digits, element names as symbols."""
    t = plain(text).replace("_", " ")
    while True:
        new = _NOTE.sub("", _HEDGE.sub("", t.strip(_QUOTES)))
        if new == t:
            break
        t = new
    if t.startswith("(") and t.endswith(")") and t.count("(") == 1:
        return bare(t[1:-1])
    t = _GRADE.sub(lambda m: m[1] + m[2] + _ROMAN[m[3]], t)
    words = re.split(r"[\s-]+", t)
    return " ".join(ELEMENTS[w] for w in words) if len(words) > 1 and all(w in ELEMENTS for w in words) else t


_HINT = re.compile(r"^(.*\S)\s*\(([^()]+)\)$", re.S)


def parts(text: str) -> tuple[str, str, str]:
    """Compact forms of the whole value, of what stands before a final bracket, and in it."""
    t = bare(text)
    m = _HINT.match(t)
    return compact(t), compact(m[1]) if m else "", compact(m[2]) if m else ""


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("whole", "outer", "inner")]))
def value_parts(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parts(x) for x in s], columns=["whole", "outer", "inner"])


def long_values(records: DataFrame, fields: tuple[str, ...] = FIELDS, *keys: str) -> DataFrame:
    """(keys, field_name, value) of the filled fields."""
    return (
        records.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))).alias("x"))
        .select(*keys, "x.*").where(F.col("value").isNotNull() & (F.regexp_replace("value", r"[\s ​﻿]+", "") != ""))
    )


def unhedged(value: str) -> str:
    """Compact form of a value without a first word that is a misspelt hedge, else empty."""
    first, _, rest = bare(value).partition(" ")
    first = first.strip(".")
    near = rest and len(first) >= 4 and any(osa(first, h, 2) <= 2 for h in HEDGES)
    return compact(bare(rest)) if near else ""


_DESIGNATION = re.compile(r"(?=.*[a-z])(?=.*\d).{2,}")


def designated(value: str, known: dict[str, tuple[int, int]]) -> int | None:
    """The entry of the only word that is a listed designation of letters and digits, where the other words are plain words
    and none of them is a listed form."""
    words = [compact(w) for w in bare(value).split()]
    hits = {known[w][0] for w in words if w in known}
    rest = [w for w in words if w not in known]
    if len(hits) == 1 and rest and all(_DESIGNATION.fullmatch(w) for w in words if w in known) and not any(re.search(r"\d", w) for w in rest):
        return hits.pop()
    return None


def _listed(terms: DataFrame, fields: tuple[str, ...], extra: tuple = EXTRA_FORMS) -> list[tuple[str, str, int]]:
    """(field_name, compact form, term_id) of labels and known forms; the list is checked to be short."""
    rows = terms.where(F.col("field_name").isin(*fields)).orderBy("term_id").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the canonical list has over {MOST_TERMS} entries")
    found: dict[tuple[str, str], int] = {}
    for labels in (True, False):
        for r in rows:
            for form in [r.canonical_label] if labels else (r.known_forms or "").split(";"):
                if form and (c := compact(bare(form))):
                    found.setdefault((r.field_name, c), r.term_id)
    for field, form, label in extra:
        for r in rows:
            if (r.field_name, r.canonical_label) == (field, label):
                found.setdefault((field, compact(bare(form))), r.term_id)
    # A short name before a number that the list uses for two entries or more holds for the others of that name.
    names = [(r.field_name, m[1], m[2], r.term_id) for r in rows if r.canonical_label and (m := _NAMED.fullmatch(compact(bare(r.canonical_label))))]
    short: dict[tuple[str, str, str], set[int]] = {}
    for field, name, number, term in names:
        for (f, c), t in found.items():
            if (f, t) == (field, term) and (m := _NAMED.fullmatch(c)) and m[2] == number and m[1] != name and name.startswith(m[1]):
                short.setdefault((field, name, m[1]), set()).add(term)
    for field, name, number, term in names:
        for (f, n, s), seen in short.items():
            if (f, n) == (field, name) and len(seen) >= 2:
                found.setdefault((field, s + number), term)
    return [(f, c, t) for (f, c), t in found.items()]


def _values(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field_name, value, n, whole, outer, inner) of distinct values."""
    counted = long_values(records, fields).groupBy("field_name", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("p", value_parts("value")).select("field_name", "value", "n", "p.*")


def _learnt(values: DataFrame, listed: DataFrame) -> DataFrame:
    """(field_name, compact, term_id, k) of forms written as "form (label)": support of two rows and nine tenths of them for
    one entry; k: their place in the entry by support."""
    hinted = values.where("outer <> ''").join(listed.withColumnRenamed("compact", "inner"), ["field_name", "inner"])
    votes = hinted.groupBy("field_name", F.col("outer").alias("compact"), "term_id").agg(F.sum("n").alias("n"))
    form, term = Window.partitionBy("field_name", "compact"), Window.partitionBy("field_name", "term_id")
    return (
        votes.withColumn("of", F.sum("n").over(form)).where("n >= 2 and n >= 0.9 * of")
        .withColumn("k", F.row_number().over(term.orderBy(F.desc("n"), "compact")))
        .join(listed.select("field_name", "compact"), ["field_name", "compact"], "left_anti")
        .select("field_name", "compact", "term_id", "k")
    )


def reference_forms(records: DataFrame, terms: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field_name, compact, term_id, k): listed forms (k 0) and those that the records themselves explain in brackets.

    Those with a k up to MOST_FORMS are bounded by the list, not by the records; the others are to be joined."""
    spark = records.sparkSession
    listed = spark.createDataFrame(_listed(terms, fields), "field_name string, compact string, term_id bigint")
    return listed.withColumn("k", F.lit(0)).unionAll(_learnt(_values(records, fields), listed))


def _letters(s: str) -> str:
    return re.sub(r"\d+", "#", s)


def _near(dictionary: dict[str, tuple[int, int]]):
    """Nearest form within one change from four letters, two from seven; digits must agree, frequency breaks ties.

    The form's entry must have five times as many sources as the value at one change, twenty times at two."""
    index: dict[str, list[str]] = {}
    longest = max(map(len, dictionary), default=0)
    for form in dictionary:
        if len(form) >= 4:
            for d in deletes(form, 2 if len(form) >= 7 else 1):
                index.setdefault(d, []).append(form)

    def one(value: str, seen: int) -> tuple[int, float] | None:
        if len(value) < 4 or len(value) > longest + 2:  # longer ones are more than two changes away from all
            return None
        most = 2 if len(value) >= 6 else 1
        digits, best = re.findall(r"\d+", value), None
        for form in {f for d in deletes(value, most) for f in index.get(d, ())}:
            allowed = min(most, 2 if len(form) >= 7 else 1)
            if re.findall(r"\d+", form) != digits or len(re.sub(r"\d", "", form)) < 4:
                continue
            dist = osa(value, form, allowed, swap=0.8)
            if dist <= allowed and dictionary[form][1] >= (5 if dist <= 1 else 20) * seen:
                rank = (dist, -dictionary[form][1], form)
                best = min(best, rank) if best else rank
        return (dictionary[best[2]][0], best[0]) if best else None

    return one


def canonicalise(records: DataFrame, terms: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS, key: str = "row_id") -> DataFrame:
    """(row_id, field_name, value, term_id, how) for every filled value; term_id 0 and how "none" report the misses.

    how: "label" (literally a canonical_label), "form" (a form listed or learnt, up to case, separators, quotes and
    footnotes, or one of them with a describing word), "hint" (the bracket names the entry), "near" (misspelt), "none". Distinct values are mapped, then joined
    back. A value that many sources write is no misspelling: the entry must have five times as many, in all its forms. Rows
    without a source count as one each.
    Null and blank values have no row; repeated rows have one row each; an empty table or list gives no matches."""
    spark = records.sparkSession
    listed_rows = _listed(terms, fields)
    listed = spark.createDataFrame(listed_rows, "field_name string, compact string, term_id bigint")
    values = scratch.keep(_values(records, fields))
    learnt = scratch.keep(_learnt(values, listed))
    forms = scratch.keep(listed.unionAll(learnt.where(F.col("k") <= MOST_FORMS).drop("k")))
    # How many sources write the forms, for ties and to tell misspellings from other names. Bounded like the forms.
    source = F.coalesce(source_key("source_id") if "source_id" in records.columns else F.lit(None), F.concat(F.lit("row "), F.col(key).cast("string")))
    heads = F.explode(F.array_distinct(F.array("whole", F.coalesce(F.nullif("outer", F.lit("")), "whole")))).alias("compact")
    uses = long_values(records.withColumn("source", source), fields, "source").distinct().join(values, ["field_name", "value"])
    uses = scratch.keep(uses.select("field_name", "source", heads).distinct())
    seen = scratch.keep(uses.groupBy("field_name", "compact").agg(F.count("*").alias("seen")))
    entries = uses.join(F.broadcast(forms), ["field_name", "compact"]).groupBy("field_name", "term_id").agg(F.countDistinct("source").alias("seen"))
    dictionary: dict[str, dict[str, tuple[int, int]]] = {f: {} for f in fields}
    for r in forms.join(entries, ["field_name", "term_id"], "left").collect():
        dictionary[r.field_name][r.compact] = (r.term_id, r.seen or 1)
    given = spark.sparkContext.broadcast(dictionary)
    state: dict = {}

    @F.pandas_udf("term_id bigint, how string")
    def mapped(field: pd.Series, value: pd.Series, whole: pd.Series, outer: pd.Series, inner: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for f, v, w, o, i, k in zip(field, value, whole, outer, inner, n):
            known = given.value[f]
            if w in known:
                rows.append((known[w][0], "form"))
            elif i in known:
                rows.append((known[i][0], "hint"))
            elif o in known:
                rows.append((known[o][0], "form"))
            else:
                if f not in state:
                    state[f] = _near(known)
                hit = None
                for part in (w, i, o, unhedged(v)):
                    hit = hit or ((known[part][0],) if part in known else state[f](part, k) if part else None)
                other = None if hit else designated(v, known)
                rows.append((hit[0], "near") if hit else (other, "form") if other is not None else (0, "none"))
        return pd.DataFrame(rows, columns=["term_id", "how"])

    rest = learnt.where(F.col("k") > MOST_FORMS).select("field_name", F.col("compact").alias("whole"), F.col("term_id").alias("rest_id"))
    labels = terms.select("field_name", F.col("canonical_label").alias("value"), F.col("term_id").alias("label_id")).dropDuplicates(["field_name", "value"])
    counted = values.join(seen.withColumnRenamed("compact", "whole"), ["field_name", "whole"], "left")
    done = counted.withColumn("m", mapped("field_name", "value", "whole", "outer", "inner", F.coalesce("seen", "n"))).join(F.broadcast(labels), ["field_name", "value"], "left")
    done = done.join(rest, ["field_name", "whole"], "left")
    done = scratch.keep(
        done.select(
            "field_name", "value", F.coalesce("label_id", "rest_id", "m.term_id").alias("term_id"),
            F.when(F.col("label_id").isNotNull(), "label").when(F.col("rest_id").isNotNull(), "form").otherwise(F.col("m.how")).alias("how"),
        )
    )
    return long_values(records, fields, key).join(done, ["field_name", "value"])
