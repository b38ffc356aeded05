"""Column expressions and pandas kernels for dirty identifiers and titles."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORDS = re.compile(r"[^\W_]+")
_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−⁃－"), "-")


def plain(text: str) -> str:
    """Lower case without entities, marks over letters, ligatures and hidden characters."""
    for _ in range(3):
        if "&" not in text:
            break
        text = html.unescape(text)
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    return _HIDDEN.sub("", "".join(c for c in text if not unicodedata.combining(c)).lower())


def compact(text: str) -> str:
    """Letters and digits of ``plain``, with & and + read as "and", so that forms differing in separators agree."""
    return "".join(_WORDS.findall(re.sub(r"[&+]", " and ", plain(text))))


def words(text: str) -> list[str]:
    return _WORDS.findall(text.replace("&", " and "))


def osa(a: str, b: str, most: int, swap: float = 1.0) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent swaps cost ``swap``); most + 1 when beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[float] = []
    row: list[float] = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new: list[float] = [i] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            x = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + swap)
            new[j] = x
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1] if row[-1] <= most else most + 1


def deletes(word: str, depth: int) -> set[str]:
    """The word and all it becomes by deleting up to ``depth`` letters."""
    found = level = {word}
    for _ in range(depth):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found


def source_key(c: str | Column) -> Column:
    """source_id without case and surrounding blanks; null when blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def doi_key(c: str | Column) -> Column:
    """A DOI without resolver, label, case, blanks, escapes and final punctuation; null when there is none."""
    c = F.col(c) if isinstance(c, str) else c
    flat = F.regexp_replace(F.regexp_replace(F.lower(c), "%2f", "/"), r"\s+", "")
    return F.nullif(F.regexp_extract(flat, r"(10\.\d{4,9}/.*?)[.,;:)\]>\"']*$", 1), F.lit(""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def delete_keys(s: pd.Series) -> pd.Series:
    """One letter deleted up to five letters, two beyond; nothing for words with digits or under three letters."""
    return s.map(
        lambda w: sorted(deletes(w, 1 if len(w) <= 5 else 2)) if len(w) >= 3 and not any(c.isdigit() for c in w) else []
    )


@F.pandas_udf(T.DoubleType())
def typo_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance within what delete_keys can find, null beyond."""

    def one(x: str, y: str) -> float | None:
        most = 1 if min(len(x), len(y)) <= 5 else 2
        d = osa(x, y, most)
        return d if d <= most else None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
