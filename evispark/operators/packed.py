"""Problem 6: several values packed in one field.

A dialect is a marked list (entries such as "1)" or bullets) or the set of separators that divide a plain field. Every
field is parsed in each dialect whose signs it holds; the parse with the least description length wins: the code lengths of
its values, -log2 of the share of their shape among all values, plus the cost of naming the dialect. Shapes are counted over
the whole table: first over marked lists and fields that have one parse only, then once more over the parses chosen so.
Brackets and quotes are never divided.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.session import Scratch

_SPACE = "\u00a0\u2007\u202f\u200b\ufeff"
#: Separators of plain fields by name; longer signs first where they overlap.
SEPARATORS = {
    "line": r"[\r\n\v\f\x85\u2028\u2029]+",
    "arrow": r"\s*(?:-+>|=+>|→|⇒|»|>+)\s*",
    "semicolon": r"\s*;+\s*|\s*；\s*",
    "bar": r"\s*(?:\|+|¦)\s*",
    "tab": r"\t+",
    "slash": r"\s+/+\s+",
    "tight slash": r"/",
    "plus": r"\s+\+\s+",
    "tight plus": r"\+",
    "amp": r"\s*&\s*",
    "then": r"(?:\s*[,;])?\s+(?:and\s+)?(?:then|followed by|afterwards|dann|gefolgt von|puis|suivi de|luego|seguido de)\s+",
    "and": r"\s+(?:and|und|et|y)\s+",
    "comma": r"\s*,\s+",
    "tight comma": r",",
    "dot": r"\s*[·•∙]\s*",
    "dash": r"\s+[-–—]+\s+",
    "blanks": r" {2,}",
}
_SEPARATOR = {k: re.compile(v, re.I) for k, v in SEPARATORS.items()}
#: Bits to name a separator; those that also occur inside values cost more.
_PRICE = {"tight slash": 8.0, "tight plus": 8.0, "tight comma": 9.0, "blanks": 6.0, "dash": 5.0, "and": 4.0, "comma": 4.0, "amp": 4.0}
#: Marks that open the entries of a list.
_MARKS = {
    "number": re.compile(r"(?:(?<=^)|(?<=\s)|(?<=[;,|/]))\(?(\d{1,3})[.):]\s+"),
    "bracket": re.compile(r"(?:(?<=^)|(?<=\s)|(?<=[;,|/]))\[(\d{1,3})\]\s*"),
    "hash": re.compile(r"(?:(?<=^)|(?<=\s)|(?<=[;,|/]))#(\d{1,3})[.):]?\s+"),
    "step": re.compile(r"(?:(?<=^)|(?<=\s)|(?<=[;,|/]))(?:step|schritt|étape|etape|paso|op\.?)\s*(\d{1,3})\s*[.:)-]\s*", re.I),
    "letter": re.compile(r"(?:(?<=^)|(?<=\s)|(?<=[;,|/]))\(?([a-z])\)\s+"),
}
_BULLET = re.compile(r"(?:^|(?<=[\r\n]))[ \t]*(?:[-*•·–—▪◦‣●]|\+)[ \t]+")
_OPEN, _CLOSE = "([{", ")]}"
_TRIM = " \t\r\n\v\f" + _SPACE
#: So many free signs are tried in all combinations; of more, one after the other is taken while that shortens the code.
MOST_SEPARATORS = 9


def _guarded(text: str) -> str:
    """The text with everything in brackets or quotes (and the quotes) replaced by a neutral letter."""
    out, depth, quote = list(text), 0, ""
    for i, c in enumerate(text):
        if quote:
            closes = c == quote
            if closes and i + 1 < len(text) and text[i + 1] == quote:
                closes = False
            elif closes and i > 0 and text[i - 1] == quote and out[i - 1] == "\0" and _paired(text, i, quote):
                closes = False
            out[i] = "\0"
            if closes:
                quote = ""
        elif c == '"' and '"' in text[i + 1 :] and not text[max(0, i - 1) : i].isdigit():
            quote, out[i] = c, "\0"
        elif c in _OPEN and any(x in text[i + 1 :] for x in _CLOSE):
            depth += 1
            out[i] = "\0"
        elif c in _CLOSE and depth:
            depth -= 1
            out[i] = "\0"
        elif depth:
            out[i] = "\0"
    return "".join(out)


def _paired(text: str, i: int, quote: str) -> bool:
    """Whether the quote at i is the second of a doubled pair: an odd number of quotes precedes it in its run."""
    start = i
    while start > 0 and text[start - 1] == quote:
        start -= 1
    opening = start == 0 or text[start - 1] in _TRIM + ";|,/+>&-"
    return (i - start - opening) % 2 == 1


@lru_cache(maxsize=1 << 16)
def _clean(value: str) -> str:
    v = value.strip(_TRIM)
    if len(v) >= 2 and v[0] == v[-1] == '"':
        v = v[1:-1].replace('""', '"').strip(_TRIM)
    return v


def _cut(text: str, spans: list[tuple[int, int]]) -> list[str]:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return [*out, text[at:]]


def _marked(text: str) -> tuple[str, list[str]] | None:
    """Entries of a list whose numbers count up from 1, or of lines that open with bullets."""
    for name, mark in _MARKS.items():
        want, spans = 1, []
        for m in mark.finditer(text):
            at = ord(m[1].lower()) - 96 if name == "letter" else int(m[1])
            if at == want:
                spans.append(m.span())
                want += 1
        if spans and not text[: spans[0][0]].strip(_TRIM):
            if len(spans) >= 2 or name != "letter":
                pieces = _cut(text, spans)[1:]
                return name, [p.strip(_TRIM).rstrip(";,|/").strip(_TRIM) if i + 1 < len(pieces) else p for i, p in enumerate(pieces)]
    spans = [m.span() for m in _BULLET.finditer(text)]
    if spans and not text[: spans[0][0]].strip(_TRIM):
        return "bullet", _cut(text, spans)[1:]
    return None


@lru_cache(maxsize=1 << 16)
def shape(value: str) -> str:
    """A value without its numbers, case and surplus blanks: what is counted."""
    v = unicodedata.normalize("NFKC", value).lower()
    v = re.sub(r"\d+(?:[.,]\d+)?", "#", v)
    return re.sub(r"\s+", " ", v).strip()


class _Plain:
    """A field's plain text: its separators present and the values that a choice of them gives."""

    def __init__(self, text: str):
        hidden = _guarded(text)
        self.text = text
        self.spots = {k: tuple(m.span() for m in p.finditer(hidden) if m.end() > m.start()) for k, p in _SEPARATOR.items()}
        ends = len(hidden) - len(hidden.lstrip(_TRIM)), len(hidden.rstrip(_TRIM))
        self.present, starts = [], set()
        for k, at in self.spots.items():
            inner = frozenset(a for a, b in at if b > ends[0] and a < ends[1])
            if inner and frozenset(b for _, b in at) not in starts:
                starts.add(frozenset(b for _, b in at))
                self.present.append(k)
        # Line ends always divide; other signs may as well.
        self.always = ["line"] if "line" in self.present else []
        self.free = [k for k in self.present if k != "line"]

    def values(self, some: Iterable[str]) -> tuple[tuple[str, ...], float]:
        """(values, bits to name the dialect) of a choice of free separators."""
        spans = sorted({x for k in (*self.always, *some) for x in self.spots[k]})
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return tuple(v for v in map(_clean, _cut(self.text, merged)) if v), sum(_PRICE.get(k, 2.0) for k in some)

    def parses(self) -> Iterator[tuple[tuple[str, ...], float]]:
        for n in range(len(self.free) + 1):
            for some in combinations(self.free, n):
                yield self.values(some)

    def shortest(self, cost) -> tuple[tuple[str, ...], float]:
        """Separators taken one by one while that shortens the code: for fields with too many kinds for all choices."""
        some: list[str] = []
        best = self.values(some)
        while True:
            near = [(cost(*(p := self.values([*some, k]))), k, p) for k in self.free if k not in some]
            if not near or min(near)[0] >= cost(*best):
                return best
            _, k, best = min(near)
            some.append(k)


def _listed(text: str) -> list[str]:
    """The values of the entries of a marked list; none where the field isn't one."""
    marked = _marked(text)
    return [v for v in map(_clean, marked[1]) if v] if marked else []


def parses(text: str, cost=None) -> list[tuple[float, list[str]]]:
    """(bits to name the dialect, values) of each dialect that divides the field otherwise than the others: the marked list,
    and each choice of separators. Fields with over MOST_SEPARATORS kinds of them have the one of least cost."""
    if text is None or not text.strip(_TRIM):
        return []
    found: dict[tuple[str, ...], float] = {}
    if entries := tuple(_listed(text)):
        found[entries] = 1.0
    plain = _Plain(text)
    if len(plain.free) <= MOST_SEPARATORS:
        each = plain.parses()
    else:
        each = [plain.values(()), plain.shortest(cost or (lambda values, bits: bits - len(values)))]
    for values, bits in each:
        if values and bits < found.get(values, math.inf):
            found[values] = bits
    return [(b, list(v)) for v, b in found.items()]


def _key(shape: str) -> str:
    """The shape as it stands in the code book; long ones by a hash, so that an entry is of bounded size."""
    return shape if len(shape) <= 64 else f"{len(shape)}:{md5(shape.encode()).hexdigest()}"


def _bits(value: str, known: dict[str, int], total: int) -> float:
    s = shape(value)
    n = known.get(_key(s), 0)
    if n:
        return -math.log2(n / total)
    return math.log2(total + 1) + 3.0 + 1.5 * len(s)


def _shapes(fields: DataFrame, column: str, known: dict[str, int] | None, total: int) -> DataFrame:
    """(shape, n): values of fields with one parse and of marked lists, or of the best parses once some shapes are known."""

    @F.pandas_udf("array<string>")
    def seen(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [_key(shape(v)) for v in (_best(t, known, total) if known else _only(t))])

    return fields.select(F.explode(seen(column)).alias("shape"), "n").groupBy("shape").agg(F.sum("n").alias("n"))


def _only(text: str) -> list[str]:
    p = parses(text)
    if len(p) == 1:
        return p[0][1]
    entries = _listed(text or "")
    return entries if len(entries) > 1 else []


def _best(text: str, known: dict[str, int], total: int) -> list[str]:
    code: dict[str, float] = {}

    def cost(values: Iterable[str], bits: float) -> float:
        for v in values:
            if v not in code:
                code[v] = _bits(v, known, total)
            bits += code[v]
        return bits

    found = parses(text, cost)
    if len(found) < 2:
        return found[0][1] if found else []
    choice = min(found, key=lambda p: cost(p[1], p[0]))[1]
    return choice if all(_key(shape(v)) in known for v in choice) else _joined(text, choice, known)


def _joined(text: str, values: list[str], known: dict[str, int]) -> list[str]:
    """Neighbours of unknown shape put together again, with the sign between them, where that makes a known value: the
    sign of a dialect may stand inside a value too."""
    spans, at = [], 0
    for v in values:
        at = text.find(v, at)
        if at < 0:  # written with doubled quotes
            return values
        spans.append((at, at + len(v)))
        at += len(v)
    out, i = [], 0
    while i < len(values):
        j = i + 1
        if _key(shape(values[i])) not in known:
            j = next((k for k in (i + 2, i + 3) if k <= len(values) and _key(shape(text[spans[i][0] : spans[k - 1][1]])) in known), j)
        out.append(text[spans[i][0] : spans[j - 1][1]] if j > i + 1 else values[i])
        i = j
    return out


#: The part of all values that a shape needs to be in the code book (and two values at least); the others are spelt out.
#: So the book has at most 1 / LEAST_SHARE entries, however large the table is, and equal shares give an equal book.
LEAST_SHARE = 2e-6


def _book(shapes: DataFrame) -> tuple[dict[str, int], int]:
    total = shapes.agg(F.sum("n")).first()[0] or 0
    rows = shapes.where(F.col("n") >= max(2.0, LEAST_SHARE * total)).collect()
    return {r["shape"]: r["n"] for r in rows}, max(1, total)


def unpack(df: DataFrame, column: str, scratch: Scratch, key: str = "row_id") -> DataFrame:
    """(key, item_pos, item_text): one row per value of every filled field, item_pos from 1 over non-empty values.

    Null and blank fields have no row, a field of one value has one. Repeated values stay. Extra columns are ignored;
    repeated rows are unpacked each. The shapes are counted over all distinct fields with their frequency."""
    text = F.col(column)
    fields = scratch.keep(df.where(text.isNotNull()).groupBy(text.alias("packed")).agg(F.count("*").alias("n")))
    known, total = _book(scratch.keep(_shapes(fields, "packed", None, 1)))
    if known:
        known, total = _book(scratch.keep(_shapes(fields, "packed", known, total)))
    given = df.sparkSession.sparkContext.broadcast((known, total))

    @F.pandas_udf("array<string>")
    def best(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _best(t, *given.value))

    # Written first: else a condition on the items is computed again for every row of the other side of the join.
    done = scratch.keep(fields.select("packed", best("packed").alias("items")))
    return (
        df.where(text.isNotNull()).select(key, text.alias("packed")).join(done, "packed")
        .select(key, F.size("items").alias("n_items"), F.posexplode("items").alias("item_pos", "item_text"))
        .select(key, (F.col("item_pos") + 1).cast("int").alias("item_pos"), "item_text", "n_items")
    )
