"""Column expressions that clean fields and derive features. All of them stay in the JVM, null in means null out unless said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of four alloys and two more, keyed by their text without blanks, underscores and hyphens.
ALLOY_SPELLINGS = {
    "Ti-6Al-4V": ("ti64", "ti6al4v", "ti6al4veli", "ti6al4velis"),
    "316L stainless steel": ("316l", "ss316l", "316lstainlesssteel"),
    "Inconel 718": ("in718", "inconel718", "alloy718"),
    "Inconel 625": ("in625", "inconel625", "alloy625"),
    "Hastelloy X": ("hastelloyx",),
    "AlSi10Mg": ("alsi10mg",),
}
# Names of three process domains, keyed by letters and digits only.
PROCESS_DOMAINS = {
    "L-PBF": ("lpbf", "lbpbf", "pbflb", "pbflbm", "laserpowderbedfusion", "laserpowderbedfusionlpbf", "selectivelasermelting", "selectivelasermeltingslm", "slm"),
    "E-PBF": ("epbf", "ebpbf", "electronbeammelting"),
    "WAAM": ("waam", "wirearcadditivemanufacturingwaam"),
}
# A term of a surface step and its label, in order of precedence.
SURFACE_TERMS = (
    ("as-built", "as-built"), ("as built", "as-built"), ("electropolish", "electropolished"), ("chemical polish", "chemically-polished"),
    ("sandblast", "sandblasted"), ("sand blast", "sandblasted"), ("shot peen", "shot-peened"), ("bead blast", "bead-blasted"),
    ("machine", "machined"), ("turn", "machined"), ("grind", "ground"), ("polish", "polished"), ("edm", "edm-cut"), ("coat", "coated"), ("plate", "coated"),
)
# Words for a test that ran out, and for one that failed.
RAN_OUT = ("true", "yes", "y", "1", "runout", "run-out", "run out", "run-out samples", "run out samples", "survived")
FAILED = ("false", "no", "n", "0", "failure", "failed")
# Patterns of specimen geometries, in order.
GEOMETRIES = (
    (r"c\s*\(\s*t\s*\)", "compact-tension"), (r"compact\s+tension", "compact-tension"), (r"circular\s+cross", "circular-cross-section"),
    (r"rectangular\s+cross", "rectangular-cross-section"), (r"cruciform", "cruciform"), (r"tubular|tube", "tubular"), (r"hourglass", "hourglass"),
    (r"single.edge.notch|\bsen[bt]?\b", "single-edge-notch"), (r"middle.tension|\bm\s*\(\s*t\s*\)", "middle-tension"),
)
# Lowest and highest plausible value of numeric fields.
NUMERIC_RANGES = {
    "source_year": (1900, 2100), "laser_power_w": (0, 2000), "scan_speed_mm_s": (0, 20000), "hatch_spacing_um": (0, 1000),
    "layer_thickness_um": (0, 500), "relative_density_percent": (0, 100), "test_temperature_c": (-273.15, 3000),
    "yield_strength_mpa": (0, 3500), "uts_mpa": (0, 4000), "elongation_percent": (0, 150), "youngs_modulus_gpa": (0, 500),
    "hardness_hv": (0, 3000), "stress_amplitude_mpa": (0, 3000), "max_stress_mpa": (0, 4000), "r_ratio": (-10, 1),
    "frequency_hz": (0, 1_000_000), "fatigue_life_cycles": (0, 1e12),
}
MISSING_WORDS = ("", "missing", "nan", "none", "<na>", "unknown")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: str | Column) -> Column:
    """Without blanks of any kind around; the trim of SQL takes spaces only."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def finite(c: str | Column) -> Column:
    """NaN and infinities as null."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def header_name(c: str | Column) -> Column:
    """A header in lower case, Greek and degree signs spelt out, everything else but letters and digits one blank."""
    t = F.translate(F.lower(_c(c)), "μµεσδ", "uue\u0001\u0002")
    t = F.replace(F.replace(t, F.lit("\u0001"), F.lit("sigma")), F.lit("\u0002"), F.lit("delta"))
    t = F.replace(F.replace(t, F.lit("℃"), F.lit("c")), F.lit("°c"), F.lit("c"))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def numeric(c: str | Column) -> Column:
    """A number from text with thousands commas or percent signs; null where it is none."""
    return finite(F.regexp_replace(stripped(c), "[,%]", "").try_cast("double"))


def truth(c: str | Column, short: bool = True) -> Column:
    """Run-out words as a boolean; unknown words are null. short: y and n count."""
    yes = [w for w in RAN_OUT if short or w != "y"]
    no = [w for w in FAILED if short or w != "n"]
    t = F.lower(stripped(_c(c).cast("string")))
    return F.when(t.isin(yes), True).when(t.isin(no), False)


def is_missing(c: str | Column, words: tuple[str, ...] = MISSING_WORDS) -> Column:
    """True for null and for the words that stand for nothing."""
    return F.coalesce(F.lower(stripped(_c(c).cast("string"))).isin(*words), F.lit(True))


def filled(c: str | Column) -> Column:
    """The text, or null when blank."""
    return F.nullif(stripped(c), F.lit(""))


def _spelt(key: Column, spellings: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    out = otherwise
    for name, keys in spellings.items():
        out = F.when(key.isin(*keys), name).otherwise(out)
    return out


def alloy_name(c: str | Column) -> Column:
    t = filled(c)
    return F.when(t.isNotNull(), _spelt(F.lower(F.regexp_replace(t, r"[\s_\-]", "")), ALLOY_SPELLINGS, t))


def alloy_family(c: str | Column) -> Column:
    """Ti, steel, Ni, Al or other alloy, by the first rule that holds."""
    t = F.lower(filled(c))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))
    return (
        F.when(t.startswith("ti") | has("ti-", "titanium"), "Ti alloy")
        .when(has("316", "steel", "ss"), "Steel")
        .when(has("inconel", "hastelloy", "nickel") | t.rlike("^in(718|625| )"), "Ni alloy")
        .when(t.startswith("al") | has("alsi", "aluminium"), "Al alloy")
        .when(t.isNotNull(), "Other")
    )


def defect_class(c: str | Column) -> Column:
    t = F.lower(filled(c))
    has = lambda w: F.contains(t, F.lit(w))
    porous = has("pore") | has("porosity")
    return (
        F.when((has("lack") & has("fusion")) | (t == "lof"), "lack_of_fusion").when(has("keyhole"), "keyhole_pore")
        .when(has("gas") & porous, "gas_pore").when(porous, "pore").when(has("crack"), "crack").when(has("inclusion"), "inclusion")
        .otherwise(F.replace(t, F.lit(" "), F.lit("_")))
    )


def process_domain(c: str | Column) -> Column:
    t = filled(c)
    t = F.when(F.lower(t) != "missing", t)
    return F.when(t.isNotNull(), _spelt(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", ""), PROCESS_DOMAINS, t))


def steps(c: str | Column) -> Column:
    """The steps of a route, trimmed and in lower case."""
    return F.transform(F.split(_c(c), ";"), lambda s: F.lower(stripped(s)))


def surface_route(c: str | Column) -> Column:
    """Labels of the surface steps in order, each once, joined by plus; a step takes its first term with a new label."""
    labels = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(x).alias("label")) for t, x in SURFACE_TERMS))

    def add(done: Column, step: Column) -> Column:
        new = F.filter(labels, lambda t: F.contains(step, t["term"]) & ~F.array_contains(done, t["label"]))
        return F.when(F.size(new) > 0, F.concat(done, F.array(F.get(new, F.lit(0))["label"]))).otherwise(done)

    surface = F.filter(steps(c), lambda s: s.startswith("surf"))
    out = F.aggregate(surface, F.array().cast("array<string>"), add)
    return F.when(F.size(out) > 0, F.array_join(out, "+"))


def heat_route(c: str | Column) -> Column:
    starts = lambda word: F.exists(steps(c), lambda s: s.startswith(word))
    hip, heat = starts("hip"), starts("ht")
    return (
        F.when(hip & heat, "hip+heat-treated").when(hip, "hip").when(heat, "heat-treated").when(starts("nht"), "no-heat-treatment")
    )


def material_state(route: str | Column, surface: str | Column, heat: str | Column) -> Column:
    """The delivered state from heat treatment and surface; where neither tells, whether a route is given."""
    s, h = F.coalesce(_c(surface), F.lit("")), F.coalesce(_c(heat), F.lit(""))
    return (
        F.when(h == "hip+heat-treated", "hip-and-heat-treated").when(h.isin("hip", "heat-treated"), h)
        .when((h == "no-heat-treatment") & (s == "as-built"), "as-manufactured")
        .when((h == "no-heat-treatment") & (s != ""), "surface-processed-no-heat-treatment")
        .when(h == "no-heat-treatment", h).when(s == "as-built", "as-manufactured")
        .when(s != "", "surface-processed-treatment-unknown").when(_c(route).isNotNull(), "reported-processing-route-unclassified")
    )


def geometry(c: str | Column) -> Column:
    t = F.lower(stripped(c))
    out = F.lit(None).cast("string")
    for pattern, label in reversed(GEOMETRIES):
        out = F.when(t.rlike(pattern), label).otherwise(out)
    return out


def single_number(c: str | Column) -> Column:
    """A size only where the text is one plain number."""
    t = stripped(c)
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double"))


def energy_density(power: Column, speed: Column, hatch: Column, layer: Column, given: Column | None = None) -> Column:
    """J/mm3; a given value wins."""
    volume = finite(speed) * finite(hatch) / 1000 * finite(layer) / 1000
    new = F.when(volume > 0, finite(power) / volume)
    return new if given is None else F.coalesce(finite(given), new)


def porosity(density: Column, given: Column | None = None) -> Column:
    new = F.when(finite(density).between(0, 100), 100 - finite(density))
    return new if given is None else F.coalesce(finite(given), new)


def cycles(hours: Column, frequency: Column, given: Column | None = None) -> Column:
    new = F.when((finite(hours) > 0) & (finite(frequency) > 0), finite(hours) * 3600 * finite(frequency))
    return new if given is None else F.coalesce(finite(given), new)


def log_life(life: Column) -> Column:
    return F.when(finite(life) > 0, F.log10(finite(life)))


def information_score(*columns: str) -> Column:
    """How many of the columns are filled; NaN counts as null by the caller's choice of columns."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def doi(c: str | Column) -> Column:
    """A DOI in lower case without blanks, resolver, label and final punctuation."""
    t = F.regexp_replace(F.lower(_c(c)), r"\s+", "")
    t = F.regexp_replace(t, r"^(https?://)?(dx\.)?doi\.[a-z]+/|^doi:?", "")
    return F.nullif(F.regexp_replace(t, r"[.,;:)\]}]+$", ""), F.lit(""))


def slug(c: str | Column, words: int = 10, drop: tuple[str, ...] = ("a", "an", "and", "by", "for", "in", "of", "on", "the", "to", "under", "with")) -> Column:
    """The first distinct words of a title without the commonest ones, joined by underscores."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*drop))
    return F.array_join(F.slice(F.array_distinct(tokens), 1, words), "_")


def snippet(c: str | Column, size: int = 300) -> Column:
    """One line of at most ``size`` letters, ending in three dots where it was cut."""
    t = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, size - 3)), F.lit("...")))


def clean_lines(c: str | Column) -> Column:
    """Lines trimmed, empty ones dropped, NUL as a blank."""
    lines = F.transform(F.split(F.translate(_c(c), "\u0000", " "), "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def score_of_ten(c: str | Column) -> Column:
    """Scores from 0 to 1 times ten, within 0 to 10; what is no number is 0."""
    x = F.coalesce(finite(_c(c)), F.lit(0.0))
    return F.greatest(F.least(F.when(x.between(0, 1), x * 10).otherwise(x), F.lit(10.0)), F.lit(0.0))


def ratio_bin(c: str | Column) -> Column:
    """Stress ratios in bins closed on the right."""
    x = finite(c)
    return (
        F.when(x <= -0.5, "R_le_-0.5").when(x <= -0.05, "R_-0.5_to_-0.05").when(x <= 0.05, "R_near_zero")
        .when(x <= 0.3, "R_0.05_to_0.3").when(x <= 0.7, "R_0.3_to_0.7").when(x > 0.7, "R_gt_0.7").otherwise("R_missing")
    )


def protocol(frequency: Column, control: Column, has_strain: Column) -> Column:
    """The test protocol from frequency (200 and 1000 Hz bound it), control mode and whether a strain is given."""
    f, c = finite(frequency), F.coalesce(F.lower(stripped(control)), F.lit(""))
    strain = F.contains(c, F.lit("strain")) & has_strain
    stress = c.rlike("force|load|stress") | (c == "")
    return (
        F.when(strain, "e606_strain_controlled").when(~stress, "non_e466_control").when(f <= 200, "e466_conventional")
        .when(f >= 1000, "ultrasonic_vhcf").otherwise("ambiguous_frequency")
    )


def stress_check(amplitude: Column, highest: Column, ratio: Column) -> Column:
    """Whether amplitude, highest stress and ratio agree within a tenth."""
    expected = finite(highest) * (1 - finite(ratio)) / 2
    error = F.abs(finite(amplitude) - expected) / F.nullif(F.abs(expected), F.lit(0.0))
    return F.when(error.isNull(), "not_checkable").when(error > 0.10, "review_required").otherwise("consistent")


def range_issues(ranges: dict[str, tuple[float, float]] = NUMERIC_RANGES) -> Column:
    """The fields outside their range, joined by semicolons in the order of the ranges; empty where there are none."""
    issues = (F.when(~finite(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in ranges.items())
    return F.array_join(F.array_compact(F.array(*issues)), ";")


def fingerprint(*columns: str) -> Column:
    """SHA-256 over the columns' texts, trimmed and in lower case, null as empty."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.lower(stripped(F.col(c).cast("string"))), F.lit("")) for c in columns)), 256)


def life_class(c: str | Column) -> Column:
    x = finite(c)
    return F.when(x < 1e7, "below_range").when(x <= 2e7, "within_range").when(x > 2e7, "above_range")


def warnings(lows: dict[str, float], highs: dict[str, float]) -> Column:
    """What is missing or beyond the training range, sorted, joined by semicolons."""
    found = []
    for c in lows:
        x = finite(c)
        found += [F.when(x.isNull(), f"missing_value:{c}"), F.when(x < lows[c], f"below_training_range:{c}"), F.when(x > highs[c], f"above_training_range:{c}")]
    return F.array_join(F.array_sort(F.array_compact(F.array(*found))), ";")


def within_gate(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies within bounds of which either may be missing; false for values that are no numbers."""
    v = finite(value)
    return F.coalesce((v >= F.coalesce(finite(low), F.lit(float("-inf")))) & (v <= F.coalesce(finite(high), F.lit(float("inf")))), F.lit(False))


def condition_value(c: str | Column, step: float) -> Column:
    """A number to the nearest multiple of step, halves to even."""
    return F.bround(finite(c) / step, 0) * step


def orientation(c: str | Column) -> Column:
    """An orientation without its degree sign, as a plain number where it is one; blank is "missing"."""
    t = F.regexp_replace(F.lower(filled(c)), r"\s*(°|deg(rees?)?)$", "")
    whole = F.regexp_replace(t, r"\.0+$", "")
    return F.coalesce(whole, F.lit("missing"))


def safe_filename(c: str | Column, most: int = 170, otherwise: str = "untitled_paper") -> Column:
    """A title as a file name: no signs that file systems forbid, single blanks, no dots or blanks at the ends."""
    t = F.regexp_replace(F.regexp_replace(_c(c), r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " ")
    ends = r"^[ .]+|[ .]+$"
    name = F.coalesce(F.nullif(F.regexp_replace(t, ends, ""), F.lit("")), F.lit(otherwise))
    return F.regexp_replace(F.substring(name, 1, most), r"[ .]+$", "")


def initials(c: str | Column, most: int = 12, otherwise: str = "unknownjournal") -> Column:
    """The first letters of a name's words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    code = F.substring(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 1, most)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit(otherwise))


def year_of(given: Column, text: Column) -> Column:
    """The first year from 1900 to 2099 in a value, else in a text, else "unknownyear"."""
    found = [F.nullif(F.regexp_extract(t.cast("string"), r"\b((?:19|20)\d{2})\b", 1), F.lit("")) for t in (given, text)]
    return F.coalesce(*found, F.lit("unknownyear"))
