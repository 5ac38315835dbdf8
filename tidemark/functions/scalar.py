"""Column functions: names, bands, features and formats, all inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as double, with NaN and infinities turned into null, so that avg and max ignore them."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def normalize_name(x: Column) -> Column:
    """Lower case, trimmed, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def excluded(x: Column, names: list[str], token: str) -> Column:
    """Whether x is one of names or contains token; null is neither."""
    return F.coalesce(x.isin(names) | x.contains(token), F.lit(False))


def week_of(day: Column) -> Column:
    return F.floor(day / 7)


def centred(raw: Column, center: Column, half_range: Column) -> Column:
    """An instrument's raw score on a scale of -1 to 1."""
    return (raw - center) / half_range


def affine_trait(latent: Column, location: Column, scale: Column) -> Column:
    """(latent - location) / scale; a scale of 0 counts as 1."""
    return (latent - location) / F.when(scale == 0, 1.0).otherwise(scale)


def loading_value(value: Column, loading: Column, least: float = 1e-8) -> Column:
    """value / loading; null where either isn't finite or the loading is next to nothing."""
    return F.when(F.abs(finite(loading)) >= least, finite(value) / loading)


def latent_from_link(value: Column, intercept: Column, loading: Column) -> Column:
    """The latent value that a linear measurement link maps to value."""
    return loading_value(value - intercept, loading)


def gap_factors(rho: Column, gap: Column) -> dict[str, Column]:
    """How much of a state persists over a gap, and the factors of its drift and its innovation variance.

    rho must lie in (0, 1] and gaps must be neither missing nor negative: rows that break this fail the query.
    """
    r = F.when((rho > 0) & (rho <= 1), rho).otherwise(F.raise_error(F.lit("persistence must lie in (0, 1]")).cast("double"))
    g = F.when(gap.isNull(), F.raise_error(F.lit("gaps cannot be missing")).cast("double")).when(gap < 0, F.raise_error(F.lit("gaps cannot be negative")).cast("double")).otherwise(gap.cast("double"))
    one = r == 1
    return {
        "persistence": F.pow(r, g),
        "drift": F.when(one, g).otherwise((1 - F.pow(r, g)) / (1 - r)),
        "innovation": F.when(one, g).otherwise((1 - F.pow(r, 2 * g)) / (1 - r * r)),
    }


def transition_features(b: list[Column], action: Column, recent: Column, burden: Column, actions: list, basis: str = "linear", subtype: Column | None = None, subtypes: int = 0) -> Column:
    """The design vector of a transition as an array.

    linear: 1, profile, one flag per action, recent, burden; interaction: also profile times recent and times burden;
    nonlinear: also squares and tanh of the profile; stratified: also the profile within each subtype.
    """
    parts = [F.lit(1.0), *b, *((action == a).cast("double") for a in actions), recent, burden]
    if basis in ("interaction", "nonlinear", "stratified"):
        parts += [x * recent for x in b] + [x * burden for x in b]
    if basis in ("nonlinear", "stratified"):
        parts += [x * x for x in b] + [F.tanh(x) for x in b]
    if basis == "stratified" and subtype is not None:
        parts += [x * (subtype == k).cast("double") for k in range(subtypes) for x in b]
    return F.array(*(p.cast("double") for p in parts))


def label_of(code: Column, labels: dict[str, str]) -> Column:
    """The display label of a code; a code without one is its own."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.element_at(table, code), code)


def mean_cell(mean: Column, error: Column) -> Column:
    return F.when(mean.isNull(), F.lit("n/a")).otherwise(F.format_string("%.3f (%.3f)", mean, F.coalesce(error, F.lit(0.0))))


def range_cell(mean: Column, low: Column, high: Column) -> Column:
    return F.when(mean.isNull(), F.lit("n/a")).otherwise(F.format_string("%.3f [%.3f, %.3f]", mean, low, high))


#: Categories of diagnoses and the patterns that name them; word or code parts, in lower case.
DIAGNOSES = (
    ("depression", r"depress|f3[23]"),
    ("anxiety", r"anxi|panic|f4[01]"),
    ("ptsd", r"ptsd|post.?traumatic|f43\.?1"),
    ("bipolar", r"bipolar|manic|f31"),
    ("adhd", r"adhd|attention.?deficit|f90"),
    ("ocd", r"\bocd\b|obsessive|f42"),
    ("psychotic", r"psychotic|psychosis|schizo|f2[0-9]"),
    ("substance", r"substance|alcohol|opioid|f1[0-9]"),
    ("eating", r"anorexi|bulimi|eating disorder|f50"),
    ("personality", r"personality|borderline|f60"),
    ("autism", r"autis|asperger|f84"),
    ("sleep", r"insomni|sleep|g47|f51"),
)


def diagnosis_categories(text: Column) -> Column:
    """The sorted categories that a free text or a run of codes names; what "without ..." denies doesn't count."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"without [a-z]+( [a-z]+)?", " ")
    return F.array_sort(F.array_compact(F.array(*(F.when(low.rlike(pattern), F.lit(name)) for name, pattern in DIAGNOSES))))


def draw(*keys: Column, salt: str = "") -> Column:
    """A reproducible number in [0, 1) from keys: the first 13 hexadecimal digits of their md5."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a norm product is at most 1e-12."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 1e-12, dot(a, b) / norms)


def top_k_f1(values: Column, truth: Column, k: int, empty: float | None = None) -> Column:
    """F1 between the places of the k values largest in size and the places of truth that aren't 0; empty where there are none."""
    places = F.sequence(F.lit(1), F.size(values))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct((-F.abs(F.element_at(values, i)).cast("double")).alias("less"), i.alias("at"))))
    top = F.transform(F.slice(ranked, 1, k), lambda s: s["at"])
    true = F.filter(places, lambda i: F.element_at(truth, i) != 0)
    both = F.size(top) + F.size(true)
    return F.when((F.size(true) == 0) | (F.size(top) == 0), F.lit(empty).cast("double")).otherwise(2 * F.size(F.array_intersect(top, true)) / both)
