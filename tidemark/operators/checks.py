"""Data-quality, validation and privacy checks as tables: (name, ok, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, named: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per check of an aggregate against an expected number; all aggregates are taken in one pass."""
    keys = list(named)
    one = df.agg(*(named[k][0].cast("double").alias(f"_{i}") for i, k in enumerate(keys)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"_{i}").alias("observed"), F.lit(float(named[k][1])).alias("expected")) for i, k in enumerate(keys))))
    return one.select(rows.alias("c")).select("c.name", F.coalesce(F.col("c.observed") == F.col("c.expected"), F.lit(False)).alias("ok"), "c.observed", "c.expected")


def complete(df: DataFrame, key: list[str], group: list[str], rows: int, group_size: int, groups: int) -> DataFrame:
    """Row count, uniqueness of the key, size of every group and number of groups."""
    per_key = df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("v"), F.sum("count").alias("n"))
    per_group = df.groupBy(*group).count().agg(F.count("*").alias("groups"), F.count_if(F.col("count") != group_size).alias("odd"))
    return checks(per_key.crossJoin(F.broadcast(per_group)), {"rows": (F.max("n"), rows), "repeated keys": (F.max("v"), 0), "groups": (F.max("groups"), groups), "groups of another size": (F.max("odd"), 0)})


def finite(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """How many values of each column are null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    return checks(df if where is None else df.where(where), {f"{c} finite": (F.count_if(bad(c)), 0) for c in columns})


def in_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return checks(df, {f"{c} in [{a:g}, {b:g}]": (F.count_if(~F.col(c).between(a, b)), 0) for c, (a, b) in ranges.items()})


def schema_problems(df: DataFrame, required: list[str] = (), forbidden: list[str] = (), prefixes: list[str] = ()) -> list[str]:
    """What is wrong with the columns; empty if nothing is."""
    have = set(df.columns)
    return [f"missing {c}" for c in required if c not in have] + [f"forbidden {c}" for c in forbidden if c in have] + [f"prefix {p}: {c}" for p in prefixes for c in df.columns if c.startswith(p)]


def expected_values(observed: DataFrame, expected: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per expected key (null keys are equal) whether the observed value is the expected one."""
    o, e = observed.alias("o"), expected.alias("e")
    same = reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key))
    return e.join(o, same, "left").select(*(F.col(f"e.{c}") for c in key), F.col(f"o.{value}").eqNullSafe(F.col(f"e.{value}")).alias("ok"), F.col(f"o.{value}").alias("observed"), F.col(f"e.{value}").alias("expected"))


def no_future_leak(build, inputs: DataFrame, perturbed: DataFrame, before: Column) -> bool:
    """Whether features of earlier times are the same after later or withheld inputs were changed."""
    a, b = build(inputs).where(before), build(perturbed).where(before)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


#: Patterns that a published table or text must not hold.
IDENTIFIERS = (("seven digits or more", r"^\s*[0-9]{7,}\s*$"), ("windows path", r"[A-Za-z]:\\(?:Users|Documents)"), ("home path", r"/(?:home|Users)/[A-Za-z]"))
SECRETS = (
    ("private key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("api key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("access key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("social security number", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
)
#: Endings, folders and names of files that must not be published.
BLOCKED_SUFFIXES = (
    ".csv", ".tsv", ".xlsx", ".xls", ".parquet", ".sas7bdat", ".dta", ".sav", ".feather", ".xpt", ".db", ".sqlite", ".sqlite3", ".pkl", ".pickle", ".pt", ".ckpt", ".npy", ".npz",
    ".docx", ".pptx", ".pdf", ".log", ".jsonl", ".ndjson", ".zip", ".7z", ".tar", ".tgz", ".pem", ".pfx", ".p12", ".tar.gz", ".csv.gz",
)
BLOCKED_FOLDERS = ("empirical", "raw", "data", "derived", "derived_phi", "outputs", "runs")
BLOCKED_NAMES = (".env", ".openai_key")
_either = lambda names: "|".join(n.replace(".", "[.]") for n in names)
BLOCKED = (
    ("suffix", rf"(?i)[^/](?:{_either(BLOCKED_SUFFIXES)})$"),
    ("folder", rf"(?i)(?:^|/)(?:{_either(BLOCKED_FOLDERS)})/"),
    ("name", rf"(?i)(?:^|/)(?:(?:{_either(BLOCKED_NAMES)})$|credentials[^/]*$)"),
)


def blocked_path(path: Column) -> Column:
    """The first rule (suffix, folder, name) by which a path is blocked; null if none."""
    return F.coalesce(*(F.when(path.rlike(pattern), F.lit(name)) for name, pattern in BLOCKED))


def event_accounting(df: DataFrame, by: list[str], key: list[str], role: str, roles: tuple[str, ...]) -> DataFrame:
    """Per group the rows, those of each role, whether the roles add up to all, and how many keys stand more than once."""
    per = df.groupBy(*dict.fromkeys([*by, *key])).agg(F.count("*").alias("_n"), *(F.count_if(F.col(role) == r).alias(f"_{r}") for r in roles))
    g = per.groupBy(*by).agg(F.sum("_n").alias("events"), *(F.sum(f"_{r}").alias(r) for r in roles), F.count_if(F.col("_n") > 1).alias("repeated"))
    return g.withColumn("adds_up", reduce(lambda a, b: a + b, (F.col(r) for r in roles)) == F.col("events"))


def scan(df: DataFrame, columns: list[str], rules=SECRETS) -> DataFrame:
    """Per column and rule how many values match; the values themselves are never shown. One pass, no explode."""
    hits = {(c, name): F.count_if(F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False))) for c in columns for name, pattern in rules}
    one = df.agg(*(x.alias(f"_{i}") for i, x in enumerate(hits.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule"), F.col(f"_{i}").alias("hits")) for i, (c, n) in enumerate(hits))))
    return one.select(rows.alias("h")).select("h.column", "h.rule", "h.hits")
