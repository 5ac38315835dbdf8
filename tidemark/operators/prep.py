"""Cleaning, deduplication and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Legal range, centre and half range of the instruments.
INSTRUMENTS = (("PHQ9", 0.0, 27.0, 13.5, 13.5), ("GAD7", 0.0, 21.0, 10.5, 10.5), ("BDI", 0.0, 63.0, 31.5, 31.5))


def genuine(value: Column, low: float, high: float, *made: Column) -> Column:
    """Whether a value was measured: there, within its legal range, and neither imputed nor interpolated."""
    out = value.isNotNull() & value.between(low, high)
    for flag in made:
        out = out & ~F.coalesce(flag.cast("boolean"), F.lit(False))
    return F.coalesce(out, F.lit(False))


def out_of_range(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """One row: how many values of each column lie outside, in one pass."""
    return df.agg(*(F.count_if(~F.col(c).between(low, high)).alias(c) for c in columns))


def require_in_range(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """df, after no value was found outside; else ValueError with the counts."""
    bad = {k: v for k, v in out_of_range(df, columns, low, high).first().asDict().items() if v}
    if bad:
        raise ValueError(f"values outside [{low}, {high}]: {bad}")
    return df


def positive_gaps(df: DataFrame, gap: str) -> DataFrame:
    """Rows of a positive gap; missing and negative gaps fail the query."""
    checked = F.when(F.col(gap).isNull(), F.raise_error(F.lit("gaps cannot be missing")).cast("double")).when(F.col(gap) < 0, F.raise_error(F.lit("gaps cannot be negative")).cast("double")).otherwise(F.col(gap))
    return df.where(checked > 0)


def in_treatment_window(df: DataFrame, day: str, next_day: str, last: int = 84) -> DataFrame:
    return df.where(F.col(day).between(0, last - 1) & F.col(next_day).between(1, last))


def collapsed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means of duplicates."""
    return df.groupBy(*by).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def with_fallback(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    """df with the columns it lacks taken from another one."""
    return df.withColumns({c: F.col(source) for c in columns if c not in df.columns})


def zeroed(df: DataFrame, values: list[str], masks: list[str]) -> DataFrame:
    """df with a block of columns set to 0 and their masks to false."""
    return df.withColumns({c: F.lit(0.0) for c in values} | {c: F.lit(False) for c in masks})


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_of_uid(df: DataFrame, uid: str, *order) -> DataFrame:
    """The first row of each uid over the whole table; rows without one all stay."""
    ranked = df.where(F.col(uid).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(uid).orderBy(*order))).where("_k = 1").drop("_k")
    return ranked.unionByName(df.where(F.col(uid).isNull()))


def set_differences(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side."""
    return observed.exceptAll(expected).withColumn("side", F.lit("unexpected")).unionByName(expected.exceptAll(observed).withColumn("side", F.lit("missing")))


def remaining_units(required: DataFrame, completed: DataFrame, unit: list[str], method: str) -> DataFrame:
    """Units of work of which some required method isn't among the completed rows, and which ones."""
    left = required.join(completed.select(*unit, method).distinct(), [*unit, method], "left_anti")
    return left.groupBy(*unit).agg(F.array_join(F.array_sort(F.collect_set(method)), ",").alias("missing"))


def canonical(value: Column, table: dict[str, str]) -> Column:
    """A label's canonical form; labels outside the table are their own."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), value), value)


def severity_bands(df: DataFrame, bands: DataFrame, instrument: str, value: str) -> DataFrame:
    """df with the name of the band (instrument, low, high, band) that value lies in; closed below, open above."""
    b = F.broadcast(bands.withColumnRenamed("instrument", "_i"))
    return df.join(b, (df[instrument] == b["_i"]) & (df[value] >= b["low"]) & (df[value] < b["high"]), "left").drop("_i")
