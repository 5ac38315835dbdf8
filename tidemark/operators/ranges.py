"""Numbers, running totals and nearest values over whole tables or large groups, none of which one task ever holds.

Rows are dealt by ranges of their order, so a group is spread over as many tasks as it needs; each range is worked on by
itself, and what the ranges before it add up to is carried in. Ranges are written to the shared folder first, because
two readings of a sampled range partitioning need not agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.tables import written


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in on))


def joined(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with the further columns of others, null keys equal to null keys."""
    there = others.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in others.columns if c not in on))
    match = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on)) if on else F.lit(True)
    return rows.join(there, match, how).drop(*(f"_on_{c}" for c in on))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df with i = 0, 1, ... by order, which must be total. One range shuffle; what is broadcast is a row for each range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_r": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = written(ranged, "numbered")
    sizes = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("_r", before.alias("_b"))), "_r").withColumn("i", F.col("_b") + F.col("_k")).drop("_r", "_k", "_b")


def running(df: DataFrame, by: list[str], order: str, totals: dict[str, tuple[Callable, str]], backwards: bool = False) -> DataFrame:
    """df with running totals of each group in ascending (or descending) order; rows of equal order count together.

    totals maps a new column to (F.sum, F.min or F.max, column). Rows that share group and order lie in one range, so a
    caller with many of them adds them up first. A group meets itself only as one row for each of its ranges.
    """
    combine = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.min: F.least, F.max: F.greatest}
    rows = written(df.repartitionByRange(*by, order).withColumn("_r", F.spark_partition_id()), "ranges")
    turn = F.desc if backwards else F.asc
    inside = Window.partitionBy(*by, "_r").orderBy(turn(order)).rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(turn("_r")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_r").agg(*(how(c).alias(f"_all_{name}") for name, (how, c) in totals.items()))
    carried = parts.select(*by, "_r", *(how(f"_all_{name}").over(earlier).alias(f"_in_{name}") for name, (how, _) in totals.items()))
    local = rows.withColumns({name: how(c).over(inside) for name, (how, c) in totals.items()})
    out = joined(local, carried, [*by, "_r"])
    return out.withColumns({name: combine[how](F.col(name), F.col(f"_in_{name}")) for name, (how, _) in totals.items()}).drop("_r", *(f"_in_{name}" for name in totals))


def mean_ranks(df: DataFrame, by: list[str], value: str, count: str, out: str) -> DataFrame:
    """Rows (by, value, count), one for each distinct value, with the mean rank that count equal values share, from 1."""
    return running(df, by, value, {"_upto": (F.sum, count)}).withColumn(out, F.col("_upto") - (F.col(count) - 1) / 2).drop("_upto")


def median_distances(df: DataFrame, by: list[str], subject: str, value: str) -> DataFrame:
    """by, subject and median_distance: the median of a subject's distances to all others of its group; one value for each subject, null ones left out.

    The k nearest others of a value are neighbours in order: of all runs of k + 1 values, the one whose middle the value
    lies next to. So values are numbered, each is joined with the one k places on, and every value looks up the next
    middle above and below by running extremes: no pairs, no group in one task, and exact. A subject alone has no row.
    """
    # value + 0.0 turns a negative zero into zero, so that equal values are one
    values = df.select(*by, subject, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where("_v is not null and not isnan(_v)")
    place = numbered(values, [*by, "_v", subject])
    sizes = place.groupBy(*by).agg(F.count("*").alias("_n"), F.min("i").alias("_first")).where("_n > 1")
    place = written(joined(place, sizes, by).withColumn("i", F.col("i") - F.col("_first")).drop("_first"), "places")
    # the median of n - 1 distances is the mean of the two in the middle, which may be the same one
    middles = F.explode(F.array_distinct(F.array(F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2))))
    each = place.withColumn("_k", middles)
    ends = place.select(*by, F.col("i").alias("_e"), F.col("_v").alias("_end"))
    runs = joined(each.withColumn("_e", F.col("i") + F.col("_k")), ends, [*by, "_e"])
    # one row for each middle and for each value asked for, however many share it
    runs = runs.groupBy(*by, "_k", ((F.col("_v") + F.col("_end")) / 2).alias("_at")).agg(F.max("_v").alias("_low"), F.min("_end").alias("_high"))
    asked = each.select(*by, "_k", F.col("_v").alias("_at"), F.lit(True).alias("_asked")).distinct()
    both = running(runs.unionByName(asked, allowMissingColumns=True), [*by, "_k"], "_at", {"_below": (F.max, "_low")})
    both = running(both, [*by, "_k"], "_at", {"_above": (F.min, "_high")}, backwards=True).where("_asked")
    nearest = F.least(F.col("_at") - F.col("_below"), F.col("_above") - F.col("_at"))
    found = both.groupBy(*by, F.col("_at").alias("_v")).agg(F.avg(nearest).alias("median_distance"))
    return joined(place.select(*by, subject, "_v"), found, [*by, "_v"]).drop("_v")


def medians(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """by and the median of each column under its new name, nulls and NaN left out; a group without any value has no row.

    Values of all columns are numbered in one order and the middle ones looked up, so no task holds a group.
    """
    values = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns.values()))).alias("_c", "_v")
    place = numbered(df.select(*by, values).where("_v is not null and not isnan(_v)"), [*by, "_c", "_v"])
    sizes = place.groupBy(*by, "_c").agg(F.count("*").alias("_n"), F.min("i").alias("_first"))
    at = F.col("i") - F.col("_first")
    middle = joined(place, sizes, [*by, "_c"]).where((at >= F.floor((F.col("_n") - 1) / 2)) & (at <= F.floor(F.col("_n") / 2)))
    found = middle.groupBy(*by, "_c").agg(F.avg("_v").alias("_m"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_c") == k, F.col("_m"))).alias(name) for k, name in enumerate(columns)))


def permuted_vectors(df: DataFrame, key: list[str], columns: list[str], shuffled: Column) -> DataFrame:
    """key and columns, in which whole vectors of columns have changed places among all rows: the vector that is i-th by shuffled, then by key, stands at the row that is i-th by key. key must be unique."""
    place = numbered(df.select(*key), key)
    moved = numbered(df.select(*columns, *(F.col(c).alias(f"_key_{c}") for c in key), shuffled.alias("_h")), ["_h", *(f"_key_{c}" for c in key)])
    return place.join(moved.select("i", *columns), "i").drop("i")
