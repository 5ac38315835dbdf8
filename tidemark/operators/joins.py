"""Joins: validated, as-of, carried forward, interval, paired."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def require_unique(df: DataFrame, on: list[str], what: str) -> None:
    if df.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError(f"{what}: keys {on} are not unique")


def join_validated(left: DataFrame, right: DataFrame, on: list[str], validate: str = "many_to_one") -> DataFrame:
    """An inner equi-join after its declared cardinality is found to hold; else ValueError."""
    if validate in ("many_to_one", "one_to_one"):
        require_unique(right, on, "right side")
    if validate in ("one_to_many", "one_to_one"):
        require_unique(left, on, "left side")
    return left.join(right, on, "inner")


def left_fill(left: DataFrame, right: DataFrame, on: list[str], fill: float = 0) -> DataFrame:
    """A left join in which the right side's columns are filled where it has no row."""
    new = [c for c in right.columns if c not in on]
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(fill).cast(right.schema[c].dataType)) for c in new})


def semi_filter(df: DataFrame, cohort: DataFrame, on: list[str]) -> DataFrame:
    return df.join(cohort.select(*on), on, "left_semi")


def anti_filter(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    return df.join(seen.select(*on), on, "left_anti")


def asof_strict_prior(sessions: DataFrame, notes: DataFrame, by: str, time: str, payload: list[str], fill: float = 0.0) -> DataFrame:
    """sessions with the payload of the same subject's latest note of a strictly earlier time.

    Adds note_time, staleness, observed, and the payload, filled where there is no earlier note. Sessions and notes go
    through one shuffle together: the note is the last one in a range frame that ends one time unit before the
    session, so no pair is ever made. Times are whole numbers; notes of one time count as their mean.
    """
    kept = [c for c in sessions.columns]
    note = notes.groupBy(by, time).agg(*(F.avg(c).alias(c) for c in payload))
    note = note.select(F.col(by), F.col(time), F.struct(F.col(time).alias("note_time"), *(F.col(c) for c in payload)).alias("_note"))
    both = sessions.withColumn("_session", F.lit(True)).unionByName(note, allowMissingColumns=True)
    frame = Window.partitionBy(by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_last", F.last("_note", ignorenulls=True).over(frame)).where("_session")
    return found.select(
        *kept,
        F.col("_last.note_time").alias("note_time"),
        (F.col(time) - F.col("_last.note_time")).alias("staleness"),
        F.col("_last").isNotNull().alias("observed"),
        *(F.coalesce(F.col(f"_last.{c}"), F.lit(fill)).alias(c) for c in payload),
    )


def carried_flags(sessions: DataFrame, events: DataFrame, by: str, time: str, flags: dict[str, Column]) -> DataFrame:
    """sessions with each flag that any strictly earlier event of the subject raised, and whether there was any event.

    Later sessions keep what earlier ones had; a subject without history has 0 throughout.
    """
    kept = sessions.columns
    raised = events.select(by, time, *(c.cast("int").alias(n) for n, c in flags.items())).groupBy(by, time).agg(*(F.max(n).alias(n) for n in flags))
    both = sessions.withColumn("_session", F.lit(True)).unionByName(raised.withColumn("_event", F.lit(1)), allowMissingColumns=True)
    frame = Window.partitionBy(by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    over = {n: F.coalesce(F.max(n).over(frame), F.lit(0)) for n in flags} | {"history": F.coalesce(F.max("_event").over(frame), F.lit(0))}
    out = both.withColumns({f"_{n}_before": c for n, c in over.items()}).where("_session")
    return out.select(*kept, *(F.col(f"_{n}_before").alias(n) for n in over))


def carried_categories(sessions: DataFrame, events: DataFrame, by: str, time: str, categories: str, names: list[str], base: str) -> DataFrame:
    """carried_flags for the names in each event's array of categories, and others: how many besides base are raised."""
    out = carried_flags(sessions, events, by, time, {n: F.coalesce(F.array_contains(categories, n), F.lit(False)) for n in names})
    return out.withColumn("others", reduce(lambda a, b: a + b, (F.col(n) for n in names if n != base), F.lit(0)))


def window_means(targets: DataFrame, series: DataFrame, by: str, time: str, value: str, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """targets with the mean of series over each one's closed window, its number of values; targets without any go, repeated ones come as often as they stand.

    Each window is spread over its days, which bounds the join by the windows' lengths and keeps it an equi-join.
    """
    keyed = targets.groupBy(*targets.columns).agg(F.count("*").alias("_times")).withColumn("_target", F.struct(*targets.columns, "_times"))
    days = keyed.select(by, "_target", F.explode(F.sequence(start, end)).alias(time))
    daily = series.groupBy(by, time).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    found = days.join(daily, [by, time]).groupBy("_target").agg((F.sum("_s") / F.sum("_n")).alias("window_mean"), F.sum("_n").alias("window_n"))
    each = found.where("window_n > 0").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_target._times"))))
    return each.select(*(F.col(f"_target.{c}") for c in targets.columns), "window_mean", "window_n")


def overlapping(rows: DataFrame, targets: DataFrame, by: str, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """The rows whose closed window meets a target's of the same subject."""
    t = targets.select(F.col(by).alias("_by"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    return rows.join(t, (rows[by] == F.col("_by")) & (rows[start] <= F.col("_e")) & (rows[end] >= F.col("_s")), "left_semi")


def paired(df: DataFrame, on: list[str], arm: str, left: str, right: str, metrics: list[str]) -> DataFrame:
    """Differences left minus right of each metric, for keys that both arms have; one shuffle, no self-join."""
    pick = lambda m, a: F.max(F.when(F.col(arm) == a, F.col(m)))
    have = lambda a: F.max((F.col(arm) == a).cast("int"))
    both = df.where(F.col(arm).isin(left, right)).groupBy(*on).agg(*(pick(m, a).alias(f"{m}_{k}") for m in metrics for k, a in (("l", left), ("r", right))), have(left).alias("_l"), have(right).alias("_r"))
    return both.where("_l = 1 and _r = 1").select(*on, *((F.col(f"{m}_l") - F.col(f"{m}_r")).alias(f"delta_{m}") for m in metrics))


def config_cross(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row under every setting of a small grid; the grid is given by its caller and bounded by it."""
    return df.crossJoin(F.broadcast(grid))


def densified(df: DataFrame, by: str, time: str) -> DataFrame:
    """One row for each subject and each time between its first and its last, with nulls where df has none."""
    axis = df.groupBy(by).agg(F.min(time).alias("_a"), F.max(time).alias("_b")).select(by, F.explode(F.sequence("_a", "_b")).alias(time))
    return axis.join(df, [by, time], "left")


@F.pandas_udf(DoubleType())
def _middle_gap(values: pd.Series) -> pd.Series:
    """Median of y - x over all pairs x <= y of a sorted array, by halving: pairs within a gap are counted, never formed."""

    def smallest(v: np.ndarray, k: int) -> float:
        low, high, own = -1.0, float(v[-1] - v[0]), np.arange(len(v))
        while True:
            middle = low + (high - low) / 2
            if middle <= low or middle >= high or high - low <= 1e-15 * high:
                return max(high, 0.0)
            within = int((np.searchsorted(v, v + middle, side="right") - 1 - own).sum())
            low, high = (low, middle) if within >= k else (middle, high)

    def one(v: np.ndarray) -> float:
        pairs = len(v) * (len(v) - 1) // 2
        first = smallest(v, (pairs + 1) // 2)
        return first if pairs % 2 else (first + smallest(v, pairs // 2 + 1)) / 2

    return pd.Series([one(np.asarray(v, dtype=float)) for v in values])


def median_difference(df: DataFrame, bucket: list[str], subject: str, value: str) -> DataFrame:
    """Per bucket the median of |x - y| over all pairs of different subjects (each subject once), and the number of subjects.

    A bucket's values make one sorted array of eight bytes a subject; time grows with n log n. Null and NaN values take no part.
    """
    one = df.groupBy(*bucket, subject).agg(F.avg(value).alias("_v")).where("_v is not null and not isnan(_v)").groupBy(*bucket).agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    return one.where(F.size("_all") >= 2).select(*bucket, F.size("_all").cast("long").alias("subjects"), _middle_gap("_all").alias("median_difference"))


def profile_swapped(rows: DataFrame, profiles: DataFrame, by: str, day: str, order: str, columns: list[str]) -> DataFrame:
    """rows with columns taken from the last profile (by order) of the same subject and day; rows without one go."""
    last = profiles.withColumn("_k", F.row_number().over(Window.partitionBy(by, day).orderBy(F.desc(order)))).where("_k = 1")
    return rows.drop(*columns).join(last.select(by, day, *columns), [by, day])


def compared_to_reference(stored: DataFrame, recomputed: DataFrame, on: list[str], metrics: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Per key (null keys are equal) and metric whether a stored aggregate is what a recomputation gives."""
    s, r = stored.alias("s"), recomputed.alias("r")
    same = None
    for c in on:
        one = F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = one if same is None else same & one
    ok = lambda m: F.coalesce(F.abs(F.col(f"s.{m}") - F.col(f"r.{m}")) <= tolerance, F.col(f"s.{m}").eqNullSafe(F.col(f"r.{m}")))
    return s.join(r, same).select(*(F.col(f"s.{c}") for c in on), *(ok(m).alias(f"{m}_ok") for m in metrics))
