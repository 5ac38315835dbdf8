"""Per-subject sequences: axes, lags, sliding means, fills, interpolation, selection and thinning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window, WindowSpec


def ordered(by: list[str], *order) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def session_axis(df: DataFrame, by: str, date: str, tie: str) -> DataFrame:
    """Adds session (from 0, by date and tie), day (whole days since the subject's first date) and gap (days to the next one)."""
    w = ordered([by], date, tie)
    day = F.datediff(F.col(date).cast("date"), F.min(F.col(date).cast("date")).over(Window.partitionBy(by)))
    out = df.withColumns({"session": F.row_number().over(w) - 1, "day": day})
    return out.withColumn("gap", F.lead("day").over(w) - F.col("day"))


def range_mean(df: DataFrame, by: list[str], day: str, value: str, width: int, mode: str = "centered") -> Column:
    """Mean over [day - width/2, day + width/2], both ends included, or over the width days that end with day."""
    low, high = (-(width // 2), width // 2) if mode == "centered" else (-(width - 1), 0)
    return F.avg(value).over(ordered(by, day).rangeBetween(low, high))


def rolling_mean(by: list[str], order: list[str], value: str, rows: int = 7) -> Column:
    return F.avg(value).over(ordered(by, *order).rowsBetween(-(rows - 1), 0))


def rolling_any(by: list[str], order: list[str], flag: Column, rows: int = 7) -> Column:
    return F.max(flag.cast("int")).over(ordered(by, *order).rowsBetween(-(rows - 1), 0))


def previous(by: list[str], order: list[str], value: str, first) -> Column:
    return F.lag(value, 1, first).over(ordered(by, *order))


def elapsed(df: DataFrame, by: list[str], order: list[str], gap: str) -> DataFrame:
    """Adds previous_gap (0 first) and elapsed, its running sum; a missing gap counts as 1 and a negative one as 0."""
    w = ordered(by, *order)
    clean = F.greatest(F.coalesce(gap, F.lit(1)), F.lit(0))
    out = df.withColumn("previous_gap", F.lag(clean, 1, 0).over(w))
    return out.withColumn("elapsed", F.sum("previous_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def forward_fill(by: list[str], order: list[str], value: str, default=0.0) -> Column:
    """The last value that isn't null, up to this row; default before any."""
    return F.coalesce(F.last(value, ignorenulls=True).over(ordered(by, *order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(default))


def interpolated_rows(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds value interpolated by row number between its neighbours, held beyond the ends, then the column's mean, then 0."""
    w = ordered(by, *order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumn("_i", F.row_number().over(w))
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    rows = rows.withColumns({"_p": F.last(point, ignorenulls=True).over(back), "_q": F.first(point, ignorenulls=True).over(ahead), "_mean": F.avg(value).over(Window.partitionBy(*by))})
    between = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / F.nullif(F.col("_q.i") - F.col("_p.i"), F.lit(0))
    held = F.coalesce(between, F.col("_p.v"), F.col("_q.v"), F.col("_mean"), F.lit(0.0))
    return rows.withColumn(out, held).drop("_i", "_p", "_q", "_mean")


def interpolated_time(axis: DataFrame, points: DataFrame, by: list[str], time: str, value: str, out: str, least: int = 2) -> DataFrame:
    """axis with value interpolated by time between a subject's points, flat beyond them; subjects of fewer than least points go.

    Points of one time are averaged. Axis and points go through one shuffle together.
    """
    p = points.where(F.col(value).isNotNull()).groupBy(*by, time).agg(F.avg(value).alias("_v"))
    both = axis.withColumn("_axis", F.lit(True)).unionByName(p.select(*by, time, F.struct(F.col(time).alias("t"), F.col("_v").alias("v")).alias("_point")), allowMissingColumns=True)
    w = ordered(by, time)
    back, ahead = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"_p": F.last("_point", ignorenulls=True).over(back), "_q": F.first("_point", ignorenulls=True).over(ahead), "_n": F.count("_point").over(Window.partitionBy(*by))})
    between = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col(time) - F.col("_p.t")) / F.nullif(F.col("_q.t") - F.col("_p.t"), F.lit(0))
    return both.where(F.col("_axis") & (F.col("_n") >= least)).select(*axis.columns, F.coalesce(between, F.col("_p.v"), F.col("_q.v")).alias(out))


def shifted_sum(by: list[str], order: list[str], value: str) -> Column:
    """The sum of all earlier rows; 0 first."""
    return F.coalesce(F.sum(value).over(ordered(by, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def prior_mean(by: list[str], order: list[str], value: str) -> Column:
    """The mean of strictly earlier rows; null first."""
    return F.avg(value).over(ordered(by, *order).rowsBetween(Window.unboundedPreceding, -1))


def last_per_group(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row per group: the first by the given descending order, which must be total."""
    return df.withColumn("_k", F.row_number().over(ordered(by, *order))).where("_k = 1").drop("_k")


def circular_shift(df: DataFrame, by: list[str], order: list[str], value: str, shift: Column, out: str) -> DataFrame:
    """Adds the value that stands shift places later in the subject's sequence, around its end."""
    w = ordered(by, *order)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    moved = rows.select(*by, F.col("_i").alias("_j"), F.col(value).alias(out))
    return rows.withColumn("_j", F.pmod(F.col("_i") + shift, F.col("_n"))).join(moved, [*by, "_j"]).drop("_i", "_n", "_j")


def next_session_available(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds available and available_flag: what was measured at one session is an input from the next one on."""
    w = ordered(by, *order)
    return df.withColumns({"available": F.lag(value).over(w), "available_flag": F.coalesce(F.lag(F.col(value).isNotNull().cast("int")).over(w), F.lit(0))})


@F.pandas_udf(ArrayType(LongType()))
def _walked(days: pd.Series, cadence: pd.Series) -> pd.Series:
    """The days kept of each sorted array: a walk that looks up the next one, its state being where it stands."""

    def one(d: np.ndarray, least: int) -> list[int]:
        out, at = [], 0
        while at < len(d):
            out.append(int(d[at]))
            at = int(np.searchsorted(d, d[at] + least))
        return out

    return pd.Series([one(np.asarray(d, np.int64), int(c)) for d, c in zip(days, cadence, strict=True)])


def thinned(df: DataFrame, by: list[str], day: str, cadence: int) -> DataFrame:
    """Adds retained: whether the row's day is kept when days are walked in order and each must lie cadence days after the last kept.

    A subject's distinct days, which the calendar bounds, are one sorted array; a walk takes a step for each kept day.
    """
    days = df.where(F.col(day).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(F.col(day).cast("long"))).alias("_days"))
    walk = _walked("_days", F.lit(max(1, cadence))).cast(f"array<{dict(df.dtypes)[day]}>")
    kept = days.select(*by, F.explode(walk).alias(day)).withColumn("retained", F.lit(True))
    return df.join(kept, [*by, day], "left").withColumn("retained", F.coalesce("retained", F.lit(False)))


def evaluation_roles(df: DataFrame, by: list[str], day: str, cadence: int, start: str = "window_start", end: str = "window_end", among: list[str] | None = None) -> DataFrame:
    """Adds evaluation_role: retained at that cadence, else withheld_ineligible_overlap where the row's closed window meets
    the window of a retained row of the same group, else withheld_eligible.

    Rows are thinned by the columns in by; windows are held against those of retained rows that agree in among, which
    are all of by unless it says less: then a measurement counts as known where another instrument recalls its days.
    Windows end in the order of days, so the latest end up to the row and the earliest start from it on decide; no pairs
    are formed.
    """
    rows = thinned(df, by, day, cadence)
    w = Window.partitionBy(*(by if among is None else among)).orderBy(day)
    # rows of the same group and day are retained together, so a withheld row never meets itself
    before = F.max(F.when(F.col("retained"), F.col(end))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("retained"), F.col(start))).over(w.rangeBetween(0, Window.unboundedFollowing))
    met = F.coalesce(before >= F.col(start), F.lit(False)) | F.coalesce(after <= F.col(end), F.lit(False))
    role = F.when(F.col("retained"), "retained").when(F.col("_met"), "withheld_ineligible_overlap").otherwise("withheld_eligible")
    return rows.withColumn("_met", met).withColumn("evaluation_role", role).drop("_met", "retained")


def custom_order(column: str, names: list[str]) -> Column:
    """A sort key that puts names in their given order, others after them."""
    at = F.array_position(F.array(*(F.lit(n) for n in names)), F.col(column))
    return F.when(at == 0, len(names) + 1).otherwise(at)
