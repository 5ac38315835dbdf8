"""Resampling, conformal intervals, multiplicity and classification outcomes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import draw
from tidemark.operators.ranges import joined, numbered, running
from tidemark.sources.tables import written


def bootstrap_draws(spark, n: int, replicates: int, salt: str) -> DataFrame:
    """(replicate, i, times): how often each of n subjects is drawn in each replicate; draws are hashes, so they can be repeated anywhere."""
    draws = spark.range(replicates * n).select((F.col("id") / n).cast("long").alias("replicate"), (F.col("id") % n).alias("d"))
    return draws.select("replicate", F.floor(draw(F.col("replicate"), F.col("d"), salt=salt) * n).alias("i")).groupBy("replicate", "i").agg(F.count("*").alias("times"))


def _intervals(each: DataFrame, alpha: float) -> DataFrame:
    """name, low, high and replicates of rows (name, _s), one for each replicate."""
    return each.groupBy("name").agg(F.percentile("_s", F.lit(alpha / 2)).alias("low"), F.percentile("_s", F.lit(1 - alpha / 2)).alias("high"), F.count("*").alias("replicates"))


def bootstrap_intervals(subjects: DataFrame, subject: str, statistics: dict[str, Column], replicates: int, salt: str = "", alpha: float = 0.05) -> DataFrame:
    """name, low, high and replicates: percentile intervals of several statistics over the same resampled subjects (one row each).

    A statistic may use times, a subject's number of draws. All of them are columns of one grouped sum, so they share
    their draws, which are hashes and made once; null values of a statistic count in none of its replicates. For any
    aggregate: each draw becomes a row. Where sums and medians do, resampled and intervals_of take a small part of the time.
    """
    rows = numbered(subjects, [subject])
    n = rows.count()
    per = bootstrap_draws(subjects.sparkSession, n, replicates, salt).join(rows, "i").groupBy("replicate").agg(*(v.alias(f"_s{k}") for k, v in enumerate(statistics.values())))
    each = per.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"_s{k}").cast("double").alias("_s")) for k, name in enumerate(statistics)))).alias("_e")).select("_e.*").where("_s is not null")
    return _intervals(each, alpha)


#: Draws that a task packs at once, most subjects of a block, and replicates that a block works on at once.
CHUNK, BLOCK, TOGETHER = 1 << 20, 8192, 128
#: An entry of a replicate's middle: column, value and how often it was drawn.
_ENTRY = np.dtype([("c", "<i4"), ("t", "<i4"), ("v", "<f8")])


def packed_draws(spark, n: int, replicates: int, salt: str, width: int) -> DataFrame:
    """(block, replicate, picks): the draws of bootstrap_draws, two bytes each: places within blocks of width subjects. A block has several rows of one replicate where a chunk of draws ends."""
    total = replicates * n
    draws = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, min(-(-total // (4 * CHUNK)), 8192)))
    draws = draws.select(F.expr(f"id div {max(n, 1)}").alias("r"), F.expr(f"id % {max(n, 1)}").alias("d")).select("r", F.floor(draw(F.col("r"), F.col("d"), salt=salt) * n).alias("i"))
    blocks = -(-n // width)

    def packed(r: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        key = np.sort(r * (blocks * width) + i)
        group = key // width
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        offsets = np.append(starts, len(key)).astype(np.int32) * 2
        picks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer((key % width).astype("<u2"))])
        first = group[starts]
        return pa.RecordBatch.from_arrays([pa.array((first % blocks).astype(np.int32)), pa.array((first // blocks).astype(np.int32)), picks], ["block", "replicate", "picks"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("r").to_numpy(), batch.column("i").to_numpy()))
                size += batch.num_rows
            if size >= CHUNK:
                yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return draws.mapInArrow(run, "block int, replicate int, picks binary")


def _middle(entries: np.ndarray, total: np.ndarray, below: np.ndarray) -> tuple[list, int]:
    """A replicate's median of each column from the values within its bounds, how many draws it has and how many lie below; None without any, and how many medians lie outside."""
    entries = entries[np.lexsort((entries["v"], entries["c"]))]
    ends = np.searchsorted(entries["c"], np.arange(len(total) + 1))
    found, missed = [], 0
    for c, (all_, low) in enumerate(zip(total, below, strict=True)):
        upto = low + np.cumsum(entries["t"][ends[c] : ends[c + 1]], dtype=np.int64)
        first, last = (all_ - 1) // 2, all_ // 2
        if not all_:
            found.append(None)
        elif first < low or not len(upto) or last >= upto[-1]:
            found.append(None)
            missed += 1
        else:
            v = entries["v"][ends[c] : ends[c + 1]]
            found.append(float((v[np.searchsorted(upto, first, "right")] + v[np.searchsorted(upto, last, "right")]) / 2))
    return found, missed


def _resample(rows: DataFrame, n: int, sums: list[str], medians: list[str], bounds: np.ndarray, replicates: int, salt: str) -> DataFrame:
    """replicate, sums, medians and missed of rows numbered by i; bounds are each median column's lowest and highest value that is kept by itself."""
    width = min(BLOCK, max(256, -(-n // 64)))
    k, m = len(sums), len(medians)
    left = packed_draws(rows.sparkSession, n, replicates, salt, width)
    right = rows.select(F.expr(f"cast(i div {width} as int)").alias("block"), F.expr(f"cast(i % {width} as int)").alias("at"), *sums, *medians)

    def meet(draws: pa.Table, own: pa.Table) -> pa.Table:
        out = {"replicate": [], "sums": [], "inside": []}
        if draws.num_rows and own.num_rows:
            column = lambda c, missing: np.asarray(own.column(c).fill_null(missing).combine_chunks())
            place = column("at", 0)
            x, v = np.zeros((width, k + 2 * m)), np.full((width, m), np.nan)
            for j, c in enumerate(sums):
                x[place, j] = column(c, 0.0)
            for j, c in enumerate(medians):
                v[place, j] = column(c, np.nan)
            x[:, k : k + m], x[:, k + m :] = ~np.isnan(v), v < bounds[0]
            inside = []
            for j in range(m):
                at = np.flatnonzero((v[:, j] >= bounds[0, j]) & (v[:, j] <= bounds[1, j]))
                at = at[np.argsort(v[at, j], kind="stable")]
                inside.append((at, np.flatnonzero(np.diff(v[at, j], prepend=np.nan) != 0)))
            order = np.argsort(column_of(draws, "replicate"), kind="stable")
            draws = draws.take(pa.array(order)).combine_chunks()
            replicate = column_of(draws, "replicate")
            picks = draws.column("picks").chunk(0)
            ends = np.frombuffer(picks.buffers()[1], np.int32)[picks.offset : picks.offset + len(picks) + 1] // 2
            flat = np.frombuffer(picks.buffers()[2], "<u2")
            names, starts = np.unique(replicate, return_index=True)
            starts = np.append(starts, len(replicate))
            for a in range(0, len(names), TOGETHER):
                b = min(a + TOGETHER, len(names))
                low, high = starts[a], starts[b]
                which = np.repeat(np.searchsorted(names[a:b], replicate[low:high]), np.diff(ends[low : high + 1]))
                times = np.bincount(which * width + flat[ends[low] : ends[high]], minlength=(b - a) * width).reshape(b - a, width)
                out["sums"] += list(times.astype(float) @ x)
                each = [[] for _ in range(a, b)]
                for j, (at, firsts) in enumerate(inside):
                    if len(at):
                        counted = np.add.reduceat(times[:, at], firsts, axis=1)
                        for r, q in enumerate(counted):
                            e = np.flatnonzero(q)
                            made = np.empty(len(e), _ENTRY)
                            made["c"], made["t"], made["v"] = j, q[e], v[at[firsts[e]], j]
                            each[r].append(made)
                out["inside"] += [np.concatenate(e).tobytes() if e else b"" for e in each]
            out["replicate"] = names.tolist()
        return pa.table({"replicate": pa.array(out["replicate"], pa.int32()), "sums": pa.array(out["sums"], pa.list_(pa.float64())), "inside": pa.array(out["inside"], pa.binary())})

    def finish(parts: pa.Table) -> pa.Table:
        total = np.sum(np.stack(parts.column("sums").to_pylist()), axis=0) if k + m else np.zeros(0)
        entries = np.frombuffer(b"".join(parts.column("inside").to_pylist()), _ENTRY)
        counts = np.rint(total[k:]).astype(np.int64)
        found, missed = _middle(entries, counts[:m], counts[m:])
        return pa.table({"replicate": parts.column("replicate")[:1], "sums": pa.array([total[:k]], pa.list_(pa.float64())), "medians": pa.array([found], pa.list_(pa.float64())), "missed": pa.array([missed], pa.int32())})

    column_of = lambda t, c: np.asarray(t.column(c).combine_chunks())
    met = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(meet, "replicate int, sums array<double>, inside binary")
    return met.groupBy("replicate").applyInArrow(finish, "replicate int, sums array<double>, medians array<double>, missed int")


def resampled(subjects: DataFrame, subject: str, sums: dict[str, Column], medians: list[str], replicates: int, salt: str = "", roots: float = 3.0) -> DataFrame:
    """replicate, the sum of each of sums and the median of each of medians, over resampled subjects (one row each), one row a replicate.

    A subject counts as often as it is drawn. Null adds 0 to a sum; null and NaN count in no median, which is null without
    any value. Draws are those of bootstrap_draws. They are packed by blocks of subjects and meet them there: counts times
    columns give a block's sums for all replicates. Resampled medians lie within a few roots of n ranks of the middle (roots), so
    between two approximate quantiles values are kept, below them only counted; where a replicate's median lies outside
    after all, all of it is done again with wider bounds. What a task holds is a block's draws, or a replicate's middle.
    """
    names = [f"_x{j}" for j in range(len(sums))], [f"_v{j}" for j in range(len(medians))]
    rows = subjects.select(subject, *(v.cast("double").alias(c) for c, v in zip(names[0], sums.values(), strict=True)), *(F.col(f"`{v}`").cast("double").alias(c) for c, v in zip(names[1], medians, strict=True)))
    rows = numbered(rows, [subject])
    usable = {c: F.when(~F.isnan(c), F.col(c)) for c in names[1]}
    size = rows.agg(F.count("*").alias("n"), *(F.count(v).alias(c) for c, v in usable.items())).first()
    while True:
        reach = {c: min(roots / np.sqrt(max(size[c], 1)), 0.5) for c in names[1]}
        edges = rows.agg(*(F.percentile_approx(usable[c], [0.5 - w, 0.5 + w], 100_000).alias(c) for c, w in reach.items())).first() if medians else None
        # a range that reaches the ends is open
        bounds = np.array([edges[c] if edges[c] is not None and reach[c] < 0.5 else [-np.inf, np.inf] for c in names[1]]).reshape(-1, 2).T
        found = written(_resample(rows, size["n"], *names, bounds, replicates, salt), "replicates")
        if not medians or not found.agg(F.sum("missed")).first()[0]:
            return found.select("replicate", *(F.get("sums", F.lit(j)).alias(c) for j, c in enumerate(sums)), *(F.get("medians", F.lit(j)).alias(c) for j, c in enumerate(medians)))
        roots *= 4


def intervals_of(replicates: DataFrame, statistics: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """name, low, high and replicates: percentile intervals of columns over rows of one replicate each; null counts in none."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), v.cast("double").alias("_s")) for name, v in statistics.items()))).alias("_e")
    return _intervals(replicates.select(each).select("_e.*").where("_s is not null"), alpha)


def _one(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.max("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.max("replicates"), F.lit(0)).cast("long").alias("replicates"))


def interval_of(replicates: DataFrame, statistic: Column, alpha: float = 0.05) -> DataFrame:
    """intervals_of for one statistic; no replicate with a value gives nulls."""
    return _one(intervals_of(replicates, {"": statistic}, alpha))


def ratio(a: str, b: str) -> Column:
    """The quotient of two sums, null where there is nothing to divide by."""
    return F.col(f"`{a}`") / F.nullif(F.col(f"`{b}`"), F.lit(0.0))


def bootstrap_medians(subjects: DataFrame, subject: str, columns: list[str], replicates: int, salt: str = "", alpha: float = 0.05) -> DataFrame:
    """name, low, high and replicates: percentile intervals of each column's median over resampled subjects (one row each); see resampled."""
    return intervals_of(resampled(subjects, subject, {}, columns, replicates, salt), {c: F.col(f"`{c}`") for c in columns}, alpha)


def bootstrap_interval(subjects: DataFrame, subject: str, statistic: Column, replicates: int, salt: str = "", alpha: float = 0.05) -> DataFrame:
    """Percentile interval of one statistic over resampled subjects; see bootstrap_intervals. No replicate with a value gives nulls."""
    return _one(bootstrap_intervals(subjects, subject, {"": statistic}, replicates, salt, alpha))


def conformal_quantile(df: DataFrame, by: list[str], subject: str, score: str, alpha: float) -> DataFrame:
    """Per group the quantile in which each subject has total weight 1; infinite where alpha asks for more than there is.

    Equal scores of a subject are counted first, then equal scores of a group; what is left runs over ranges of scores.
    """
    counted = df.groupBy(*by, subject, score).agg(F.count("*").alias("_c"))
    sizes = df.groupBy(*by, subject).agg(F.count("*").alias("_all"))
    weights = joined(counted, sizes, [*by, subject]).groupBy(*by, score).agg(F.sum(F.col("_c") / F.col("_all")).alias("_w"))
    totals = sizes.groupBy(*by).agg(F.count("*").cast("double").alias("_n")).withColumn("_r", (F.col("_n") + 1) * (1 - alpha))
    walked = joined(running(weights, by, score, {"_cum": (F.sum, "_w")}), totals, by)
    reach = F.min(F.when(F.col("_cum") >= F.col("_r") - 1e-9, F.col(score)))
    return walked.groupBy(*by).agg(F.when(F.max("_r") > F.max("_n"), F.lit(float("inf"))).otherwise(reach).alias("quantile"), F.max("_n").cast("long").alias("subjects"))


def holm(df: DataFrame, by: list[str], p: str, order: str) -> DataFrame:
    """df with Holm's step-down adjusted probability, at most 1."""
    w = Window.partitionBy(*by).orderBy(p, order)
    m = F.count("*").over(Window.partitionBy(*by))
    step = df.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    return step.withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def outcome_rates(df: DataFrame, by: list[str], subject: str, actual: str, predicted: str) -> DataFrame:
    """Subject-balanced accuracy, prevalence, sensitivity, specificity and balanced accuracy of a 0/1 prediction."""
    w = df.withColumn("_w", 1 / F.count("*").over(Window.partitionBy(*by, subject)))
    cell = lambda a, p: F.sum(F.when((F.col(actual) == a) & (F.col(predicted) == p), F.col("_w")).otherwise(0.0))
    g = w.groupBy(*by).agg(*(cell(a, p).alias(f"_{a}{p}") for a in (0, 1) for p in (0, 1)), F.count_distinct(subject).alias("subjects"))
    total, yes, no = F.col("_00") + F.col("_01") + F.col("_10") + F.col("_11"), F.col("_10") + F.col("_11"), F.col("_00") + F.col("_01")
    sens, spec = F.col("_11") / F.nullif(yes, F.lit(0.0)), F.col("_00") / F.nullif(no, F.lit(0.0))
    return g.select(*by, "subjects", ((F.col("_00") + F.col("_11")) / total).alias("accuracy"), (yes / total).alias("prevalence"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"))


def coverage_width(df: DataFrame, by: list[str], value: str, low: str, high: str, least: float, most: float) -> DataFrame:
    """Coverage and mean width of intervals, raw and clipped to the legal range, and the width's share of that range."""
    a, b = F.greatest(F.col(low), F.lit(least)), F.least(F.col(high), F.lit(most))
    return df.groupBy(*by).agg(F.avg(F.col(value).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width"), (F.avg(F.col(high) - F.col(low)) / (most - least)).alias("relative_width"), F.avg(F.greatest(b - a, F.lit(0.0))).alias("clipped_width"), F.count("*").alias("n"))
