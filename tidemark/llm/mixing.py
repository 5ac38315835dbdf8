"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions alone.

A source's share of the mix changes over training time t in [0, 1] by a schedule of knots (t, weight), linear between
them. Its integral, made to end at 1, is the part of the source's words that training has asked for by time t. The
inverse of that gives each word, and so each document, its training position: the document whose words stand at part u
of the source's demand is read when the integral reaches u. Documents are then sorted by position over ranges.

Sources are few beside documents but may be many, and one may hold most documents: places within a source come from
hashed slots, each of bounded size, and sums over slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, shuffle_partitions

#: Weights of the sources in their order, repeating; all that the mix takes, as a part of all words; how often a document is taken at most.
WEIGHTS, TOTAL, REPEATS = (5, 2, 1), 1.5, 2
#: Schedules of the sources in their order, repeating: knots of time and weight.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Documents that one slot holds on average.
SLOT = 64
WORD = r"[^\x20\x09-\x0D]+"


def words(column: str = "text") -> Column:
    """Number of words; null has none. Each word's first byte is counted, which needs no array."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def ordered(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, ... by code point, null last. Slots by range keep the order; each is ranked on its own."""
    parts = materialize(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source").withColumn("slot", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("slot").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("source").isNull(), "source"))
    return parts.withColumn("inside", inside).join(sizes.select("slot", "before"), "slot").withColumn("place", F.col("before") + F.col("inside") - 1).drop("slot", "inside", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: float = REPEATS) -> DataFrame:
    """source, source_size, place, weight and target of each source.

    Targets share total times all words by weight. One that is above repeats times its source's size stops there, and
    what it leaves is shared by the others by weight, until none is above. Only sums reach the driver; each round of
    sharing is one of them.
    """
    array = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ordered(sizes).withColumn("weight", F.element_at(array, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = materialize(ranked.withColumn("most", F.col("source_size") * F.lit(float(repeats))), "ranked")
    asked = total * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    share, stopped = 0.0, -1
    while True:
        full = F.col("most") < F.col("weight") * share
        row = ranked.agg(F.sum(F.when(full, F.col("most"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("full")).first()
        if row["full"] == stopped or not row["weight"]:
            break
        stopped, share = row["full"], (asked - (row["held"] or 0.0)) / row["weight"]
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.lit(share)))


def position(part: Column, place: Column, schedules=SCHEDULES) -> Column:
    """When a source's demand reaches the given part: the inverse of its schedule's integral, piece by piece."""
    def inverse(knots):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots[:-1], knots[1:], strict=True)]
        whole, out, before = sum(areas), F.lit(float(knots[-1][0])), sum(areas)
        for (a, b), area in reversed(list(zip(zip(knots[:-1], knots[1:], strict=True), areas, strict=True))):
            before -= area
            rest = part * whole - before
            slope = (b[1] - a[1]) / (b[0] - a[0])
            # weight * t + slope / 2 * t * t = rest, in a form that holds for a slope of 0
            root = F.sqrt(F.greatest(F.lit(a[1] * a[1]) + 2 * slope * rest, F.lit(0.0)))
            t = F.lit(a[0]) + 2 * rest / F.greatest(root + a[1], F.lit(1e-300))
            out = F.when(rest <= area, F.least(t, F.lit(b[0]))).otherwise(out)
        return out

    out = inverse(schedules[0])
    for k, knots in enumerate(schedules[1:], 1):
        out = F.when(place % len(schedules) == k, inverse(knots)).otherwise(out)
    return out


def _placed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, size, source_size, target, place and at for each row of docs: at is the number of its source's words before it."""
    # a null source is a key of its own, so that plain keys serve the window and the joins alike; a null id's place comes from its text
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none"), words().alias("size"), digest.alias("digest"), F.xxhash64("text").alias("tie"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    rows = materialize(rows, "sizes") if not keep else rows
    n = rows.count() if not keep else docs.count()
    bits = max(4, math.ceil(math.log2(max(n, 1) / SLOT)))
    # the slot is the digest's beginning: slots are in the order of digests
    slotted = rows.withColumn("slot", F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - bits))
    sums = materialize(slotted.groupBy("key", "none", "slot").agg(F.sum("size").alias("n")), "slots")
    named = F.when(~F.col("none"), F.col("key")).alias("source")
    total = targets(sums.groupBy("key", "none").agg(F.sum("n").alias("source_size")).select("key", "none", named, "source_size"))
    # sums over slots, in two levels: a source has many slots
    own, high = ["key", "none"], bits // 2
    upper = sums.groupBy(*own, F.shiftright("slot", high).alias("upper")).agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*own).orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(*own, "upper", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("above"))
    over = Window.partitionBy(*own, "upper").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    lower = sums.withColumn("upper", F.shiftright("slot", high)).withColumn("below", F.coalesce(F.sum("n").over(over), F.lit(0)))
    starts = lower.join(upper, [*own, "upper"]).select(*own, "slot", (F.col("above") + F.col("below")).alias("start"))
    starts = materialize(starts.join(total.drop("source"), own).select(*own, "slot", "start", "source_size", "target", "place"), "starts")
    over = Window.partitionBy(*own, "slot").orderBy("digest", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = slotted.withColumn("inside", F.coalesce(F.sum("size").over(over), F.lit(0))).join(starts, [*own, "slot"])
    return placed.select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in keep), "size", "source_size", "target", "place", (F.col("start") + F.col("inside")).alias("at"))


def _pass(k: Column | int) -> tuple[Column, Column]:
    """Words that the k-th pass over a source takes of a document, and the training position at which it does."""
    at = F.lit(k) * F.col("source_size") + F.col("at")
    took = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - at)).cast("long")
    return took, F.when(took > 0, position(F.least(at / F.col("target"), F.lit(1.0)), F.col("place")))


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    """rows in the order of by over ranges, nulls last."""
    keys = [F.col(c).asc_nulls_last() for c in by]
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def mixed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and positions for each row of docs, besides the columns in keep, sorted by first position.

    docs needs doc_id, text and source; other columns are ignored. taken is the number of a document's words in the
    mix: once or twice its size, but for the one document of a source where the target ends, which is taken in part,
    from its start. positions has one entry for each time the document is read: a source that is read more than once
    runs through all of training, its second pass after its first. The order within a source is that of a digest of the
    id, then of the size and a hash of the text, so reruns agree also where an id repeats; null ids are ordered by a digest of the text. A null source is one of
    its own; null and empty texts have size 0 and are never taken. Repeated rows are documents of their own, and equal
    ones are alike. An empty table gives no rows. Sums are computed while the plan is built.
    """
    passes = [_pass(k) for k in range(REPEATS)]
    taken = passes[0][0]
    for took, _ in passes[1:]:
        taken = taken + took
    out = _placed(docs, keep).select("doc_id", *keep, "size", "source_size", "target", taken.alias("taken"), F.array_compact(F.array(*(p for _, p in passes))).alias("positions"))
    return _sorted(out.withColumn("position", F.get("positions", F.lit(0))), "position", "doc_id").drop("position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, columns as they came: in full once or twice, cut after some words, or not at all.

    Each time that a document is read is a row of its own, at the position of that pass; rows are sorted by position.
    """
    names = docs.columns
    rest = tuple(c for c in names if c != "doc_id")
    # clashing names: the operator's own columns and the kept ones never share a frame but here, under other names
    kept = {c: f"own_{k}" for k, c in enumerate(rest)}
    rows = _placed(docs.withColumns({v: F.col(c) for c, v in kept.items()}), tuple(kept.values()))
    passes = F.array(*(F.struct(took.alias("took"), p.alias("position")) for took, p in map(_pass, range(REPEATS))))
    out = rows.withColumn("passes", F.explode(F.filter(passes, lambda p: p["took"] > 0))).select("doc_id", *(F.col(v) for v in kept.values()), "size", "passes.took", "passes.position")
    text = F.col(kept["text"])
    head = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("took").cast("int")), "")
    out = _sorted(out.withColumn(kept["text"], F.when(F.col("took") < F.col("size"), F.concat(head, cut)).otherwise(text)), "position", "doc_id")
    own = {**{c: F.col(v) for c, v in kept.items()}, "doc_id": F.col("doc_id")}
    if "n_chars" in names:
        own["n_chars"] = F.length(text).cast("long")
    return out.select(*(own[c].alias(c) for c in names))
