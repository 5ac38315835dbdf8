"""What each filter removes, under every order of the filters: SQL folds over the cells of filters failed.

A document is known by the set of filters that it fails, a mask of five bits. Rows are counted by part and mask; each
such cell folds across the array of all orders, which the plan carries as a constant, and gives 600 structs weighted
by its counts; a part's cells, 32 at most, are added element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
#: Names of a step's counts.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

#: Characters that separate words, capitals, and marks that a text must not hold.
SPACES, CAPITALS, MARKS = r"[\x20\x09-\x0D]+", "[A-Z]", r"[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails filter A (under 200 words), B (less than half of its words distinct), C (over 2 % capitals), D (holds a mark)."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    # split once: the words' two sizes come from one array
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    bits = lambda s: (F.when(s["n"] < 200, 1).otherwise(0) + F.when(100 * s["distinct"] < 50 * s["n"], 2).otherwise(0))
    return F.transform(F.array(sizes), bits)[0] + F.when(100 * capitals > 2 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: rows of each source by the filters that they fail, and how many of them are labelled good or toxic.

    Filter E, bit 4, is failed by a row whose text stands under a smaller doc_id anywhere in the table; texts are told
    apart by their SHA-256. Rows that share text and doc_id fail or pass it together; a null doc_id is neither smaller
    nor larger, so it neither fails E nor makes others fail. A null source is the empty part, a null text the empty
    text. Of an id's several labels any 1 counts. Copies of a text are combined before they are shuffled; a text's
    rows meet only as one row for each source.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    # null ids meet no label and are spread by their texts
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    known = rows.join(flags.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    same = known.groupBy("digest", "part", "doc_id", "salt").agg(F.first("mask").alias("mask"), F.count("*").alias("n"), count("good"), count("toxic"))
    # null ids sort last, so that the least one is a number if there is any
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "good", "toxic")
    nothing = lambda c: F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"free_{c}")
    parts = same.groupBy("digest", "part").agg(F.first("mask").alias("mask"), F.min(own).alias("own"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")), *(nothing(c) for c in ("n", "good", "toxic")))
    first = F.min("own.doc_id").over(Window.partitionBy("digest"))
    owns = F.col("own.doc_id").isNotNull() & (F.col("own.doc_id") == F.col("first"))
    passes = {c: F.col(f"free_{c}") + F.when(owns, F.col(f"own.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), *(passes[c].alias(c) for c in passes)),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - passes[c]).alias(c) for c in passes)),
    ))
    cells = parts.withColumn("first", first).select("part", split.alias("_c")).select("part", "_c.*")
    return cells.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def orders() -> Column:
    """All orders of the filters as an array of arrays of bit numbers."""
    return F.array(*(F.array(*(F.lit(k) for k in order)) for order in permutations(range(len(FILTERS)))))


def _walk(cell: Column, order: Column) -> Column:
    """The five steps of one order for one cell: structs of its counts, by a fold whose state is whether the cell still stands."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(True).alias("stands"), F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>").alias("steps"))

    def step(state: Column, bit: Column) -> Column:
        fails = F.call_function("getbit", cell["mask"], bit) == 1
        gone = state["stands"] & fails
        only = cell["mask"] == F.call_function("shiftleft", F.lit(1), bit)
        counts = (
            F.when(state["stands"] & ~fails, cell["n"]).otherwise(zero), F.when(gone, cell["n"]).otherwise(zero), F.when(~state["stands"] & fails, cell["n"]).otherwise(zero),
            F.when(only, cell["n"]).otherwise(zero), F.when(gone, cell["good"]).otherwise(zero), F.when(gone, cell["toxic"]).otherwise(zero),
        )
        one = F.struct(*(v.alias(c) for c, v in zip(COUNTS, counts, strict=True)))
        return F.struct((state["stands"] & ~fails).alias("stands"), F.concat(state["steps"], F.array(one)).alias("steps"))

    return F.aggregate(order, start, step, lambda state: state["steps"])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order of the filters, 600 rows a part; see mask_cells for the filters.

    kept, removed and redundant split a part's rows by this step's filter; unique_fails fail no other filter;
    good_lost and toxic_lost are the labelled ones among removed; shapley is what the step's filter removes over all
    orders together. Tables without documents give no rows. A cell's fold takes 600 steps, however many rows it has.
    """
    every = orders()
    cell = mask_cells(docs, labels).withColumn("mask", F.col("mask").cast("int"))
    parts = cell.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    nothing = F.transform(F.sequence(F.lit(1), F.lit(600)), lambda _: F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)))
    unfolded = lambda c: F.flatten(F.transform(every, lambda order: _walk(c, order)))
    added = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(*((x[c] + y[c]).alias(c) for c in COUNTS)))
    summed = parts.select("part", F.aggregate("cells", nothing, lambda total, c: added(total, unfolded(c))).alias("steps"))
    # element i is step i % 5 of order i / 5
    bit = lambda i: F.get(F.get(every, F.floor(i / 5).cast("int")), (i % 5).cast("int"))
    tagged = summed.withColumn("steps", F.transform("steps", lambda s, i: F.struct(bit(i).alias("bit"), *(s[c].alias(c) for c in COUNTS))))
    share = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda b: F.aggregate("steps", F.lit(0).cast("long"), lambda total, s: total + F.when(s["bit"] == b, s["removed"]).otherwise(F.lit(0).cast("long"))))
    rows = tagged.withColumn("share", share).select("part", "share", F.posexplode("steps").alias("i", "s"))
    names = F.array(*(F.lit("".join(FILTERS[k] for k in order)) for order in permutations(range(len(FILTERS)))))
    return rows.select("part", F.get(names, F.floor(F.col("i") / 5).cast("int")).alias("filter_order"), (F.col("i") % 5 + 1).cast("int").alias("step"), *(F.col(f"s.{c}").alias(c) for c in COUNTS), F.get("share", F.col("s.bit")).alias("shapley"))


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as first from d),
l as (select doc_id, max((quality = 1)::bigint) as good, max((toxic = 1)::bigint) as toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, false)] as f
      from w left join l on l.doc_id = w.doc_id),
c as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
x as (select unnest([1, 2, 3, 4, 5]) as k),
o as (select [a.k, b.k, c.k, d.k, e.k] as o from x a, x b, x c, x d, x e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') as filter_order, k as step, o[k] as i, f[o[k]] as fails, len(list_filter(o[:k - 1], lambda i: f[i])) = 0 as stands, len(list_filter(f, lambda y: y)) = 1 as alone, n, good, toxic from c, o, x),
r as (select part, filter_order, step::integer as step, i, coalesce(sum(n) filter (stands and not fails), 0)::bigint as kept, coalesce(sum(n) filter (stands and fails), 0)::bigint as removed, coalesce(sum(n) filter (fails and not stands), 0)::bigint as redundant,
      coalesce(sum(n) filter (fails and alone), 0)::bigint as unique_fails, coalesce(sum(good) filter (stands and fails), 0)::bigint as good_lost, coalesce(sum(toxic) filter (stands and fails), 0)::bigint as toxic_lost from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, i))::bigint as shapley from r
"""
