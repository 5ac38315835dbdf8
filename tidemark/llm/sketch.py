"""Document fingerprints: threshold-scaled sketches, with DataFrame functions alone.

A fingerprint keeps every five-word shingle whose hash lies below a fixed fraction of the hash range, and of a text
with fewer than LEAST such hashes the LEAST smallest ones (all, if it has no more), so that short texts are compared in
full. Whether a hash is kept depends on the set of shingles alone: sketches of parts merge into that of their union, and the share
of one sketch that another contains estimates how much of a text the other holds, however unequal they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, shuffle_partitions

#: Words in a shingle; hashes whose hexadecimal form is below this are kept: 3 of 16, so 0.1875 of all.
WIDTH, BELOW = 5, "3"
#: Hashes that a sketch keeps at least, if there are so many shingles.
LEAST = 16
#: Hexadecimal digits of a kept hash that a fingerprint holds.
DIGITS = 16
SEPARATOR = r"[\x20\x09-\x0D]+"


def shingles(text: Column) -> Column:
    """A text's shingles in order: words (runs of non-space bytes, A-Z lower-cased) joined by a space; fewer than five words make one, none make none."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, SEPARATOR), lambda w: w != "")

    def made(w):
        # a word and the four after it; what stands beyond the end is null and left out
        joined = F.transform(w, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, WIDTH))))
        return F.slice(joined, F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(1)))

    # one transform over a single list binds the words, which else would be split anew for each shingle
    return F.flatten(F.transform(F.array(words), made))


def _bound(value: Column, made) -> Column:
    """made(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _kept(hashes: Column) -> Column:
    """The sketch of distinct hashes, sorted."""
    below = F.filter(hashes, lambda h: h < BELOW)
    return F.when(F.size(below) >= LEAST, F.array_sort(below)).otherwise(F.slice(F.array_sort(hashes), 1, LEAST))


def kept_hashes(text: Column) -> Column:
    """The sorted hashes of a text's sketch; none for a text without words."""
    every = F.array_distinct(F.transform(shingles(text), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS)))
    return _bound(every, _kept)


def merged_sketch(a: Column, b: Column) -> Column:
    """The sketch of all shingles of which a and b are sketches of parts."""
    return _bound(F.array_union(a, b), _kept)


def _reach(a: Column) -> Column:
    """The bound below which a sketch holds all hashes of its text."""
    return F.when(F.size(a) < LEAST, F.lit("g")).otherwise(F.greatest(F.lit(BELOW), F.concat(F.element_at(a, -1), F.lit("g"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller set of shingles that the other one holds, from the hashes that both sketches would show.

    1 where neither text has words; 0 where one has none, or shows no hash in the common range.
    """
    def share(bound):
        x, y = F.filter(a, lambda h: h < bound), F.filter(b, lambda h: h < bound)
        least = F.least(F.size(x), F.size(y))
        return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_bound(F.least(_reach(a), _reach(b)), share))


def _slots(key: Column, digest: Column, bounds: list[int]) -> Column:
    """Number of a row's slot, ascending by key: found by bisection of the sorted bounds. A bound that repeats is a key of many rows, which get as many slots of their own, by digest."""
    distinct = sorted(set(bounds))
    many = [bounds.count(x) for x in distinct]
    first = [0]
    for m in many:
        first.append(first[-1] + (1 if m == 1 else 1 + m))
    top = (1 << 63) - 1
    steps = len(distinct).bit_length()
    values = F.array(*(F.lit(x) for x in [*distinct, *[top] * ((1 << steps) - len(distinct))]))
    starts, own = F.array(*(F.lit(x) for x in first)), F.array(*(F.lit(x) for x in [*many, 1]))
    # the number of bounds below the key
    widths = F.array(*(F.lit(1 << k) for k in range(steps - 1, -1, -1)))
    place = F.aggregate(widths, F.lit(0), lambda at, width: at + F.when(F.get(values, at + width - 1) < key, width).otherwise(0)) if steps else F.lit(0)

    def slot(k):
        m = F.get(own, k)
        return F.get(starts, k) + F.when((m > 1) & (F.get(values, k) == key), 1 + F.floor(digest * m).cast("int")).otherwise(0)

    return _bound(place.cast("int"), slot)


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, text, own (the text's kept hashes), next_text and next_own: those of the next row in descending doc_id, after the last of the first.

    Rows are dealt into slots of id ranges that hold about equally many; an id that fills several is dealt by digest.
    Within a slot the next row is the window's lead, and the first row of each slot is what the last row of the slot
    before it meets. Only the slots' bounds and numbers are put in order in one task. Texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "digest": F.md5(F.col("text").cast("binary"))})
    slots = 8 * partitions
    bounds = rows.select("key").agg(F.percentile_approx("key", [i / slots for i in range(1, slots)], 100 * slots)).first()[0] or []
    # 52 bits of the digest as a part of 1
    part = F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / (1 << 52)
    slotted = rows.withColumn("slot", -_slots(F.col("key"), part, sorted(bounds)))
    heads = slotted.groupBy("slot").agg(F.max(F.struct("key", "digest", "text")).getField("text").alias("head"))
    heads = materialize(heads, "heads")
    turn = Window.orderBy("slot")
    first = F.first("slot").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("slot", F.coalesce(F.lead("slot").over(turn), first).alias("next"))
    following = after.join(heads.select(F.col("slot").alias("next"), F.col("head").alias("following")), "next").drop("next").withColumn("following_own", kept_hashes(F.col("following")))
    # rows of one id are ordered by the digests of their texts
    over = Window.partitionBy("slot").orderBy(F.col("key").desc(), F.col("digest").desc())
    led = slotted.repartition("slot").withColumn("own", kept_hashes(F.col("text"))).withColumns({"after": F.lead("text").over(over), "after_own": F.lead("own").over(over)})
    return led.join(following, "slot").select("doc_id", "text", "own", F.coalesce("after", "following").alias("next_text"), F.coalesce("after_own", "following_own").alias("next_own"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs.

    docs needs doc_id (integer) and text; other columns are ignored. Null texts count as empty; null ids are smaller
    than all others. Rows of one id are ordered by the MD5 of their texts, descending, so repeated rows are alike up to
    what follows the last of them. A single row is its own next one. A fingerprint is its hashes, comma-joined; it is
    empty only for a text without words. An empty table gives no rows. Bounds are computed while the plan is built.
    """
    rows = with_next(docs, shuffle_partitions(docs.sparkSession))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), kept_hashes(F.col("edited")).alias("changed"), "next_own")
    return rows.select("doc_id", "n_chars", "edited_sha256", F.array_join("own", ",").alias("fingerprint"), F.array_join("changed", ",").alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last, md5(coalesce(text, '')) desc) as n from documents),
e as (select a.doc_id, a.text, b.text as next_text from d a join d b on b.n = a.n % (select count(*) from d) + 1),
t as (select doc_id, text, next_text, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) as edited from e),
w as (select *, {words_text} as w0, {words_edited} as w1, {words_next_text} as w2 from t),
s as (select doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, {every0} as a, {every1} as b, {every2} as c from w),
k as (select doc_id, n_chars, edited_sha256, {kept_a} as own, {kept_b} as changed, {kept_c} as following from s),
h as (select *, {reach_own} as reach_own, {reach_changed} as reach_changed, {reach_following} as reach_following from k)
select doc_id, n_chars, edited_sha256, array_to_string(own, ',') as fingerprint, array_to_string(changed, ',') as edited_fingerprint,
       {near_own_changed} as near_edited, {near_own_following} as near_next
from h
"""


def sql() -> str:
    """The same result as DuckDB SQL over documents."""
    parts = {}
    for k, column in enumerate(("text", "edited", "next_text")):
        parts[f"words_{column}"] = f"list_filter(regexp_split_to_array(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
        made = f"case when len(w{k}) >= {WIDTH} then list_transform(range(1, len(w{k}) - {WIDTH - 2}), lambda i: array_to_string(w{k}[i:i + {WIDTH - 1}], ' ')) when len(w{k}) > 0 then [array_to_string(w{k}, ' ')] else []::varchar[] end"
        parts[f"every{k}"] = f"list_sort(list_distinct(list_transform({made}, lambda s: substr(md5(s), 1, {DIGITS}))))"
        x = "abc"[k]
        parts[f"kept_{x}"] = f"{x}[1:greatest({LEAST}, len(list_filter({x}, lambda h: h < '{BELOW}')))]"
    for x in ("own", "changed", "following"):
        parts[f"reach_{x}"] = f"case when len({x}) < {LEAST} then 'g' else greatest('{BELOW}', {x}[len({x})] || 'g') end"
    for other in ("changed", "following"):
        x, y = (f"list_filter({side}, lambda h: h < least(reach_own, reach_{other}))" for side in ("own", other))
        parts[f"near_own_{other}"] = f"case when len(own) = 0 and len({other}) = 0 then 1.0::double when least(len({x}), len({y})) = 0 then 0.0::double else len(list_intersect({x}, {y}))::double / least(len({x}), len({y})) end"
    return SQL.format(**parts)
