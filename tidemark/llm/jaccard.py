"""N-gram Jaccard join: a T-occurrence search over inverted lists, short lists merged and long ones probed.

Two documents link when the Jaccard likeness of their sets of five-word shingles is at least 0.75. Then they share at
least T = ceil(0.75 * n) shingles, n being the size of the larger set. As in DivideSkip, a document's shingles are
divided by the length of their inverted lists: the T - 1 longest lists are left out of the merge, the n - T + 1
shortest ones are merged, and a partner must show up in these at least once. What the long lists add is found by
binary search of each candidate's sorted set. List lengths come from a sketch of counts whose size is bounded; any
common order of shingles gives right results, so its errors only cost time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Rolling, materialize, mix, pack, pieces, powers, shuffle_partitions, small_batches, text_bytes, unpacked, words_of
from tidemark.llm.components import connected_components

#: Likeness from which two documents link, as a fraction.
LIKE, OF = 75, 100
#: Words in a shingle.
WIDTH = 5
#: Documents up to which a list gives all its pairs at once.
SMALL_LIST = 8
#: Partners that are verified against one document in one group; documents in a block of a search.
BLOCK, SHARD = 48, 128
#: Documents outside their crowd's main component that are searched for at once; tries of each before.
FEW, TRIES = 256, 3
#: Shingles that a task holds before it deals them out.
CHUNK = 1_000_000
#: Largest number of counters (bytes) of the sketch, and counters for each shingle.
SKETCH_MOST, SKETCH_LOAD = 1 << 26, 8
#: Largest number of bits of the filter that lets only documents with candidates send their sets.
FILTER_MOST = 1 << 25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words than width make one shingle, none make none."""
    start, end, first = words_of(data, offsets)
    words = Rolling(LOWER[data]).of(start, end)
    weights = powers(0xD6E8FEB86659FD93, width + 1)
    n = np.diff(first)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * weights[k + 1]
    rolled = mix(rolled)
    out = []
    for at, many in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if many >= width:
            h = np.sort(rolled[at : at + many - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif many:
            h = np.uint64(many)
            with np.errstate(over="ignore"):
                for k in range(many):
                    h = h + words[at + k] * weights[k + 1]
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_shared(n: int | np.ndarray) -> int | np.ndarray:
    """T: what a set of n shingles shares at least with any set that it links with."""
    return -(-LIKE * n // OF)


def _sets_of(batch: pa.RecordBatch):
    """(row, set) of each document in the batch, some MB of text at a time."""
    data, offsets = text_bytes(batch.column("text"))
    for at, to in pieces(offsets, 1 << 21):
        yield from enumerate(shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]), at)


def _describe(batches):
    """doc_id, n_shingles and a 128-bit digest of each document's set."""
    for batch in batches:
        n, low, high = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for i, h in _sets_of(batch):
            n[i] = len(h)
            low[i] = np.add.reduce(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)
            high[i] = np.add.reduce(h * (h | np.uint64(1))).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(low), pa.array(high)], ["doc_id", "n_shingles", "low", "high"])


def _counter(width: int, slices: int):
    def count(batches):
        seen = np.zeros(width, np.int32)
        for batch in batches:
            held = [h for _, h in _sets_of(batch)]
            if held:
                np.add.at(seen, (np.concatenate(held) & np.uint64(width - 1)).astype(np.int64), 1)
        part = np.minimum(seen, 255).astype(np.uint8).reshape(slices, -1)
        used = [k for k in range(slices) if part[k].any()]
        rows = [_sparse(part[k]) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "gaps", "counts"])

    return count


_COUNTS = "slice int, gaps binary, counts binary"


def _sparse(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The steps between used counters (of up to 65536) and what they hold: what a task sends follows its shingles, not the sketch's width."""
    at = np.flatnonzero(counts)
    return pack(np.diff(at, prepend=0).astype(np.uint16)), counts[at].tobytes()


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << 16, np.int64)
    for gaps, counts in zip(table.column("gaps"), table.column("counts"), strict=True):
        total[np.cumsum(unpacked(gaps, np.uint16), dtype=np.int64)] += np.frombuffer(counts.as_buffer(), np.uint8)
    gaps, counts = _sparse(np.minimum(total, 255).astype(np.uint8))
    return pa.table({"slice": table.column("slice")[:1], "gaps": pa.array([gaps], pa.binary()), "counts": pa.array([counts], pa.binary())})


def _sketch(docs: DataFrame, shingles: int) -> np.ndarray:
    """About how many documents hold the shingles of each hash bucket, at most 255; SKETCH_MOST bytes at most."""
    width = 1 << min(int(math.log2(SKETCH_MOST)), max(16, math.ceil(math.log2(max(shingles, 1) / SKETCH_LOAD))))
    slices = max(1, width >> 16)
    out = np.zeros((slices, width // slices), np.uint8)
    parts = docs.mapInArrow(_counter(width, slices), _COUNTS)
    fold = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    parts = parts.withColumn("fold", F.pmod(F.spark_partition_id(), F.lit(fold)))
    once = parts.groupBy("slice", "fold").applyInArrow(_add_counts, _COUNTS)
    for row in once.groupBy("slice").applyInArrow(_add_counts, _COUNTS).toLocalIterator():
        gaps = np.ascontiguousarray(np.frombuffer(row["gaps"], np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
        out[row["slice"], np.cumsum(gaps, dtype=np.int64)] = np.frombuffer(row["counts"], np.uint8)
    return out.ravel()


def _lister(sketch, buckets: int):
    """The short lists' entries of each document, dealt into buckets by shingle; equal sets in a chunk are entered once."""

    def deal(batches):
        counts = sketch.value
        held: dict[bytes, None] = {}
        hs, ids, ns, size = [], [], [], 0

        def flush():
            h, doc, n = np.concatenate(hs), np.concatenate(ids), np.concatenate(ns)
            bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            used, cut = bucket[order][cut], [*cut.tolist(), len(order)]
            h, doc, n = h[order], doc[order], n[order]
            rows = [(h[i:j].tobytes(), doc[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], ["bucket", "h", "doc", "n"])

        for batch in batches:
            doc_ids = batch.column("doc_id")
            valid = np.array(doc_ids.is_valid())
            doc_ids = np.array(doc_ids.fill_null(0))
            for i, h in _sets_of(batch):
                n = len(h)
                if not n or not valid[i]:
                    continue
                key = mix(h).sum().tobytes() + h[:2].tobytes() + n.to_bytes(8, "little")
                if key in held:
                    continue
                held[key] = None
                short = n - int(least_shared(n)) + 1
                load = counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]
                if short < n:
                    rank = (load.astype(np.uint64) << np.uint64(56)) | (mix(h) >> np.uint64(8))
                    h = h[np.argpartition(rank, short - 1)[:short]]
                hs.append(h)
                ids.append(np.full(len(h), doc_ids[i], np.int64))
                ns.append(np.full(len(h), n, np.int32))
                size += len(h)
                if size >= CHUNK:
                    yield flush()
                    held, hs, ids, ns, size = {}, [], [], [], 0
        if size:
            yield flush()

    return deal


def _columns(table: pa.Table, *names: tuple[str, type]) -> list[np.ndarray]:
    """The binary columns' arrays, end to end."""
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]) for name, kind in names]


def _merge(table: pa.Table) -> pa.Table:
    """Candidates of one bucket: all pairs of a list of up to SMALL_LIST documents; of longer ones a star."""
    h, doc, n = _columns(table, ("h", np.uint64), ("doc", np.int64), ("n", np.int32))
    order = np.lexsort((doc, n, h))
    h, doc, n = h[order], doc[order], n[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc, n = h[keep], doc[keep], n[keep]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    many = np.diff(np.append(first, len(h)))
    size = np.repeat(many, many)
    pairs = []
    for step in range(1, SMALL_LIST):
        i = np.flatnonzero((size[step:] <= SMALL_LIST) & (h[step:] == h[:-step])) if len(h) > step else np.zeros(0, np.int64)
        i = i[n[i] >= least_shared(n[i + step].astype(np.int64))]
        pairs.append(np.stack([np.minimum(doc[i], doc[i + step]), np.maximum(doc[i], doc[i + step])]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    # a long list's members each with its least one; members that many lists share give few such pairs
    big = size > SMALL_LIST
    least = np.minimum.reduceat(doc, first)[np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))]
    star = np.unique(np.stack([least[big], doc[big]]), axis=1)
    both = np.concatenate([pairs, star], axis=1)
    return pa.table({"a": both[0], "b": both[1], "star": np.arange(both.shape[1]) >= pairs.shape[1]})


def _filter_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit map of hashed ids, 16 bits an id and FILTER_MOST bits at most, and its size: it lets few others pass."""
    bits = 1 << min(int(math.log2(FILTER_MOST)), max(16, math.ceil(math.log2(16 * max(ids.count(), 1)))))

    def mark(table: pa.Table) -> pa.Table:
        part = np.zeros(1 << 16, bool)
        part[np.array(table.column("at")) & 0xFFFF] = True
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at")).distinct().withColumn("slice", F.shiftright("at", 16))
    out = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for row in at.groupBy("slice").applyInArrow(mark, "slice long, bits binary").toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel(), bits


def _emit_sets(shared):
    """The sets of documents that the bit map lets pass."""

    def run(batches):
        for batch in batches:
            at = np.array(batch.column("at").fill_null(0))
            keep = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(keep.astype(bool)))
            sets: list[bytes] = [b""] * batch.num_rows
            for i, h in _sets_of(batch):
                sets[i] = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "held"])

    return run


def _verify(table: pa.Table) -> pa.Table:
    """Which documents of a group link with document a: its lists, long ones included, are probed in each one's set."""
    a, ids = table.column("a")[0].as_py(), table.column("doc_id").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("held")]
    mine = [s for i, s in zip(ids, sets, strict=True) if i == a]
    out = set()
    for i, s in zip(ids, sets, strict=True):
        if i == a:
            continue
        for own in mine:
            few, lots = (own, s) if len(own) < len(s) else (s, own)
            at = np.searchsorted(lots, few)
            shared = int((lots[np.minimum(at, len(lots) - 1)] == few).sum())
            if OF * shared >= LIKE * (len(few) + len(lots) - shared):
                out.add(i)
    return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(sorted(out), pa.int64())})


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id and set of the asked documents and a few others. Texts aren't shuffled. Joins with it merge at every size, so that small tables show what large ones cost."""
    bits, size = _filter_of(asked.select("doc_id").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("at"))
    return rows.mapInArrow(_emit_sets(shared), "doc_id long, held binary")


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that link; a's partners are dealt into blocks of about BLOCK."""
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    blocked = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / BLOCK)).alias("block"))
    blocked = materialize(blocked, "pairs")
    asked = blocked.select("a", "block", F.col("b").alias("doc_id")).unionByName(blocked.select("a", "block", F.col("a").alias("doc_id")).distinct())
    asked = materialize(asked, "asked")
    held = _sets(docs, asked).join(asked.hint("shuffle_merge"), "doc_id").select("a", "block", "doc_id", "held")
    return materialize(held.groupBy("a", "block").applyInArrow(_verify, "a long, b long"), "links")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row of docs.

    docs needs doc_id (integer) and text; other columns are ignored. Words are runs of non-space bytes, A-Z lower-cased.
    Null and empty texts have no shingles and link with nothing. A null doc_id links with nothing and has itself (null)
    as component. Equal sets link. Repeated rows are given back as often as they came; rows of one doc_id with
    different texts count as one node. An empty table gives no rows.

    Documents of equal sets are one class, found by digest. A list of more than SMALL_LIST documents does not give all
    pairs: its members are held against its first one, then some times against drawn ones of their main component, and
    what is still outside is searched for in all of the others' blocks. A pair within one component can't change the
    result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    about = materialize(docs.mapInArrow(_describe, "doc_id long, n_shingles long, low long, high long"), "sets")
    known = about.where("n_shingles > 0 and doc_id is not null")
    shingles = known.agg(F.sum("n_shingles")).first()[0] or 0
    # a class may hold a third of all rows: it is dealt into parts, and each part that has rows is told the class's representative
    same = ["n_shingles", "low", "high"]
    known = known.withColumn("dealt", F.pmod(F.xxhash64("doc_id"), F.lit(shuffle_partitions(spark))).cast("int"))
    parts = known.groupBy(*same, "dealt").agg(F.min("doc_id").alias("rep"))
    classes = parts.groupBy(*same).agg(F.min("rep").alias("rep"), F.collect_list("dealt").alias("parts"))
    classes = classes.select(*same, "rep", F.explode("parts").alias("dealt"))
    # a doc_id with several texts belongs to several classes; it links their representatives
    member = materialize(known.join(classes, [*same, "dealt"]).groupBy("doc_id", "rep").agg(F.count("*").alias("rows")), "member")
    links = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    if shingles:
        links = links.unionByName(_near(docs, member, shingles))
    links = materialize(links, "all_links")
    found = connected_components(links)
    out = about.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    # links of a document without shingles can only come from another row of its doc_id
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")).alias("component_id"))


def _near(docs: DataFrame, member: DataFrame, shingles: int) -> DataFrame:
    """Links between representatives of different classes, enough of them to connect all that is connected."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, shingles))
    buckets = 4 * max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    dealt = docs.mapInArrow(_lister(sketch, buckets), "bucket int, h binary, doc binary, n binary")
    merged = dealt.groupBy("bucket").applyInArrow(_merge, "a long, b long, star boolean").distinct()
    rep = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    as_a, as_b = (rep.select(F.col("doc_id").alias(x), F.col("rep").alias(f"{x}_rep")) for x in "ab")
    pairs = merged.join(as_a, "a").join(as_b, "b").select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), "star").where("a <> b")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    star = pairs.where("star")
    links = _linked(docs, pairs.select("a", "b"))
    if star.limit(1).count() == 0:
        return links
    # documents of long lists that lists connect are one crowd: links between its components are all that is left to find
    crowd = connected_components(star.select("a", "b")).select(F.col("node").alias("doc"), F.col("component").alias("crowd"))
    crowd, before = materialize(crowd, "crowd"), None
    while True:
        found = connected_components(links).withColumnRenamed("node", "doc")
        parts = materialize(crowd.join(found, "doc", "left").select("crowd", "doc", F.coalesce("component", "doc").alias("component")), "parts")
        sizes = parts.groupBy("crowd", "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy("crowd").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("many"), F.max("n").alias("held"), F.count("*").alias("components"))
        main = materialize(main.where("components > 1"), "main")
        open_ = main.agg(F.sum(F.col("many") - F.col("held"))).first()[0] or 0
        if not open_:
            return links
        if open_ < FEW or (before is not None and 4 * open_ > 3 * before):
            return materialize(links.unionByName(_searched(docs, parts, main)), "links")
        before = open_
        # those outside the main component try some of its documents, drawn by hash
        inside = parts.join(main, "crowd")
        drawn = inside.where("component <> main").select("crowd", "held", F.col("doc").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(TRIES))).alias("k"))
        drawn = drawn.select("crowd", "x", F.pmod(F.xxhash64("x", "k", F.lit(open_)), "held").alias("slot"))
        core = inside.where("component = main").select("crowd", F.col("doc").alias("y"), F.pmod(F.xxhash64("doc"), "held").alias("slot"))
        more = drawn.join(core, ["crowd", "slot"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = materialize(links.unionByName(_linked(docs, more)), "links")


def _searched(docs: DataFrame, parts: DataFrame, main: DataFrame) -> DataFrame:
    """Links of each crowd's documents outside its main component with any document of another component, block by block."""
    inside = parts.join(main.select("crowd", "main", "many", "held"), "crowd")
    blocks, asking = F.ceil(F.col("many") / SHARD).cast("int"), F.ceil((F.col("many") - F.col("held")) / SHARD).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    listed = inside.select("crowd", F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("block"), every(asking).alias("query_block"), F.col("doc").alias("doc_id"), "component", F.lit(False).alias("asks"))
    asks = inside.where("component <> main").select("crowd", every(blocks).alias("block"), F.pmod(F.xxhash64("doc", F.lit(1)), asking).cast("int").alias("query_block"), F.col("doc").alias("doc_id"), "component", F.lit(True).alias("asks"))
    asked = materialize(listed.unionByName(asks), "asked")
    held = _sets(docs, asked).join(asked.hint("shuffle_merge"), "doc_id").select("crowd", "block", "query_block", "doc_id", "component", "asks", "held")
    return held.groupBy("crowd", "block", "query_block").applyInArrow(_search, "a long, b long")


def divide_skip(query: np.ndarray, hashes: np.ndarray, owners: np.ndarray, sets: list[np.ndarray], candidates: np.ndarray) -> list[int]:
    """Places of the sets that link with query. hashes and owners are the sets' inverted lists, sorted by hash; only candidates count.

    The L longest lists are kept out of the merge; what reaches T - L in the others is looked up in the long ones by
    binary search.
    """
    low, high = np.searchsorted(hashes, query, side="left"), np.searchsorted(hashes, query, side="right")
    size = high - low
    t = int(least_shared(len(query)))
    skip = min(t - 1, int(t / (0.1 * math.log2(max(int(size.max(initial=1)), 2)) + 1)))
    order = np.argsort(size, kind="stable")
    short, long = order[: len(order) - skip], query[order[len(order) - skip :]]
    short = short[size[short] > 0]
    # the short lists end to end
    many = size[short]
    at = np.repeat(low[short] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    met = np.bincount(owners[at], minlength=len(sets))
    out = []
    for k in np.flatnonzero((met >= t - skip) & candidates).tolist():
        own = sets[k]
        if not LIKE * max(len(own), len(query)) <= OF * min(len(own), len(query)):
            continue
        place = np.searchsorted(own, long)
        shared = int(met[k]) + int((own[np.minimum(place, len(own) - 1)] == long).sum())
        if OF * shared >= LIKE * (len(own) + len(query) - shared):
            out.append(k)
    return out


def _search(table: pa.Table) -> pa.Table:
    """Links between the asking and the listed documents of one pair of blocks; one for each other component that a document meets."""
    ids, component = np.array(table.column("doc_id")), np.array(table.column("component"))
    asks = np.array(table.column("asks"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("held")]
    listed = np.flatnonzero(~asks)
    if not len(listed) or not asks.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    own = [sets[k] for k in listed.tolist()]
    hashes, owners = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    out = set()
    for q in np.flatnonzero(asks).tolist():
        met = {}
        for k in divide_skip(sets[q], hashes, owners, own, component[listed] != component[q]):
            met[int(component[listed[k]])] = int(ids[listed[k]])
        out |= {(int(ids[q]), k) for k in met.values()}
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
