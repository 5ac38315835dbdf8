"""Exact top-k search: tiled integer matrix products, partial selection in each tile, tree merging of the lists.

Candidates are cut into tiles, queries into blocks, of up to TILE and BLOCK vectors and TILE_BYTES. Every tile meets
every block once, in one cell of a grid: a block is copied over a row of cells, a tile over a column, so that copies
grow with the sides of the grid and not with the tiles and blocks. Cells are as few as keep all tasks busy and hold
no more than CELL pairs. Both sides are joined by shuffle on the cell; a task meets one pair at a time, keeps a
block's k best over the tiles of its cell, and nothing is broadcast. Lists are then merged in rounds of FAN columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shuffle_partitions, small_batches

TILE, BLOCK, FAN, K = 1024, 1024, 16, 5
#: Bytes of a tile's or block's components, and pairs of them in a cell.
TILE_BYTES, CELL = 1 << 20, 64
#: Bits of one limb of a component that is too large for 32 bits.
LIMB = 20


def quantized(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """floor(256 * x) / 256 of each usable vector (no nulls and only finite components), and which rows are usable.

    Vectors of one length make one entry: their places among the usable ones and a matrix. The quotient is exact.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    usable = np.array(column.is_valid())
    # a null list holds nothing; components of the others lie end to end
    sizes = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    values = np.array(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    usable &= np.bincount(owner, ~np.isfinite(values), len(sizes)) == 0
    values, sizes = values[usable[owner]], sizes[usable]
    # beyond 2**52 a double is an integer already
    inner = np.abs(values) < 2.0**52
    values[inner] = np.floor(256 * values[inner]) / 256
    begin = np.cumsum(sizes) - sizes
    found = []
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        found.append((at, values[begin[at][:, None] + np.arange(length)]))
    return found, usable


_TILE = "ids binary, rows binary, length int, narrow boolean"


def _tiles(size: int):
    """Tiles of a partition's usable vectors, each of one length: ids and components as bytes, 32-bit integers (narrow) or doubles."""

    def tile(ids, rows):
        scaled = 256 * rows if np.abs(rows).max(initial=0) < 1 << 22 else None
        kept = rows if scaled is None else scaled.astype(np.int32)
        values = [np.ascontiguousarray(ids, np.int64).tobytes()], [np.ascontiguousarray(kept).tobytes()], [rows.shape[1]], [scaled is not None]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.binary(), pa.binary(), pa.int32(), pa.bool_()), strict=True)], ["ids", "rows", "length", "narrow"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            found, usable = quantized(batch.column("embedding"))
            usable_ids = np.array(batch.column("vec_id"))[usable]
            for at, matrix in found:
                length = matrix.shape[1]
                most = max(1, min(size, TILE_BYTES // (4 * max(length, 1))))
                ids, rows = usable_ids[at], matrix
                if length in held:
                    ids, rows = np.concatenate([held[length][0], ids]), np.concatenate([held[length][1], rows])
                full = len(ids) // most * most
                for i in range(0, full, most):
                    yield tile(ids[i : i + most], rows[i : i + most])
                # a copy, so that the batch is let go
                held[length] = [ids[full:].copy(), rows[full:].copy()]
            # many lengths: what is held stays bounded
            while sum(r.nbytes for _, r in held.values()) > 8 * TILE_BYTES and len(held) > 1:
                ids, rows = held.pop(max(held, key=lambda x: held[x][1].nbytes))
                yield tile(ids, rows)
        for ids, rows in held.values():
            if len(ids):
                yield tile(ids, rows)

    return run


def _limbs(rows: np.ndarray, n: int) -> list[np.ndarray]:
    """256 * rows in n limbs of LIMB bits, lowest first, each with the number's sign."""
    rest, sign, out = np.abs(rows), np.sign(rows), []
    for i in reversed(range(n)):
        # a power of two: quotient, product and difference are exact
        unit = 2.0 ** (LIMB * i - 8)
        limb = np.floor(rest / unit)
        rest = rest - limb * unit
        out.append(sign * limb)
    return out[::-1]


def wide_products(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of 256 * rows for components of any finite size, limb by limb, and -1, 0 or 1: below, within or above 64 bits.

    One outside is put at the nearest 64-bit number.
    """
    n, m = (max(1, math.ceil((math.frexp(np.abs(x).max(initial=0))[1] + 8) / LIMB)) for x in (queries, candidates))
    left, right = _limbs(queries, n), _limbs(candidates, m)
    # room for 64 bits above the highest sum, so that the last carry is 0 or -1
    digits = [np.zeros((len(queries), len(candidates)), np.int64) for _ in range(max(n + m + 4, 8))]
    step = 1 << (52 - 2 * LIMB)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            # partial sums of so few products of two limbs are exact in doubles
            for c in range(0, a.shape[1], step):
                digits[i + j] += (a[:, c : c + step] @ b[:, c : c + step].T).astype(np.int64)
    for i in range(len(digits) - 1):
        digits[i + 1] += digits[i] >> LIMB
        digits[i] &= (1 << LIMB) - 1
    top = digits[-1] >> LIMB
    digits[-1] = digits[-1] & ((1 << LIMB) - 1)
    # three limbs are 60 bits; what stands above them has to lie between -8 and 7
    blank = np.where(top < 0, (1 << LIMB) - 1, 0)
    above = digits[3] - np.where(top < 0, 1 << LIMB, 0)
    within = (above >= -8) & (above <= 7)
    for d in digits[4:]:
        within &= d == blank
    value = (np.where(within, above, 0) << 3 * LIMB) + (digits[2] << 2 * LIMB) + (digits[1] << LIMB) + digits[0]
    side = np.where(within, 0, np.where(top < 0, -1, 1)).astype(np.int8)
    ends = np.iinfo(np.int64)
    return np.where(side == 0, value, np.where(side < 0, ends.min, ends.max)), side


def products(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of 256 * rows, as wide_products; 32-bit integers stand for 256 times themselves already.

    By one floating-point matrix product where all its partial sums are exact.
    """
    if queries.dtype == candidates.dtype == np.int32:
        most = int(np.abs(queries.astype(np.int64)).max(initial=0)) * int(np.abs(candidates.astype(np.int64)).max(initial=0)) * max(queries.shape[1], 1)
        if most < 1 << 53:
            found = (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
            return found, np.zeros(found.shape, np.int8)
    return wide_products(*(x / 256 if x.dtype == np.int32 else x for x in (queries, candidates)))


def best(ids: np.ndarray, scores: np.ndarray, sides: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores, ties to the smaller id, in that order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores, sides = ids[keep], scores[keep], sides[keep]
    # ~ turns the order round without leaving 64 bits
    order = np.lexsort((ids, ~sides, ~scores))[:k]
    return ids[order], scores[order], sides[order]


_LISTS = "query_id long, part long, ids array<long>, scores array<long>, sides array<tinyint>"
_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()))


def _meet(k: int):
    def written(part, tops):
        out = [(q, part, *(x.tolist() for x in top)) for q, top in tops.items() if len(top[0])]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], ["query_id", "part", "ids", "scores", "sides"])

    def lists(batches):
        # the pairs of a block in one column of cells come one after the other; should they not, more lists are written
        key, tops = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, length, q_ids, q_rows, q_narrow, ids, rows, narrow = (batch.column(c)[row].as_py() for c in ("s", "block", "length", "q_ids", "q_rows", "q_narrow", "ids", "rows", "narrow"))
                if key != (part, block):
                    if tops:
                        yield written(key[0], tops)
                    key, tops = (part, block), {}
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                found, sides = products(np.frombuffer(q_rows, np.int32 if q_narrow else np.float64).reshape(len(q_ids), length), np.frombuffer(rows, np.int32 if narrow else np.float64).reshape(len(ids), length))
                for i, query in enumerate(q_ids.tolist()):
                    other = ids != query
                    top = best(ids[other], found[i][other], sides[i][other], k)
                    if query in tops:
                        top = best(*(np.concatenate(both) for both in zip(tops[query], top, strict=True)), k)
                    tops[query] = top
        if tops:
            yield written(key[0], tops)

    return lists


def grid(blocks: int, tiles: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of the grid of cells: at least four cells a task, at most CELL pairs a cell, and as few copies as that allows."""
    cells = min(max(4 * tasks, -(-blocks * tiles // CELL)), max(blocks, 1) * max(tiles, 1))
    # rows copies of each tile and columns copies of each block: least where blocks * columns is tiles * rows
    rows = min(max(round(math.sqrt(cells * blocks / max(tiles, 1))), 1), max(blocks, 1))
    return rows, min(-(-cells // rows), max(tiles, 1))


def _dealt(parts: DataFrame, name: str) -> DataFrame:
    """parts written down, with a task and a place in it."""
    return materialize(parts.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("number"), "*"), name)


def _line(lines: int):
    """Which line of the grid a tile or block belongs to: those of one task go round the lines, from a start that its number gives."""
    return F.pmod(F.pmod(F.xxhash64("task"), F.lit(lines)) + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(lines))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates, its own id excepted.

    Both tables need vec_id (integer) and embedding (array of numbers); other columns are ignored. Rows with a null
    id or vector, and vectors with null or non-finite components, take no part; an empty table gives no rows. A
    query_id that repeats with the same vector counts once; a vec_id that repeats among the candidates is as many
    candidates. Ties go to the smaller vec_id. A query meets the candidates of its own length alone. Components may be
    of any finite size; an error is raised only where a score among the k best is no 64-bit integer. Tiles are written
    down and counted while the plan is built.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable = "vec_id is not null and embedding is not null"
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").dropDuplicates(["vec_id", "embedding"])
    tiles, blocks = _dealt(rows.mapInArrow(_tiles(TILE), _TILE), "tiles"), _dealt(asked.mapInArrow(_tiles(BLOCK), _TILE), "blocks")
    high, wide = grid(blocks.count(), tiles.count(), shuffle_partitions(spark))
    # block and tile meet where the block's row crosses the tile's column; copies are too many to broadcast
    left = blocks.select(_line(high).alias("r"), F.explode(F.expr(f"sequence(0L, {wide - 1}L)")).alias("s"), "length", F.col("number").alias("block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("narrow").alias("q_narrow"))
    right = tiles.select(F.explode(F.expr(f"sequence(0L, {high - 1}L)")).alias("r"), _line(wide).alias("s"), "length", "ids", "rows", "narrow")
    met = left.hint("merge").join(right, ["r", "s", "length"]).drop("r")
    lists = met.mapInArrow(_meet(k), _LISTS).select("query_id", "part", F.expr("transform(arrays_zip(scores, sides, ids), x -> struct(~x.scores as less, ~x.sides as side, x.ids as id))").alias("top"))
    while True:
        wide = -(-wide // FAN)
        gathered = lists.groupBy("query_id", F.floor(F.col("part") / FAN).alias("part")).agg(F.flatten(F.collect_list("top")).alias("top"))
        lists = gathered.select("query_id", "part", F.slice(F.array_sort("top"), 1, k).alias("top"))
        if wide == 1:
            break
    score = F.when(F.col("t.side") == F.lit(-1), F.bitwise_not("t.less")).otherwise(F.raise_error(F.lit("a score among the k best is no 64-bit integer")).cast("long"))
    return lists.select("query_id", F.posexplode("top").alias("place", "t")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("t.id").alias("vec_id"), score.alias("score"))
