"""Best-fit packing into bins of several permitted lengths.

Pieces of documents go to shards of bounded size by hash. In a shard they are placed in descending order of length,
each into the open bin that it leaves the least room in. Where none has room, a new bin is opened in the permitted
length of least cost for each word that it will hold. A bin costs its length, a constant, and a part that grows with
the square of its length, as attention does; what it will hold is the piece and what the sizes that are still to be
placed can fill of the rest. So a short bin is opened where it fills well, and a longer one where only that leaves room
that remaining pieces fit. At the end every bin is downsized to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches
from tidemark.llm.mixing import words

#: Permitted lengths in words, ascending; pieces of a shard on average.
LENGTHS, SHARD = (512, 1024, 2048), 20_000
#: What a bin costs besides its length, in words: a constant, and its length squared over the other one.
BIN_COST, SQUARE = 16, 16_384


def cost(length: int) -> float:
    return length + BIN_COST + length * length / SQUARE


class Unplaced:
    """How many pieces of each size are still to be placed."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.sizes = sorted(self.count)

    def remove(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.sizes.pop(bisect_left(self.sizes, size))

    def fill(self, room: int) -> int:
        """How much of the room remaining pieces fill if the largest that fits always comes next."""
        left, k = room, bisect_right(self.sizes, room)
        while k:
            size = self.sizes[k - 1]
            left -= size * min(self.count[size], left // size)
            k = bisect_right(self.sizes, left, 0, k - 1)
        return room - left


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's final length. Sizes run from 1 to the largest permitted length; of equal ones the first in the list comes first."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bin_of, offset, used = [0] * len(sizes), [0] * len(sizes), []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    unplaced = Unplaced(sizes)
    for i in order:
        size = sizes[i]
        unplaced.remove(size)
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            b = len(used)
            used.append(0)
            left = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / (size + unplaced.fill(c - size)), c))
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return bin_of, offset, [lengths[bisect_left(lengths, u)] for u in used]


_PACKED = "doc_id long, digest long, copy long, piece long, start long, size long, shard long, bin long, offset long, capacity int"


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, piece (from 0), start and size (in words), shard, bin, offset in the bin and capacity of the bin, for each piece.

    docs needs doc_id and text; other columns are ignored. Words are runs of non-space bytes. A document longer than
    the largest permitted length is cut into pieces of that length and a rest, so one document may fill many bins of
    many shards. Null and empty texts have no pieces. Repeated rows and null ids are documents of their own. shard and
    bin together name a bin. Shards don't depend on how the input is partitioned. An empty table gives no rows. Lengths
    are written down and pieces counted while the plan is built.
    """
    small_batches(docs.sparkSession)
    most = lengths[-1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), words().alias("n")).where("n > 0")
    # equal rows are counted and then numbered, so each is dealt by itself
    rows = materialize(rows.groupBy("doc_id", "digest", "n").agg(F.count("*").alias("rows")), "lengths")
    pieces = rows.agg(F.sum(F.col("rows") * F.ceil(F.col("n") / most))).first()[0] or 0
    every = rows.select("doc_id", "digest", "n", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    cut = every.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most) - 1)).alias("piece"))
    cut = cut.select("doc_id", "digest", "copy", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("size"))
    shards = max(1, round(pieces / SHARD))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "digest", "copy", "piece"), F.lit(shards)))

    def pack(table: pa.Table) -> pa.Table:
        # the order of arrival doesn't count
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("digest", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bin_of, offset, length = best_fit(table.column("size").to_pylist(), lengths)
        capacity = np.array(length, np.int32)[bin_of]
        return table.append_column("bin", pa.array(bin_of, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("capacity", pa.array(capacity, pa.int32()))

    return sharded.groupBy("shard").applyInArrow(pack, _PACKED).drop("digest", "copy")
