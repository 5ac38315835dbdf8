"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch that is handed to Python. Texts are long, so few rows make a batch.
BATCH_ROWS = 1024
#: Bytes from which a batch takes no more rows.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own (tests); a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that a Python worker's memory does not follow the text sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id's text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes end to end, and where each one starts (one more entry than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Ranges (first, last + 1) of whole texts that hold about most bytes, at least one text each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def long_cuts(data: np.ndarray, lo: int, hi: int, most: int, space: np.ndarray) -> list[int]:
    """Where the text in data[lo:hi] is cut into parts of about most bytes: only at bytes of space, so that no word is cut."""
    out = [lo]
    while hi - out[-1] > 2 * most:
        at = out[-1] + most
        while at < hi and not space[data[at : min(at + most, hi)]].any():
            at += most
        if at >= hi:
            break
        out.append(at + int(np.argmax(space[data[at : min(at + most, hi)]])))
    return [*out, hi]


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that separate runs of letters: ASCII but for letters.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

#: Lower-cases A to Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base & 0xFFFFFFFFFFFFFFFF
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(step)
        size, step = size * 2, step * step & 0xFFFFFFFFFFFFFFFF
    return out[:n]


#: A random 64-bit value for each byte, so that the polynomial hashes below don't follow the byte order.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Polynomial hashes modulo 2**64 of any slices of one byte array, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _ODD)


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes other than space within one text), and the first word of each text with a total at the end."""
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1][(offsets[1:-1] < len(data))]
    first[cut] = inside[cut]
    last = np.zeros(len(data), bool)
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    if len(data):
        last[-1] = inside[-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def pack(values: np.ndarray) -> bytes:
    """The numbers' bytes, all first ones, then all second ones and so on: Spark's compression finds more in them."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(blob: pa.Scalar, kind: type) -> np.ndarray:
    """The numbers of one packed value."""
    return np.ascontiguousarray(np.frombuffer(blob.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
