"""Reading and writing tables, manifests and inventories."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite


def read_csv_coerced(spark: SparkSession, path: str, kinds: dict[str, str], required: list[str] = ()) -> DataFrame:
    """The named columns of a CSV with a header: date, number or text by kinds; what can't be read is null, rows without a required key go.

    All columns are read as text by their header, so that a file's own order and further columns don't matter.
    """
    raw = spark.read.option("header", True).csv(path)
    parse = {"date": lambda c: F.try_to_timestamp(c).cast("date"), "number": lambda c: finite(F.expr(f"try_cast(`{c}` as double)")), "integer": lambda c: F.expr(f"try_cast(`{c}` as bigint)"), "text": F.col}
    return raw.select(*((parse[k](F.col(c)) if k == "date" else parse[k](c)).alias(c) for c, k in kinds.items())).dropna(subset=list(required) or None, how="any" if required else "all")


def read_text_verbatim(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose cells all stay text: the words null and NA, and empty cells, survive."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("nullValue", "\u0001").option("emptyValue", "").csv(path).na.fill("")


def read_json_spec(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and a CSV beside it for small result tables."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}-csv")


def manifest(spark: SparkSession, arguments: dict[str, str], counts: dict[str, int], rules: dict[str, str], inputs: DataFrame | None = None) -> DataFrame:
    """One row of JSON: arguments, row counts, rule texts, the Spark version, and the SHA-256 of each input file where an inventory of a run's few inputs is given."""
    as_map = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p)) if d else F.create_map()
    fields = [as_map(arguments).alias("arguments"), as_map(counts).alias("rows"), as_map(rules).alias("rules"), F.lit(spark.version).alias("spark")]
    if inputs is None:
        return spark.range(1).select(F.to_json(F.struct(*fields)).alias("manifest"))
    hashes = inputs.agg(F.array_sort(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("_inputs"))
    return hashes.select(F.to_json(F.struct(*fields, F.col("_inputs").alias("inputs"))).alias("manifest"))


def write_remaining(df: DataFrame, path: str, unit: list[str]) -> None:
    """Appends units of work; a unit that is written again replaces itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*unit).parquet(path)


#: Stores that a task can open by itself and read as a stream; files of others come as whole rows.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs", "abfs")
#: Bytes up to which a file of another store is read as one row.
WHOLE = 1 << 26


def listed(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> list[tuple[str, int]]:
    """Path and bytes of each file in a folder, and below it if recursive, with empty files and names that begin with _ or ., over which Spark's scan passes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, names = hadoop.Path(path), hadoop.GlobFilter(pattern)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, recursive)
    found = []
    while files.hasNext():
        file = files.next()
        if names.accept(file.getPath()):
            found.append((file.getPath().toString(), file.getLen()))
    return found


def streamed_hashes(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of listed files that a task opens by itself, a piece at a time."""

    def run(batches):
        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                if uri.startswith(("file:", "/")):
                    store, inner = pa.fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
                else:
                    store, inner = pa.fs.FileSystem.from_uri(quote(re.sub("^s3a:", "s3:", uri), safe=":/"))
                total = hashlib.sha256()
                with store.open_input_stream(inner, compression=None) as stream:
                    while piece := stream.read(1 << 22):
                        total.update(piece)
                found.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    return files.mapInArrow(run, "path string, bytes long, sha256 string")


def line_hashes(spark: SparkSession, paths: list[str], tasks: int) -> DataFrame:
    """path and sha256 of files that only Spark reads: many tasks read lines and pack them, one a file hashes the packs in their order.

    The reader drops the last line's end, if there is one, and a byte order mark; the bytes that then lack say which.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.concat_ws(":", "_metadata.file_block_start", "_metadata.file_path").alias("split"), F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("row"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"),
    )

    def pack(batches):
        for batch in batches:
            runs, begin, packs = pc.run_end_encode(batch.column("split")), 0, []
            for split, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                start, path = split.split(":", 1)
                text = b"".join(batch.column("line").slice(begin, end - begin).to_pylist())
                packs.append({"path": path, "bytes": batch.column("bytes")[begin].as_py(), "start": int(start), "row": batch.column("row")[begin].as_py(), "text": text})
                begin = end
            if packs:
                yield pa.RecordBatch.from_pylist(packs)

    def run(batches):
        path = None

        def ended():
            ends = {size: (plain, b"\n"), size - 1: (plain, b""), size + 3: (marked, b"\n"), size + 2: (marked, b"")}
            if length not in ends:
                raise ValueError(f"{path} has {length} bytes and its lines {size}")
            total, last = ends[length]
            total.update(last)
            return pa.RecordBatch.from_pylist([{"path": unquote(path), "sha256": total.hexdigest()}])

        for batch in batches:
            for name, n, text in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), batch.column("text")):
                if name != path:
                    if path is not None:
                        yield ended()
                    path, length, size = name, n, 0
                    plain, marked = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                # a pack ends with a line's end, which is kept back: the last of a file may lack
                for total in (plain, marked):
                    if size:
                        total.update(b"\n")
                    total.update(memoryview(text.as_buffer())[:-1])
                size += len(text.as_buffer())
        if path is not None:
            yield ended()

    packed = lines.mapInArrow(pack, "path string, bytes long, start long, row long, text binary")
    dealt = packed.repartition(tasks, "path").sortWithinPartitions("path", "start", "row")
    return dealt.select("path", "bytes", "text").mapInArrow(run, "path string, sha256 string")


def read_hashes(spark: SparkSession, found: list[tuple[str, int]], tasks: int) -> DataFrame:
    """path and sha256 of files that only Spark reads; the driver streams those that no source of Spark gives as they are."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    location = jvm.org.apache.hadoop.fs.Path
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def streamed(path):
        stream = location(path).getFileSystem(conf).open(location(path))
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    # passed over for their names or their size, and decompressed for their names
    odd = {p for p, n in found if not n or re.search(r"(/[_.][^/]*|\._COPYING_)$", p) or (n > WHOLE and codecs.getCodec(location(p)) is not None)}
    parts = [spark.createDataFrame([(p, streamed(p)) for p in sorted(odd)], "path string, sha256 string")]
    # a reader takes a path as a pattern
    small, large = ([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p, n in found if p not in odd and (n > WHOLE) == above] for above in (False, True))
    if small:
        parts.append(spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("sha256")))
    if large:
        parts.append(line_hashes(spark, large, min(len(large), tasks)))
    return reduce(DataFrame.unionByName, parts)


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """name, bytes and sha256 of each file in a folder, and below it if recursive.

    Files are listed without their content and hashed in the tasks, a piece at a time, so their size doesn't matter. In a
    store that only Spark reads, a file of up to WHOLE bytes is one row and a larger one is read by lines; there the driver hashes empty files,
    names that begin with _ or . and larger files whose names make Spark decompress them, while the plan is built.
    """
    found = listed(spark, path, pattern, recursive)
    tasks = max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = spark.createDataFrame(found, "path string, bytes long").coalesce(1).repartition(tasks)
    if all(p.split(":")[0] in STREAMED for p, _ in found):
        hashes = streamed_hashes(files)
    else:
        hashes = files.join(read_hashes(spark, found, tasks), "path", "left").withColumn("sha256", F.coalesce("sha256", F.raise_error(F.concat(F.lit("not read: "), "path"))))
    return hashes.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; a local master without one gets a folder of its own, a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_wide(df: DataFrame, name: str, key: str) -> DataFrame:
    """written, dealt by a key into as many files as a shuffle has partitions: for few bytes that take long to work on, which adaptive execution would put into one task."""
    # by a hash of the key: a repartition by a key that rows are dealt by already is left out of the plan
    return written(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key)), name)
