"""Round trips of files."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.plans import summaries
from tidemark.sources import tables


def test_csv_is_coerced_and_projected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,d,x,more\n1,2024-01-02,1.5,q\n,2024-01-02,2,q\n2,soon,NaN,q\n3,2024-02-01,oops,q\n")
    out = tables.read_csv_coerced(spark, str(tmp_path / "a.csv"), {"x": "number", "id": "integer", "d": "date"}, ["id"]).orderBy("id").collect()
    assert [(r.id, str(r.d), r.x) for r in out] == [(1, "2024-01-02", 1.5), (2, "None", None), (3, "2024-02-01", None)]


def test_text_survives_verbatim(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nnull,\nNA,1\n")
    assert [tuple(r) for r in tables.read_text_verbatim(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()] == [("null", ""), ("NA", "1")]


def test_json_manifest_and_inventory(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"discriminations": [1.0, 2.0],\n "thresholds": [[-1, 0], [0, 1]]}')
    spec = tables.read_json_spec(spark, str(tmp_path / "s.json"), "discriminations array<double>, thresholds array<array<double>>").first()
    assert spec.thresholds == [[-1.0, 0.0], [0.0, 1.0]]
    tables.write_table(tables.manifest(spark, {"a": "b"}, {"t": 3}, {}), str(tmp_path / "m"))
    text = spark.read.parquet(str(tmp_path / "m")).first()[0]
    assert '"arguments":{"a":"b"}' in text and '"rows":{"t":3}' in text
    assert tables.file_inventory(spark, str(tmp_path), "s.json").first().bytes == (tmp_path / "s.json").stat().st_size


def test_inventory_lists_the_files_that_its_sql_lists(spark, tmp_path):
    for name, content in {"a.parquet": b"abc", "empty.parquet": b"", "_b.parquet": b"b", ".c.parquet": b"c", "d e+%20[1].parquet": b"d", "f.PARQUET": b"f", "documents.parquet/part-0.parquet": b"g", "k=1/h.parquet": b"h"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    sql = summaries.SQL["file_inventory"].replace("/root/testdata/sf0.01", str(tmp_path))
    assert str(tmp_path) in sql
    assert sorted(tuple(r) for r in summaries.file_inventory(spark, str(tmp_path)).collect()) == sorted(duckdb.sql(sql).fetchall())
    everything = {(r.name, r.sha256) for r in tables.file_inventory(spark, str(tmp_path)).collect()}
    assert everything == {(p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*") if p.is_file()}


def test_inventory_reads_no_file_as_a_row_that_is_too_large_for_one(spark, tmp_path, monkeypatch):
    mark, folder = b"\xef\xbb\xbf", tmp_path / "x y"
    folder.mkdir()
    large = [b"0123456789abcdef" * 2, b"\n" * 17, mark + b"a\n" * 9, mark + b"a\n" * 9 + b"b", mark * 7, b"\r\n\x00\xff" * 5, bytes(range(256)) * 9000]
    files = {f"{i} [+]%20 é.parquet": content for i, content in enumerate(large)} | {"small.parquet": mark, "empty.parquet": b"", "_a.parquet": b"a" * 20, ".b.parquet": b"b", "c.parquet.gz": b"no gzip" * 3}
    for name, content in files.items():
        (folder / name).write_bytes(content)
    want = {(name, len(content), hashlib.sha256(content).hexdigest()) for name, content in files.items()}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.inventory.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(tables, "WHOLE", 16, raising=False)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes")}
    try:
        for k, v in zip(kept, ("16", "100000")):
            spark.conf.set(k, v)
        for path in (str(folder), "viewfs://inventory/in/x y"):
            assert {tuple(r) for r in tables.file_inventory(spark, path).collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_units_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "u string, v int")
    tables.write_remaining(df, str(tmp_path / "w"), ["u"])
    tables.write_remaining(df.where("u = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "w"), ["u"])
    assert sorted((r.u, r.v) for r in spark.read.parquet(str(tmp_path / "w")).collect()) == [("a", 9), ("b", 2)]


def test_scans_count_and_never_show(spark):
    df = spark.createDataFrame([("123-45-6789", "12345678"), ("AKIA" + "A" * 16, None)], "a string, b string")
    hits = {(r.column, r.rule): r.hits for r in checks.scan(df, ["a", "b"]).collect()}
    assert hits["a", "social security number"] == 1 and hits["a", "access key"] == 1 and hits["b", "api key"] == 0
    assert checks.scan(df, ["b"], checks.IDENTIFIERS).where("hits > 0").count() == 1
    assert checks.schema_problems(df, ["a", "z"], ["b"], ["a"]) == ["missing z", "forbidden b", "prefix a: a"]
