"""The pipeline's run() against the plain form of each stage, each on what its predecessor kept."""

import itertools
import random
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import quality, queries

from plain import kept_bytes, least_of_links


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(40)
    texts = [prose(r.randint(30, 90)) for _ in range(24)]
    texts += [texts[0], texts[1], texts[1]] + [texts[k][:-1] + ["other"] for k in (2, 3, 4)]
    texts += [prose(20) + passage + prose(20) for _ in range(4)]
    texts += [["buy", "now!!!", "$$$"] * r.randint(10, 30) for _ in range(10)]
    rows = [(k, " ".join(t), "en", f"s{k % 3}") for k, t in enumerate(texts)]
    return [*rows, (len(rows), None, None, None), (len(rows) + 1, "", "en", "s1")]


def test_run_against_plain_stages(spark, tmp_path, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(d, 0, 0 if t and "$$$" in t else 1) for d, t, *_ in rows], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path / "shared"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    folder = next((tmp_path / "shared" / "tidemark").iterdir())
    stage = [[tuple(q) for q in spark.read.parquet(f"{folder}/{k}").select("doc_id", "text", "source").collect()] for k in range(4)]
    ids = lambda k: sorted(q[0] for q in stage[k])

    good = {q.doc_id for q in quality.quality(docs, labels).where("predicted = 1").collect()}
    assert ids(0) == sorted(good) and len(good) >= 30

    least = least_of_links({d: t for d, t, _ in stage[0]})
    assert ids(1) == sorted(d for d in good if least[d] == d)
    assert len(ids(1)) < len(ids(0))

    want = {}
    for (d, t, _), kept in zip(sorted(stage[1]), kept_bytes([t for _, t, _ in sorted(stage[1])]), strict=True):
        if kept or not t:
            want[d] = kept.decode()
    assert {d: t or "" for d, t, _ in stage[2]} == want
    assert sum(len(t or "") for _, t, _ in stage[1]) > sum(map(len, want.values()))

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", stage[2])
    taken = {d: n for d, n in con.execute(f"select doc_id, taken from ({queries.MIXING})").fetchall() if n}
    words = {d: (t or "").split() for d, t, _ in stage[2]}
    assert Counter({d: sum(len(t.split()) for _, t, _ in g) for d, g in itertools.groupby(sorted(stage[3]), key=lambda q: q[0])}) == taken
    assert all(words[d][: len(t.split())] == t.split() for d, t, _ in stage[3])

    assert {d: sum(q.size for q in g) for d, g in itertools.groupby(sorted(packed, key=lambda q: q.doc_id), key=lambda q: q.doc_id)} == taken
    for _, g in itertools.groupby(sorted(packed, key=lambda q: (q.shard, q.bin, q.offset)), key=lambda q: (q.shard, q.bin)):
        at = 0
        for q in g:
            assert q.offset == at
            at += q.size
        assert at <= q.capacity
    assert Path(folder).is_dir()
