"""Operators held against brute force: packing, the quality network, mixing positions, sketches, and top-k plans."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, quality, sketch, topk


def least_cost(sizes, lengths):
    """The cost of the best packing, by trying every way to put each piece into an open bin or a new one."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(c for c in lengths if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= lengths[-1]:
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best[0]


def test_packing_is_near_the_optimum_and_chooses_among_lengths():
    r = np.random.default_rng(4)
    lengths, opened, ratio = (512, 1024, 2048), set(), []
    for _ in range(60):
        sizes = r.integers(1, 2049, r.integers(1, 8)).tolist() if r.integers(2) else r.integers(1, 600, r.integers(1, 8)).tolist()
        bin_of, offset, length = packing.best_fit(sizes, lengths)
        used = {}
        for b, o, s in sorted(zip(bin_of, offset, sizes)):
            assert used.get(b, 0) == o
            used[b] = o + s
        assert all(length[b] == min(c for c in lengths if c >= u) for b, u in used.items())
        ratio.append(sum(map(packing.cost, length)) / least_cost(sizes, lengths))
        opened |= set(length)
    assert opened == set(lengths) and min(ratio) >= 1 - 1e-9 and max(ratio) < 1.6 and np.mean(ratio) < 1.08
    # with plenty to place, each length is opened while much is left
    sizes = [2000] * 50 + [700] * 50 + [320] * 50 + [480] * 50 + [30] * 500
    bin_of, _, length = packing.best_fit(sizes, lengths)
    assert {length[bin_of[k]] for k in (0, 50, 150)} >= {512, 2048} and 1024 in length


def test_fill_takes_the_largest_that_fits():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(1, 30, r.integers(0, 12)).tolist()
        room = int(r.integers(0, 60))
        left, rest = room, sorted(sizes, reverse=True)
        for s in rest:
            left -= s if s <= left else 0
        assert packing.Unplaced(sizes).fill(room) == room - left


def test_packing_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    df = spark.range(300).select(F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("doc_id"), F.expr("repeat('w ', cast(1 + (id * 7919) % 3000 as int))").alias("text"))
    df = df.unionAll(df.limit(20))
    one, other = packing.packed(df.repartition(2)), packing.packed(df.repartition(7))
    assert one.select("shard").distinct().count() > 5 and sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)


def whole_score(text, network):
    """The network on one text, chunk by chunk."""
    b = np.frombuffer(text + bytes(-len(text) % quality.BLOCK), np.uint8)
    best = np.zeros(quality.FILTERS)
    for i in range(0, max(len(b) - quality.BLOCK, 1 if len(b) else 0), quality.BLOCK):
        chunk = np.concatenate([b[i : i + quality.CHUNK], np.zeros(quality.CHUNK, np.uint8)])[: quality.CHUNK]
        best = np.maximum(best, network.vectors[chunk].ravel().astype(np.float64) @ network.filters + network.bias)
    return 1 / (1 + np.exp(-(best @ network.out + network.out_bias[0])))


def test_quality_of_long_texts_in_parts(monkeypatch):
    r = np.random.default_rng(8)
    network = quality.Network(3)
    network.out[:] = r.standard_normal(quality.FILTERS)
    network.bias[:] = r.standard_normal(quality.FILTERS) * 0.1
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 15, 16, 17, 33, 500, 4000, 129, 0, 2600)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    monkeypatch.setattr(quality, "PIECE", 256)
    assert np.allclose(quality.score(np.frombuffer(b"".join(texts), np.uint8), offsets, network), [whole_score(x, network) for x in texts], atol=1e-5)


def test_quality_gradient():
    r = np.random.default_rng(6)
    network = quality.Network(5)
    for p in (network.out, network.bias):
        p[:] = r.standard_normal(len(p)) * 0.3
    for name in ("vectors", "filters", "bias", "out", "out_bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (40, 5, 200)]
    good = np.array([1.0, 0.0, 1.0])

    def loss():
        p = np.array([whole_score(x, network) for x in texts])
        return -np.mean(good * np.log(p) + (1 - good) * np.log(1 - p))

    for value, g in zip(network.parameters(), quality.gradients(texts, good, network), strict=True):
        flat, slope = value.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(slope))[:4]:
            was, step = flat[k], 1e-4
            flat[k] = was + step
            up = loss()
            flat[k] = was - step
            down = loss()
            flat[k] = was
            assert abs((up - down) / (2 * step) - slope[k]) < 1e-3 + 0.02 * abs(slope[k])


def test_quality_learns():
    r = np.random.default_rng(9)
    words = [bytes(r.integers(97, 123, r.integers(3, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[k] for k in r.integers(0, 300, 60)) if i % 2 else bytes(r.integers(33, 127, 350).astype(np.uint8)) for i in range(400)]
    good = np.arange(400) % 2
    network = quality.fit(texts[:300], good[:300].astype(np.float32))
    data = np.frombuffer(b"".join(texts[300:]), np.uint8)
    found = quality.score(data, np.concatenate(([0], np.cumsum([len(x) for x in texts[300:]]))), network) >= 0.5
    assert (found == good[300:]).mean() > 0.95


def test_a_source_read_twice_spans_all_of_training(spark):
    # source b is small beside its target, so it is read twice; targets are 2 x its size
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("w " * 20).alias("text"), F.expr("case when id % 6 = 0 then 'a' when id % 6 = 1 then 'b' else 'c' end").alias("source"))
    rows = mixing.mixed(df, ("source",)).collect()
    own = [r for r in rows if r.source == "a"]
    assert own[0].target == 2 * own[0].source_size
    first, second = sorted(r.positions[0] for r in own), sorted(r.positions[1] for r in own)
    assert first[0] == 0 and first[-1] < second[0] and second[-1] > 0.98
    # the integral of the schedule at a position is the part of the target that was read before it
    total = own[0].target
    for k, r in enumerate(sorted(own, key=lambda r: r.positions[0])):
        for p, t in enumerate(r.positions):
            assert abs((1.5 * t - t * t / 2) - (p * r.source_size + 20 * k) / total) < 1e-9
    for source in "abc":
        own = [t for r in rows if r.source == source for t in r.positions]
        assert min(own) < 0.01 and max(own) > 0.95
    out = mixing.mixed_documents(df).select("doc_id", "source").collect()
    assert [r.doc_id for r in out] == [i for _, i in sorted((t, r.doc_id) for r in rows for t in r.positions)]


def test_null_ids_spread_over_slots(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("s").alias("source"))
    assert mixing.mixed(df).select("positions").distinct().count() > 1900


def sketch_of(words):
    import hashlib

    made = {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    return sorted(hashlib.md5(x.encode()).hexdigest()[: sketch.DIGITS] for x in made)


def kept_of(hashes):
    below = [h for h in hashes if h < sketch.BELOW]
    return below if len(below) >= sketch.LEAST else hashes[: sketch.LEAST]


def test_sketches_of_short_and_long_texts_and_their_merge(spark):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 50, n)) for n in (0, 1, 3, 5, 6, 9, 20, 25, 60, 200, 800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("own", sketch.kept_hashes(F.col("text")))
    rows = df.orderBy("i").collect()
    assert [x.own for x in rows] == [kept_of(sketch_of(t.split())) for t in texts]
    assert all(x.own for x in rows[1:])
    both = df.alias("a").crossJoin(df.alias("b")).select("a.i", F.col("b.i").alias("j"), sketch.merged_sketch(F.col("a.own"), F.col("b.own")).alias("m"), sketch.likeness(F.col("a.own"), F.col("b.own")).alias("like"))
    for x in both.collect():
        a, b = (set(sketch_of(texts[k].split())) for k in (x.i, x.j))
        assert x.m == kept_of(sorted(a | b))
        true = len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)
        assert abs(x.like - true) < (1e-9 if max(len(a), len(b)) < sketch.LEAST else 0.5) and (x.i != x.j or x.like == 1)


def test_next_rows_of_one_id_in_several_slots(spark):
    import hashlib

    texts = [(None if i % 3 else i % 40, f"text {i} " * (i % 4 + 1)) for i in range(900)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    order = sorted(texts, key=lambda x: (-(1 << 63) if x[0] is None else x[0], hashlib.md5(x[1].encode()).hexdigest()), reverse=True)
    got = {(r.doc_id, r.text): r.next_text for r in sketch.with_next(df, 4).collect()}
    assert got == {a: b[1] for a, b in zip(order, order[1:] + order[:1])}


def test_top_k_against_brute_force_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "FAN", 3)
    r = np.random.default_rng(3)
    vectors = r.integers(-3, 4, (150, 6)) / 2
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    out = topk.top_k(df, df.where("vec_id % 10 = 0"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    q = np.floor(256 * vectors).astype(int)
    want = [(i, k + 1, j, int(s)) for i in range(0, 150, 10) for k, (s, j) in enumerate(sorted(((q[i] @ q[j], j) for j in range(150) if j != i), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == want
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df.where("vec_id = 10")).count() == 0
    found, usable = topk.quantized(pa.array([None, [1.0, None], [2.0, 3.0], [0.5], [-0.001, 4.0], []]))
    assert usable.tolist() == [False, False, True, True, True, True]
    assert [(at.tolist(), rows.tolist()) for at, rows in found] == [([3], [[]]), ([1], [[0.5]]), ([0, 2], [[2.0, 3.0], [-1 / 256, 4.0]])]


def _whole(x: float) -> int:
    return math.floor(256 * Fraction(x))


def test_products_of_any_size():
    r = np.random.default_rng(11)
    for power in (3, 24, 27, 31, 60, 500, 1015):
        a, b = (np.ldexp(r.uniform(-1, 1, (n, 5)), r.integers(-power, power + 1, (n, 5))) for n in (9, 12))
        a[0], b[0] = 0.0, [1.7e308, -1.7e308, 5e-324, -5e-324, 1e8]
        exact = lambda x: topk.quantized(pa.array(x.tolist()))[0][0][1]
        found, sides = topk.products(exact(a), exact(b))
        for i in range(9):
            for j in range(12):
                want = sum(_whole(x) * _whole(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
                side = (want >= 1 << 63) - (want < -(1 << 63))
                assert (sides[i, j], found[i, j]) == (side, min(max(want, -(1 << 63)), (1 << 63) - 1))
    ends = np.array([[2.0**31]]), np.array([[-(2.0**16)], [2.0**16], [2.0**16 - 1]])
    found, sides = topk.products(*ends)
    assert found.tolist() == [[-(1 << 63), (1 << 63) - 1, (1 << 63) - (1 << 47)]] and sides.tolist() == [[0, 1, 0]]


def test_top_k_large_components_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 7)
    r = np.random.default_rng(4)
    vectors = [np.ldexp(r.uniform(-1.3, 1.3, 2 + i % 2), 22 if i % 3 else 2).tolist() for i in range(60)] + [[]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 < 2")).collect()))
    want = []
    for i in range(61):
        if i % 10 < 2:
            scores = sorted((-sum(_whole(x) * _whole(y) for x, y in zip(vectors[i], v, strict=True)), j) for j, v in enumerate(vectors) if j != i and len(v) == len(vectors[i]))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])]
    assert got == want
    # scores below 64 bits that are not among the best are no fault, those among them are
    rows = [(0, [2.0**40]), (1, [-(2.0**40)]), (2, [1.0]), (3, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1, 2, 1 << 56), (0, 2, 3, -(1 << 56))]
    with pytest.raises(Exception, match="no 64-bit integer"):
        topk.top_k(df, df.where("vec_id = 0"), 3).collect()


def test_grid_copies_grow_with_the_root():
    for blocks, tiles in ((1, 1), (3, 2000), (40, 2000), (400, 20000), (4000, 200000)):
        rows, columns = topk.grid(blocks, tiles, 200)
        assert rows <= blocks and columns <= tiles and blocks * tiles <= 2 * topk.CELL * rows * columns
    # of 2,000,000 vectors and 40,000 queries each pair was two copies before: 160,000
    rows, columns = topk.grid(40, 2000, 200)
    assert rows * 2000 + columns * 40 < 24000
