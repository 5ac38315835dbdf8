"""Running totals, ranks, distances, permutations, folds and bootstraps against plain versions."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, inference, joins, models, ranges, windows
from tidemark.sources import tables


def tied(seed=0, n=400):
    r = np.random.default_rng(seed)
    # a third of all values are equal, one group has most rows, one key is null
    return [(None if i % 50 == 0 else "big" if i % 5 else "small", i, 1.5 if i % 3 == 0 else float(r.integers(0, 40)) / 4, float(r.integers(1, 9))) for i in range(n)]


def test_running_totals_and_ranks(spark):
    rows = tied()
    df = spark.createDataFrame(rows, "g string, id int, v double, w double")
    up = {r.id: (r.s, r.m) for r in ranges.running(df, ["g"], "v", {"s": (F.sum, "w"), "m": (F.max, "w")}).collect()}
    down = {r.id: r.m for r in ranges.running(df, ["g"], "v", {"m": (F.min, "w")}, backwards=True).collect()}
    for g, i, v, _ in rows:
        before, after = ([x[3] for x in rows if x[0] == g and (x[2] <= v if low else x[2] >= v)] for low in (True, False))
        assert up[i] == (sum(before), max(before)) and down[i] == min(after)
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in ranges.mean_ranks(counts, ["g"], "v", "n", "rank").collect():
        own = sorted(x[2] for x in rows if x[0] == r.g)
        assert r["rank"] == np.mean([k + 1 for k, v in enumerate(own) if v == r.v])
    assert ranges.running(df.limit(0), ["g"], "v", {"s": (F.sum, "w")}).count() == 0


def test_numbers_are_those_of_the_order(spark):
    df = spark.createDataFrame(tied(1), "g string, id int, v double, w double").repartition(7)
    assert [r.i for r in ranges.numbered(df, ["v", "id"]).orderBy("v", "id").collect()] == list(range(400))


@pytest.mark.parametrize("seed", [0, 1])
def test_median_distances_are_those_of_all_pairs(spark, seed):
    rows = tied(seed, 260) + [("one", 900, 3.0, 1.0), ("two", 901, 3.0, 1.0), ("two", 902, 7.5, 1.0), ("two", 903, None, 1.0), ("same", 904, -0.0, 1.0), ("same", 905, 0.0, 1.0), ("same", 906, 0.0, 1.0), ("nan", 907, math.nan, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, v double, w double")
    got = {r.id: r.median_distance for r in ranges.median_distances(df, ["g"], "id", "v").collect()}
    usable = [x for x in rows if x[2] is not None and x[2] == x[2]]
    want = {}
    for g, i, v, _ in usable:
        apart = [abs(v - x[2]) for x in usable if x[0] == g and x[1] != i]
        if apart:
            want[i] = float(np.median(apart))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_agreement_and_quantile_with_most_values_equal(spark):
    r = np.random.default_rng(4)
    rows = [("x" if i % 4 else None, i % 7, float(r.integers(0, 4)) / 2, float(r.integers(0, 4)) / 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double")
    rank = lambda v: np.array([np.mean([k + 1 for k, x in enumerate(sorted(v)) if x == y]) for y in v])
    for q in aggregates.rater_agreement(df, ["g"], "a", "b").collect():
        a, b = (np.array([x[k] for x in rows if x[0] == q.g]) for k in (2, 3))
        assert q.n == len(a) and np.allclose([q.pearson, q.spearman, q.exact, q.mean_difference], [np.corrcoef(a, b)[0, 1], np.corrcoef(rank(a), rank(b))[0, 1], np.mean(a == b), np.mean(abs(a - b))])
    for q in inference.conformal_quantile(df, ["g"], "id", "a", 0.3).collect():
        own = [x for x in rows if x[0] == q.g]
        n = len({x[1] for x in own})
        weight = {i: 1 / sum(x[1] == i for x in own) for i in {x[1] for x in own}}
        reach = [v for v in sorted({x[2] for x in own}) if sum(weight[x[1]] for x in own if x[2] <= v) >= (n + 1) * 0.7 - 1e-9]
        assert q.subjects == n and q.quantile == reach[0]


def test_whole_vectors_change_places_alike_however_rows_are_dealt(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))
    moved = [sorted(tuple(r) for r in ranges.permuted_vectors(x, ["id"], ["a", "b"], F.xxhash64("id")).collect()) for x in (df.repartition(3), df.repartition(11))]
    assert moved[0] == moved[1] and [r[0] for r in moved[0]] == list(range(500))
    assert all(3 * a == 2 * b for _, a, b in moved[0]) and sorted(a for _, a, _ in moved[0]) == [2 * i for i in range(500)] and sum(a == 2 * i for i, a, _ in moved[0]) < 20


def test_a_walk_over_a_hundred_thousand_days(spark):
    df = spark.range(100_000).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("day"))
    assert windows.thinned(df, ["id"], "day", 7).where("retained").agg(F.count("*"), F.max("day")).first()[:] == (14286, 99995)
    gaps = spark.createDataFrame([(1, 0), (1, 0), (1, 6), (1, 8), (1, None), (2, 5)], "id int, day int")
    assert sorted((r.id, r.day is None, r.day or 0, r.retained) for r in windows.thinned(gaps, ["id"], "day", 7).collect()) == [(1, False, 0, True), (1, False, 0, True), (1, False, 6, False), (1, False, 8, True), (1, True, 0, False), (2, False, 5, True)]


def draw(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 16**13


def plain_cv(rows, x, y, penalty=1.0):
    """Out-of-fold sum of squares; rows are (subject, x..., y), means and deviations come from the training folds."""
    fold = np.array([int(draw(r[0], "fold") * 5) for r in rows])
    data, out = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float), 0.0
    for f in set(fold):
        train, test = data[fold != f], data[fold == f]
        mean = np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in train[:, x].T])
        fill = lambda d, m=mean: np.where(np.isnan(d[:, x]), m, d[:, x])  # noqa: B023, E731
        sd = fill(train).std(axis=0)
        sd[sd <= 1e-8] = 1
        design = lambda d, m=mean, s=sd: np.column_stack([np.ones(len(d)), (fill(d) - m) / s])  # noqa: B023, E731
        ridge = penalty * np.eye(len(x) + 1)
        ridge[0, 0] = 0
        a = design(train)
        out += np.sum((test[:, y] - design(test) @ np.linalg.solve(a.T @ a + ridge, a.T @ train[:, y])) ** 2)
    return out


def test_folds_take_their_means_from_the_training_folds(spark):
    r = np.random.default_rng(3)
    rows = [(i // 4, None if r.random() < 0.4 else float(r.normal() + i / 40), float(r.normal()), float(r.normal() + i / 60)) for i in range(160)]
    df = spark.createDataFrame([("g", *x) for x in rows] + [("g", 1, 0.0, 0.0, None), ("h", 1, None, 1.0, 1.0)], "g string, s int, a double, b double, y double")
    got = {q.g: q for q in models.ridge_cv(df, ["g"], "s", ["a", "b"], "y").collect()}
    want = plain_cv(rows, [0, 1], 2)
    assert got["g"].n == 160 and math.isclose(got["g"].sse, want, rel_tol=1e-9) and math.isclose(got["g"].rmse, math.sqrt(want / 160), rel_tol=1e-9)
    assert got["h"].n == 0 and got["h"].rmse is None


def test_association_equals_a_plain_version(spark):
    r = np.random.default_rng(8)
    rows = [(u, t, float(r.normal()), float(r.normal()), float(r.normal()), float(r.normal())) for u in range(18) for t in range(int(r.integers(3, 9)))]
    df = spark.createDataFrame([("g", *x) for x in rows], "g string, u int, t int, s double, a double, b double, y double")
    got = models.transition_association(df, ["g"], "u", "t", ["s"], ["a", "b"], "y", 12).first()
    bare = plain_cv([(u, s, y) for u, _, s, _, _, y in rows], [0], 1)
    errors = []
    for rep in range(13):
        moved = []
        for u in {x[0] for x in rows}:
            own = sorted(x for x in rows if x[0] == u)
            by = int(draw(u, rep, "shift") * len(own)) if rep else 0
            moved += [(u, x[2], own[(k + by) % len(own)][3], own[(k + by) % len(own)][4], x[5]) for k, x in enumerate(own)]
        errors.append(plain_cv(moved, [0, 1, 2], 3))
    y = np.array([x[5] for x in rows])
    assert math.isclose(got.rmse, math.sqrt(errors[0] / len(rows))) and math.isclose(got.bare, math.sqrt(bare / len(rows)))
    assert math.isclose(got.p, (1 + sum(e <= errors[0] * (1 + 1e-9) for e in errors[1:])) / 13) and math.isclose(got.added_r2, (bare - errors[0]) / np.sum((y - y.mean()) ** 2))


def test_a_grid_of_trends_sorts_rows_once(spark):
    r = np.random.default_rng(10)
    rows = [(u, int(d), None if r.random() < 0.15 else float(r.normal())) for u in range(30) for d in sorted(r.choice(25, int(r.integers(1, 12)), replace=False))]
    df = spark.createDataFrame(rows, "u int, d int, v double")
    trends = {str(w): windows.range_mean(df, ["u"], "d", "v", w) for w in (4, 8)}
    made = aggregates.trend_grid(df, "u", "d", "v", trends)
    got = {x.name: x for x in made.collect()}
    for name, trend in trends.items():
        t = df.withColumns({"t": trend, "g": F.lit(1)}).withColumn("f", F.col("v") - F.col("t"))
        ar1 = lambda c, unit=False: aggregates.pooled_ar1(t, ["g"], "u", "d", c, unit).first()  # noqa: B023, E731
        x, share = got[name], aggregates.within_share(t, ["g"], "u", "t", "v").first()
        assert np.allclose([x.raw_ar1, x.fast_ar1, x.fast_ar1_unit, x.slow_share], [ar1("v").ar1, ar1("f").ar1, ar1("f", True).ar1, share.slow_share])
        assert (x.pairs, x.subjects) == (ar1("v").pairs, share.subjects)
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1 and "Union" not in plan
    assert aggregates.trend_grid(df.limit(0), "u", "d", "v", trends).count() == 0


def test_shifts_are_summed_where_subjects_lie(spark, monkeypatch):
    r = np.random.default_rng(9)
    hole = lambda x: None if r.random() < 0.2 else float(x)
    rows = [(g, None if u == 0 else u, u % 3, t, hole(r.normal()), hole(r.normal()), float(r.normal())) for g in "gh" for u in range(12) for t in range(int(r.integers(1, 9)))]
    df = spark.createDataFrame(rows, "g string, u int, _f int, t int, s double, a double, y double")
    held = df.groupBy("g", "u", "_f").agg(F.array_sort(F.collect_list(F.struct("t", "s", "a", "y"))).alias("_s"))
    monkeypatch.setattr(models, "SUMS_HELD", 2)
    parts = models._shifted_parts(held, ["g"], "u", ["s"], ["a"], "y", 5)
    assert "Generate" not in parts._jdf.queryExecution().toString()
    got = {(q.g, q["_f"], q.replicate): {(x.a, x.b): tuple(x)[2:] for x in q["_gram"]} for q in parts.collect()}
    assert len(got) == 2 * 3 * 6
    for (g, f, replicate), sums in got.items():
        want = {other: np.zeros(4) for other in "sy"}
        for u in {x[1] for x in rows if x[0] == g and x[2] == f}:
            own = sorted((x for x in rows if x[0] == g and x[1] == u), key=lambda x: x[3])
            by = int((draw(replicate, "shift") if u is None else draw(u, replicate, "shift")) * len(own)) if replicate else 0
            for k, x in enumerate(own):
                a = own[(k + by) % len(own)][5]
                for other, v in (("s", x[4]), ("y", x[6])):
                    want[other] += [(a or 0) * (v or 0), (a is None) * (v or 0), (a or 0) * (v is None), (a is None) * (v is None)]
        assert all(np.allclose(sums["a", other], want[other]) for other in "sy")


def test_intervals_share_their_draws(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 3 else 2.0) for i in range(40)], "id int, a double, b double")
    mean = lambda c: F.sum(F.col(c) * F.col("times")) / F.sum(F.when(F.col(c).isNotNull(), F.col("times")))
    both = {r.name: r for r in inference.bootstrap_intervals(df, "id", {"a": mean("a"), "again": mean("a"), "b": mean("b")}, 150, "x").collect()}
    alone = inference.bootstrap_interval(df, "id", mean("a"), 150, "x").first()
    assert (both["a"].low, both["a"].high) == (both["again"].low, both["again"].high) == (alone.low, alone.high) and both["a"].low < both["a"].high
    assert both["b"].low == both["b"].high == 2.0


def test_medians_of_groups_spread_over_ranges(spark):
    rows = [(*x[:3], None if x[1] % 7 == 0 else float("nan") if x[1] % 11 == 0 else x[3]) for x in tied()]
    df = spark.createDataFrame(rows, "g string, id int, v double, w double")
    got = {r.g: (r.a, r.b) for r in ranges.medians(df, ["g"], {"a": "v", "b": "w"}).collect()}
    for g in (None, "big", "small"):
        own = [x for x in rows if x[0] == g]
        assert got[g] == (np.median([x[2] for x in own]), np.median([x[3] for x in own if x[3] is not None and x[3] == x[3]]))
    assert ranges.medians(df.limit(0), ["g"], {"a": "v"}).count() == 0


def test_bootstrapped_medians_equal_a_plain_version(spark):
    r = np.random.default_rng(5)
    values = [(i, float(r.integers(0, 9)), None if i % 4 == 0 else float(r.normal()), None) for i in range(83)]
    df = spark.createDataFrame(values, "id int, a double, b double, c double").repartition(5)
    got = {x.name: (x.low, x.high, x.replicates) for x in inference.bootstrap_medians(df, "id", ["a", "b", "c"], 60, "salt").collect()}
    picks = [[int(int(hashlib.md5(f"{k}|{d}|salt".encode()).hexdigest()[:13], 16) / 2**52 * 83) for d in range(83)] for k in range(60)]
    for name, at in (("a", 1), ("b", 2)):
        each = [np.median([values[i][at] for i in p if values[i][at] is not None]) for p in picks]
        assert got[name] == (pytest.approx(np.quantile(each, 0.025)), pytest.approx(np.quantile(each, 0.975)), 60)
    # a column without values has no median; so has an empty table
    assert set(got) == {"a", "b"} and inference.bootstrap_medians(df.limit(0), "id", ["a"], 5).count() == 0


def test_draws_meet_subjects_in_blocks(spark):
    packed = inference.packed_draws(spark, 700, 9, "s", 256).collect()
    got = sorted((r.replicate, 256 * r.block + int(i)) for r in packed for i in np.frombuffer(r.picks, "<u2"))
    assert got == sorted((r.replicate, r.i) for r in inference.bootstrap_draws(spark, 700, 9, "s").collect() for _ in range(r.times))
    # a row for each block, not for each draw; a replicate that lies in two tasks has two
    assert len(packed) <= 3 * (9 + 4)


def test_resamples_by_blocks_equal_those_of_single_draws(spark):
    r = np.random.default_rng(6)
    rows = [(i, float(r.normal()), None if i % 3 else float(r.integers(0, 4)), float("nan") if i % 5 else 1.0 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(5)
    sums = {"a": F.col("a"), "b": F.col("b"), "n": F.when(F.col("b").isNotNull(), 1.0)}
    made = [inference.resampled(df, "id", sums, ["a", "b", "c"], 40, "x", roots).toDF("replicate", "a", "b", "n", "ma", "mb", "mc") for roots in (3.0, 0.001)]
    wide, narrow = (sorted(map(tuple, m.collect())) for m in made)
    # bounds that miss nearly all medians are widened until they hold them
    assert wide == narrow and len(wide) == 40
    for k, a, b, n, *middle in wide:
        own = [rows[int(draw(k, d, "x") * 600)] for d in range(600)]
        assert math.isclose(a, sum(x[1] for x in own)) and b == sum(x[2] or 0 for x in own) and n == sum(x[2] is not None for x in own)
        assert middle == [np.median([x[j] for x in own if x[j] is not None and x[j] == x[j]]) for j in (1, 2, 3)]
    mean = F.sum(F.col("b") * F.col("times")) / F.sum(F.when(F.col("b").isNotNull(), F.col("times")))
    assert inference.interval_of(made[0], inference.ratio("b", "n")).first() == inference.bootstrap_interval(df, "id", mean, 40, "x").first()


@pytest.mark.parametrize("seed", range(3))
def test_roles_across_instruments_are_those_of_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    rows = sorted({(int(u), "ab"[k], int(d)) for u, k, d in zip(r.integers(0, 3, 60), r.integers(0, 2, 60), r.integers(0, 80, 60), strict=True)})
    rows = [(u, k, d, d - (13 if k == "a" else 3), d) for u, k, d in rows]
    df = spark.createDataFrame(rows, "u int, k string, day int, window_start int, window_end int")
    kept, last = set(), {}
    for x in sorted(rows, key=lambda x: x[2]):
        if x[2] >= last.get(x[:2], -99) + 10:
            last[x[:2]] = x[2]
            kept.add(x)
    for among in (["u"], ["u", "k"]):
        got = {tuple(x)[:3]: x.evaluation_role for x in windows.evaluation_roles(df, ["u", "k"], "day", 10, among=among).collect()}
        for x in rows:
            met = any(y[: len(among)] == x[: len(among)] and y[3] <= x[4] and y[4] >= x[3] for y in kept)
            assert got[x[:3]] == ("retained" if x in kept else "withheld_ineligible_overlap" if met else "withheld_eligible")


def test_repeated_targets_stay(spark):
    targets = spark.createDataFrame([(1, 0, 2, "x"), (1, 0, 2, "x"), (1, 5, 6, "y")], "id int, window_start int, window_end int, k string")
    series = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 9, 7.0)], "id int, day int, v double")
    assert [tuple(r) for r in joins.window_means(targets, series, "id", "day", "v").collect()] == [(1, 0, 2, "x", 2.0, 2)] * 2


def test_inventory_reads_streams_and_the_manifest_names_inputs(spark, tmp_path):
    (tmp_path / "large file.bin").write_bytes(b"0123456789abcdef" * (1 << 20))
    (tmp_path / "a+b %20.bin").write_bytes(b"x")
    found = {r.name: (r.bytes, r.sha256) for r in tables.file_inventory(spark, str(tmp_path), "*.bin").collect()}
    assert found == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    made = json.loads(tables.manifest(spark, {"a": "b"}, {"t": 3}, {"r": "s"}, tables.file_inventory(spark, str(tmp_path), "*.bin")).first()[0])
    assert [x["name"] for x in made["inputs"]] == ["a+b %20.bin", "large file.bin"] and made["inputs"][1]["sha256"] == found["large file.bin"][1] and made["rows"] == {"t": 3}
