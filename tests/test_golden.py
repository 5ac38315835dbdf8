"""Hand-made inputs whose results are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import aggregates, checks, cohort, inference, irt, joins, models, prep, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_prior_flags_exclude_the_same_day(spark):
    sessions = spark.createDataFrame([(101, 10), (101, 12), (101, 15), (202, 31)], "id int, day int")
    events = spark.createDataFrame([(101, 9, ["depression"]), (101, 12, ["anxiety"]), (101, 16, ["ptsd"]), (101, 14, ["ptsd"])], "id int, day int, categories array<string>")
    flags = {k: F.array_contains("categories", k) for k in ("depression", "anxiety", "ptsd")}
    out = rows(joins.carried_flags(sessions, events, "id", "day", flags), "id", "day")
    assert out == [(101, 10, 1, 0, 0, 1), (101, 12, 1, 0, 0, 1), (101, 15, 1, 1, 1, 1), (202, 31, 0, 0, 0, 0)]


def test_diagnosis_categories(spark):
    texts = ["F33.2; F41.1; F43.12", "history of bipolar disorder and ADHD", "F33.2F41.1", "major depressive disorder, severe, without psychotic features", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [set(r[0]) for r in df.orderBy("i").select(scalar.diagnosis_categories(F.col("t"))).collect()]
    assert got == [{"depression", "anxiety", "ptsd"}, {"bipolar", "adhd"}, {"depression", "anxiety"}, {"depression"}, set()]


def test_only_measured_values_within_range_are_genuine(spark):
    df = spark.createDataFrame([(27.0, 0), (28.0, 0), (10.0, 1), (None, 0)], "v double, imputed int")
    assert [r[0] for r in df.select(prep.genuine(F.col("v"), 0, 27, F.col("imputed"))).collect()] == [True, False, False, False]


def test_thinning_by_cadence(spark):
    df = spark.createDataFrame([(1, d) for d in (0, 5, 14, 20, 27, 28, 43)], "id int, day int")
    assert [r[0] for r in windows.thinned(df, ["id"], "day", 14).where("retained").orderBy("day").select("day").collect()] == [0, 14, 28, 43]


def test_gap_factors(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0), (0.5, 3.0), (1.0, 1.0), (1.0, 3.0)], "r double, g double")
    f = scalar.gap_factors(F.col("r"), F.col("g"))
    got = [tuple(r) for r in df.select(*f.values()).collect()]
    assert got == [(1, 0, 0), (0.5, 1, 1), (0.125, 1.75, 1.3125), (1, 1, 1), (1, 3, 3)]
    for r, g in ((0.0, 1.0), (1.1, 1.0), (0.5, -1.0), (0.5, None)):
        with pytest.raises(Exception, match="persistence|gaps"):
            spark.createDataFrame([(r, g)], "r double, g double").select(*scalar.gap_factors(F.col("r"), F.col("g")).values()).collect()


def test_holm(spark):
    p = [0.010, 0.040, 0.005, 0.200, 0.030, 0.500]
    df = spark.createDataFrame(list(enumerate(p)), "pos int, p double").withColumn("g", F.lit(1))
    assert [round(r.adjusted, 6) for r in inference.holm(df, ["g"], "p", "pos").orderBy("pos").collect()] == [0.05, 0.12, 0.03, 0.4, 0.12, 0.5]


def test_conformal_quantile(spark):
    scores = [(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (3, 5.0)]
    quantile = lambda s, a: inference.conformal_quantile(spark.createDataFrame(s, "id int, s double").withColumn("g", F.lit(1)), ["g"], "id", "s", a).first()["quantile"]
    assert quantile(scores, 0.5) == 3.0
    assert quantile(scores + 3 * scores[:2], 0.5) == 3.0
    assert quantile(scores, 0.05) == math.inf


def test_masked_anchors_never_meet_a_target(spark):
    data = [(1, "Y1", 0, 6, True), (1, "Y1", 10, 16, True), (1, "Y2", 15, 20, True), (1, "Y2", 16, 22, False), (2, "Y1", 0, 1, False)]
    a = spark.createDataFrame(data, "id int, anchor string, window_start int, window_end int, observed boolean")
    m = cohort.evaluation_mask(a, "id", "anchor", F.desc("window_end"))
    targets = m.where("evaluation")
    assert targets.count() == 2
    assert joins.overlapping(m.where("observed_after"), targets, "id").count() == 0
    assert m.where("not observed and embargo").count() == 0


def test_forward_and_facility_partitions(spark):
    s = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-12-31"), (2, "2025-01-01"), (2, "2025-02-01"), (3, "2024-12-15"), (3, "2025-01-15")], "id int, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    assert rows(cohort.forward_time(s, "id", "d", "2025-01-01 00:00:00"), "id") == [(1, "train"), (2, "test"), (3, "excluded")]
    f = spark.createDataFrame([(1, "train"), (1, "train"), (2, "train"), (2, "test")], "id int, p string")
    assert rows(cohort.facility_exclusive(f, "id", "p"), "id") == [(1, "train", False), (2, None, True)]


def test_item_likelihood_is_the_sum_over_items(spark):
    spec = [(1.0 + 0.2 * k, [-1.0, 0.1 * k, 1.2]) for k in range(9)]
    for z, items in ((2.0, [1, 2, 0, 3, 1, 2, 0, 1, 3]), (-1.5, [0, 0, 1, 1, 2, 3, 2, 1, 0])):
        total = 0.0
        for x, (a, b) in zip(items, spec, strict=True):
            above = [1.0, *(1 / (1 + math.exp(-a * (z - t))) for t in b), 0.0]
            total += math.log(max(above[x] - above[x + 1], 1e-12))
        df = spark.createDataFrame([(z, items)], "z double, i array<int>")
        assert abs(df.select(irt.log_likelihood(F.col("z"), [F.element_at("i", k + 1) for k in range(9)], spec)).first()[0] - total) < 1e-9
    df = spark.createDataFrame([([3] * 9,), ([0] * 9,), ([None] * 9,)], "i array<int>")
    out = irt.trait_estimates(df, "i", spec).collect()
    assert out[0].trait > 1 > -1 > out[1].trait and out[2].trait == 0 and out[2].target_sd == 1


def test_ridge_equals_a_direct_solution(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 2))
    y = 1 + x @ [2, -1] + 0.1 * r.standard_normal(60)
    df = spark.createDataFrame([(1, i // 3, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "g int, s int, a double, b double, y double")
    sums = {(q.a, q.b): q.value for q in models.gram(df, ["g"], ["a", "b"], "y").collect()}
    z = (x - x.mean(0)) / x.std(0)
    slopes = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(models.solve_ridge(sums, ["a", "b"], "y", 1.0), [y.mean() - x.mean(0) @ slopes, *slopes])
    cv = models.ridge_cv(df, ["g"], "s", ["a", "b"], "y").first()
    assert cv.n == 60 and cv.rmse < 0.2


def test_causal_features_ignore_later_values(spark):
    data = [(1, d, float(d)) for d in range(20)] + [(2, d, 1.0) for d in range(0, 20, 3)]
    a = spark.createDataFrame(data, "id int, day int, value double")
    b = a.withColumn("value", F.when(F.col("day") >= 10, F.col("value") + 10000).otherwise(F.col("value")))
    builds = [
        lambda x: x.select("id", "day", windows.prior_mean(["id"], ["day"], "value").alias("f")),
        lambda x: x.select("id", "day", windows.range_mean(x, ["id"], "day", "value", 7, "trailing").alias("f")),
        lambda x: windows.next_session_available(x, ["id"], ["day"], "value").drop("value"),
        lambda x: joins.asof_strict_prior(x.select("id", "day"), x, "id", "day", ["value"]),
        lambda x: models.gp_filter(x, "id", "day", "value", (28.0,), (3.0,)),
    ]
    for build in builds:
        assert checks.no_future_leak(build, a, b, F.col("day") < 10)
    assert not checks.no_future_leak(lambda x: x.select("id", "day", windows.range_mean(x, ["id"], "day", "value", 7).alias("f")), a, b, F.col("day") < 10)


def test_state_space_fills_gaps_between_neighbours(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, None), (1, 2, 2.0), (2, 5, None)], "id int, day int, value double")
    out = {(r.id, r.day): r.level for r in models.state_space(df, "id", "day", "value").collect()}
    assert out[1, 0] < out[1, 1] < out[1, 2] and out[2, 5] == 0


def test_validated_join_and_empty_tables(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        joins.join_validated(a, a.withColumnRenamed("v", "w"), ["k"])
    none = a.limit(0)
    assert joins.left_fill(none, none.withColumnRenamed("v", "w"), ["k"], 0).count() == 0
    assert windows.thinned(none.select("k", F.lit(1).alias("day")), ["k"], "day", 3).count() == 0
    with pytest.raises(ValueError, match="outside"):
        prep.require_in_range(spark.createDataFrame([(2.0,)], "x double"), ["x"])


def test_interpolation_by_row_and_by_time(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1.0), (1, 5, None), (1, 6, 3.0), (2, 0, None)], "id int, t int, v double")
    assert [r.f for r in windows.interpolated_rows(df, ["id"], ["t"], "v", "f").orderBy("id", "t").collect()] == [1.0, 1.0, 2.0, 3.0, 0.0]
    out = windows.interpolated_time(df.select("id", "t"), df, ["id"], "t", "v", "f").orderBy("id", "t").collect()
    assert [round(r.f, 6) for r in out] == [1.0, 1.0, 2.6, 3.0]


def test_replicate_error_of_one_value_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 3.0), ("c", 1, None)], "m string, seed int, x double")
    assert rows(aggregates.replicate_summary(df, ["m"], "seed", ["x"]), "m") == [("a", 1, 2.0, 0.0), ("b", 2, 2.0, 1.0), ("c", 1, None, 0.0)]


def test_trait_steps_row_by_row(spark):
    spec = [(1.0 + 0.1 * k, [-1.0 + 0.1 * k, 0.0, 1.0 - 0.1 * k]) for k in range(9)]
    rows = [[1, 2, 0, 3, 1, 2, 0, 1, 3], [0, None, 1, 1, None, 3, 2, 1, 0], [3] * 9, [None] * 9]
    out = irt.trait_estimates(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "n int, i array<int>"), "i", spec, location=5.0, scale=2.0).orderBy("n").collect()
    for items, got in zip(rows, out, strict=True):
        z = 0.0
        for step in range(7):
            score = information = 0.0
            for x, (a, b) in zip(items, spec, strict=True):
                if x is not None:
                    c = [1.0, *(1 / (1 + math.exp(-a * (z - t))) for t in b), 0.0]
                    p = [max(u - v, 1e-12) for u, v in zip(c[:-1], c[1:])]
                    d = [a * u * (1 - u) - a * v * (1 - v) for u, v in zip(c[:-1], c[1:])]
                    score += d[x] / p[x]
                    information += sum(u * u / v for u, v in zip(d, p))
            if step < 6:
                z = min(max(z + score / (information + 1), -4.0), 4.0)
        assert np.allclose([got.trait, got.information, got.target, got.target_sd], [z, information, 2 * z + 5, 2 / math.sqrt(information + 1)])


def test_gram_puts_the_mean_for_a_null_predictor(spark):
    rows = [(1, 1.0, 2.0, 3.0), (1, None, 4.0, 1.0), (1, 5.0, None, 2.0), (1, None, None, 7.0), (1, 9.0, 9.0, None), (2, None, 1.0, 1.0)]
    got = {(q.g, q.a, q.b): q.value for q in models.gram(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["g"], ["a", "b"], "y").collect()}
    x = np.array([[1, 1, 2, 3], [1, 3, 4, 1], [1, 5, 3, 2], [1, 3, 3, 7]])
    names = ["one", "a", "b", "y"]
    assert all(abs(got[1, names[i], names[j]] - x[:, i] @ x[:, j]) < 1e-9 for i in range(4) for j in range(i, 4))
    assert got[2, "one", "a"] == 0 and got[2, "one", "b"] == 1


def test_notes_of_one_day_count_as_their_mean(spark):
    notes = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (1, 3, 9.0)], "id int, day int, value double")
    out = joins.asof_strict_prior(spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "id int, day int"), notes, "id", "day", ["value"]).orderBy("day").collect()
    assert [(r.note_time, r.value, r.observed) for r in out] == [(None, 0.0, False), (1, 3.0, True), (1, 3.0, True)]


def test_only_the_validation_split_has_targets(spark):
    rows = [(1, "a", 0, 6, True), (1, "a", 5, 9, True), (2, "a", 5, 9, True)]
    df = spark.createDataFrame(rows, "id int, i string, window_start int, window_end int, observed boolean")
    out = cohort.evaluation_mask(df, "id", "i", F.desc("window_end"), among=F.col("id") == 1).orderBy("id", "window_end").collect()
    assert [(r.evaluation, r.embargo, r.observed_after) for r in out] == [(False, True, False), (True, True, False), (False, False, True)]


def test_carried_categories_count_others_than_the_base(spark):
    sessions = spark.createDataFrame([(101, 10), (101, 12), (101, 15), (202, 31)], "id int, day int")
    events = spark.createDataFrame([(101, 9, ["depression"]), (101, 12, ["anxiety"]), (101, 13, None), (101, 16, ["ptsd"])], "id int, day int, categories array<string>")
    out = joins.carried_categories(sessions, events, "id", "day", "categories", ["depression", "anxiety", "ptsd"], "depression")
    assert [r[-1] for r in rows(out, "id", "day")] == [0, 0, 1, 0]
    assert [r[-2] for r in rows(out, "id", "day")] == [1, 1, 1, 0]


def test_roles_of_events_add_up(spark):
    days = {"M1": [0, 19], "M2": [0, 5, 19, 30, 31]}
    events = spark.createDataFrame([(1, k, d, d - 6, d) for k, v in days.items() for d in v], "id int, kind string, day int, window_start int, window_end int")
    out = windows.evaluation_roles(events, ["id", "kind"], "day", 28)
    late, near = "withheld_eligible", "withheld_ineligible_overlap"
    assert [r[2:] for r in rows(out.select("id", "kind", "day", "evaluation_role"), "kind", "day")] == [(0, "retained"), (19, late), (0, "retained"), (5, near), (19, late), (30, "retained"), (31, near)]
    counted = checks.event_accounting(out, ["kind"], ["id", "kind", "day"], "evaluation_role", ("retained", late, near))
    assert rows(counted.select("kind", "events", "repeated", "adds_up"), "kind") == [("M1", 2, 0, True), ("M2", 5, 0, True)]
    twice = checks.event_accounting(out.union(out).where("day = 0 or evaluation_role is null"), ["kind"], ["id", "kind", "day"], "evaluation_role", ("retained", late))
    assert rows(twice.select("repeated", "adds_up")) == [(1, True), (1, True)]


def test_clinic_exclusive_roles(spark):
    splits = ["train"] * 10 + ["val"] * 3 + ["test"] * 6
    sessions = [(1000 + 2 * c + k, part, f"C{c:02d}") for c, part in enumerate(splits) for k in (0, 1) for _ in (0, 1)] + [(1000, "test", "C18")]
    df = spark.createDataFrame(sessions, "id int, split string, clinic string")
    found = cohort.facility_exclusive(df, "id", "split")
    assert rows(found.where("excluded").select("id")) == [(1000,)]
    kept = found.where("not excluded")
    assert {r["partition"]: r["count"] for r in kept.groupBy("partition").count().collect()} == {"train": 19, "val": 6, "test": 12}
    roles = cohort.partition_roles(kept, "id", "partition")
    assert {r["role"]: r["count"] for r in roles.groupBy("role").count().collect()} == {"fit": 19, "selection": 6, "development": 25}
    held = kept.where("partition = 'test'").join(df.select("id", "clinic").distinct(), "id")
    assert {r["role"]: r["count"] for r in cohort.held_out_halves(held, "clinic", "id").groupBy("role").count().collect()} == {"calibration": 6, "test": 6}


def test_truncated_labels_reconcile(spark):
    df = spark.createDataFrame([("DALLA",), ("DALLAS",), ("OTHER",), (None,)], "c string")
    table = {"DALLA": "DALLAS_GRP", "DALLAS": "DALLAS_GRP"}
    assert [r[0] for r in df.select(prep.canonical(F.col("c"), table)).collect()] == ["DALLAS_GRP", "DALLAS_GRP", "OTHER", None]


def test_blocked_paths(spark):
    cases = {"a/b.csv": "suffix", "B.XLSX": "suffix", "x.tar.gz": "suffix", "Raw/x.py": "folder", "raw.py": None, "x/.env": "name", "credentials_old": "name", "x/my_credentials": None, ".csv": None, "src/a.py": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert dict(rows(df.select("p", checks.blocked_path(F.col("p"))))) == cases


def test_median_of_pairs_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    data = {1: rng.normal(size=41), 2: np.array([5.0, 5.0, 5.0, 7.0]), 3: np.array([1.0, 1e9]), 4: np.array([2.0]), 5: np.round(rng.normal(size=30), 1)}
    df = spark.createDataFrame([(b, i, float(v)) for b, vs in data.items() for i, v in enumerate(vs)] + [(2, 99, None)], "b int, id int, v double")
    got = {r["b"]: r["median_difference"] for r in joins.median_difference(df, ["b"], "id", "v").collect()}
    want = {b: np.median([abs(x - y) for i, x in enumerate(v) for y in v[:i]]) for b, v in data.items() if len(v) > 1}
    assert got.keys() == want.keys()
    assert all(abs(got[b] - want[b]) <= 1e-12 * max(1.0, want[b]) for b in want)


def test_expected_values_and_treatment_window(spark):
    have = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    want = spark.createDataFrame([("a", 1), (None, 3), ("c", 4)], "k string, n int")
    assert {r[0]: r[1] for r in checks.expected_values(have, want, ["k"], "n").select("k", "ok").collect()} == {"a": True, None: False, "c": False}
    pairs = spark.createDataFrame([(0, 1), (83, 84), (83, 85), (84, 84), (-1, 3), (5, None)], "d int, n int")
    assert rows(prep.in_treatment_window(pairs, "d", "n"), "d") == [(0, 1), (83, 84)]


def test_causal_filter_equals_a_solve_for_each_day(spark):
    rng = np.random.default_rng(5)
    data = [(1, int(t), float(x)) for t, x in zip([0, 1, 1, 4, 9, 9, 30], rng.normal(size=7))] + [(2, 3, 1.5)]
    df = spark.createDataFrame(data + [(3, 1, None)], "id int, day int, v double")
    got = rows(models.gp_filter(df, "id", "day", "v", slow=(14.0,), fast=(3.0,)), "id", "day", "predicted")
    kernel = lambda gap: np.exp(-0.5 * (gap / 14.0) ** 2) + 0.5 * np.exp(-gap / 3.0)
    want = []
    for s, day, _ in data:
        t, v = (np.array([r[k] for r in data if r[0] == s and r[1] < day], dtype=float) for k in (1, 2))
        cov = kernel(np.abs(t[:, None] - t[None, :])) + 0.25 * np.eye(len(t))
        want.append((s, day, v.mean() + kernel(np.abs(day - t)) @ np.linalg.solve(cov, v - v.mean()) if len(t) else 0.0))
    assert len(got) == len(want)
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, sorted(want), strict=True))


def test_daily_readout_equals_a_dense_fit(spark):
    r = np.random.default_rng(7)
    axis = [("a", u, t, None if (u + t) % 4 == 0 else float(r.normal()), float(r.normal())) for u in range(4) for t in range(6)]
    points = [("a", u, t, float(r.normal())) for u in range(3) for t in (1, 4)] + [("a", 3, 2, 9.0), ("a", 0, 2, None)]
    got = models.daily_readout(spark.createDataFrame(axis, "g string, u int, t int, x double, z double"), spark.createDataFrame(points, "g string, u int, t int, y double"), ["g"], "u", "t", ["x", "z"], "y").first()
    own = {u: sorted((t, y) for _, v, t, y in points if v == u and y is not None) for u in range(3)}
    rows = [q for q in axis if q[1] < 3]
    y = np.array([np.interp(t, *zip(*own[u])) for _, u, t, *_ in rows])
    x = np.array([[q[3] if q[3] is not None else np.nan, q[4]] for q in rows])
    means = np.nanmean(x, axis=0)
    design = np.column_stack([np.ones(len(x)), np.where(np.isnan(x), means, x)])
    coef = np.linalg.solve(design.T @ design + np.diag([0, 1, 1]), design.T @ y)
    assert np.allclose([got.intercept, *got.coefficients, *got.means, got.sd], [*coef, *means, max(np.std(y - design @ coef), 0.35)]) and got.n == 18


def test_transition_association_finds_what_explains(spark):
    r = np.random.default_rng(2)
    data = []
    for g in ("noise", "signal"):
        for u in range(20):
            for t in range(8):
                a, b, s = r.normal(size=3)
                data.append((g, u, t, float(s), float(a), float(b), float((2 * b if g == "signal" else 0) - s + 0.1 * r.normal())))
    df = spark.createDataFrame(data, "g string, u int, t int, s double, a double, b double, y double")
    out = {q.g: q for q in models.transition_association(df, ["g"], "u", "t", ["s"], ["a", "b"], "y", 39).collect()}
    hit, miss = out["signal"], out["noise"]
    assert hit.p == 1 / 40 and hit.adjusted == 2 / 40 and hit.top == "b" and hit.improvement > 1 and 0.7 < hit.added_r2 < 0.9 and abs(hit.norm - 2) < 0.5
    assert miss.p > 0.05 and miss.adjusted == miss.p and abs(miss.improvement) < 0.05 and hit.n == miss.n == 160
    direct = models.ridge_cv(df.where("g = 'signal'"), ["g"], "u", ["s", "a", "b"], "y").first()
    assert abs(direct.rmse - hit.rmse) < 1e-9
