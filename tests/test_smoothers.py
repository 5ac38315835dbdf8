"""Smoothers and the causal filter against dense algebra, written from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import factors, smoothers

ACTIONS, SD, GRID = [0, 1], {"d": 0.4, "p": 0.6}, (0.1, 0.3, 0.6, 0.9)


def made(seed=0, subjects=14, strata=False):
    """Axis and measurement rows; subjects differ in how often they are measured."""
    r = np.random.default_rng(seed)
    axis, points = [], []
    for s in range(subjects):
        days = np.sort(r.choice(60, r.integers(8, 22), replace=False))
        level = {c: np.cumsum(r.normal(0, 0.3, 60)) + (0.8 * (s % 3) if strata else 0) for c in SD}
        for k, day in enumerate(days):
            b = r.normal(size=2)
            axis.append((s, int(day), s % 4 != 0, None if k % 5 == 2 else float(b[0]), float(b[1]), int(r.integers(-1, 2)), float(r.integers(0, 2)), float(r.random()), None if r.random() < 0.3 else float(level["d"][day] + r.normal(0, 0.3)), None if r.random() < 0.3 else float(r.normal())))
        for c, every, back in (("d", 7, 6), ("p", 11, 13)):
            for end in range(5 + s % 3, 60, every * (1 + s % 3)):
                loading = float(r.choice([1.0, 0.8]))
                points.append((s, c, end - back, end, end + int(s == 5), float(loading * level[c][max(0, end - back) : end + 1].mean() + r.normal(0, SD[c])), loading, SD[c]))
    points += [(1, "d", 61, 70, 70, 1.0, 1.0, 0.4), (2, "d", 3, 9, 9, float("nan"), 1.0, 0.4), (2, "d", 3, 9, 9, None, 1.0, 0.4), (2, "d", 3, 9, 9, 5.0, 1e-12, 0.4), (2, "other", 3, 9, 9, 5.0, 1.0, 0.4), (99, "d", 3, 9, 9, 5.0, 1.0, 0.4)]
    return axis, points


AXIS = "id int, day int, train boolean, b0 double, b1 double, action int, recent double, burden double, x0 double, x1 double"
POINTS = "id int, channel string, window_start int, window_end int, available int, value double, loading double, sd double"


#: Two items of three categories, and a raw scale.
ITEMS = smoothers.Instrument(((1.2, (-0.5, 0.6)), (0.8, (-1.0, 0.2))), 0.1, 0.7)


def curves(z, items):
    """Score and information of answered items at z, item by item."""
    score = information = 0.0
    for x, (a, b) in zip(items, ITEMS.spec, strict=True):
        if x is None:
            continue
        above = [1.0, *(1 / (1 + math.exp(-a * (z - t))) for t in b), 0.0]
        slope = [0.0, *(a * q * (1 - q) for q in above[1:-1]), 0.0]
        p, d = [above[k] - above[k + 1] for k in range(3)], [slope[k] - slope[k + 1] for k in range(3)]
        score += d[x] / p[x]
        information += sum(v * v / w for v, w in zip(d, p, strict=True))
    return score, information


def answered(points):
    """The measurements as answers to the items; some without any."""
    r = np.random.default_rng(9)
    out = []
    for p in points:
        v = 0.0 if p[5] is None or not math.isfinite(p[5]) else p[5] / max(p[6], 0.5)
        items = [int(np.clip(np.floor(v + 1.5 + k / 3), 0, 2)) for k in range(2)]
        out.append((*p[:5], [None if r.random() < 0.15 else x for x in items]))
    return [*out, (3, "d", 2, 9, 9, None), (3, "d", 2, 9, 9, [None, None]), (3, "d", 2, 9, 9, [1])]


def packed(spark, axis, points, strata=0):
    return smoothers.panel(spark.createDataFrame(axis, AXIS), spark.createDataFrame(points, POINTS), "id", "day", ["d", "p"], ["b0", "b1"], "action", ACTIONS, "recent", "burden", ["x0", "x1"], strata=strata)


class Dense:
    """The same inputs as plain arrays, and the formulas with full matrices."""

    def __init__(self, axis, points, strata=0):
        self.people = {}
        usable = [p for p in points if p[1] in SD and p[5] is not None and math.isfinite(p[5]) and abs(p[6]) >= 1e-8]
        ids = sorted({a[0] for a in axis})
        for s in ids:
            rows = sorted(a for a in axis if a[0] == s)
            days = np.array([a[1] for a in rows], float)
            b = np.array([[np.nan if v is None else v for v in a[3:5]] for a in rows])
            for j in range(2):
                some = np.isfinite(b[:, j])
                b[:, j] = np.interp(np.arange(len(b)), np.flatnonzero(some), b[some, j]) if some.any() else 0
            flags = np.array([[float(a[5] == x) for x in ACTIONS] for a in rows])
            more = np.array([a[6:8] for a in rows])
            x = np.array([[np.nan if v is None else v for v in a[8:10]] for a in rows])
            own = {c: sorted((p for p in usable if p[0] == s and p[1] == c), key=lambda p: p[4]) for c in SD}
            self.people[s] = {"days": days, "train": rows[0][2], "f": np.column_stack([np.ones(len(rows)), b, flags, more]), "aux": np.column_stack([b, flags, more]), "x": x, "points": own}
        counts = {s: float(sum(len(v) for v in p["points"].values())) for s, p in self.people.items()}
        edges = np.quantile(list(counts.values()), np.linspace(0, 1, strata + 1)[1:-1]) if strata > 1 else []
        self.stratum, self.strata = {s: int(np.searchsorted(edges, v, side="right")) for s, v in counts.items()}, strata
        self.read = {c: self.readout(c) for c in SD}

    def design(self, person, c):
        rows, y, sd, at = [], [], [], []
        for p in person["points"][c]:
            inside = (person["days"] >= p[2]) & (person["days"] <= p[3])
            if inside.any():
                rows.append(inside * p[6] / inside.sum())
                y.append(p[5])
                sd.append(p[7])
                at.append(p[4])
        return np.array(rows).reshape(-1, len(person["days"])), np.array(y), np.array(sd), np.array(at)

    def readout(self, c):
        xs, ys = [], []
        for p in self.people.values():
            at = sorted({q[3] for q in p["points"][c]})
            if p["train"] and len(at) >= 2:
                ys.append(np.interp(p["days"], at, [np.mean([q[5] / q[6] for q in p["points"][c] if q[3] == a]) for a in at]))
                xs.append(p["x"])
        x, y = np.concatenate(xs), np.concatenate(ys)
        means = np.nanmean(x, axis=0)
        d = np.column_stack([np.ones(len(x)), np.where(np.isnan(x), means, x)])
        coef = np.linalg.solve(d.T @ d + np.diag([0.0, 1.0, 1.0]), d.T @ y)
        return coef, means, max(float(np.std(y - d @ coef)), 0.35)

    def prediction(self, person, c):
        coef, means, _ = self.read[c]
        return coef[0] + np.where(np.isnan(person["x"]), means, person["x"]) @ coef[1:]

    def level(self, s, c, theta, rho, innovation, trait=None):
        p = self.people[s]
        t = len(p["days"])
        h, y, sd, _ = self.design(p, c)
        all_h = h
        if trait is not None:
            some = []
            for k, (z, items) in enumerate(zip(trait, self.items(p, c), strict=True)):
                score, information = curves(z, items)
                if information >= 1e-3:
                    some.append(k)
                    y[k], sd[k] = (z + score / information) * ITEMS.scale + ITEMS.location, ITEMS.scale / math.sqrt(information)
            h, y, sd = h[some], y[some], sd[some]
        rows, targets = [np.eye(t)[:1], h / sd[:, None]], [np.zeros(1), y / sd]
        seen = ~np.isnan(p["x"]).all(axis=1)
        rows.append(np.eye(t)[seen] / self.read[c][2])
        targets.append(self.prediction(p, c)[seen] / self.read[c][2])
        gap = np.diff(p["days"])
        mean = p["f"][:-1] @ theta[: p["f"].shape[1]] + (theta[p["f"].shape[1] + self.stratum[s]] if self.strata else 0)
        spread = innovation * np.sqrt((1 - rho ** (2 * gap)) / (1 - rho**2))
        step = np.eye(t)[1:] - np.eye(t)[:-1] * (rho**gap)[:, None]
        rows.append(step / spread[:, None])
        targets.append(mean * (1 - rho**gap) / (1 - rho) / spread)
        out = np.linalg.lstsq(np.vstack(rows), np.concatenate(targets), rcond=None)[0]
        if trait is not None:
            trait[:] = [(row @ out - ITEMS.location) / ITEMS.scale for row in all_h]
        return out

    def items(self, person, c):
        return [p[8] for p in person["points"][c] if ((person["days"] >= p[2]) & (person["days"] <= p[3])).any()]

    def fit(self, rounds, answers=False):
        width = 7 + self.strata
        theta, rho, innovation = {c: np.zeros(width) for c in SD}, dict.fromkeys(SD, 0.6), dict.fromkeys(SD, 0.3)
        own = [0, *range(3, width)]
        for _ in range(rounds):
            if answers and not hasattr(self, "trait"):
                self.trait = {(s, c): np.zeros(len(self.items(self.people[s], c))) for s in self.people for c in SD}
            solved = {(s, c): self.level(s, c, theta[c], rho[c], innovation[c], self.trait[s, c] if answers else None) for s in self.people for c in SD}
            best = None
            for rd in GRID:
                for rp in GRID:
                    x, y = {}, {}
                    for c, r in (("d", rd), ("p", rp)):
                        x[c], y[c] = [], []
                        for s, p in self.people.items():
                            if p["train"]:
                                gap, z = np.diff(p["days"]), solved[s, c]
                                y[c].append((z[1:] - r**gap * z[:-1]) / ((1 - r**gap) / (1 - r)))
                                x[c].append(np.column_stack([p["f"][:-1], np.eye(max(self.strata, 1))[[self.stratum[s]] * len(gap)][:, : self.strata]]))
                        x[c], y[c] = np.vstack(x[c]), np.concatenate(y[c])
                    zero = np.zeros((len(x["d"]), len(own)))
                    big = np.vstack([np.column_stack([x["d"][:, 1:3], x["d"][:, own], zero]), np.column_stack([x["p"][:, 1:3], zero, x["p"][:, own]])])
                    out = np.concatenate([y["d"], y["p"]])
                    ridge = np.eye(big.shape[1])
                    ridge[2, 2] = ridge[2 + len(own), 2 + len(own)] = 0
                    beta = np.linalg.solve(big.T @ big + ridge, big.T @ out)
                    error = np.mean((out - big @ beta) ** 2)
                    if best is None or error < best[0]:
                        best = (error, rd, rp, beta, x, y)
            _, rho["d"], rho["p"], beta, x, y = best
            for k, c in enumerate(SD):
                theta[c] = np.zeros(width)
                theta[c][1:3], theta[c][own] = beta[:2], beta[2 + k * len(own) : 2 + (k + 1) * len(own)]
                innovation[c] = max(float(np.std(y[c] - x[c] @ theta[c], ddof=1)), 0.05)
        return theta, rho, innovation


@pytest.mark.parametrize("strata", [0, 3])
def test_smoother_equals_dense_algebra_in_every_round(spark, strata):
    axis, points = made(strata=bool(strata))
    data, dense = packed(spark, axis, points, strata), Dense(axis, points, strata)
    for rounds in (1, 3):
        fit = smoothers.fit_smoother(data, rounds)
        theta, rho, innovation = dense.fit(rounds)
        for k, c in enumerate(SD):
            assert fit.persistence[k] == rho[c] and np.allclose(fit.innovation[k], innovation[c]) and np.allclose(fit.theta[k], theta[c])
    out = {(r.id, int(r.day)): r for r in smoothers.smoothed(data, fit).collect()}
    assert len(out) == len(axis)
    for s, p in dense.people.items():
        want = {c: dense.level(s, c, theta[c], rho[c], innovation[c]) for c in SD}
        for k, day in enumerate(p["days"]):
            r = out[s, int(day)]
            assert np.allclose([r.level_d, r.level_p, r.level], [want["d"][k], want["p"][k], (want["d"][k] + want["p"][k]) / 2])


def test_items_are_linearized_anew_in_every_round(spark):
    axis, points = made(11)
    asked = [p for p in answered(points) if p[1] != "other"]
    data = smoothers.panel(spark.createDataFrame(axis, AXIS), spark.createDataFrame(asked, "id int, channel string, window_start int, window_end int, available int, items array<int>"), "id", "day", ["d", "p"], ["b0", "b1"], "action", ACTIONS, "recent", "burden", ["x0", "x1"], instrument=ITEMS)
    found = []
    for p in asked:
        if p[5] is None or len(p[5]) != 2 or p[5] == [None, None]:
            continue
        z = 0.0
        for _ in range(6):
            score, information = curves(z, p[5])
            z = min(4.0, max(-4.0, z + score / (information + 1)))
        found.append((*p[:5], z * ITEMS.scale + ITEMS.location, 1.0, ITEMS.scale / math.sqrt(curves(z, p[5])[1] + 1), p[5]))
    dense = Dense(axis, found)
    fit = smoothers.fit_smoother(data, 3)
    theta, rho, innovation = dense.fit(3, answers=True)
    assert fit.persistence == tuple(rho.values()) and np.allclose(fit.innovation, list(innovation.values())) and np.allclose(fit.theta, list(theta.values()))
    out = {(r.id, int(r.day)): r for r in smoothers.smoothed(data, fit).collect()}
    for s, p in dense.people.items():
        want = {c: dense.level(s, c, theta[c], rho[c], innovation[c], dense.trait[s, c]) for c in SD}
        assert np.allclose([[out[s, int(day)].level_d, out[s, int(day)].level_p] for day in p["days"]], np.column_stack([want["d"], want["p"]]))
    # the filter takes the same answers as pseudo-observations
    variance = {c: max(np.var([q[5] for p in dense.people.values() if p["train"] for q in p["points"][c]]), 0.25) for c in SD}
    assert np.allclose(data.shape.spread, list(variance.values()))
    got = {(r.id, int(r.day)): r for r in smoothers.filtered(data, ((28.0, 3.0),) * 2).collect()}
    for s, p in dense.people.items():
        want = dense_filter(dense, s, "d", (28.0, 3.0), np.array(data.shape.center), np.array(data.shape.scale), variance["d"])[0]
        assert np.allclose([got[s, int(day)].level_d for day in p["days"]], want)


def test_subjects_are_solved_together_whatever_their_sizes(spark, monkeypatch):
    """More subjects of the same kinds take no more calls of the solver, and each gets what it gets by itself."""
    r = np.random.default_rng(4)
    people = []
    for days in (1, 2, 9, 10, 11, 13, 16, 17, 23):
        lo = r.integers(0, days, 4)
        end = np.minimum(lo + 2, days - 1)
        items = r.integers(0, 3, (4, 2)).astype(float)
        people.append({"days": np.arange(days, dtype=float), "train": True, "stratum": 0, "features": r.normal(size=days * 3), "readouts": r.normal(size=days * 2), "seen": r.integers(0, 2, days).astype(float),
            "p_channel": np.array([0.0, 0, 1, 1]), "p_start": lo.astype(float), "p_end": end.astype(float), "p_available": end.astype(float), "p_value": r.normal(size=4), "p_loading": np.ones(4), "p_sd": np.full(4, 0.5), "p_items": items.ravel()})
    shape = smoothers.Shape("id", "day", ("d", "p"), 1, 3, 0, 0, (), (), (0.5, 0.5), (1.0, 1.0), ITEMS)
    steps = tuple(smoothers.Step(((0.0, 0.1, k / 9),) * 2, (0.6, 0.3), (0.3, 0.2)) for k in range(3))
    fit, calls, solve = smoothers.Smoother(steps, 1.0), [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: calls.append(1) or solve(a, b))
    alone = [fit.levels([p], shape)[0] for p in people]
    calls.clear()
    once = fit.levels(people, shape)
    few = len(calls)
    calls.clear()
    many = fit.levels(people * 20, shape)
    assert len(calls) == few
    for k, x in enumerate(many):
        assert x.shape == (2, len(people[k % len(people)]["days"])) and np.allclose(x, alone[k % len(people)]) and np.allclose(x, once[k % len(people)])


def test_one_stratum_gives_the_levels_of_none(spark):
    axis, points = made(3)
    plain, one = packed(spark, axis, points), packed(spark, axis, points, 1)
    a = smoothers.smoothed(plain, smoothers.fit_smoother(plain, 2)).orderBy("id", "day").collect()
    b = smoothers.smoothed(one, smoothers.fit_smoother(one, 2)).orderBy("id", "day").collect()
    # the constant is free of the penalty and takes the whole of the one offset
    assert np.allclose([r.level for r in a], [r.level for r in b], atol=1e-6)


def test_strata_take_their_offsets(spark):
    """Transitions drift by stratum, nothing else differs; the offsets show it."""
    r, axis, points = np.random.default_rng(2), [], []
    for s in range(45):
        k, z = s % 3, 0.0
        for day in range(50):
            z = 0.6 * z + 0.3 * (k - 1) + r.normal(0, 0.05)
            axis.append((s, day, True, 0.0, 0.0, -1, 0.0, 0.0, None, None))
            if day % (3 + 2 * k) == 0:
                points += [(s, c, day, day, day, z, 1.0, 0.05) for c in SD]
    data = packed(spark, axis, points, 3)
    theta = np.array(smoothers.fit_smoother(data, 4, grid=(0.6,)).theta)[:, 7:]
    offsets = theta - theta.mean(axis=1, keepdims=True)
    # more measurements, higher stratum: k = 0 is the top one
    assert np.allclose(offsets, [[0.3, 0.0, -0.3]] * 2, atol=0.08)


def dense_filter(dense, s, c, lengths, center, scale, variance):
    p = dense.people[s]
    t, x = p["days"] - p["days"][0], (p["aux"] - center) / scale
    gap = np.abs(t[:, None] - t[None])
    k = 0.85 * variance * (0.7 * np.exp(-0.5 * (gap / lengths[0]) ** 2) + 0.3 * np.exp(-gap / lengths[1])) + 1e-6 * np.eye(len(t))
    k += 0.15 * variance * np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).mean(axis=2))
    h, y, sd, at = dense.design(p, c)
    m = dense.prediction(p, c)
    out = m.copy()
    for i, day in enumerate(p["days"]):
        u = at < day
        if u.any():
            out[i] += k[i] @ h[u].T @ np.linalg.solve(h[u] @ k @ h[u].T + np.diag(sd[u] ** 2), y[u] - h[u] @ m)
    cost = 0.5 * ((y - h @ m) @ np.linalg.solve(h @ k @ h.T + np.diag(sd**2), y - h @ m) + np.linalg.slogdet(h @ k @ h.T + np.diag(sd**2))[1] + len(y) * np.log(2 * np.pi)) if len(y) else 0.0
    return out, cost, len(y)


@pytest.mark.parametrize(("block", "held"), [(512, 1 << 28), (3, 1 << 28), (4, 100)])
def test_filter_equals_dense_algebra_whatever_the_blocks(spark, monkeypatch, block, held):
    monkeypatch.setattr(factors, "BLOCK", block)
    monkeypatch.setattr(factors, "HELD", held)
    axis, points = made(5)
    dense = Dense(axis, points)
    data = packed(spark, axis, points)
    train = [p for p in dense.people.values() if p["train"]]
    center, scale = np.concatenate([p["aux"] for p in train]).mean(axis=0), np.concatenate([p["aux"] for p in train]).std(axis=0)
    assert np.allclose(data.shape.center, center) and np.allclose(data.shape.scale, np.where(scale < 1e-6, 1, scale))
    variance = {c: max(np.var([q[5] / q[6] for p in train for q in p["points"][c]]), 0.25) for c in SD}
    assert np.allclose(data.shape.spread, list(variance.values()))
    people = [(p, batch.column("id")[p["i"]].as_py()) for batch in data.rows.toArrow().to_batches() for p in smoothers._people(batch)]
    assert len(people) == len(dense.people)
    for p, who in people:
        for k, c in enumerate(SD):
            own = smoothers.Conditioned(p, k, 2, smoothers._scaled(data.shape, p), data.shape.spread[k], 28.0, 3.0)
            want, cost, n = dense_filter(dense, who, c, (28.0, 3.0), np.array(data.shape.center), np.array(data.shape.scale), variance[c])
            assert own.n == n and np.allclose(own.means(), want) and (not n or np.isclose(own.cost(), cost))


def test_filter_chooses_lengths_and_ignores_what_comes_later(spark):
    axis, points = made(6)
    data, dense = packed(spark, axis, points), Dense(axis, points)
    lengths = smoothers.fit_filter(data)
    for k, c in enumerate(SD):
        costs = []
        for slow in (14.0, 28.0, 56.0):
            for fast in (1.0, 3.0, 7.0):
                found = [dense_filter(dense, s, c, (slow, fast), np.array(data.shape.center), np.array(data.shape.scale), data.shape.spread[k])[1:] for s, p in dense.people.items() if p["train"]]
                costs.append((sum(x for x, _ in found) / sum(n for _, n in found), (slow, fast)))
        assert lengths[k] == min(costs, key=lambda x: x[0])[1]
    before = {(r.id, r.day): (r.level_d, r.level_p) for r in smoothers.filtered(data, lengths).collect()}
    late = [(*p[:5], p[5] + 9, *p[6:]) if p[5] is not None and p[4] >= 30 else p for p in points]
    shifted = smoothers.panel(spark.createDataFrame(axis, AXIS).withColumn("train", F.col("train")), spark.createDataFrame(late, POINTS), "id", "day", ["d", "p"], ["b0", "b1"], "action", ACTIONS, "recent", "burden", ["x0", "x1"])
    shifted = smoothers.Panel(shifted.rows, data.shape)
    # the readout learns from all measurements, so only what the filter adds to it is compared
    base = lambda panel: {(ids, d): m for ids, ds, ms in ((r.id, r.days, r.readouts) for r in panel.rows.collect()) for d, m in zip(ds, np.reshape(ms, (-1, 2)), strict=True)}
    still = smoothers.Panel(shifted.rows.drop("readouts").join(data.rows.select("id", "readouts"), "id"), data.shape)
    after = {(r.id, r.day): (r.level_d, r.level_p) for r in smoothers.filtered(still, lengths).collect()}
    assert base(data).keys() == before.keys()
    early = [k for k in before if k[1] <= 30]
    assert np.allclose([before[k] for k in early], [after[k] for k in early]) and any(not np.allclose(before[k], after[k]) for k in before if k[1] > 31)


def test_panels_without_rows_or_measurements(spark):
    axis, points = made(7, 3)
    empty = packed(spark, [], [])
    assert smoothers.smoothed(empty, smoothers.fit_smoother(empty)).count() == 0
    assert smoothers.filtered(empty, smoothers.fit_filter(empty)).count() == 0
    bare = packed(spark, axis, [])
    assert smoothers.smoothed(bare, smoothers.fit_smoother(bare)).count() == len(axis)
    assert smoothers.filtered(bare, smoothers.fit_filter(bare)).where("level_d <> 0 or level_p <> 0").count() == 0
