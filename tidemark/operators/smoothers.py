"""Latent levels between sparse measurements: a smoother with shared coefficients, and a causal Gaussian-process filter.

Both read a panel: one row for each subject, with its days, features and measurements as arrays. The panel is written
once; every later step is a scan of it without a shuffle, whose sums are small and combined by one aggregate. A
subject's days are distinct, so the calendar bounds its arrays. Linear algebra runs in the tasks: subjects of
alike sizes together for the smoother, one at a time for the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import aggregates, factors, irt, models, windows
from tidemark.sources.tables import written, written_wide


@dataclass(frozen=True)
class Instrument:
    """A calibrated graded-response instrument: each item's discrimination and thresholds, and the raw scale of its trait."""

    spec: tuple[tuple[float, tuple[float, ...]], ...]
    location: float = 0.0
    scale: float = 1.0


@dataclass(frozen=True)
class Shape:
    """What a panel's arrays hold, and what its training rows say: location and scale of the auxiliary inputs, and each channel's readout deviation and variance."""

    subject: str
    day: str
    channels: tuple[str, ...]
    profile: int
    features: int
    auxiliary: int
    strata: int
    center: tuple[float, ...]
    scale: tuple[float, ...]
    noise: tuple[float, ...]
    spread: tuple[float, ...]
    instrument: Instrument | None = None


@dataclass(frozen=True)
class Panel:
    rows: DataFrame
    shape: Shape


def panel(
    axis: DataFrame, points: DataFrame, subject: str, day: str, channels: list[str], profile: list[str], action: str, actions: list, recent: str, burden: str, signals: list[str],
    basis: str = "linear", subtype: str | None = None, subtypes: int = 0, strata: int = 0, penalty: float = 1.0, instrument: Instrument | None = None,
) -> Panel:
    """Packs a panel from sessions and measurements, and fits each channel's readout of the signals.

    axis has one row for each subject and day: train (whether the subject's rows may teach), profile columns (null ones are
    interpolated), an action, recent and burden, and signals (null ones weren't seen). points has subject, channel,
    window_start, window_end, available, value, loading and sd; those that lack a number or whose loading is next to
    nothing are left out, as is one whose window holds no day of its subject. A channel without a readout has that of
    zeros. Strata are quantile strata of a subject's number of points.

    With an instrument, points have items (an array of categories, null where not answered) instead of value, loading
    and sd: the trait that explains them best, on the raw scale, stands for the value and its deviation for sd, and the
    smoother goes back to the items themselves. Points without any answer, or with another number of items, are left out.
    """
    if instrument:
        some = points.where(F.coalesce(F.size("items") == len(instrument.spec), F.lit(False)) & F.exists("items", lambda x: x.isNotNull()))
        points = irt.trait_estimates(some, "items", [(a, list(b)) for a, b in instrument.spec], location=instrument.location, scale=instrument.scale)
        points = points.withColumns({"value": F.col("target"), "loading": F.lit(1.0), "sd": F.col("target_sd")}).drop("trait", "information", "target", "target_sd")
    ok = [scalar.finite(F.col(c)).isNotNull() for c in ("value", "loading", "sd")]
    points = points.where(ok[0] & ok[1] & ok[2] & (F.abs("loading") >= 1e-8) & F.col("channel").isin(channels))
    for c in profile:
        axis = windows.interpolated_rows(axis, [subject], [day], c, f"_b_{c}")
    axis, points = written(axis, "axis"), written(points, "points")
    b = [F.col(f"_b_{c}") for c in profile]
    teach = axis.where("train").select(subject).distinct()
    targets = points.select(F.col("channel"), subject, F.col("window_end").cast("double").alias("_at"), (F.col("value") / F.col("loading")).alias("_y")).join(teach, subject, "left_semi")
    taught = axis.where("train").select(subject, F.col(day).cast("double").alias("_at"), *signals, F.explode(F.array(*(F.lit(c) for c in channels))).alias("channel"))
    read = {r["channel"]: r for r in models.daily_readout(taught, targets, ["channel"], subject, "_at", signals, "_y", penalty).collect()}

    def readout(c: str):
        r, out = read.get(c), F.lit(0.0)
        for k, s in enumerate(signals if r else ()):
            out = out + r["coefficients"][k] * F.coalesce(F.col(s).cast("double"), F.lit(r["means"][k]))
        return out + (r["intercept"] if r else 0.0)

    auxiliary = [*b, *((F.col(action) == a).cast("double") for a in actions), F.col(recent), F.col(burden)]
    auxiliary = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in auxiliary]
    design = scalar.transition_features(b, F.col(action), F.col(recent), F.col(burden), actions, basis, F.col(subtype) if subtype else None, subtypes)
    seen = F.greatest(*(F.col(s).isNotNull().cast("double") for s in signals), F.lit(0.0))
    rows = axis.select(
        subject, "train", F.col(day).cast("double").alias("_d"), F.transform(design, lambda x: F.coalesce(x, F.lit(0.0))).alias("_f"), F.array(*auxiliary).alias("_x"),
        F.array(*(readout(c) for c in channels)).alias("_r"), seen.alias("_o"),
    )
    packed = rows.groupBy(subject).agg(F.max("train").alias("train"), F.array_sort(F.collect_list(F.struct("_d", "_f", "_x", "_r", "_o"))).alias("_s"))
    take = lambda c: F.transform("_s", lambda s: s[c])
    packed = packed.select(subject, "train", take("_d").alias("days"), F.flatten(take("_f")).alias("features"), F.flatten(take("_x")).alias("auxiliary"), F.flatten(take("_r")).alias("readouts"), take("_o").alias("seen"))
    number = F.array_position(F.array(*(F.lit(c) for c in channels)), F.col("channel")) - 1
    fields = {"available": F.col("available"), "channel": number, "start": F.col("window_start"), "end": F.col("window_end"), "value": F.col("value"), "loading": F.col("loading"), "sd": F.col("sd")}
    items = F.transform("items", lambda x: F.coalesce(x.cast("double"), F.lit(-1.0))) if instrument else F.array().cast("array<double>")
    measured = points.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(*(v.cast("double").alias(n) for n, v in fields.items()), items.alias("items")))).alias("_p"))
    none = F.array().cast("array<double>")
    part = lambda n: F.coalesce(F.transform("_p", lambda p: p[n]), none).alias(f"p_{n}")
    packed = packed.join(measured, subject, "left").select("*", *(part(n) for n in fields), F.coalesce(F.flatten(F.transform("_p", lambda p: p["items"])), none).alias("p_items")).drop("_p")
    packed = aggregates.quantile_strata(packed.withColumn("_n", F.size("p_value")), "_n", strata).drop("_n") if strata else packed.withColumn("stratum", F.lit(0))
    packed = written_wide(packed.withColumn("stratum", F.col("stratum").cast("int")), "panel", subject)
    # location and scale of what the auxiliary kernel reads, and each channel's variance: from rows that may teach
    place = [F.get("_x", F.lit(k)) for k in range(len(auxiliary))]
    stats = rows.where("train").agg(*(F.avg(x).alias(f"m{k}") for k, x in enumerate(place)), *(F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(place))).first()
    spread = {r["channel"]: r["v"] for r in targets.groupBy("channel").agg(F.var_pop("_y").alias("v")).collect()}
    scale = [stats[f"s{k}"] or 0.0 for k in range(len(place))]
    shape = Shape(
        subject, day, tuple(channels), len(profile), _width(len(profile), len(actions), basis, subtypes if subtype else 0), len(auxiliary), strata,
        tuple(stats[f"m{k}"] or 0.0 for k in range(len(place))), tuple(x if x >= 1e-6 else 1.0 for x in scale), tuple(read[c]["sd"] if c in read else 1.0 for c in channels), tuple(max(spread.get(c) or 0.0, 0.25) for c in channels), instrument,
    )
    return Panel(packed, shape)


def _width(q: int, actions: int, basis: str, subtypes: int) -> int:
    more = {"linear": 0, "interaction": 2, "nonlinear": 4, "stratified": 4 + subtypes}[basis]
    return 1 + q + actions + 2 + q * more


_LISTS = ("days", "features", "auxiliary", "readouts", "seen", "p_available", "p_channel", "p_start", "p_end", "p_value", "p_loading", "p_sd", "p_items")


def _people(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each row's arrays as numpy views."""
    lists = {}
    for c in _LISTS:
        column = batch.column(c)
        lists[c] = (column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy())
    train, stratum = batch.column("train").to_pylist(), batch.column("stratum").to_pylist()
    for i in range(len(batch)):
        yield {c: v[o[i] : o[i + 1]] for c, (v, o) in lists.items()} | {"i": i, "train": bool(train[i]), "stratum": stratum[i]}


def _windows(p: dict, channel: int) -> dict[str, np.ndarray]:
    """The channel's measurements whose windows hold any of the subject's days: first and last + 1 of those days' places, and the rest."""
    own = np.flatnonzero(p["p_channel"] == channel)
    lo, hi = np.searchsorted(p["days"], p["p_start"][own], "left"), np.searchsorted(p["days"], p["p_end"][own], "right")
    some = hi > lo
    return {"lo": lo[some], "hi": hi[some], "at": own[some]} | {c: p[f"p_{c}"][own[some]] for c in ("available", "value", "loading", "sd")}


def gap_factors(rho: float, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What persists over a gap, and the factors of its drift and its innovation's deviation."""
    keep = rho**gap
    return keep, (1 - keep) / (1 - rho), np.sqrt(np.maximum((1 - keep * keep) / max(1 - rho * rho, 1e-8), 0))


#: Bytes of the blocks of normal equations that are solved together; one subject may take more.
STACKED = 1 << 23


class Stacked:
    """Subjects whose normal equations have blocks of one size, end to end, and one channel: their equations are made and solved together.

    A window ties no days further apart than its own length, so a subject's equations are block tridiagonal with blocks
    of its longest window: time grows with the days, not with their cube. Each subject has as many blocks as the one with
    the most; places beyond its days have equations of their own, which nothing ties to it.
    """

    def __init__(self, people: list[dict], found: list[dict[str, np.ndarray]], channel: int, m: int, shape: Shape):
        days = np.array([len(p["days"]) for p in people])
        self.channel, self.shape, self.m = channel, shape, m
        self.blocks = int((-(-days // m)).max())
        self.start = np.arange(len(people)) * self.blocks * m
        self.place = np.repeat(self.start - (np.cumsum(days) - days), days) + np.arange(days.sum())
        self.ends = np.cumsum(days)
        every = lambda c: np.concatenate([p[c] for p in people])
        self.days, self.seen = every("days"), every("seen") > 0
        self.readouts = every("readouts").reshape(-1, len(shape.channels))[:, channel]
        inner = np.ones(len(self.days), bool)
        inner[self.ends - 1] = False
        self.first = np.flatnonzero(inner)  # of each transition: its first day
        self.gap = self.days[self.first + 1] - self.days[self.first]
        self.features = every("features").reshape(-1, shape.features)[self.first]
        self.stratum = np.repeat([p["stratum"] for p in people], days)[self.first]
        self.points = {c: np.concatenate([w[c] for w in found]) for c in ("value", "loading", "sd")}
        count = [len(w["lo"]) for w in found]
        self.lo, self.length = np.repeat(self.start, count) + np.concatenate([w["lo"] for w in found]), np.concatenate([w["hi"] - w["lo"] for w in found])
        if shape.instrument:
            self.items = np.concatenate([p["p_items"].reshape(-1, len(shape.instrument.spec))[w["at"]] for p, w in zip(people, found, strict=True)]).astype(np.int64)

    def _pairs(self, some: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the measurements in some, each with each place in its window that has another so far behind it there."""
        some = some[self.length[some] > apart]
        count = self.length[some] - apart
        return np.repeat(some, count), np.repeat(self.lo[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def solve(self, theta: np.ndarray, rho: float, innovation: float, prior: float, trait: np.ndarray | None = None) -> np.ndarray:
        """The level of each subject at each of its days: weighted least squares over a prior for the first day, windowed measurements, the readout where signals were seen, and gap-aware transitions.

        With an instrument a measurement is one Fisher-scoring step from trait, the point for each of the channel's
        measurements around which its items are linearized, without any prior of its own; trait is moved to the
        solution's. Items that say next to nothing are left out.
        """
        shape, m, size, noise = self.shape, self.m, len(self.start) * self.blocks * self.m, self.shape.noise[self.channel]
        value, loading, sd = (self.points[c] for c in ("value", "loading", "sd"))
        used = np.arange(len(self.lo))
        if trait is not None:
            own = shape.instrument
            score, information = irt.score_and_information(trait, self.items, own.spec)
            some = information >= 1e-3
            used = np.flatnonzero(some)
            information = np.where(some, information, 1)
            value, sd, loading = (trait + score / information) * own.scale + own.location, own.scale / np.sqrt(information), np.ones(len(trait))
        bands, right = np.zeros((m, size)), np.zeros(size)
        bands[0] = 1.0
        bands[0, self.place] = 0.0
        bands[0, self.start] += prior**-2
        seen = self.place[self.seen]
        bands[0, seen] += noise**-2
        right[seen] += self.readouts[self.seen] * noise**-2
        keep, drift, spread = gap_factors(rho, self.gap)
        mean = self.features @ theta[: shape.features] + (theta[shape.features + self.stratum] if shape.strata else 0.0)
        weight = (np.maximum(innovation * spread, 1e-8)) ** -2.0
        a = self.place[self.first]
        bands[0, a + 1] += weight
        bands[0, a] += keep * keep * weight
        bands[1, a] -= keep * weight
        right[a + 1] += weight * mean * drift
        right[a] -= keep * weight * mean * drift
        each, sd = loading / self.length, np.maximum(sd, 1e-8)
        for apart in range(m):
            whose, at = self._pairs(used, apart)
            if apart == 0:
                right += np.bincount(at, (each * value / sd**2)[whose], minlength=size)
            bands[apart] += np.bincount(at, ((each / sd) ** 2)[whose], minlength=size)
        main, side = np.zeros((2, size // m, m, m))
        for apart in range(m):
            band, low, high = bands[apart].reshape(-1, m), np.arange(m - apart), np.arange(apart, m)
            main[:, low, high] = main[:, high, low] = band[:, : m - apart]
            side[:, np.arange(m - apart, m), np.arange(apart)] = band[:, m - apart :]
        main, side = (x.reshape(len(self.start), self.blocks, m, m) for x in (main, side))
        right = right.reshape(len(self.start), self.blocks, m, 1)
        for i in range(1, self.blocks):
            back = side[:, i - 1].transpose(0, 2, 1) @ np.linalg.solve(main[:, i - 1], np.concatenate([side[:, i - 1], right[:, i - 1]], axis=2))
            main[:, i] -= back[:, :, :m]
            right[:, i] -= back[:, :, m:]
        for i in range(self.blocks - 1, -1, -1):
            right[:, i] = np.linalg.solve(main[:, i], right[:, i] - (side[:, i] @ right[:, i + 1] if i + 1 < self.blocks else 0.0))
        flat = right.ravel()
        if trait is not None:
            whose, at = self._pairs(np.arange(len(self.lo)), 0)
            trait[:] = (np.bincount(whose, flat[at], minlength=len(trait)) / self.length - shape.instrument.location) / shape.instrument.scale
        return flat[self.place]


def _alike(people: list[dict], found: list[list[dict[str, np.ndarray]]]) -> Iterator[tuple[int, list[int]]]:
    """Size of blocks and places of subjects that are solved together: alike in their longest window and, within a factor of two, in their blocks."""
    longest = [max([2, *(int((w["hi"] - w["lo"]).max(initial=1)) for w in own)]) for own in found]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (p, m) in enumerate(zip(people, longest, strict=True)):
        groups.setdefault((m, (-(-len(p["days"]) // m) - 1).bit_length()), []).append(k)
    for (m, _), own in groups.items():
        most = max(-(-len(people[k]["days"]) // m) for k in own)
        step = max(1, STACKED // (8 * most * m * max(m, 16)))
        for at in range(0, len(own), step):
            yield m, own[at : at + step]


@dataclass(frozen=True)
class Step:
    """Per channel coefficients (features, then strata), persistence and innovation."""

    theta: tuple[tuple[float, ...], ...]
    persistence: tuple[float, ...]
    innovation: tuple[float, ...]


@dataclass(frozen=True)
class Smoother:
    """The steps of a fit, of which the last is what it found, and the prior deviation of a first day."""

    steps: tuple[Step, ...]
    prior: float

    @property
    def theta(self) -> tuple[tuple[float, ...], ...]:
        return self.steps[-1].theta

    @property
    def persistence(self) -> tuple[float, ...]:
        return self.steps[-1].persistence

    @property
    def innovation(self) -> tuple[float, ...]:
        return self.steps[-1].innovation

    def stacks(self, people: list[dict], shape: Shape) -> Iterator[tuple[list[int], Stacked, np.ndarray]]:
        """Places of subjects that were solved together, their days and transitions, and their levels, channels by days. With an instrument every step is walked again, because the points around which items are linearized move with each; they are never stored."""
        found = [[_windows(p, c) for c in range(len(shape.channels))] for p in people]
        for m, own in _alike(people, found):
            out = []
            for c in range(len(shape.channels)):
                stack = Stacked([people[k] for k in own], [found[k][c] for k in own], c, m, shape)
                trait = np.zeros(len(stack.lo)) if shape.instrument else None
                for step in self.steps if shape.instrument else self.steps[-1:]:
                    x = stack.solve(np.array(step.theta[c]), step.persistence[c], step.innovation[c], self.prior, trait)
                out.append(x)
            yield own, stack, np.stack(out)

    def levels(self, people: list[dict], shape: Shape) -> list[np.ndarray]:
        """Channels by days of each subject."""
        out: list[np.ndarray] = [np.zeros((len(shape.channels), 0))] * len(people)
        for own, stack, x in self.stacks(people, shape):
            for k, levels in zip(own, np.split(x, stack.ends[:-1], axis=1), strict=True):
                out[k] = levels
        return out


def _pooled_sums(data: Panel, fit: Smoother, grid: tuple[float, ...]) -> np.ndarray:
    """Sums of products of (features, strata, each channel's outcome under each persistence) over all transitions of subjects that may teach."""
    shape = data.shape
    size = shape.features + shape.strata + len(shape.channels) * len(grid)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            people = [p for p in _people(batch) if p["train"] and len(p["days"]) > 1]
            for _, stack, levels in fit.stacks(people, shape):
                one = np.zeros((len(stack.first), shape.strata))
                if shape.strata:
                    one[np.arange(len(one)), stack.stratum] = 1.0
                factors = [gap_factors(rho, stack.gap) for rho in grid]
                outcomes = [(x[stack.first + 1] - keep * x[stack.first]) / np.maximum(drift, 1e-8) for x in levels for keep, drift, _ in factors]
                z = np.column_stack([stack.features, one, *outcomes])
                total += z.T @ z
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])

    found = data.rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((size, size))
    for r in found:
        out[r["i"], r["j"]] = r["value"]
    return out


def pooled_step(sums: np.ndarray, channels: int, features: int, strata: int, profile: int, grid: tuple[float, ...], penalty: float) -> tuple[list[np.ndarray], list[float], list[float]]:
    """Coefficients, persistence and innovation from the pooled sums: the profile's coefficients are the same for all channels, all others are a channel's own; of the grid of persistences the least mean squared residual wins, the first of equal ones."""
    width = features + strata
    shared = np.arange(1, 1 + profile)
    own = np.setdiff1d(np.arange(width), shared)
    total = profile + channels * len(own)
    maps = []
    for c in range(channels):
        m = np.zeros((width, total))
        m[shared, np.arange(profile)] = 1.0
        m[own, profile + c * len(own) + np.arange(len(own))] = 1.0
        maps.append(m)
    ridge = penalty * np.eye(total)
    for c in range(channels):
        ridge[profile + c * len(own), profile + c * len(own)] = 0.0  # the constant
    xx, n = sums[:width, :width], sums[0, 0]
    left = sum(m.T @ xx @ m for m in maps) + ridge
    best = None
    for choice in product(range(len(grid)), repeat=channels):
        at = [width + c * len(grid) + k for c, k in enumerate(choice)]
        beta = np.linalg.solve(left, sum(m.T @ sums[:width, a] for m, a in zip(maps, at, strict=True)))
        theta = [m @ beta for m in maps]
        errors = [sums[a, a] - 2 * t @ sums[:width, a] + t @ xx @ t for t, a in zip(theta, at, strict=True)]
        if best is None or sum(errors) < best[0]:
            means = [(sums[0, a] - sums[0, :width] @ t) / n for t, a in zip(theta, at, strict=True)]
            best = (sum(errors), theta, [grid[k] for k in choice], [max(float(np.sqrt(max(e - n * u * u, 0) / max(n - 1, 1))), 0.05) for e, u in zip(errors, means, strict=True)])
    return best[1], best[2], best[3]


def fit_smoother(data: Panel, rounds: int = 3, grid: tuple[float, ...] = (0.1, 0.3, 0.6, 0.9), start: float = 0.6, innovation: float = 0.3, prior: float = 1.0, penalty: float = 1.0) -> Smoother:
    """Alternates between all subjects' levels and one pooled ridge fit of their transitions.

    With strata the channels have an offset for each (a pattern mixture). A round is one scan of the panel whose sums
    are a small matrix; what a round hands to the next are the coefficients alone, so no lineage grows. Without any
    transition to learn from the start is kept.
    """
    if any(not 0 < rho < 1 for rho in grid):
        raise ValueError("persistence must lie between 0 and 1")
    shape = data.shape
    c, width = len(shape.channels), shape.features + shape.strata
    steps = [Step(((0.0,) * width,) * c, (start,) * c, (innovation,) * c)]
    for _ in range(max(1, rounds)):
        sums = _pooled_sums(data, Smoother(tuple(steps), prior), grid)
        if sums[0, 0] < 1:
            break
        theta, rho, spread = pooled_step(sums, c, shape.features, shape.strata, shape.profile, grid, penalty)
        steps.append(Step(tuple(tuple(float(x) for x in t) for t in theta), tuple(rho), tuple(spread)))
    return Smoother(tuple(steps), prior)


def _unpacked(data: Panel, levels) -> DataFrame:
    """One row for each subject and day with levels(people), an array of channels by days for each, and their mean."""
    kinds, subject, day = dict(data.rows.dtypes), data.shape.subject, data.shape.day
    names = [*(f"level_{c}" for c in data.shape.channels), "level"]

    def run(batches):
        for batch in batches:
            people = list(_people(batch))
            if not people:
                continue
            days = [p["days"] for p in people]
            found = np.concatenate(levels(people), axis=1)
            whose = batch.column(subject).take(pa.array(np.repeat(np.arange(len(batch)), [len(d) for d in days])))
            yield pa.RecordBatch.from_arrays([whose, pa.array(np.concatenate(days)), *(pa.array(x) for x in found), pa.array(found.mean(axis=0))], [subject, day, *names])

    return data.rows.mapInArrow(run, ", ".join([f"`{subject}` {kinds[subject]}, `{day}` double", *(f"`{n}` double" for n in names)]))


def smoothed(data: Panel, fit: Smoother) -> DataFrame:
    """subject, day, a level for each channel, and their mean."""
    shape = data.shape
    return _unpacked(data, lambda people: fit.levels(people, shape))


# --- causal filter -------------------------------------------------------------------------------------------------

#: Shares of a channel's variance: the slow and the fast kernel of time, and the kernel of profile and treatment.
SLOW, FAST, AUXILIARY = 0.85 * 0.70, 0.85 * 0.30, 0.15


def _kernel(t: np.ndarray, x: np.ndarray, at: slice, variance: float, slow: float, fast: float) -> np.ndarray:
    """Covariances of the days in at with all days."""
    gap = np.abs(t[at, None] - t[None, :])
    out = variance * SLOW * np.exp(-0.5 * (gap / slow) ** 2) + variance * FAST * np.exp(-gap / fast)
    apart = np.maximum((x[at] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * x[at] @ x.T, 0) / x.shape[1]
    out += variance * AUXILIARY * np.exp(-0.5 * apart)
    out[np.arange(out.shape[0]), np.arange(len(t))[at]] += 1e-6
    return out


class Conditioned:
    """Measurements of one subject and channel in the order in which they become available, and the factor of their covariance.

    A leading part of the factor is that of the measurements available first, so one factor serves every day. Kernels
    are made a block of days at a time and measured by running sums; the factor is made and used in blocks.
    """

    def __init__(self, p: dict, channel: int, channels: int, auxiliary: np.ndarray, variance: float, slow: float, fast: float):
        w = _windows(p, channel)
        order = np.argsort(w["available"], kind="stable")
        self.lo, self.hi, self.available = (w[c][order] for c in ("lo", "hi", "available"))
        self.weight = w["loading"][order] / (self.hi - self.lo)
        self.t, self.x, self.settings = p["days"] - p["days"][:1], auxiliary, (variance, slow, fast)
        self.mean = p["readouts"].reshape(len(self.t), channels)[:, channel]
        self.n = len(self.lo)
        sums = np.concatenate(([0.0], np.cumsum(self.mean)))
        self.residual = w["value"][order] - self.weight * (sums[self.hi] - sums[self.lo])
        self.noise = w["sd"][order] ** 2
        self.days = p["days"]

    def measured(self, at: slice) -> np.ndarray:
        """Covariances of the days in at with the measurements."""
        k = np.cumsum(_kernel(self.t, self.x, at, *self.settings), axis=1)
        k = np.concatenate([np.zeros((len(k), 1)), k], axis=1)
        return (k[:, self.hi] - k[:, self.lo]) * self.weight

    def factor(self) -> None:
        for extra in (0.0, 1e-5):
            try:
                self._factor(extra)
                return
            except np.linalg.LinAlgError:
                if extra:
                    raise

    def _factor(self, extra: float) -> None:
        n, block = self.n, factors.BLOCK
        self.low = factors.Factor(n)
        for a in range(0, len(self.t), block):
            b = min(a + block, len(self.t))
            own = np.flatnonzero((self.lo < b) & (self.hi > a))
            if not len(own):
                continue
            rows = np.cumsum(self.measured(slice(a, b)), axis=0)
            rows = np.concatenate([np.zeros((1, n)), rows])
            self.low.low[own] += (rows[np.minimum(self.hi[own], b) - a] - rows[np.maximum(self.lo[own], a) - a]) * self.weight[own, None]
        self.low.low[np.arange(n), np.arange(n)] += self.noise + extra
        self.low.factor()
        self.solved = self.low.forward(self.residual[:, None], n)[:, 0]

    def cost(self) -> float:
        """Half of the quadratic form, the logarithm of the determinant and n log 2 pi."""
        self.factor()
        return 0.5 * (float(self.solved @ self.solved) + self.low.log_determinant() + self.n * float(np.log(2 * np.pi)))

    def means(self) -> np.ndarray:
        """Each day's mean given the measurements that were available before it."""
        out = self.mean.astype(float).copy()
        if not self.n:
            return out
        self.factor()
        known = np.searchsorted(self.available, self.days, "left")
        for a in range(0, len(out), factors.BLOCK):
            b = min(a + factors.BLOCK, len(out))
            most = int(known[a:b].max())
            if most:
                weight = np.cumsum(self.low.forward(self.measured(slice(a, b)).T[:most], most) * self.solved[:most, None], axis=0)
                some = np.flatnonzero(known[a:b] > 0)
                out[a + some] += weight[known[a + some] - 1, some]
        return out


def _scaled(shape: Shape, p: dict) -> np.ndarray:
    return (p["auxiliary"].reshape(len(p["days"]), shape.auxiliary) - np.array(shape.center)) / np.array(shape.scale)


def fit_filter(data: Panel, slow: tuple[float, ...] = (14.0, 28.0, 56.0), fast: tuple[float, ...] = (1.0, 3.0, 7.0)) -> tuple[tuple[float, float], ...]:
    """For each channel the slow and the fast length of least cost for each measurement over the subjects that may teach; the first of equal ones. Without any measurement, the middle of each."""
    shape = data.shape
    grid, channels = [(s, f) for s in slow for f in fast], len(shape.channels)

    def run(batches):
        cost, n = np.zeros((channels, len(grid))), np.zeros(channels)
        for batch in batches:
            for p in _people(batch):
                if not p["train"]:
                    continue
                x = _scaled(shape, p)
                for c in range(channels):
                    for k, (s, f) in enumerate(grid):
                        own = Conditioned(p, c, channels, x, shape.spread[c], s, f)
                        if own.n:
                            cost[c, k] += own.cost()
                    n[c] += own.n
        at = np.indices(cost.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(cost.ravel()), pa.array(np.repeat(n, len(grid)))], ["channel", "setting", "cost", "n"])

    found = data.rows.mapInArrow(run, "channel int, setting int, cost double, n double").groupBy("channel", "setting").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n")).collect()
    best = [(slow[len(slow) // 2], fast[len(fast) // 2])] * channels
    for c in range(channels):
        own = sorted((r["cost"] / r["n"], r["setting"]) for r in found if r["channel"] == c and r["n"])
        if own:
            best[c] = grid[own[0][1]]
    return tuple(best)


def filtered(data: Panel, lengths: tuple[tuple[float, float], ...]) -> DataFrame:
    """subject, day, a level for each channel given only what was available before the day, and their mean."""
    shape = data.shape
    channels = len(shape.channels)

    def levels(p: dict) -> np.ndarray:
        x = _scaled(shape, p)
        return np.stack([Conditioned(p, c, channels, x, shape.spread[c], *lengths[c]).means() for c in range(channels)])

    return _unpacked(data, lambda people: [levels(p) for p in people])
