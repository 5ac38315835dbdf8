"""Regressions from distributed Gram matrices, and per-subject smoothers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import draw
from tidemark.operators import factors, windows
from tidemark.sources.tables import written, written_wide


def _pairs(x: list[str], y: str) -> list[tuple[str, str]]:
    names = ["one", *x, y]
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def gram_parts(df: DataFrame, by: list[str], x: list[str], y: str, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per group and pair (a, b) of the columns (1, x..., y) four sums over rows whose y isn't null: products of values (null ones as 0), of a's gaps with b, of a with b's gaps, and of gaps.

    A gap is 1 where a value is null. With them a mean can be put for null values after rows are summed, and it may
    come from other rows: the sums of groups add up. One aggregate, combined before its shuffle. pairs are all, or those given.
    """
    pairs = pairs or _pairs(x, y)
    names = ["one", *x, y]
    col = {c: F.lit(1.0) if c == "one" else F.col(c).cast("double") for c in names}
    kept = {c: F.coalesce(v, F.lit(0.0)) for c, v in col.items()}
    gap = {c: v.isNull().cast("double") for c, v in col.items()}
    sums = []
    for i, (a, b) in enumerate(pairs):
        sums += [F.sum(one * other).alias(f"_{i}{k}") for k, (one, other) in enumerate(((kept[a], kept[b]), (gap[a], kept[b]), (kept[a], gap[b]), (gap[a], gap[b])))]
    whole = df.where(F.col(y).isNotNull()).groupBy(*by).agg(*sums)
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.col(f"_{i}{k}").alias(f"v{k}") for k in range(4))) for i, (a, b) in enumerate(pairs)))
    return whole.select(*by, rows.alias("_gram"))


def gram(df: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """Per group the sums of products of (1, x..., y), one row per pair of columns; a null x stands for the group's mean of that column (0 without any)."""
    parts = gram_parts(df, by, x, y)
    place = {p: i for i, p in enumerate(_pairs(x, y))}
    at = lambda i, k: F.col("_gram")[i][f"v{k}"]
    mean = {c: F.coalesce(at(place["one", c], 0) / F.nullif(at(0, 0) - at(place["one", c], 2), F.lit(0.0)), F.lit(0.0)) if c in x else F.lit(0.0) for c in ("one", *x, y)}
    value = [at(i, 0) + mean[a] * at(i, 1) + mean[b] * at(i, 2) + mean[a] * mean[b] * at(i, 3) for (a, b), i in place.items()]
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("value")) for (a, b), v in zip(place, value, strict=True))))
    return parts.select(*by, rows.alias("_gram")).select(*by, "_gram.a", "_gram.b", "_gram.value")


class Sums:
    """The four sums of gram_parts as matrices over (1, x..., y); they add up and subtract."""

    def __init__(self, parts: list, names: list[str], start: np.ndarray | None = None):
        """From rows (a, b, v0 to v3); pairs without a row keep what they have in start, or 0."""
        at = {c: i for i, c in enumerate(names)}
        self.names, self.all = names, np.zeros((3, len(names), len(names))) if start is None else start
        for p in parts:
            i, j = at[p["a"]], at[p["b"]]
            self.all[0, i, j] = self.all[0, j, i] = p["v0"]
            self.all[1, i, j], self.all[1, j, i] = p["v1"], p["v2"]
            self.all[2, i, j] = self.all[2, j, i] = p["v3"]

    def less(self, other: Sums) -> Sums:
        out = Sums([], self.names)
        out.all = self.all - other.all
        return out

    def means(self) -> np.ndarray:
        n = self.all[0, 0, 0] - self.all[1, :, 0]
        out = np.where(n > 0.5, self.all[0, 0] / np.maximum(n, 1), 0.0)
        out[[0, -1]] = 0.0
        return out

    def filled(self, means: np.ndarray) -> np.ndarray:
        kept, mixed, gaps = self.all
        return kept + means[:, None] * mixed + (means[:, None] * mixed).T + np.outer(means, means) * gaps


def solve_ridge(sums: dict[tuple[str, str], float], x: list[str], y: str, penalty: float) -> np.ndarray:
    """Intercept and slopes on the raw scale: predictors standardized, intercept free of penalty, pseudo-inverse if singular."""
    get = lambda a, b: sums.get((a, b), sums.get((b, a), 0.0))
    n = get("one", "one")
    mean = np.array([get("one", c) / n for c in x])
    xx = np.array([[get(a, b) for b in x] for a in x])
    cov = xx - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd[sd <= 1e-8] = 1
    left = cov / np.outer(sd, sd) + penalty * np.eye(len(x))
    right = (np.array([get(c, y) for c in x]) - n * mean * get("one", y) / n) / sd
    try:
        slopes = np.linalg.solve(left, right) / sd
    except np.linalg.LinAlgError:
        slopes = np.linalg.pinv(left) @ right / sd
    return np.concatenate([[get("one", y) / n - mean @ slopes], slopes])


def _out_of_fold(parts: list[Sums], x: list[str], y: str, penalty: float) -> tuple[float, float]:
    """Squared error and rows of a fit's test folds; means and deviations come from the training folds."""
    names = parts[0].names
    total = Sums([], names)
    total.all = sum(p.all for p in parts)
    sse = n = 0.0
    for own in parts:
        rest = total.less(own)
        if rest.all[0, 0, 0] < 0.5:
            continue
        means = rest.means()
        train, test = rest.filled(means), own.filled(means)
        sums = {(a, b): train[i, j] for i, a in enumerate(names) for j, b in enumerate(names)}
        beta = np.append(solve_ridge(sums, x, y, penalty), -1.0)
        sse += float(beta @ test @ beta)
        n += own.all[0, 0, 0]
    return sse, n


def fold_of(subject: str, folds: int) -> Column:
    """A subject's fold, by a hash of its key."""
    return F.floor(draw(F.col(subject), salt="fold") * folds).cast("int")


def ridge_cv(df: DataFrame, by: list[str], subject: str, x: list[str], y: str, penalty: float = 1.0, folds: int = 5, fold: str | None = None) -> DataFrame:
    """Per group the out-of-fold squared error and RMSE of a ridge fit, whole subjects held out.

    One pass gives each fold's sums; a fold's training sums are the total less its own, and so is its error: no row is
    read twice. Means for null predictors, and the standardization, come from the training folds and serve the test
    fold as well. What reaches a task is a group's sums, four times (p + 2) squared for each fold. Rows with a null y
    are left out, a fold with nothing to learn from is not scored. fold names a column that says the fold.
    """
    keyed = df.withColumn("_fold", F.col(fold) if fold else fold_of(subject, folds))
    names = ["one", *x, y]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sse, n = _out_of_fold([Sums(g, names) for g in group["_gram"]], x, y, penalty)
        out = {c: [group[c].iloc[0]] for c in by}
        return pd.DataFrame(out | {"n": [round(n)], "sse": [sse], "rmse": [float(np.sqrt(max(sse, 0) / n)) if n else None]})

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long, sse double, rmse double"])
    return gram_parts(keyed, [*by, "_fold"], x, y).groupBy(*by).applyInPandas(fit, schema)


def daily_readout(axis: DataFrame, points: DataFrame, by: list[str], subject: str, day: str, x: list[str], target: str, penalty: float = 1.0, least_sd: float = 0.35) -> DataFrame:
    """Per group a ridge fit of the target, interpolated between a subject's points, on its daily predictors: n, intercept, coefficients, means and sd.

    The intercept is free of the penalty, predictors are on their own scale, a null one stands for its mean. Subjects of
    fewer than two points take no part; a group without any other gives no row. sd is that of what is left, at least
    least_sd. One shuffle interpolates, one aggregate sums the products; what reaches a task is a group's sums.
    """
    rows = windows.interpolated_time(axis.select(*by, subject, day, *x), points.select(*by, subject, day, target), [*by, subject], day, target, "_target")
    names = ["one", *x]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        sums = {(r.a, r.b): r.value for r in group.itertuples()}
        get = lambda a, b: sums.get((a, b), sums.get((b, a)))
        left = np.array([[get(a, b) for b in names] for a in names]) + penalty * np.diag([0.0] + [1.0] * len(x))
        coef = np.linalg.lstsq(left, np.array([get(a, "_target") for a in names]), rcond=None)[0]
        all_ = [*names, "_target"]
        beta, n = np.append(coef, -1.0), get("one", "one")
        sse = beta @ np.array([[get(a, b) for b in all_] for a in all_]) @ beta
        found = {"n": int(n), "intercept": coef[0], "coefficients": coef[1:].tolist(), "means": [get("one", c) / n for c in x], "sd": max(float(np.sqrt(max(sse, 0) / n)), least_sd)}
        return pd.DataFrame({c: [group[c].iloc[0]] for c in by} | {k: [v] for k, v in found.items()})

    kinds = dict(axis.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long, intercept double, coefficients array<double>, means array<double>, sd double"])
    return gram(rows, by, x, "_target").groupBy(*by).applyInPandas(fit, schema)


#: Groups and folds whose sums a task holds at once.
SUMS_HELD = 512


def _shifted_parts(held: DataFrame, by: list[str], subject: str, nuisance: list[str], profile: list[str], y: str, replicates: int) -> DataFrame:
    """gram_parts of the profile with nuisance and y, per group, fold and replicate, in which each subject's profile is shifted around its end; held has a subject's rows in order, as the array _s."""
    others = [*nuisance, y]
    kinds = dict(held.dtypes)
    shape = (2 * len(profile), 2 * len(others))

    def draws(name: str | None) -> np.ndarray:
        """scalar.draw of a subject and each replicate."""
        start = b"" if name is None else name.encode() + b"|"
        digests = b"".join([hashlib.md5(start + b"%d|shift" % r).digest()[:8] for r in range(1, replicates + 1)])
        return (np.frombuffer(digests, ">u8") >> 12) / 2.0**52

    def run(batches):
        sums, last, drawn = {}, (), None

        def made():
            keys = list(sums)
            columns = [pa.array([k[j] for k in keys for _ in range(replicates + 1)], t.field(c).type) for j, c in enumerate((*by, "_f"))]
            values = np.concatenate([sums[k].reshape(replicates + 1, -1) for k in keys]).ravel()
            each = pa.FixedSizeListArray.from_arrays(pa.array(values), shape[0] * shape[1]).cast(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(replicates + 1, dtype=np.int32), len(keys))), each], [*by, "_f", "replicate", "_v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.schema
            s = batch.column("_s")
            offsets, flat = s.offsets.to_numpy(), s.values
            raw = {c: np.asarray(flat.field(c).cast(pa.float64()).fill_null(0.0)) for c in (*profile, *others)}
            gaps = {c: np.asarray(flat.field(c).is_null().cast(pa.float64())) for c in raw}
            left, right = (np.column_stack([raw[c] for c in names] + [gaps[c] for c in names]) for names in (profile, others))
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "_f")), strict=True))
            for key, name, a, b in zip(keys, batch.column("_name").to_pylist(), offsets, offsets[1:], strict=False):
                if last != (name,):
                    last, drawn = (name,), draws(name)
                n = b - a
                shift = np.concatenate([[0], np.floor(drawn * n).astype(np.int64)])
                # the shifts that were drawn, each worked out once
                asked, which = np.unique(shift, return_inverse=True)
                p, o = left[a:b], right[a:b]
                found = np.stack([np.roll(p, -k, axis=0).T @ o for k in asked]) if n > 256 else p[(np.arange(n) + asked[:, None]) % n].transpose(0, 2, 1) @ o
                if key not in sums:
                    if len(sums) >= SUMS_HELD:
                        yield made()
                        sums.clear()
                    sums[key] = np.zeros((replicates + 1, *shape))
                sums[key] += found[which]
        if sums:
            yield made()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, "_f")), "replicate int, _v array<double>"])
    named = held.select(*by, "_f", F.col(subject).cast("string").alias("_name"), "_s")
    whole = named.mapInArrow(run, schema).groupBy(*by, "_f", "replicate").agg(*(F.sum(F.get("_v", F.lit(j))).alias(f"_{j}") for j in range(shape[0] * shape[1])))
    at = lambda i, j: F.col(f"_{i * shape[1] + j}")
    m, k = len(profile), len(others)
    rows = [F.struct(F.lit(c).alias("a"), F.lit(x).alias("b"), at(i, j).alias("v0"), at(m + i, j).alias("v1"), at(i, k + j).alias("v2"), at(m + i, k + j).alias("v3")) for i, c in enumerate(profile) for j, x in enumerate(others)]
    return whole.select(*by, "_f", "replicate", F.array(*rows).alias("_gram"))


def transition_association(df: DataFrame, by: list[str], subject: str, order: str, nuisance: list[str], profile: list[str], y: str, replicates: int = 200, penalty: float = 1.0) -> DataFrame:
    """Per group whether a profile explains y beyond nuisance: errors with and without it, and a permutation probability with Holm's adjustment over the groups.

    bare and rmse are out-of-fold errors; added_r2 is what the profile adds to the out-of-fold share of y's variance. norm and top are
    the length and the largest entry's name of the profile's standardized coefficients in a fit of all rows. A replicate
    shifts each subject's profile in time, around its end, by a hash of the subject and the replicate; p is the share of replicates, the
    observed order among them, whose error is as small. Days must be distinct within a subject, which bounds its rows by
    the calendar. They are put in order and written once. A task works out each shift of a subject once and adds it to
    the replicates that drew it, so what is shuffled are the tasks' sums; a subject's draws serve all of its groups.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(y).isNotNull()).select(*by, subject, order, *nuisance, *profile, y).withColumn("_f", fold_of(subject, 5))
    held = rows.groupBy(*by, subject).agg(F.first("_f").alias("_f"), F.array_sort(F.collect_list(F.struct(order, *nuisance, *profile, y))).alias("_s"))
    held = written(held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(subject)).sortWithinPartitions(subject), "subjects")
    rows = held.select(*by, subject, "_f", F.inline("_s"))
    # a shift within a subject, whose rows share a fold, changes what the profile is multiplied with and nothing else
    still = gram_parts(rows, [*by, "_f"], [*nuisance, *profile], y)
    moving = _shifted_parts(held, by, subject, nuisance, profile, y, replicates)
    moving = moving.select(*(F.col(c).alias(c) for c in moving.columns))  # columns of its own, or the two sides of the cogroup are ambiguous
    names = ["one", *nuisance, *profile, y]

    def fits(fixed: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        base = {f: Sums(g, names) for f, g in zip(fixed["_f"], fixed["_gram"], strict=True)}
        found = {c: [] for c in ("replicate", "n", "sse", "rmse")}
        for replicate, group in moved.groupby("replicate"):
            parts = []
            for f, g in zip(group["_f"], group["_gram"], strict=True):
                own = Sums(g, names, base[f].all.copy())
                parts.append(own)
            sse, n = _out_of_fold(parts, [*nuisance, *profile], y, penalty)
            for c, v in zip(found, (replicate, round(n), sse, float(np.sqrt(max(sse, 0) / n)) if n else None), strict=True):
                found[c].append(v)
        return pd.DataFrame({c: [fixed[c].iloc[0]] * len(found["n"]) for c in by} | found)

    keys = Window.partitionBy(*by)
    cv = still.groupBy(*by).cogroup(moving.groupBy(*by)).applyInPandas(fits, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "replicate int, n long, sse double, rmse double"]))
    cv = cv.withColumn("_own", F.min(F.when(F.col("replicate") == 0, F.col("sse"))).over(keys))
    # errors of equal orders differ in the last digits only
    as_small = F.count_if((F.col("replicate") > 0) & (F.col("sse") <= F.col("_own") * (1 + 1e-9)))
    full = cv.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col("n"))).alias("n"), F.max("_own").alias("_full"), F.max(F.when(F.col("replicate") == 0, F.col("rmse"))).alias("rmse"), ((1 + as_small) / F.lit(1 + replicates)).alias("p"))
    bare = ridge_cv(rows, by, subject, nuisance, y, penalty, fold="_f").select(*by, F.col("rmse").alias("bare"), F.col("sse").alias("_bare"))
    spread = rows.groupBy(*by).agg((F.var_pop(y) * F.count(y)).alias("_all"))

    def weigh(group: pd.DataFrame) -> pd.DataFrame:
        sums = {(r.a, r.b): r.value for r in group.itertuples()}
        n, x = sums["one", "one"], [*nuisance, *profile]
        slope = solve_ridge(sums, x, y, penalty)[1 + len(nuisance) :]
        weight = slope * np.sqrt([max(sums[c, c] / n - (sums["one", c] / n) ** 2, 0) for c in profile])
        return pd.DataFrame({c: [group[c].iloc[0]] for c in by} | {"norm": [float(np.linalg.norm(weight))], "top": [profile[int(np.abs(weight).argmax())]]})

    weights = gram(rows, by, [*nuisance, *profile], y).groupBy(*by).applyInPandas(weigh, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "norm double, top string"]))
    out = full.join(bare, by).join(spread, by).join(weights, by)
    out = out.select(*by, "n", "bare", "rmse", (F.col("bare") - F.col("rmse")).alias("improvement"), ((F.col("_bare") - F.col("_full")) / F.nullif("_all", F.lit(0.0))).alias("added_r2"), "norm", "top", "p")
    ranked = out.withColumn("_key", F.struct(*by))
    m, walk = F.count("*").over(Window.partitionBy()), Window.partitionBy().orderBy("p", "_key")
    step = ranked.withColumn("_t", (m - F.row_number().over(walk) + 1) * F.col("p"))
    return step.withColumn("adjusted", F.least(F.lit(1.0), F.max("_t").over(walk.rowsBetween(Window.unboundedPreceding, 0)))).drop("_t", "_key")


def state_space(df: DataFrame, subject: str, day: str, value: str, rho: float = 0.9, innovation: float = 0.3, noise: float = 0.5) -> DataFrame:
    """subject, day and level: the least-squares path of an autoregressive level through a subject's values, aware of gaps.

    Rows with a null value are points to fill. Days must be distinct within a subject, which
    bounds its rows by the calendar; the system is tridiagonal, so time and memory grow with its days.
    """
    kinds = dict(df.dtypes)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(day)
        t, v = g[day].to_numpy(float), g[value].to_numpy(float)
        seen = np.isfinite(v)
        mean = v[seen].mean() if seen.any() else 0.0
        gap = np.diff(t)
        keep = rho**gap
        var = innovation**2 * (gap if rho == 1 else (1 - rho ** (2 * gap)) / (1 - rho**2))
        main, off, right = np.full(len(t), 1e-6), np.zeros(max(len(t) - 1, 0)), np.zeros(len(t))
        main[0] += 1.0
        main[seen] += 1 / noise**2
        right[seen] += (v[seen] - mean) / noise**2
        main[1:] += 1 / var
        main[:-1] += keep**2 / var
        off -= keep / var
        # tridiagonal elimination
        for i in range(1, len(t)):
            w = off[i - 1] / main[i - 1]
            main[i] -= w * off[i - 1]
            right[i] -= w * right[i - 1]
        x = np.zeros(len(t))
        for i in range(len(t) - 1, -1, -1):
            x[i] = (right[i] - (off[i] * x[i + 1] if i + 1 < len(t) else 0)) / main[i]
        return pd.DataFrame({subject: g[subject], day: g[day], "level": x + mean})

    return df.select(subject, day, value).groupBy(subject).applyInPandas(solve, f"`{subject}` {kinds[subject]}, `{day}` {kinds[day]}, level double")


def _kernel(t: np.ndarray, at: slice, slow: float, fast: float, noise: float) -> np.ndarray:
    """Covariances of the values in at with all values; a value's own has the noise."""
    gap = np.abs(t[at, None] - t[None, :])
    out = np.exp(-0.5 * (gap / slow) ** 2) + 0.5 * np.exp(-gap / fast)
    out[np.arange(len(out)), np.arange(len(t))[at]] += noise**2
    return out


def _gp_factor(t: np.ndarray, slow: float, fast: float, noise: float) -> factors.Factor:
    f = factors.Factor(len(t))
    for a in range(0, len(t), factors.BLOCK):
        at = slice(a, min(a + factors.BLOCK, len(t)))
        f.low[at] = _kernel(t, at, slow, fast, noise)
    f.factor()
    return f


def gp_log_likelihood(t: np.ndarray, v: np.ndarray, slow: float, fast: float, noise: float = 0.5) -> float:
    f = _gp_factor(t, slow, fast, noise)
    a = f.forward(v[:, None], len(t))[:, 0]
    return -0.5 * (float(a @ a) + f.log_determinant() + len(t) * float(np.log(2 * np.pi)))


def gp_filter(df: DataFrame, subject: str, day: str, value: str, slow: tuple = (14.0, 28.0, 56.0), fast: tuple = (1.0, 3.0, 7.0), noise: float = 0.5) -> DataFrame:
    """subject, day and predicted: a Gaussian process's mean at each day given strictly earlier values only; rows with a null value go.

    Time scales are those of the greatest summed likelihood over all subjects; ties go to the first of the grid. The
    grid runs where a subject's packed values lie, so data are read once for it. One factor serves all of a subject's
    days: time grows with the cube of its values; beyond a bound the factor lies in a file of the task.
    """
    grid = [(a, b) for a in slow for b in fast]
    kinds = dict(df.dtypes)
    held = df.where(F.col(value).isNotNull()).groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(F.col(day).cast("double").alias("t"), F.col(value).cast("double").alias("v")))).alias("_s"))
    held = written_wide(held.select(subject, F.transform("_s", lambda s: s["t"]).alias("_t"), F.transform("_s", lambda s: s["v"]).alias("_v")), "values", subject)

    def people(batch):
        offsets, t, v = batch.column("_t").offsets.to_numpy(), batch.column("_t").values.to_numpy(), batch.column("_v").values.to_numpy()
        return [(t[a:b], v[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]

    def likelihood(batches):
        total = np.zeros(len(grid))
        for batch in batches:
            for t, v in people(batch):
                total += [gp_log_likelihood(t, v - v.mean(), a, b, noise) for a, b in grid]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], ["setting", "value"])

    best = held.mapInArrow(likelihood, "setting int, value double").groupBy("setting").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "setting").first()
    a, b = grid[best["setting"]] if best else grid[0]

    def predict(batches):
        for batch in batches:
            out, days = [], []
            for t, v in people(batch):
                f = _gp_factor(t, a, b, noise)
                # a leading part of the factor is that of the earlier days alone, and a row's start solves its own weights
                solved, ones = f.forward(np.column_stack([v, np.ones(len(t))]), len(t)).T
                sums, found = np.cumsum(v), np.zeros(len(t))
                for i, before in enumerate(np.searchsorted(t, t, side="left")):
                    if before:
                        mean = sums[before - 1] / before
                        found[i] = mean + f.low[i, :before] @ (solved[:before] - mean * ones[:before])
                out.append(found)
                days.append(t)
            if out:
                whose = batch.column(subject).take(pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out])))
                yield pa.RecordBatch.from_arrays([whose, pa.array(np.concatenate(days)), pa.array(np.concatenate(out))], [subject, day, "predicted"])

    made = held.mapInArrow(predict, f"`{subject}` {kinds[subject]}, `{day}` double, predicted double")
    return made.withColumn(day, F.col(day).cast(kinds[day]))
