"""Summaries: replicates, paired differences, roll-ups, subject-balanced errors, agreement, autoregression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranges import joined, mean_ranks, median_distances, medians
from tidemark.sources.tables import written


def mean_error(metric: str, single=0.0, none=0.0) -> list[Column]:
    """Mean and Monte-Carlo standard error (sample deviation over the root of n) of the values that are there."""
    n = F.count(metric)
    error = F.when(n > 1, F.stddev_samp(metric) / F.sqrt(n)).when(n == 1, F.lit(single).cast("double")).otherwise(F.lit(none).cast("double"))
    return [F.avg(metric).alias(f"{metric}_mean"), error.alias(f"{metric}_mcse")]


def replicate_summary(df: DataFrame, by: list[str], seed: str, metrics: list[str]) -> DataFrame:
    """Per group the number of distinct seeds and each metric's mean and error; an error of one value is 0."""
    return df.groupBy(*by).agg(F.count_distinct(seed).alias("n_seeds"), *(c for m in metrics for c in mean_error(m)))


def panel_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Across panels: how many, and each metric's mean, error, least and largest value."""
    return df.groupBy(*by).agg(F.count("*").alias("n_panels"), *(c for m in metrics for c in (*mean_error(m), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"))))


def scope(df: DataFrame, sets: dict[str, list[str]], columns: list[str], *aggregates: Column) -> DataFrame:
    """The same aggregates at several scopes in one pass: GROUPING SETS with each set's name in scope."""
    bits = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own): name for name, own in sets.items()}
    label = F.element_at(F.create_map(*(F.lit(x) for pair in bits.items() for x in pair)), F.grouping_id().cast("int"))
    grouped = df.groupingSets([[F.col(c) for c in own] for own in sets.values()], *[F.col(c) for c in columns])
    return grouped.agg(label.alias("scope"), *aggregates)


def interval_and_wins(metric: str) -> list[Column]:
    """Of paired differences: n, mean, error, mean -+ 1.96 errors, and how many are below 0."""
    mean, error = F.avg(metric), F.when(F.count(metric) > 1, F.stddev_samp(metric) / F.sqrt(F.count(metric))).otherwise(0.0)
    return [F.count(metric).alias("n"), mean.alias("mean"), error.alias("mcse"), (mean - 1.96 * error).alias("low"), (mean + 1.96 * error).alias("high"), F.count_if(F.col(metric) < 0).alias("wins")]


def category_profile(df: DataFrame, columns: list[str], subject: str) -> DataFrame:
    """Per column and category (null is "unrecorded"): rows and distinct subjects."""
    name = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))
    value = F.coalesce(*(F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit("unrecorded"))) for c in columns))
    grouped = df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    return grouped.agg(name.alias("variable"), value.alias("category"), F.count("*").alias("n"), F.count_distinct(subject).alias("subjects")).drop(*columns)


def prevalence(df: DataFrame, flags: list[str], subject: str) -> DataFrame:
    """Per flag: rows with it, and subjects that ever have it."""
    long = df.unpivot([subject], flags, "flag", "raised")
    return long.groupBy("flag").agg(F.sum("raised").alias("sessions"), F.count_distinct(F.when(F.col("raised") == 1, F.col(subject))).alias("subjects"))


def balanced_rmse(df: DataFrame, by: list[str], subject: str, prediction: str, truth: str) -> DataFrame:
    """Root of the mean over subjects of each one's mean squared error."""
    error = F.pow(F.col(prediction) - F.col(truth), 2)
    per = df.groupBy(*by, subject).agg(F.avg(error).alias("_mse"))
    return per.groupBy(*by).agg(F.sqrt(F.avg("_mse")).alias("rmse"), F.count("_mse").alias("subjects"))


def anchor_rmse(df: DataFrame, by: list[str], value: str, predicted: str) -> DataFrame:
    """Root of the mean squared error over anchors."""
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(value) - F.col(predicted), 2))).alias("rmse"), F.count("*").alias("anchors"))


def rater_agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per group: n, Pearson's r with its Fisher interval, Spearman's rho, exact agreement, quadratic-weighted kappa, mean difference.

    Kappa's categories are twice the score, rounded half to even. Pairs of equal scores are counted first; ranks run
    over ranges of the distinct scores, so no task sorts a group.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"))
    both = written(both, "scores")
    for c in ("_a", "_b"):
        both = joined(both, mean_ranks(both.groupBy(*by, c).agg(F.sum("_n").alias("_c")), by, c, "_c", f"_r{c}").drop("_c"), [*by, c])
    n = F.sum("_n")
    mean = lambda x: F.sum(F.col("_n") * x) / n
    whole = both.groupBy(*by).agg(n.alias("_all"), mean(F.col("_a")).alias("_ma"), mean(F.col("_b")).alias("_mb"))
    x, y = F.col("_a") - F.col("_ma"), F.col("_b") - F.col("_mb")
    p, q = F.col("_r_a") - (F.col("_all") + 1) / 2, F.col("_r_b") - (F.col("_all") + 1) / 2
    ca, cb = F.bround(2 * F.col("_a")), F.bround(2 * F.col("_b"))
    corr = lambda u, v: F.sum(F.col("_n") * u * v) / F.nullif(F.sqrt(F.sum(F.col("_n") * u * u) * F.sum(F.col("_n") * v * v)), F.lit(0.0))
    # expected disagreement needs only the two raters' means and mean squares
    observed, expected = mean(F.pow(ca - cb, 2)), mean(ca * ca) + mean(cb * cb) - 2 * mean(ca) * mean(cb)
    r = corr(x, y)
    z, se = F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999))), 1 / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return joined(both, whole, by).groupBy(*by).agg(
        n.alias("n"), r.alias("pearson"), F.tanh(z - 1.96 * se).alias("pearson_low"), F.tanh(z + 1.96 * se).alias("pearson_high"), corr(p, q).alias("spearman"),
        mean((F.col("_a") == F.col("_b")).cast("double")).alias("exact"), F.when(expected > 0, 1 - observed / expected).alias("kappa"), mean(F.abs(F.col("_a") - F.col("_b"))).alias("mean_difference"),
    )


def level_distribution(df: DataFrame, by: list[str], value: str, levels: list[float]) -> DataFrame:
    """Per group and level how many values are equal to it and their share; levels that don't occur are kept."""
    counted = df.groupBy(*by).agg(F.count(value).alias("_n"), *(F.count_if(F.col(value) == x).alias(f"_{k}") for k, x in enumerate(levels)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("level"), F.col(f"_{k}").alias("n")) for k, x in enumerate(levels))))
    return counted.select(*by, "_n", rows.alias("_l")).select(*by, "_l.level", "_l.n", (F.col("_l.n") / F.col("_n")).alias("share"))


def pooled_ar1(df: DataFrame, by: list[str], subject: str, day: str, value: str, unit_gap: bool = False, least: int = 3) -> DataFrame:
    """Per group the lag-1 coefficient of values without their subject's mean, pooled over subjects of at least that many values, and the pairs it rests on."""
    whole, order = Window.partitionBy(*by, subject), Window.partitionBy(*by, subject).orderBy(day)
    rows = df.where(F.col(value).isNotNull()).withColumns({"_c": F.col(value) - F.avg(value).over(whole), "_n": F.count(value).over(whole)})
    rows = rows.withColumns({"_p": F.lag("_c").over(order), "_g": F.col(day) - F.lag(day).over(order)}).where(F.col("_n") >= least)
    pairs = rows.where(F.col("_g") == 1 if unit_gap else F.col("_g") > 0)
    den = F.sum(F.col("_p") * F.col("_p"))
    return pairs.groupBy(*by).agg(F.when(den > 1e-12, F.sum(F.col("_p") * F.col("_c")) / den).alias("ar1"), F.count("*").alias("pairs"))


def trend_grid(df: DataFrame, subject: str, day: str, value: str, trends: dict[str, Column], least: int = 3, least_share: int = 2) -> DataFrame:
    """name, raw_ar1, fast_ar1, fast_ar1_unit, pairs, slow_share and subjects: pooled_ar1 of the value and of what a trend leaves (all gaps and gaps of a day), and within_share of the trend, for each of several trends.

    Trends are window columns by subject in the order of days, and so is all else: rows are sorted once and never
    copied, however many trends there are. Days must be distinct within a subject.
    """
    whole, order = Window.partitionBy(subject), Window.partitionBy(subject).orderBy(day)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(subject, day, F.col(value).alias("_raw"), *(t.alias(f"_t{k}") for k, t in enumerate(trends.values())))
    names = ["_raw", *(f"_f{k}" for k in range(len(trends)))]
    rows = rows.withColumns({f"_f{k}": F.col("_raw") - F.col(f"_t{k}") for k in range(len(trends))})
    rows = rows.withColumns({f"_c{n}": F.col(n) - F.avg(n).over(whole) for n in names} | {"_n": F.count("_raw").over(whole)})
    seen = F.when(F.col("_raw").isNotNull(), F.col(day))
    # the row before is the last one with a value
    rows = rows.withColumns({f"_p{n}": F.last(f"_c{n}", ignorenulls=True).over(before) for n in names} | {"_g": seen - F.last(seen, ignorenulls=True).over(before)})
    spread = lambda c: F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0))
    used = {"": (F.col("_n") >= least) & (F.col("_g") > 0), "_unit": (F.col("_n") >= least) & (F.col("_g") == 1)}
    sums = {f"{part}{n}{u}": F.sum(F.when(when, F.col(f"_p{n}") * F.col(f"{other}{n}"))) for n in names for u, when in used.items() for part, other in (("_num", "_c"), ("_den", "_p"))}
    per = rows.groupBy(subject).agg(
        *(v.alias(c) for c, v in sums.items()), F.count_if(used[""]).alias("_pairs"), F.count("_raw").alias("_n"), spread("_raw").alias("_v"), *(spread(f"_t{k}").alias(f"_s{k}") for k in range(len(trends))),
    )
    shared = F.col("_n") >= least_share
    added = [F.sum(c).alias(c) for c in (*sums, "_pairs")] + [F.sum(F.when(shared, F.col(c))).alias(c) for c in ("_v", *(f"_s{k}" for k in range(len(trends))))]
    total = per.agg(*added, F.count_if(shared).alias("_subjects"))
    ar1 = lambda n, u="": F.when(F.col(f"_den{n}{u}") > 1e-12, F.col(f"_num{n}{u}") / F.col(f"_den{n}{u}"))
    each = [F.struct(F.lit(name).alias("name"), ar1("_raw").alias("raw_ar1"), ar1(f"_f{k}").alias("fast_ar1"), ar1(f"_f{k}", "_unit").alias("fast_ar1_unit"), F.col("_pairs").alias("pairs"), (F.col(f"_s{k}") / F.nullif("_v", F.lit(0.0))).alias("slow_share"), F.col("_subjects").alias("subjects")) for k, name in enumerate(trends)]
    return total.where("_pairs > 0").select(F.explode(F.array(*each)).alias("_e")).select("_e.*")


def within_share(df: DataFrame, by: list[str], subject: str, trend: str, value: str, least: int = 2) -> DataFrame:
    """Share of the variance within subjects that a trend makes up, pooled over subjects of at least that many values."""
    per = df.groupBy(*by, subject).agg((F.var_pop(trend) * F.count(trend)).alias("_t"), (F.var_pop(value) * F.count(value)).alias("_v"), F.count(value).alias("_n")).where(F.col("_n") >= least)
    return per.groupBy(*by).agg((F.sum("_t") / F.nullif(F.sum("_v"), F.lit(0.0))).alias("slow_share"), F.count("*").alias("subjects"))


def least_setting(df: DataFrame, by: list[str], criterion: str, position: str) -> DataFrame:
    """Per group the setting of the least criterion; ties go to the first position, NaN and null never win."""
    best = Window.partitionBy(*by).orderBy(criterion, position)
    return df.where(F.col(criterion).isNotNull() & ~F.isnan(criterion)).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def quantile_strata(counts: DataFrame, count: str, strata: int) -> DataFrame:
    """counts with the number of inner quantile edges that are at most count; 0 where one stratum is asked for or all edges are equal."""
    if strata <= 1:
        return counts.withColumn("stratum", F.lit(0))
    inner = [k / strata for k in range(1, strata)]
    edges = counts.agg(F.percentile(count, F.array(*(F.lit(p) for p in inner))).alias("_e"), F.min(count).alias("_a"), F.max(count).alias("_b"))
    rows = counts.crossJoin(F.broadcast(edges))
    return rows.withColumn("stratum", F.when(F.col("_a") == F.col("_b"), 0).otherwise(F.size(F.filter("_e", lambda e: e <= F.col(count))))).drop("_e", "_a", "_b")


def masked_stats(df: DataFrame, by: list[str], value: str, mask: Column) -> DataFrame:
    """Mean of the masked values (0 if there are none) and their population deviation (1 if it is next to nothing)."""
    kept = F.when(mask, F.col(value))
    sd = F.coalesce(F.stddev_pop(kept), F.lit(0.0))
    return df.groupBy(*by).agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("mean"), F.when(sd <= 1e-8, 1.0).otherwise(sd).alias("sd"), F.count(kept).alias("n"), F.greatest(F.coalesce(F.var_pop(kept), F.lit(0.0)), F.lit(0.25)).alias("floored_variance"))


def subject_stability(df: DataFrame, by: list[str], subject: str, week: str, state: str, change: str, least: int = 10, least_changes: int = 2) -> DataFrame:
    """Per group and subject: within, between, paired (between - within), n (changes) and weeks.

    A subject's week has its mean state and mean absolute change; weeks of fewer than least subjects go. The difference
    is the median distance to the week's other subjects. Both are averaged over a subject's weeks; subjects with fewer
    than least_changes changes go.
    """
    weeks = df.where(F.col(state).isNotNull() & F.col(change).isNotNull()).groupBy(*by, week, subject).agg(F.avg(state).alias("_state"), F.avg(F.abs(change)).alias("_within"), F.count("*").alias("_n"))
    weeks = written(weeks, "weeks")
    big = weeks.groupBy(*by, week).agg(F.count("*").alias("_users")).where(F.col("_users") >= least).drop("_users")
    kept = written(joined(weeks, big, [*by, week]), "weeks")
    apart = joined(kept, median_distances(kept, [*by, week], subject, "_state"), [*by, week, subject], "left")
    per = apart.groupBy(*by, subject).agg(F.avg("_within").alias("within"), F.avg("median_distance").alias("between"), F.sum("_n").alias("n"), F.count("*").alias("weeks"))
    return per.where((F.col("n") >= least_changes) & F.col("between").isNotNull()).withColumn("paired", F.col("between") - F.col("within"))


def week_stability(df: DataFrame, by: list[str], subject: str, week: str, state: str, change: str, least: int = 10, least_changes: int = 2) -> DataFrame:
    """Per group how much subjects change within themselves and differ from others of the same week: medians over the rows of subject_stability, and the share in which the difference is larger."""
    per = written(subject_stability(df, by, subject, week, state, change, least, least_changes), "stability")
    counts = per.groupBy(*by).agg(F.count("*").alias("subjects"), F.sum("weeks").alias("subject_weeks"), F.avg((F.col("paired") > 0).cast("double")).alias("share_between_larger"))
    middle = medians(per, by, {"median_within_change": "within", "median_between_difference": "between", "median_paired_difference": "paired"})
    return joined(counts, middle, by)
