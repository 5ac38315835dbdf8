"""Queries over ranges, folds and resamples: stability of subject-weeks, shared bootstraps, permuted vectors, out-of-fold errors, counts of roles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalar
from tidemark.operators import aggregates as agg
from tidemark.operators import checks, cohort, inference, joins, models, prep, ranges, windows
from tidemark.plans.summaries import _DRAW, r9, rounded
from tidemark.plans.views import DAILY, EVENTS, anchors, daily, days, events, table
from tidemark.sources.tables import written

QUERIES, SQL = {}, {}
CADENCES = (2, 3, 5)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _kept(spark, d):
    """Daily values of purchases, views and clicks at each cadence, each user and type thinned by itself."""
    x = daily(spark, d).where("event_type in ('purchase', 'view', 'click')")
    key = ["user_id", "event_type"]
    return prep.union_all(*(windows.thinned(x, key, "day", c).where("retained").select(F.lit(c).alias("cadence"), *key, "day", "value") for c in CADENCES))


_KEPT = DAILY + """, dc as (select c::integer as cadence, * from daily, (select unnest([2, 3, 5]) as c) where event_type in ('purchase', 'view', 'click')),
w as (select cadence, user_id, event_type, min(day) as day from dc group by all
union all select w.cadence, w.user_id, w.event_type, n.day from w, lateral (select min(x.day) as day from dc x where x.cadence = w.cadence and x.user_id = w.user_id and x.event_type = w.event_type and x.day >= w.day + w.cadence) n where n.day is not null),
kept as (select dc.* from dc semi join w using (cadence, user_id, event_type, day))"""


def _changes(spark, d):
    change = F.lead("value").over(windows.ordered(["cadence", "user_id", "event_type"], "day")) - F.col("value")
    return _kept(spark, d).withColumns({"change": change, "week": F.floor(F.col("day") / 7)})


_STABLE = _KEPT + """, t as (select cadence, event_type, user_id, day // 7 as week, value as state, abs(lead(value) over (partition by cadence, user_id, event_type order by day) - value) as change from kept),
p as (select cadence, event_type, week, user_id, avg(state) as state, avg(change) as within, count(*) as n from t where change is not null group by all),
b as (select * from (select *, count(*) over (partition by cadence, event_type, week) as users from p) where users >= 10),
o as (select a.cadence, a.event_type, a.week, a.user_id, median(abs(a.state - c.state)) as apart from b a join b c on a.cadence = c.cadence and a.event_type = c.event_type and a.week = c.week and a.user_id <> c.user_id group by all),
s as (select cadence, event_type, user_id, avg(within) as within, avg(apart) as apart, sum(n) as n, count(*) as weeks from b left join o using (cadence, event_type, week, user_id) group by all)"""


@query(f"""with recursive {_STABLE}
select cadence, event_type, count(*) as subjects, sum(weeks)::bigint as subject_weeks, round(median(within), 9) as median_within_change, round(median(apart), 9) as median_between_difference, round(median(apart - within), 9) as median_paired_difference, round(avg((apart > within)::int), 9) as share_between_larger
from s where n >= 2 and apart is not null group by all""")
def patient_week_stability(spark, d):
    """How much users change within themselves and differ from others of their week, by cadence and instrument."""
    return rounded(agg.week_stability(_changes(spark, d), ["cadence", "event_type"], "user_id", "week", "value", "change"))


@query(f"""with {EVENTS}, w as (select user_id, day // 7 as week, avg(value) as state from ev group by all)
select a.week::bigint as week, a.user_id, round(median(abs(a.state - b.state)), 9) as median_distance from w a join w b on a.week = b.week and a.user_id <> b.user_id group by a.week, a.user_id""")
def median_distances(spark, d):
    w = events(spark, d).groupBy("user_id", F.floor(F.col("day") / 7).alias("week")).agg(F.avg("value").alias("state"))
    return rounded(ranges.median_distances(w, ["week"], "user_id", "state"))


@query(f"""with recursive {_STABLE}, z as (select * from s where n >= 2 and apart is not null),
u as (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as total from (select distinct user_id from z)),
k as (select r as replicate, floor({_DRAW.format("r || '|' || d || '|stability'")} * (select any_value(total) from u))::bigint as i from (select unnest(range(0, 2000)) as r), (select unnest(range(0, (select any_value(total) from u))) as d)),
x as (select cadence, event_type, replicate, median(within) as w, median(apart) as a, median(apart - within) as p, avg((apart > within)::int) as l from z join u using (user_id) join k using (i) group by all)
select cadence, event_type, m[1] as measure, round(quantile_cont(m[2], 0.025), 9) as low, round(quantile_cont(m[2], 0.975), 9) as high, count(*) as replicates from (select cadence, event_type, unnest([('within', w), ('between', a), ('paired', p), ('share', l)]) as m from x) group by all""")
def stability_intervals(spark, d):
    """Intervals of the stability table: of three medians and a share, by cadence and instrument, over the same 2000 resamples of users."""
    per = agg.subject_stability(_changes(spark, d), ["cadence", "event_type"], "user_id", "week", "value", "change")
    cells = [(c, k) for c in CADENCES for k in ("purchase", "view", "click")]
    here = lambda c, k, m: F.max(F.when((F.col("cadence") == c) & (F.col("event_type") == k), F.col(m))).alias(f"{c}|{k}|{m}")
    wide = written(per.groupBy("user_id").agg(*(here(c, k, m) for c, k in cells for m in ("within", "between", "paired"))), "stability")
    medians = [x for x in wide.columns if x != "user_id"]
    paired = {f"{c}|{k}": F.col(f"`{c}|{k}|paired`") for c, k in cells}
    sums = {f"{x}|larger": F.when(v > 0, 1.0) for x, v in paired.items()} | {f"{x}|all": F.when(v.isNotNull(), 1.0) for x, v in paired.items()}
    each = inference.resampled(wide, "user_id", sums, medians, 2000, "stability")
    found = inference.intervals_of(each, {x: F.col(f"`{x}`") for x in medians} | {f"{x}|share": inference.ratio(f"{x}|larger", f"{x}|all") for x in paired})
    part = F.split("name", r"\|")
    return rounded(found.select(part[0].cast("int").alias("cadence"), part[1].alias("event_type"), part[2].alias("measure"), "low", "high", "replicates"))


_METHODS = ("blend", "locf", "history", "center")
_PREDICTED = _KEPT + """, pr as (select *, lag(value) over v as locf, avg(value) over (v rows between unbounded preceding and 1 preceding) as history, first_value(value) over v as base from kept window v as (partition by cadence, user_id, event_type order by day)),
pm as (select * from pr where locf is not null)"""


def _predicted(spark, d):
    w = windows.ordered(["cadence", "user_id", "event_type"], "day")
    x = _kept(spark, d).withColumns({"locf": F.lag("value").over(w), "history": F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), "base": F.first("value").over(w)})
    return x.where("locf is not null").withColumns({"blend": (F.col("locf") + F.col("history")) / 2, "center": F.lit(100.0)})


_TIMES = "{0} as (select replicate, i, count(*) as times from (select r as replicate, floor({1} * {2})::bigint as i from (select unnest(range(0, 2000)) as r), (select unnest(range(0, {2})) as d)) group by all)"


@query(f"""with recursive {_PREDICTED}, e as (select cadence, user_id, count(*) as n, sum(pow((locf + history) / 2 - value, 2)) as blend, sum(pow(locf - value, 2)) as locf, sum(pow(history - value, 2)) as history, sum(pow(100 - value, 2)) as center from pm group by all),
u as (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as total from (select distinct user_id from e)),
{_TIMES.format("k", _DRAW.format("r || '|' || d || '|pairs'"), "(select any_value(total) from u)")},
l as (select cadence, u.i, n, blend, unnest([('locf', locf), ('history', history), ('center', center)]) as m from e join u using (user_id)),
s as (select cadence, m[1] as comparator, replicate, sqrt(sum(blend * times) / sum(n * times)) - sqrt(sum(m[2] * times) / sum(n * times)) as v from l join k using (i) group by all),
o as (select cadence, m[1] as comparator, sqrt(sum(blend) / sum(n)) - sqrt(sum(m[2]) / sum(n)) as difference from l group by all)
select cadence, comparator, round(difference, 9) as difference, round(quantile_cont(v, 0.025), 9) as low, round(quantile_cont(v, 0.975), 9) as high, count(v) as replicates from o join s using (cadence, comparator) group by cadence, comparator, difference""")
def pairwise_bootstrap(spark, d):
    """The difference in RMSE between one method and each comparator at each cadence, with intervals over the same 2000 resamples of users."""
    error = lambda m: F.sum(F.pow(F.col(m) - F.col("value"), 2)).alias(m)
    per = _predicted(spark, d).groupBy("user_id", "cadence").agg(F.count("*").cast("double").alias("n"), *(error(m) for m in _METHODS))
    wide = per.groupBy("user_id").agg(*(F.max(F.when(F.col("cadence") == c, F.col(m))).alias(f"{m}_{c}") for c in CADENCES for m in ("n", *_METHODS)))
    wide = written(wide, "errors")
    root = lambda m, c: F.sqrt(inference.ratio(f"{m}_{c}", f"n_{c}"))
    made = {f"{c}|{m}": root("blend", c) - root(m, c) for c in CADENCES for m in _METHODS[1:]}
    sums = {c: F.col(c) for c in wide.columns if c != "user_id"}
    seen = wide.agg(*(F.sum(v).alias(c) for c, v in sums.items()))
    seen = seen.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("difference")) for k, v in made.items()))).alias("_o")).select("_o.*")
    out = seen.join(inference.intervals_of(inference.resampled(wide, "user_id", sums, [], 2000, "pairs"), made), "name")
    part = F.split("name", r"\|")
    return rounded(out.select(part[0].cast("int").alias("cadence"), part[1].alias("comparator"), "difference", "low", "high", "replicates"))


@query(f"""with recursive {_PREDICTED}, o as (select cadence, event_type, user_id, unnest([('locf', 'response', (value <= 0.5 * base)::int, (locf <= 0.5 * base)::int), ('locf', 'remission', (value < 40)::int, (locf < 40)::int), ('history', 'response', (value <= 0.5 * base)::int, (history <= 0.5 * base)::int), ('history', 'remission', (value < 40)::int, (history < 40)::int)]) as x from pm),
r as (select cadence, event_type, x[1] as method, x[2] as outcome, user_id, x[3] as a, x[4] as p, 1.0 / count(*) over (partition by cadence, event_type, x[1], x[2], user_id) as w from o),
c as (select cadence, event_type, method, outcome, count(distinct user_id) as subjects, sum(w) as t, coalesce(sum(w) filter (a = 1), 0) as y, coalesce(sum(w) filter (a = 0), 0) as n, coalesce(sum(w) filter (a = 1 and p = 1), 0) as tp, coalesce(sum(w) filter (a = 0 and p = 0), 0) as tn from r group by all),
g as (select cadence, event_type, method, outcome, user_id, sum(w * (a = p)::int) as hit from r group by all),
u as (select user_id, row_number() over (order by user_id) - 1 as i, count(*) over () as total from (select distinct user_id from g)),
{_TIMES.format("k", _DRAW.format("r || '|' || d || '|workload'"), "(select any_value(total) from u)")},
s as (select cadence, event_type, method, outcome, replicate, sum(hit * times) / sum(times) as v from g join u using (user_id) join k using (i) group by all),
q as (select cadence, event_type, method, outcome, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high, count(v) as replicates from s group by all)
select cadence, event_type, method, outcome, subjects, round((tp + tn) / t, 9) as accuracy, round(low, 9) as accuracy_low, round(high, 9) as accuracy_high, round(y / t, 9) as prevalence, round(tp / nullif(y, 0), 9) as sensitivity, round(tn / nullif(n, 0), 9) as specificity, round((tp / nullif(y, 0) + tn / nullif(n, 0)) / 2, 9) as balanced_accuracy, replicates
from c join q using (cadence, event_type, method, outcome)""")
def workload_classification(spark, d):
    """Response and remission by cadence, instrument and method; accuracies have intervals over the same 2000 resamples of users."""
    key = ["cadence", "event_type", "method", "outcome"]
    below = {"response": lambda c: (F.col(c) <= 0.5 * F.col("base")).cast("int"), "remission": lambda c: (F.col(c) < 40).cast("int")}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(o).alias("outcome"), f("value").alias("a"), f(m).alias("p")) for m in ("locf", "history") for o, f in below.items())))
    long = _predicted(spark, d).select("cadence", "event_type", "user_id", rows.alias("o")).select("cadence", "event_type", "user_id", "o.*")
    long = written(long, "outcomes")
    hits = long.groupBy(*key, "user_id").agg(F.avg((F.col("a") == F.col("p")).cast("double")).alias("hit"))
    keys = [f"{c}|{k}|{m}|{o}" for c in CADENCES for k in ("purchase", "view", "click") for m in ("locf", "history") for o in below]
    wide = hits.withColumn("_key", F.concat_ws("|", *key)).groupBy("user_id").agg(*(F.max(F.when(F.col("_key") == k, F.col("hit"))).alias(f"h{i}") for i, k in enumerate(keys)))
    sums = {f"h{i}": F.col(f"h{i}") for i in range(len(keys))} | {f"n{i}": F.when(F.col(f"h{i}").isNotNull(), 1.0) for i in range(len(keys))}
    each = inference.resampled(wide, "user_id", sums, [], 2000, "workload")
    between = inference.intervals_of(each, {k: inference.ratio(f"h{i}", f"n{i}") for i, k in enumerate(keys)}).select("name", F.col("low").alias("accuracy_low"), F.col("high").alias("accuracy_high"), "replicates")
    out = inference.outcome_rates(long, key, "user_id", "a", "p").withColumn("name", F.concat_ws("|", *key)).join(between, "name").drop("name")
    return rounded(out)


@query(f"""with {DAILY}, i as (select event_type, user_id, value, avg(value) over b as m, greatest(stddev_pop(value) over b, 1) as sd from daily window b as (partition by event_type, user_id order by day rows between unbounded preceding and 1 preceding)),
s as (select event_type, user_id, abs(value - m) / sd as score, 1.0 / count(*) over (partition by event_type, user_id) as w from i where m is not null),
c as (select event_type, score, sum(sum(w)) over (partition by event_type order by score) as cum from s group by event_type, score), t as (select event_type, count(distinct user_id) as n from s group by event_type)
select t.event_type, round(min(score) filter (cum >= (n + 1) * 0.95 - 1e-9), 9) as quantile, n as subjects from c join t using (event_type) group by t.event_type, n""")
def conformal_scores(spark, d):
    """The quantile of residuals in units of their predictive deviation, that of a user's earlier values."""
    before = windows.ordered(["event_type", "user_id"], "day").rowsBetween(Window.unboundedPreceding, -1)
    x = daily(spark, d).withColumns({"m": F.avg("value").over(before), "sd": F.greatest(F.stddev_pop("value").over(before), F.lit(1.0))}).where("m is not null")
    return rounded(inference.conformal_quantile(x.select("event_type", "user_id", (F.abs(F.col("value") - F.col("m")) / F.col("sd")).alias("score")), ["event_type"], "user_id", "score", 0.05))


_COLUMNS = [f"b{k}" for k in range(1, 7)]


@query(f"""with v as (select vec_id, {", ".join(f"embedding[{k}]::double as b{k}" for k in range(1, 7))} from embeddings),
a as (select vec_id, row_number() over (order by vec_id) as i from v), b as (select {", ".join(_COLUMNS)}, row_number() over (order by {_DRAW.format("vec_id || '|vectors'")}, vec_id) as i from v)
select vec_id, {", ".join(_COLUMNS)} from a join b using (i)""")
def permute_vectors(spark, d):
    """Whole six-dimensional profiles that have changed places among all rows."""
    v = table(spark, d, "embeddings").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(_COLUMNS)))
    return ranges.permuted_vectors(v, ["vec_id"], _COLUMNS, scalar.draw(F.col("vec_id"), salt="vectors")).select("vec_id", *_COLUMNS)


_D, _U, _V, _W = "(n + 1)", "(n * cab / (sa * sb))", "(n * cac / (sa * sc))", "(n * cbc / (sb * sc))"
_R = ("(n * cay / sa)", "(n * cby / sb)", "(n * ccy / sc)")
_DET = f"({_D} * ({_D} * {_D} - {_W} * {_W}) - {_U} * ({_U} * {_D} - {_W} * {_V}) + {_V} * ({_U} * {_W} - {_D} * {_V}))"
_SLOPES = (
    f"(({_R[0]} * ({_D} * {_D} - {_W} * {_W}) - {_U} * ({_R[1]} * {_D} - {_W} * {_R[2]}) + {_V} * ({_R[1]} * {_W} - {_D} * {_R[2]})) / {_DET} / sa)",
    f"(({_D} * ({_R[1]} * {_D} - {_W} * {_R[2]}) - {_R[0]} * ({_U} * {_D} - {_W} * {_V}) + {_V} * ({_U} * {_R[2]} - {_R[1]} * {_V})) / {_DET} / sb)",
    f"(({_D} * ({_D} * {_R[2]} - {_R[1]} * {_W}) - {_U} * ({_U} * {_R[2]} - {_R[1]} * {_V}) + {_R[0]} * ({_U} * {_W} - {_D} * {_V})) / {_DET} / sc)",
)


@query(f"""with x as (select l_returnflag as cell, l_quantity as q, l_discount as dis, case when l_linenumber % 4 <> 0 then l_tax end as tax, l_extendedprice / 1000 as y, floor({_DRAW.format("l_orderkey || '|fold'")} * 5)::int as f from lineitem),
t as (select x.*, k from x, (select unnest(range(0, 5)) as k)), m as (select cell, k, avg(tax) as mt from t where f <> k group by all),
i as (select cell, k, f <> k as train, y, q as a, dis as b, coalesce(tax, mt) as c from t join m using (cell, k)),
s as (select cell, k, count(*)::double as n, avg(a) as ma, avg(b) as mb, avg(c) as mc, avg(y) as my, stddev_pop(a) as sa, stddev_pop(b) as sb, stddev_pop(c) as sc, covar_pop(a, b) as cab, covar_pop(a, c) as cac, covar_pop(b, c) as cbc, covar_pop(a, y) as cay, covar_pop(b, y) as cby, covar_pop(c, y) as ccy from i where train group by all),
l as (select cell, k, ma, mb, mc, my, {", ".join(f"{x} as {n}" for n, x in zip(("ba", "bb", "bc"), _SLOPES, strict=True))} from s),
e as (select cell, pow(y - my - (a - ma) * ba - (b - mb) * bb - (c - mc) * bc, 2) as e from i join l using (cell, k) where not train)
select cell, count(*) as n, round(sum(e), 3) as sse, round(sqrt(avg(e)), 9) as rmse from e group by cell""")
def ridge_folds(spark, d):
    """Out-of-fold errors by whole orders; taxes are missing on every fourth line, and training folds give the mean that stands for them."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_orderkey").alias("subject"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("dis"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax")).alias("tax"), (F.col("l_extendedprice") / 1000).alias("y"))
    return models.ridge_cv(x, ["cell"], "subject", ["q", "dis", "tax"], "y").select("cell", "n", F.round("sse", 3).alias("sse"), r9("rmse").alias("rmse"))


@query()
def profile_association(spark, d):
    """Whether an earlier day's profile explains the next change of a measurement beyond its state, the gap, the profile's age and the user's mean profile."""
    notes = days(spark, d).select("user_id", "day", F.col("value").alias("level"), F.col("n").cast("double").alias("amount"))
    w = windows.ordered(["cadence", "user_id", "event_type"], "day")
    pairs = _kept(spark, d).withColumns({"y": F.lead("value").over(w) - F.col("value"), "gap": (F.lead("day").over(w) - F.col("day")).cast("double")}).where("y is not null")
    pairs = joins.asof_strict_prior(pairs, notes, "user_id", "day", ["level", "amount"]).where("observed")
    whole = Window.partitionBy("cadence", "event_type", "user_id")
    for c in ("level", "amount"):
        pairs = pairs.withColumn(f"{c}_mean", F.avg(c).over(whole)).withColumn(f"{c}_deviation", F.col(c) - F.col(f"{c}_mean"))
    pairs = pairs.withColumn("staleness", F.col("staleness").cast("double"))
    return models.transition_association(pairs, ["cadence", "event_type"], "user_id", "day", ["value", "gap", "staleness", "level_mean", "amount_mean"], ["level_deviation", "amount_deviation"], "y")


_BASIS = f"with {EVENTS}, e as (select *, lead(day) over (partition by user_id order by day, event_id) as next_day, value / 500 as b from ev) select event_id, list_transform([1.0, b, (event_type = 'click')::int, (event_type = 'view')::int, (day < 7)::int, day / 30.0, b * (day < 7)::int, b * day / 30.0{{0}}], lambda x: round(x::double, 9)) as features from e where next_day is not null"


def _basis(spark, d, basis: str, **more):
    x = events(spark, d).withColumns({"next_day": F.lead("day").over(windows.ordered(["user_id"], "day", "event_id")), "b": F.col("value") / 500}).where("next_day is not null")
    made = scalar.transition_features([F.col("b")], F.col("event_type"), (F.col("day") < 7).cast("double"), F.col("day") / 30.0, ["click", "view"], basis, **more)
    return x.select("event_id", F.transform(made, r9).alias("features"))


@query(_BASIS.format(""))
def basis_interactions(spark, d):
    return _basis(spark, d, "interaction")


@query(_BASIS.format(", b * b, tanh(b), " + ", ".join(f"b * (user_id % 3 = {k})::int" for k in range(3))))
def basis_strata(spark, d):
    return _basis(spark, d, "stratified", subtype=F.col("user_id") % 3, subtypes=3)


@query("""with p as (select l_orderkey, case when max(l_shipdate) < timestamp '1998-07-01' then 'train' when min(l_shipdate) >= timestamp '1998-07-01' then 'test' else 'excluded' end as partition from lineitem group by l_orderkey)
select partition, count(*) as subjects, sum(n)::bigint as sessions from p join (select l_orderkey, count(*) as n from lineitem group by all) using (l_orderkey) group by partition""")
def forward_split_counts(spark, d):
    """Subjects and sessions of each side of a forward split, those that span the cut-off included."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    p = cohort.forward_time(x, "l_orderkey", "l_shipdate", "1998-07-01 00:00:00")
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(p, "l_orderkey").groupBy("partition").agg(F.count("*").alias("subjects"), F.sum("n").alias("sessions"))


@query("select \"column\", rule, hits from (" + " union all ".join(f"select '{c}' as \"column\", '{n}' as rule, count(*) filter (regexp_matches({c}, '{p}')) as hits from conversations" for c in ("text", "role") for n, p in (*checks.SECRETS, *checks.IDENTIFIERS)) + ")")
def conversation_scan(spark, d):
    return checks.scan(table(spark, d, "conversations"), ["text", "role"], (*checks.SECRETS, *checks.IDENTIFIERS))


@query("""select 'lineitem' as name, 'missing l_missing' as problem union all select 'lineitem', 'forbidden l_comment' where exists (select 1 from duckdb_columns() where table_name = 'lineitem' and column_name = 'l_comment')
union all select 'lineitem', 'prefix l_ship: ' || column_name from (select distinct column_name from duckdb_columns() where table_name = 'lineitem' and column_name like 'l_ship%')""")
def schema_check(spark, d):
    """What is wrong with the columns of a table: missing, forbidden, or of a banned prefix."""
    found = checks.schema_problems(table(spark, d, "lineitem"), ["l_orderkey", "l_missing"], ["l_comment"], ["l_ship"])
    return spark.createDataFrame([("lineitem", x) for x in found], "name string, problem string")


@query(" union all ".join(f"select '{n}' as operator, true as ok" for n in ("prior mean", "strict as-of", "carried flags", "session axis")))
def leak_check(spark, d):
    """Whether features of days before the 20th stay the same when every later value is changed, and days after the 25th are taken away."""
    ev = events(spark, d).select("user_id", "event_id", "event_type", "day", "value")
    later = ev.where("day <= 25").withColumn("value", F.when(F.col("day") >= 20, -F.col("value") - 1).otherwise(F.col("value")))
    sessions = lambda x: x.select("user_id", "event_id", "day")
    built = {
        "prior mean": lambda x: x.select("event_id", "day", windows.prior_mean(["user_id"], ["day", "event_id"], "value").alias("m")),
        "strict as-of": lambda x: joins.asof_strict_prior(sessions(x), x, "user_id", "day", ["value"]),
        "carried flags": lambda x: joins.carried_flags(sessions(x), x, "user_id", "day", {"high": F.col("value") > 100}),
        "session axis": lambda x: x.select("event_id", "day", F.row_number().over(windows.ordered(["user_id"], "day", "event_id")).alias("session")),
    }
    return spark.createDataFrame([(n, checks.no_future_leak(f, ev, later, F.col("day") < 20)) for n, f in built.items()], "operator string, ok boolean")


@query(f"""with recursive {DAILY}, a as (select *, day - case when event_type = 'purchase' then 13 else 6 end as window_start, day as window_end from daily where event_type in ('purchase', 'view', 'click')),
t as (select user_id, event_type, max(day) as day from a where user_id % 5 = 0 and value > 2 group by all),
x as (select a.event_type, a.value > 2 as observed, t.day is not null as evaluation, exists (select 1 from a b join t u on u.user_id = b.user_id and u.event_type = b.event_type and u.day = b.day where b.user_id = a.user_id and a.window_start <= b.window_end and a.window_end >= b.window_start) as met from a left join t on t.user_id = a.user_id and t.event_type = a.event_type and t.day = a.day)
select event_type, count(*) as anchors, count(*) filter (observed) as observed, count(*) filter (evaluation) as targets, count(*) filter (observed and met) as embargoed, count(*) filter (observed and not met) as observed_after from x group by event_type""")
def evaluation_counts(spark, d):
    """How many measurements are targets, under embargo, and left."""
    m = cohort.evaluation_mask(anchors(spark, d), "user_id", "event_type", F.desc("day"), among=F.col("user_id") % 5 == 0)
    return m.groupBy("event_type").agg(F.count("*").alias("anchors"), *(F.count_if(c).alias(n) for n, c in {"observed": F.col("observed"), "targets": F.col("evaluation"), "embargoed": F.col("embargo"), "observed_after": F.col("observed_after")}.items()))
