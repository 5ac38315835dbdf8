"""Latent-level queries: two-channel and pattern-mixture smoothing, and the causal filter, over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import smoothers, windows
from tidemark.plans.views import anchors, events

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Event types that count as treatments.
TREATMENTS = ["purchase", "signup"]


#: Four items of four categories.
ITEMS = smoothers.Instrument(tuple((1.0 + 0.2 * k, (-1.0 + 0.1 * k, 0.0, 1.0 - 0.1 * k)) for k in range(4)), 0.0, 0.5)


def _panel(spark, d, strata: int = 0, basis: str = "linear", items: bool = False) -> smoothers.Panel:
    """Users by day: the day's level and number of events are the profile, purchases and signups the treatments, clicks and errors the signals; purchases and views are two channels, whose values look back over their recall windows."""
    level = (F.col("value") - 100) / 100
    seen = lambda kind: F.avg(F.when((F.col("event_type") == kind) & F.col("value").between(0, 200), level))
    treated = F.max(F.when(F.col("event_type").isin(TREATMENTS), F.col("event_type")))
    axis = events(spark, d).groupBy("user_id", "day").agg(
        F.avg(F.when(F.col("value").between(0, 200), level)).alias("level"), (F.count("*") / 4).alias("amount"), treated.alias("treatment"), seen("click").alias("click"), seen("error").alias("error"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("errors"),
    )
    axis = axis.withColumns({
        "train": F.col("user_id") % 5 != 0, "recent": windows.rolling_any(["user_id"], ["day"], F.col("treatment").isNotNull(), 7).cast("double"),
        "burden": windows.rolling_mean(["user_id"], ["day"], "errors", 7),
    })
    measured = anchors(spark, d).where("event_type in ('purchase', 'view')")
    points = measured.select("user_id", F.col("event_type").alias("channel"), "window_start", "window_end", F.col("day").alias("available"), level.alias("value"), F.when(F.col("event_type") == "view", 0.8).otherwise(1.0).alias("loading"), F.lit(0.5).alias("sd"))
    if items:
        answer = lambda k: F.greatest(F.lit(0), F.least(F.lit(3), F.floor((F.col("value") + 1.0 + 0.1 * k) * 2))).cast("int")
        points = points.withColumn("items", F.array(*(answer(k) for k in range(4)))).drop("value", "loading", "sd")
    return smoothers.panel(axis, points, "user_id", "day", ["purchase", "view"], ["level", "amount"], "treatment", TREATMENTS, "recent", "burden", ["click", "error"], basis=basis, strata=strata, instrument=ITEMS if items else None)


@query()
def two_channel_smooth(spark, d):
    """Both channels' levels after three rounds of levels and pooled coefficients."""
    panel = _panel(spark, d)
    return smoothers.smoothed(panel, smoothers.fit_smoother(panel))


@query()
def pattern_mixture_smooth(spark, d):
    """The same with an offset for each third of the users by their number of measurements, and interactions of profile and treatment."""
    panel = _panel(spark, d, strata=3, basis="interaction")
    return smoothers.smoothed(panel, smoothers.fit_smoother(panel))


@query()
def causal_filter(spark, d):
    """Both channels' levels at each day from what was available before it, with the time scales that fit the training users best."""
    panel = _panel(spark, d)
    return smoothers.filtered(panel, smoothers.fit_filter(panel))


@query()
def item_response_smooth(spark, d):
    """Both channels' levels from answers to items: readouts of estimated traits, and measurements linearized anew in every round."""
    panel = _panel(spark, d, items=True)
    return smoothers.smoothed(panel, smoothers.fit_smoother(panel))
