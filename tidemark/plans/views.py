"""Longitudinal views of the driver's tables, in DataFrames and in the SQL that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Instruments by event type: name, recall in days.
RECALL = {"purchase": ("M1", 14), "view": ("M2", 7), "click": ("M3", 7)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with day: whole days since the user's first date."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("date"))
    first = F.min("date").over(Window.partitionBy("user_id"))
    return rows.withColumn("day", F.datediff("date", first)).drop("date")


def daily(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Mean value per user, event type and day, of values in [0, 200]."""
    rows = events(spark, sf_dir).where("value between 0 and 200")
    if kind:
        rows = rows.where(F.col("event_type") == kind)
    return rows.groupBy("user_id", "event_type", "day").agg(F.avg("value").alias("value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day with any event: mean value, number of events."""
    return events(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with their recall windows: purchases look back over 14 days, views and clicks over 7."""
    back = F.when(F.col("event_type") == "purchase", 13).otherwise(6)
    return daily(spark, sf_dir).where("event_type in ('purchase', 'view', 'click')").select("user_id", "event_type", "day", "value", (F.col("day") - back).alias("window_start"), F.col("day").alias("window_end"), (F.col("value") > 2).alias("observed"))


EVENTS = "ev as (select event_id, user_id, event_type, value, date_diff('day', min(cast(ts as date)) over (partition by user_id), cast(ts as date))::integer as day from events)"
DAILY = EVENTS + ", daily as (select user_id, event_type, day, avg(value) as value from ev where value between 0 and 200 group by all)"
DAYS = EVENTS + ", days as (select user_id, day, avg(value) as value, count(*) as n from ev group by all)"
ANCHORS = DAILY + ", anchors as (select *, day - case when event_type = 'purchase' then 13 else 6 end as window_start, day as window_end, value > 2 as observed from daily where event_type in ('purchase', 'view', 'click'))"
