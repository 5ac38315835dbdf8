"""Cohort partitions: by facility, by time, and evaluation masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import draw
from tidemark.operators.joins import overlapping


def facility_exclusive(sessions: DataFrame, subject: str, partition: str) -> DataFrame:
    """One row per subject: its partition, or null with excluded set where its sessions fall into several."""
    g = sessions.groupBy(subject).agg(F.count_distinct(partition).alias("_n"), F.min(partition).alias("_p"))
    return g.select(subject, F.when(F.col("_n") == 1, F.col("_p")).alias("partition"), (F.col("_n") != 1).alias("excluded"))


def held_out_halves(subjects: DataFrame, facility: str, subject: str) -> DataFrame:
    """Held-out subjects in turn to calibration and test within each facility, in an order drawn by hash."""
    w = Window.partitionBy(facility).orderBy(draw(F.col(subject)), subject)
    return subjects.withColumn("role", F.when(F.row_number().over(w) % 2 == 1, "calibration").otherwise("test"))


def partition_roles(subjects: DataFrame, subject: str, partition: str) -> DataFrame:
    """One row per subject and role: train fits, val selects, both are for development; subjects of other partitions have none."""
    roles = F.when(F.col(partition) == "train", F.array(F.lit("fit"), F.lit("development"))).when(F.col(partition) == "val", F.array(F.lit("selection"), F.lit("development")))
    return subjects.select(subject, F.explode(roles).alias("role"))


def forward_time(sessions: DataFrame, subject: str, date: str, cutoff: str) -> DataFrame:
    """One row per subject: train if its last session is before the cut-off, test if its first isn't, else excluded."""
    g = sessions.groupBy(subject).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    cut = F.lit(cutoff).cast("timestamp_ntz")
    return g.select(subject, F.when(F.col("_b") < cut, "train").when(F.col("_a") >= cut, "test").otherwise("excluded").alias("partition"))


def evaluation_mask(anchors: DataFrame, by: str, instrument: str, *order: Column, observed: str = "observed", among: Column | None = None) -> DataFrame:
    """anchors with evaluation (the last observed one of each subject and instrument), embargo and observed_after.

    Only rows for which among holds can be targets: those of the subjects that are held for validation. Every observed anchor whose window meets a target's of the same subject, targets included, is under embargo and no
    longer counts as observed; unobserved ones are never flagged.
    """
    w = Window.partitionBy(by, instrument).orderBy(F.desc(observed), *order)
    rows = anchors.withColumn("evaluation", F.coalesce(F.col(observed) & (F.lit(True) if among is None else among), F.lit(False)) & (F.row_number().over(w) == 1))
    # windows of targets are few per subject: each row is held against them in one array
    targets = F.collect_list(F.when(F.col("evaluation"), F.struct(F.col("window_start").alias("s"), F.col("window_end").alias("e")))).over(Window.partitionBy(by))
    met = F.exists("_targets", lambda t: (F.col("window_start") <= t["e"]) & (F.col("window_end") >= t["s"]))
    rows = rows.withColumn("_targets", targets).withColumn("embargo", F.coalesce(F.col(observed), F.lit(False)) & met).drop("_targets")
    return rows.withColumn("observed_after", F.col(observed) & ~F.col("embargo"))


__all__ = ["evaluation_mask", "facility_exclusive", "forward_time", "held_out_halves", "overlapping", "partition_roles"]
