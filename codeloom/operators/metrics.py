"""Metric facts, snapshots and their differences.

A fact has snapshot, entity_id, metric_key and metric_value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """entity_id, metric_key, current_value, baseline_value and delta of what differs; a missing value is 0."""
    keys = ["entity_id", "metric_key"]
    a, z = (df.select(*keys, F.col("metric_value").alias(name)) for df, name in ((current, "current_value"), (baseline, "baseline_value")))
    both = a.join(z, keys, "full_outer").na.fill(0.0, ["current_value", "baseline_value"])
    return both.withColumn("delta", F.col("current_value") - F.col("baseline_value")).filter("delta <> 0").select(*keys, "current_value", "baseline_value", "delta")


def top_by(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """The n rows of the largest column, ties in order; only n rows of each task travel."""
    return df.orderBy(F.desc(column), *ties).limit(n)


def latest(snapshots: DataFrame, other_than: object = None) -> DataFrame:
    """The newest row, or the newest but one given by id."""
    left = snapshots if other_than is None else snapshots.filter(F.col("id") != F.lit(other_than))
    return left.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change of rows (id, x, y, parent, size): added, reparented, moved or resized by more than one."""
    old = before.select("id", *(F.col(c).alias(f"old_{c}") for c in ("x", "y", "parent", "size")))
    joined = after.join(old, "id", "left")
    moved = (F.abs(F.col("x") - F.col("old_x")) > 1) | (F.abs(F.col("y") - F.col("old_y")) > 1)
    change = F.when(F.col("old_x").isNull(), "added").when(~F.col("parent").eqNullSafe(F.col("old_parent")), "reparented").when(moved, "moved").when(F.abs(F.col("size") - F.col("old_size")) > 1, "resized")
    return joined.select("id", change.alias("change")).filter("change is not null")
