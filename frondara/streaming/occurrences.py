"""An extension: occurrences arriving as a stream, cleaned, without repeats, counted by species and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frondara.plans.core_problems import put_right


def daily_counts(points: DataFrame, late: str = "30 days") -> DataFrame:
    """(day, species, n) of a stream or table of points by load time; a delivery counts once, rows later than ``late`` not."""
    clean = put_right(points.where(F.col("species").isNotNull())).withWatermark("loaded_at", late)
    once = clean.dropDuplicates(["point_id", "loaded_at"])
    return once.groupBy(F.window("loaded_at", "1 day").alias("w"), "species").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "species", "n")
