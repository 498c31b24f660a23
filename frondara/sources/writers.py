"""Sinks: the catalogue, reports and caches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frondara.operators.ordered import upsert
from frondara.session import cut


def rebuild(df: DataFrame, path: str) -> None:
    """Replace the stored table."""
    df.write.mode("overwrite").parquet(path)


def merge_into(df: DataFrame, path: str, new_path: str, key: str, keep: str = "last") -> None:
    """Write the stored table with ``df`` merged in by key to ``new_path``, so that a lost job leaves the old one whole."""
    upsert(df.sparkSession.read.parquet(path), df, key, keep).write.mode("overwrite").parquet(new_path)


def csv_report(df: DataFrame, path: str) -> None:
    """A CSV report with a header; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def documents(df: DataFrame) -> DataFrame:
    """(vector_id, document): each record as one JSON text."""
    return df.select("vector_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def from_documents(df: DataFrame, schema: str | StructType) -> DataFrame:
    """The records of :func:`documents`; a text that doesn't fit the schema fails."""
    return df.select("vector_id", F.from_json("document", schema, {"mode": "FAILFAST"}).alias("r"))


def index_records(df: DataFrame) -> DataFrame:
    """Flat metadata for a vector index: effective bounds, -1 for missing numbers, months as texts."""
    n = lambda c: F.coalesce(c, F.lit(-1))
    return df.select(
        "vector_id", "species", "family", n(F.col("elev_min")).alias("elev_min"), n(F.col("elev_max")).alias("elev_max"), n(F.coalesce("elev_outlier_min", "elev_min")).alias("elev_min_eff"),
        n(F.coalesce("elev_outlier_max", "elev_max")).alias("elev_max_eff"), "habits", "vertientes", "regions", "forest_types", F.transform("flowering_months", lambda m: m.cast("string")).alias("flowering_months"),
    )


def markdown(df: DataFrame, title: str, rows: int = 12) -> str:
    """A report of at most ``rows`` rows as a Markdown table; the rest is only counted."""
    head = df.limit(rows).collect()
    more = df.count() - len(head)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head]
    return "\n".join([*lines, *([f"+{more} más"] if more > 0 else [])])


def in_batches(df: DataFrame, key: str, rows: int = 90) -> DataFrame:
    """(part, batch, records): records grouped for an external index, at most ``rows`` a batch, as they lie in the tasks."""
    part = cut(df.withColumns({"_id": F.monotonically_increasing_id(), "part": F.spark_partition_id()}))
    batch = F.floor(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) / rows)
    return part.groupBy("part", batch.alias("batch")).agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias("records"))


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not stored yet, so that a long run can go on where it was lost; how many were added."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException:
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new.count()


def point_cache(points: DataFrame, path: str) -> None:
    """Points by species, so that one species is read alone; species of few points share files of one bucket."""
    points.withColumn("bucket", F.pmod(F.xxhash64("species"), F.lit(64)).cast("int")).repartition("bucket").sortWithinPartitions("species").write.mode("overwrite").partitionBy("bucket").parquet(path)


def cached_points(spark: SparkSession, path: str, species: str) -> DataFrame:
    """The points of one species from the cache; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(species)), F.lit(64)).cast("int")
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("species") == species)).drop("bucket")


def count_cache(df: DataFrame, key: str, path: str) -> DataFrame:
    """Counts by key, kept at ``path`` and read from there when they exist."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
        return spark.read.parquet(path)
