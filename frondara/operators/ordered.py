"""Operators on ordered rows: global positions, first or best of a key, sessions, carried states, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frondara.session import cut

_IN_PART = 33  # monotonically_increasing_id keeps the row number of a partition in its low bits


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> tuple[DataFrame, int]:
    """Rows numbered from 0 in a total order, and their number, without gathering them in one task.

    The table is range-partitioned and sorted once and written; the sizes of the partitions (as many numbers as there
    are partitions) give each partition its start.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _IN_PART)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, n = [], 0
    for p, size in sizes:
        starts += [F.lit(p), F.lit(n)]
        n += size
    if not sizes:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at"), 0
    inner = F.col("_at").bitwiseAND(F.lit((1 << _IN_PART) - 1))
    return placed.withColumn(name, F.create_map(*starts)[part].cast("long") + inner).drop("_at"), n


def systematic_sample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every ``max(1, rows // n)``-th row of the order, the first ``n`` of them, with ``position``."""
    placed, rows = with_position(df, order)
    step = max(1, rows // n)
    return placed.where((F.col("position") % step == 0) & (F.col("position") < step * n))


def slices(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``slice`` from 1: positions [i * n // k, (i + 1) * n // k) of the order belong to slice i + 1."""
    placed, rows = with_position(df, order)
    return placed.withColumn("slice", (F.floor((k * F.col("position") + k - 1) / max(1, rows)) + 1).cast("int"))


def best_of(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys form a key. Sorted aggregation keeps one row per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: str = "last") -> DataFrame:
    """``old`` with ``new`` merged in by key: 'last' lets new rows win, 'first' old ones."""
    a, b = (old, new) if keep == "last" else (new, old)
    return a.join(b.select(key), key, "left_anti").unionByName(b, allowMissingColumns=True)


def sessions(df: DataFrame, part: str, order: str, starts: Column) -> DataFrame:
    """``session``: how many starting rows the document had so far; rows before the first start are session 0."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(starts.cast("int")).over(w))


def carried(df: DataFrame, part: str, order: str, state: Column, name: str) -> DataFrame:
    """``name``: the last non-null state of the document up to each row."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(state, ignorenulls=True).over(w))


def first_k_of(df: DataFrame, key: str, order: Sequence[str], k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key, exactly: first of each (key, salt), so that no task sorts a whole hot key, then of
    those that are left, at most salts * k rows a key. Null keys form a key."""
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    some = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= k)
    return some.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn", "_salt")


def running(df: DataFrame, part: str, order: Sequence[str], starts: Column | None = None, states: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``session``, how many starting rows the document had so far, and for each of ``states`` its last
    non-null value up to the row; over documents of any length.

    The table is range-partitioned and sorted once and written. Each partition counts for itself; what it starts from is
    made of one row for each partition and document before it. A null ``part`` is a document.
    """
    states = states or {}
    flag = F.coalesce(starts, F.lit(False)).cast("long") if starts is not None else F.lit(0).cast("long")
    placed = cut(df.withColumns({"_start": flag, **{f"_s_{n}": c for n, c in states.items()}}).orderBy(F.col(part).asc_nulls_first(), *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_at", _IN_PART))
    up_to = Window.partitionBy("_pid", part).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("_n", F.sum("_start").over(up_to))
    for n in states:
        inner = inner.withColumn(f"_l_{n}", F.last(f"_s_{n}", ignorenulls=True).over(up_to))
    ends = placed.groupBy("_pid", part).agg(F.sum("_start").alias("_sum"), *[F.max_by(F.when(F.col(f"_s_{n}").isNotNull(), F.struct(F.col(f"_s_{n}").alias("v"))), F.when(F.col(f"_s_{n}").isNotNull(), F.col("_at"))).alias(f"_e_{n}") for n in states])
    before = Window.partitionBy(part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_pid", F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in states])
    joined = inner.join(F.broadcast(carry), (inner["_pid"] == carry["_pid"]) & inner[part].eqNullSafe(carry["_part"]))
    keep = [inner[c] for c in df.columns]
    return joined.select(*keep, (F.col("_n") + F.col("_base")).alias("session"), *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}.v")).alias(n) for n in states])
