"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

Stage one aggregates by (key, salt), where only heavy keys get a salt other than 0; stage two merges the partial
results by key. No task sees more than about 1/salts of a heavy key's rows, whatever the aggregate is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key counts as heavy. At most 1 / HEAVY_SHARE keys can be.
HEAVY_SHARE = 0.02
#: Number of salts of a heavy key.
SALTS = 64


#: Items that the search for heavy keys keeps at most, a power of two; its error is 3.5 rows in as many, far below the share.
TRACKED = 1 << 14


def likely_heavy(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """All non-null keys that hold at least ``share`` of the rows, and perhaps a few more: at most 2 / share.

    One pass by a frequent-items sketch that is merged up a tree of tasks; each task keeps TRACKED items, so nothing is
    gathered by key. A key that holds the share is among the most frequent ones by count less error and so never missed.
    """
    most = int(2 / share)
    found = df.where(F.col(key).isNotNull()).agg(F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(TRACKED)).alias("t")).first()
    return [r["item"] for r in (found["t"] or []) if r["item"] is not None] if found else []


def salted_aggregate(
    df: DataFrame, key: str, partial: Sequence[Column], merge: Sequence[Column], share: float = HEAVY_SHARE, salts: int = SALTS
) -> DataFrame:
    """(key, merged columns): ``partial`` by (key, salt), then ``merge`` over the partial columns by key.

    Only keys recognised as heavy, and the null key, get salts; the others have salt 0 and cross the exchange once. Rows
    with a null key form one group of their own, like any other key. Columns of ``df`` named ``_salt`` are not touched,
    since only ``key`` and what ``partial`` names is read. An empty table gives no row.
    """
    heavy = likely_heavy(df, key, share)
    col = F.col(key)
    is_heavy = (col.isin(heavy) if heavy else F.lit(False)) | col.isNull()
    salt = F.when(is_heavy, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0))
    stage1 = df.withColumn("_fr_salt", salt).groupBy(key, "_fr_salt").agg(*partial)
    return stage1.groupBy(key).agg(*merge)


def key_counts(df: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """(key, n): rows of each key, the null key included, by salted aggregation."""
    return salted_aggregate(df, key, [F.count(F.lit(1)).alias("_n")], [F.sum("_n").alias("n")], salts=salts)


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """(key, n, total): non-null keys that hold at least ``share`` of all rows (null keys count in the total), counted exactly."""
    counts = key_counts(df, key, salts)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("total", total).where(F.col(key).isNotNull() & (F.col("n") >= F.lit(share) * F.col("total")))
