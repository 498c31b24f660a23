"""Names alike up to a share of their letters: all pairs, by equal segments, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frondara.session import cut

#: Least similarity of two names: one less the edits for each letter of the longer one.
CUTOFF = 0.88


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0 for names without a letter in common."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def _edits(length: Column, cutoff: float) -> Column:
    """Most edits that a name of this length can have within the cutoff, whatever the other's length."""
    return F.floor(length * ((1 - cutoff) / cutoff) + 1e-9).cast("int")


def similar_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, cutoff: float = CUTOFF) -> DataFrame:
    """Columns of both sides and ``similarity`` of every pair of names at or above the cutoff.

    A right name of n letters that allows k edits is cut into k + 1 segments; every name within k edits holds one of them
    unaltered, at most k places off. So pairs meet by (length, number, segment, in the left name at each such place), and
    only those are compared. Null names match nothing, empty ones only each other; repeated rows repeat.
    """
    r = right.where(F.col(right_name).isNotNull()).withColumn("_n", F.length(right_name))
    r = r.withColumn("_k", _edits(F.col("_n"), cutoff))
    segment = lambda n, k, i: (F.floor(n * i / (k + 1)).cast("int"), F.floor(n * (i + 1) / (k + 1)).cast("int"))

    def own(i: Column) -> Column:
        a, b = segment(F.col("_n"), F.col("_k"), i)
        return F.struct(F.col("_n").alias("n"), i.alias("i"), F.substring(F.col(right_name), a + 1, b - a).alias("s"))

    r_keys = r.select(F.struct(*right.columns).alias("_r"), F.col(right_name).alias("_rn"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_k")), own)).alias("_key"))
    # Numbers of rows must outlive a lost executor, so they are written.
    left_ = cut(left.where(F.col(left_name).isNotNull()).withColumns({"_lid": F.monotonically_increasing_id(), "_m": F.length(left_name)}))
    most = _edits(F.ceil(F.col("_m") / cutoff), cutoff)
    at = left_.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_m") - most), F.col("_m") + most)))
    at = at.withColumn("_k", _edits(F.col("_n"), cutoff)).where(F.abs(F.col("_n") - F.col("_m")) <= F.col("_k"))
    at = at.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    a, b = segment(F.col("_n"), F.col("_k"), F.col("_i"))
    at = at.withColumns({"_a": a, "_w": b - a}).withColumn("_p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_a") - F.col("_k")), F.greatest(F.lit(0), F.col("_a") + F.col("_k")))))
    at = at.where(F.col("_p") + F.col("_w") <= F.col("_m"))
    key = F.struct(F.col("_n").alias("n"), F.col("_i").alias("i"), F.substring(F.col(left_name), F.col("_p") + 1, F.col("_w")).alias("s"))
    l_keys = at.select("_lid", F.struct(*left.columns).alias("_l"), F.col(left_name).alias("_ln"), key.alias("_key"))
    met = l_keys.join(r_keys, "_key").withColumn("similarity", similarity(F.col("_ln"), F.col("_rn"))).where(F.col("similarity") >= cutoff - 1e-12)
    one = met.groupBy("_lid", "_l", "_r").agg(F.max("similarity").alias("similarity"))
    return one.select("_l.*", "_r.*", "similarity")
