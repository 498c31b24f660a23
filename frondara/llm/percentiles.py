"""Percentiles per group over very many numbers, by radix selection on order-preserving integers.

A double becomes a 64-bit integer that sorts alike. A pass histograms the next DIGIT_BITS of it, per group and per
prefix still followed, and keeps only the digit that contains each target rank. After ``levels`` passes a value is known
to its first 16 * levels bits: exactly with 4, within a factor of 2**-20 with 2 (for altitudes under 4,096 m: 4 mm).
Histograms of separate days are added before the ranks are followed, so parts combine without error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from frondara.session import at_most, cut

DIGIT_BITS = 16
#: Followed prefixes that go to the tasks at most; more of them are joined by shuffle.
FOLLOWED_ROWS = 50_000


@F.pandas_udf(T.LongType())
def order_key(x: pd.Series) -> pd.Series:
    """The integer that sorts like the double; -0.0 as 0.0."""
    bits = (x.to_numpy("float64", na_value=np.nan) + 0.0).view("int64")
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """The double of an order key."""
    bits = k.to_numpy("int64")
    return pd.Series((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view("float64"))


def usable(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def _digit(level: int) -> Column:
    """The digit of a level; the first keeps the sign."""
    x = F.shiftright(F.col("_k"), 64 - DIGIT_BITS * (level + 1))
    return x if level == 0 else x.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def _prefix(level: int) -> Column:
    """All digits before a level."""
    return F.shiftright(F.col("_k"), 64 - DIGIT_BITS * level)


def _follow(hist: DataFrame, by: list[str], targets: DataFrame | None, probs: Sequence[float]) -> DataFrame:
    """(by, _t, _rank, _n, _digit): for each target rank the digit that contains it and the rank within the digit.

    hist: by, _digit, _c with at most 2**16 digits for each ``by``, whatever the number of rows.
    """
    w = Window.partitionBy(*by).orderBy("_digit")
    hist = hist.withColumn("_hi", F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    if targets is None:
        hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
        ranks = []
        for i, p in enumerate(probs):
            at = F.lit(float(p)) * (F.col("_n") - 1)
            ranks += [F.struct(F.lit(2 * i).alias("_t"), F.floor(at).alias("_rank")), F.struct(F.lit(2 * i + 1).alias("_t"), F.ceil(at).alias("_rank"))]
        here = F.filter(F.array(*ranks), lambda r: (r["_rank"] >= F.col("_lo")) & (r["_rank"] < F.col("_hi")))
        return hist.withColumn("_r", F.explode(here)).select(*by, "_n", F.col("_r._t").alias("_t"), (F.col("_r._rank") - F.col("_lo")).alias("_rank"), "_digit")
    joined = hist.join(targets, by)
    return joined.where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).select(*by, "_n", "_t", (F.col("_rank") - F.col("_lo")).alias("_rank"), "_digit")


def _answers(state: DataFrame, groups: list[str], probs: Sequence[float], names: Sequence[str], levels: int) -> DataFrame:
    """One row per group: n and the interpolated percentiles, from the followed prefixes."""
    gap = 64 - DIGIT_BITS * levels
    low = F.shiftleft(F.col("_p"), gap)
    # The middle of what the unread bits can be, so that the error is at most half of their range.
    state = state.withColumn("_v", key_value(low + F.lit((1 << gap >> 1) if gap else 0).cast("long")))
    out = state.groupBy(*groups).agg(F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_m"))
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*groups, "n", *cols)


def _renamed(df: DataFrame, groups: Sequence[str]) -> tuple[list[Column], list[str]]:
    """Group columns under inner names that can't clash, nulls made comparable."""
    inner = [f"_g{i}" for i in range(len(groups))]
    return [F.struct(F.col(g).isNull().alias("n"), F.col(g).alias("v")).alias(i) for g, i in zip(groups, inner)], inner


def _outer(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if not c.startswith("_g")]
    return df.select(*[F.col(f"_g{i}.v").alias(g) for i, g in enumerate(groups)], *rest)


def radix_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], levels: int = 4) -> DataFrame:
    """(groups, n, one column per percentile): linear interpolation between the two neighbouring ranks.

    Nulls and NaN of ``value`` are left out; a null group is a group; groups without values and empty tables give no
    row; repeated rows count each; infinities are values. The rows are read ``levels`` times and never shuffled; if more
    than FOLLOWED_ROWS prefixes are followed, equal values of a group are counted once, written, and read from there.
    """
    keys, inner = _renamed(df, groups)
    rows = df.where(usable(F.col(value))).select(*keys, order_key(F.col(value).cast("double")).alias("_k"), F.lit(1).cast("long").alias("_c"))
    counted = False
    hist = rows.groupBy(*inner, _digit(0).alias("_digit")).agg(F.sum("_c").alias("_c"))
    state = cut(_follow(hist, inner, None, probs).withColumnRenamed("_digit", "_p"))
    for level in range(1, levels):
        followed = state.select(*inner, "_p").distinct()
        by = [*inner, "_p"]
        small = at_most(followed, FOLLOWED_ROWS)
        if not small and not counted:
            rows, counted = cut(rows.groupBy(*inner, "_k").agg(F.sum("_c").alias("_c"))), True
        here = rows.select(*inner, _prefix(level).alias("_p"), _digit(level).alias("_digit"), "_c")
        kept = here.join(F.broadcast(followed) if small else followed.hint("merge"), by, "left_semi")
        hist = kept.groupBy(*by, "_digit").agg(F.sum("_c").alias("_c"))
        found = _follow(hist, by, state, probs)
        state = cut(found.withColumn("_p", F.shiftleft("_p", DIGIT_BITS).bitwiseOR(F.col("_digit"))).drop("_digit"))
    return _outer(_answers(state, inner, probs, names, levels), groups)


def histograms(df: DataFrame, groups: Sequence[str], part: str, value: str) -> DataFrame:
    """(groups, part, prefix, c): counts by the first 32 bits, a summary of each part (a day) to keep and to add up."""
    rows = df.where(usable(F.col(value))).select(*groups, part, F.shiftright(order_key(F.col(value).cast("double")), 64 - 2 * DIGIT_BITS).alias("prefix"))
    return rows.groupBy(*groups, part, "prefix").agg(F.count(F.lit(1)).alias("c"))


def merged_percentiles(hist: DataFrame, groups: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Percentiles of the union of all parts, each within a factor of 2**-20 of the exact value.

    The parts' counts are added, then both digits of the prefix are followed as in :func:`radix_percentiles`.
    """
    keys, inner = _renamed(hist, groups)
    rows = hist.select(*keys, F.shiftleft("prefix", 64 - 2 * DIGIT_BITS).alias("_k"), "c")
    both = rows.groupBy(*inner, _digit(0).alias("_p"), _digit(1).alias("_digit")).agg(F.sum("c").alias("_c"))
    first = both.groupBy(*inner, F.col("_p").alias("_digit")).agg(F.sum("_c").alias("_c"))
    state = _follow(first, inner, None, probs).withColumnRenamed("_digit", "_p")
    found = _follow(both.join(state.select(*inner, "_p").distinct(), [*inner, "_p"], "left_semi"), [*inner, "_p"], state, probs)
    state = found.withColumn("_p", F.shiftleft("_p", DIGIT_BITS).bitwiseOR(F.col("_digit"))).drop("_digit")
    return _outer(_answers(state, inner, probs, names, 2), groups)
