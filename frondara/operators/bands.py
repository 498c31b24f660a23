"""Elevation bands: three overlap predicates, scores of a band against a window or another band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective(core: str | Column, outlier: str | Column) -> Column:
    """The outlier bound where there is one, else the core bound."""
    return F.coalesce(outlier, core)


def strictly_overlaps(lo: Column, hi: Column, window_lo: Column | None, window_hi: Column | None) -> Column:
    """Whether band and window share more than a point; an open side takes the band's own bound; no bounds, no match."""
    a, b = window_lo if window_lo is not None else lo, window_hi if window_hi is not None else hi
    return lo.isNotNull() & hi.isNotNull() & ((F.least(b, hi) - F.greatest(a, lo)) > 0)


def touches(lo: Column, hi: Column, window_lo: Column | None, window_hi: Column | None) -> Column:
    """Whether band and window share at least a point."""
    c = lo.isNotNull() & hi.isNotNull()
    if window_hi is not None:
        c = c & (lo <= window_hi)
    if window_lo is not None:
        c = c & (hi >= window_lo)
    return c


def relevance(lo: Column, hi: Column, window_lo: Column, window_hi: Column, semantic: Column) -> Column:
    """0.6 containment + 0.3 coverage + 0.1 semantic."""
    inter = F.greatest(F.lit(0), F.least(window_hi, hi) - F.greatest(window_lo, lo))
    contain, cover = inter / F.greatest(F.lit(1), hi - lo), inter / F.greatest(F.lit(1), window_hi - window_lo)
    return 0.6 * contain + 0.3 * cover + 0.1 * semantic


def iou(lo1: Column, hi1: Column, lo2: Column, hi2: Column, points_equal: float = 1.0) -> Column:
    """Intersection over union of two bands; two equal points give ``points_equal`` (1.0 or, in the other sense, 0.0)."""
    inter = F.greatest(F.lit(0), F.least(hi1, hi2) - F.greatest(lo1, lo2))
    union = F.greatest(hi1, hi2) - F.least(lo1, lo2)
    return F.when(union <= 0, F.when((lo1 == lo2) & (hi1 == hi2), F.lit(points_equal)).otherwise(0.0)).otherwise(inter / union)


def precision_recall(hits: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1), 0 where undefined."""
    p = F.when(predicted > 0, hits / predicted).otherwise(0.0)
    r = F.when(gold > 0, hits / gold).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
