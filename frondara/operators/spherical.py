"""Points near other points, or inside regions, on the sphere.

The right side (places with a reach: a radius in metres, or a region with its circumscribed radius) is divided among
Voronoi cells around pivots. A place goes into every cell that can hold a point within its reach: for a point x of
pivot p's cell and a place y nearest to pivot q, d(x, y) >= (d(y, p) - d(y, q)) / 2 by the triangle inequality. With
many places, the cells are divided again around pivots of their own, by the same rule. Inside a cell a vantage-point
tree under the great-circle metric yields every place within reach; regions are then tested exactly, edge by edge. The
result is complete whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frondara.session import cut

#: Mean Earth radius in metres.
EARTH_M = 6_371_008.8
#: Cells around the pivots of one level, places from which pivots are chosen, leaf size of the trees: speed only.
PIVOTS, PIVOT_SAMPLE, LEAF = 64, 16_384, 8
#: Places, and corners of their regions, up to which the index goes to the tasks; beyond, both sides are shuffled by cell.
INDEX_ROWS, INDEX_CORNERS = 50_000, 2_000_000
#: Points and places that one task joins at a time at most; a cell that holds more is divided into blocks of both.
CELL_ROWS, CELL_PLACES = 200_000, 50_000
#: Slack in metres for rounding, of distances and of the choice of the nearest pivot; candidates are tested exactly.
SLACK_M, CELL_SLACK_M = 0.01, 2.0
#: Distances worked out at a time; speed only.
PAIRS = 1 << 21


def great_circle(lon1, lat1, lon2, lat2):
    """Haversine distance in metres, elementwise."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def choose_pivots(lon: np.ndarray, lat: np.ndarray, k: int = PIVOTS) -> np.ndarray:
    """Indices of up to k places far from one another (farthest-first)."""
    if not len(lon):
        return np.zeros(0, int)
    picked = [0]
    near = great_circle(lon, lat, lon[0], lat[0])
    while len(picked) < min(k, len(lon)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, great_circle(lon, lat, lon[picked[-1]], lat[picked[-1]]))
    return np.array(picked)


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def nearest_pivot(lon: np.ndarray, lat: np.ndarray, plon: np.ndarray, plat: np.ndarray) -> np.ndarray:
    """Number of the nearest pivot of each point, up to CELL_SLACK_M."""
    if not len(plon):
        return np.zeros(len(lon), np.int64)
    return (_unit(lon, lat) @ _unit(plon, plat).T).argmax(axis=1)


def cells_of_places(lon, lat, reach, plon, plat) -> tuple[np.ndarray, np.ndarray]:
    """(place, cell) of every cell that each place must be copied to."""
    d = great_circle(lon[:, None], lat[:, None], plon[None, :], plat[None, :])
    return np.nonzero((d - d.min(axis=1, keepdims=True) - CELL_SLACK_M) / 2 <= reach[:, None] + SLACK_M)


class Cells:
    """Voronoi cells on one level, or on two where a level of PIVOTS would leave too many places in a cell."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, cells: int = PIVOTS):
        pick = choose_pivots(lon, lat)
        self.lon, self.lat = lon[pick], lat[pick]
        inner = min(PIVOTS, -(-cells // PIVOTS))
        self.below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if inner > 1 and len(pick):
            home = nearest_pivot(lon, lat, self.lon, self.lat)
            for c in range(len(pick)):
                x, y = lon[home == c], lat[home == c]
                p = choose_pivots(x, y, inner)
                self.below[c] = x[p], y[p]

    def of_points(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The one cell of each point."""
        outer = nearest_pivot(lon, lat, self.lon, self.lat)
        out = outer * PIVOTS
        for c, (x, y) in self.below.items():
            here = np.flatnonzero(outer == c)
            if len(here):
                out[here] += nearest_pivot(lon[here], lat[here], x, y)
        return out

    def of_places(self, lon: np.ndarray, lat: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell) of every cell that can hold a point within the place's reach."""
        if not len(lon) or not len(self.lon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, cell = cells_of_places(lon, lat, reach, self.lon, self.lat)
        if not self.below:
            return place, cell * PIVOTS
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for c, (x, y) in self.below.items():
            here = place[cell == c]
            if len(here) and len(x):
                k, inner = cells_of_places(lon[here], lat[here], reach[here], x, y)
                parts.append((here[k], c * PIVOTS + inner))
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


class VantageTree:
    """Places with their own reach; a query gets all places whose reach covers it. Queries run in batches."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, reach: np.ndarray):
        self.lon, self.lat, self.reach = lon, lat, reach
        #: (places at the vantage point, radius, reach inside, reach outside, inner, outer); a leaf has no radius.
        self.nodes: list[list] = []
        stack = [(None, 0, np.arange(len(lon)))]
        while stack:
            above, side, ids = stack.pop()
            if above is not None:
                self.nodes[above][side] = len(self.nodes)
            node, at = [ids, None, 0.0, 0.0, None, None], len(self.nodes)
            self.nodes.append(node)
            if len(ids) <= LEAF:
                continue
            d = great_circle(lon[ids], lat[ids], lon[ids[0]], lat[ids[0]])
            away = d > 0  # places at the vantage point itself stay in the node, however many they are
            rest, far = ids[away], d[away]
            radius = float(np.median(far)) if len(far) else 0.0
            inner, outer = rest[far <= radius], rest[far > radius]
            if len(rest) <= LEAF or not len(outer):
                continue  # nothing to divide
            node[:4] = [ids[~away], radius, reach[inner].max(), reach[outer].max()]
            stack += [(at, 4, inner), (at, 5, outer)]

    def within(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of every place within whose reach a query lies."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        stack = [(0, np.arange(len(lon)))]
        while stack:
            at, q = stack.pop()
            own, radius, r_in, r_out, inner, outer = self.nodes[at]
            if not len(q) or not len(own):
                continue
            one = radius is not None  # one point, so one distance for all its places
            step = max(1, PAIRS // len(own))
            for k in range(0, len(q), step):
                p = q[k : k + step]
                at_own = own[:1] if one else own
                d = great_circle(lon[p][:, None], lat[p][:, None], self.lon[at_own][None, :], self.lat[at_own][None, :])
                i, j = np.nonzero(d <= self.reach[own][None, :])
                found.append((p[i], own[j]))
                if one:
                    d = d[:, 0]
                    stack.append((inner, p[d - r_in - SLACK_M <= radius]))
                    stack.append((outer, p[d + r_out + SLACK_M >= radius]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def inside_ring(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Ray casting in the lon/lat plane; half-open edges, so a point of a shared edge is in one polygon."""
    odd = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        if y1 == y2:
            continue
        cross = (y1 > y) != (y2 > y)
        odd ^= cross & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def on_edge(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether a point lies on an edge of the ring, corners included."""
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        between = (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
        out |= between & ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))
    return out


def circumscribed(ring: np.ndarray) -> tuple[float, float, float]:
    """Centre of a ring and a radius in metres that surely covers it."""
    cx, cy = ring.mean(axis=0)
    edges = great_circle(ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1])
    return cx, cy, float(great_circle(ring[:, 0], ring[:, 1], cx, cy).max() + edges.max(initial=0))


class CellIndex:
    """One vantage-point tree per Voronoi cell, over the places copied to it; or one tree of the places of one cell."""

    def __init__(self, places: pd.DataFrame, cells: Cells | None, edges: bool = False):
        self.edges = edges
        self.places = places.reset_index(drop=True)
        self.cells = cells
        lon, lat, reach = (self.places[c].to_numpy(float) for c in ("lon", "lat", "reach_m"))
        self.ring = [None if r is None else np.array([(p["x"], p["y"]) for p in r], float) for r in self.places["ring"]]
        self.trees: dict[int, tuple[np.ndarray, VantageTree]] = {}
        if cells is None:
            self.trees[0] = np.arange(len(lon)), VantageTree(lon, lat, reach)
            return
        place, cell = cells.of_places(lon, lat, reach)
        order = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.diff(cell[order], prepend=-1))
        for m in np.split(order, edges[1:]) if len(order) else []:
            ids = place[m]
            self.trees[int(cell[m[0]])] = ids, VantageTree(lon[ids], lat[ids], reach[ids])

    def match(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, place) pairs: within the place's reach and, for a region, inside its ring."""
        points, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cell = np.zeros(len(lon), np.int64) if self.cells is None else self.cells.of_points(lon, lat)
        for c in np.unique(cell):
            if int(c) not in self.trees:
                continue
            ids, tree = self.trees[int(c)]
            q = np.flatnonzero(cell == c)
            a, b = tree.within(lon[q], lat[q])
            a, b = q[a], ids[b]
            keep = np.ones(len(a), bool)
            for place in np.unique(b):
                if self.ring[place] is not None:
                    m = np.flatnonzero(b == place)
                    keep[m] = inside_ring(lon[a[m]], lat[a[m]], self.ring[place])
                    if self.edges:
                        keep[m] |= on_edge(lon[a[m]], lat[a[m]], self.ring[place])
            points.append(a[keep])
            places.append(b[keep])
        return np.concatenate(points), np.concatenate(places)


def _ready(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places with centre and reach of their regions; those without a usable position left out."""
    pdf = pdf.reset_index(drop=True)
    for i, ring in enumerate(pdf["ring"]):
        if ring is not None and len(ring) > 3:
            pdf.loc[i, ["lon", "lat", "reach_m"]] = circumscribed(np.array([(p["x"], p["y"]) for p in ring], float))
    return pdf.dropna(subset=["lon", "lat", "reach_m"]).reset_index(drop=True)


def _xy(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float)


def reach_join(
    points: DataFrame, places: DataFrame, keep: Sequence[str] = ("point_id",), index_rows: int = INDEX_ROWS, cell_rows: int = CELL_ROWS, cell_places: int = CELL_PLACES,
    how: str = "inner", edges: bool = False,
) -> DataFrame:
    """The columns ``keep`` of points with ``place_id``, for every point within a place's reach or region.

    points: ``keep``, ``lon``, ``lat``. places: ``place_id``, ``lon``, ``lat``, ``reach_m`` and ``ring`` (an array of
    x, y for a region, whose centre and reach are made here; null for a plain radius). Null or NaN coordinates never
    match; an empty side gives no pairs; repeated points give repeated pairs; other columns are not read. Up to
    ``index_rows`` places the index goes with the tasks and nothing is shuffled; beyond, both sides are shuffled by
    cell, and a cell over ``cell_rows`` points or ``cell_places`` places (as where a third of the rows share one
    position) is joined block by block. Pivots are chosen from PIVOT_SAMPLE places; every place is indexed.

    how: ``left`` keeps points without a place, with a null ``place_id``; such points may have any coordinates. edges:
    whether a point on the edge of a region lies in all regions that share it; otherwise it lies in one or none.
    """
    spark = points.sparkSession
    keep = list(keep)
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    given, points = points, points.select(*keep, lon.alias("_x"), lat.alias("_y"))
    sound = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    places = places.select("place_id", lon.alias("lon"), lat.alias("lat"), F.col("reach_m").cast("double").alias("reach_m"), "ring")
    kept = T.StructType([points.schema[c] for c in keep])
    out = T.StructType([*kept, T.StructField("place_id", places.schema["place_id"].dataType)])

    n_places, corners = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.coalesce("ring", F.array()))), F.lit(0))).first()
    if n_places <= index_rows and corners <= INDEX_CORNERS:
        sample = _ready(places.toPandas())
        index = spark.sparkContext.broadcast(CellIndex(sample, Cells(sample["lon"].to_numpy(float), sample["lat"].to_numpy(float)), edges))

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = index.value
            ids = ix.places["place_id"].to_numpy()
            for pdf in batches:
                a = b = np.zeros(0, np.int64)
                if len(pdf) and len(ids):
                    x, y = _xy(pdf)
                    here = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
                    a, b = ix.match(x[here], y[here])
                    a = here[a]
                if how != "left":
                    yield pdf[keep].iloc[a].reset_index(drop=True).assign(place_id=ids[b])
                elif len(pdf):
                    alone = np.setdiff1d(np.arange(len(pdf)), a)
                    found = pd.Series([*ids[b].tolist(), *[None] * len(alone)], dtype=object)
                    yield pdf[keep].iloc[np.concatenate([a, alone])].reset_index(drop=True).assign(place_id=found)

        return (points if how == "left" else points.where(sound)).mapInPandas(local, out)

    if how == "left":
        marked = cut(given.select(*keep, "lon", "lat").withColumn("_rid", F.monotonically_increasing_id()))
        pairs = reach_join(marked.select("_rid", "lon", "lat"), places, ["_rid"], index_rows, cell_rows, cell_places, edges=edges)
        return marked.select(*keep, "_rid").join(pairs.hint("merge"), "_rid", "left").drop("_rid")
    points = points.where(sound)
    one_in = max(1, -(-n_places // PIVOT_SAMPLE))
    bare = places.where(F.pmod(F.xxhash64("place_id"), F.lit(one_in)) == 0).where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    sample = _ready(bare.limit(2 * PIVOT_SAMPLE).withColumn("ring", F.when(F.size("ring") <= 64, F.col("ring"))).toPandas())
    want = max(-(-n_places // (cell_places // 4 + 1)), -(-points.count() // cell_rows))
    cells = spark.sparkContext.broadcast(Cells(sample["lon"].to_numpy(float), sample["lat"].to_numpy(float), want))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_cell=cells.value.of_points(*_xy(pdf)))

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = _ready(pdf)
            place, cell = cells.value.of_places(*(pdf[c].to_numpy(float) for c in ("lon", "lat", "reach_m")))
            yield pdf.iloc[place].reset_index(drop=True).assign(_cell=cell)

    column = T.StructField("_cell", T.LongType())
    left = points.mapInPandas(to_cells, T.StructType([*points.schema, column]))
    right = places.mapInPandas(copies, T.StructType([*places.schema, column]))
    # At most PIVOTS squared rows each.
    n_left, n_right = ({r[0]: -(-r[1] // most) for r in side.groupBy("_cell").agg(F.count(F.lit(1))).collect()} for side, most in ((left, cell_rows), (right, cell_places)))

    def blocks(sizes: dict[int, int]) -> Column:
        many = {c: n for c, n in sizes.items() if n > 1}
        return F.coalesce(F.create_map(*[F.lit(int(x)) for kv in many.items() for x in kv])[F.col("_cell")], F.lit(1)) if many else F.lit(1)

    def grid(side: DataFrame, own: str, other: str, n_own: dict[int, int], n_other: dict[int, int]) -> DataFrame:
        placed = side.withColumn(own, F.pmod(F.monotonically_increasing_id(), blocks(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), blocks(n_other).cast("int") - 1)))

    left, right = grid(left, "_a", "_b", n_left, n_right), grid(right, "_b", "_a", n_right, n_left)

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return a[keep].head(0).assign(place_id=b["place_id"].head(0))
        ix = CellIndex(b, None, edges)
        i, j = ix.match(*_xy(a))
        return a[keep].iloc[i].reset_index(drop=True).assign(place_id=ix.places["place_id"].to_numpy()[j])

    by = ["_cell", "_a", "_b"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(join, out)
