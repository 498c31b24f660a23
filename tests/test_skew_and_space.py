import numpy as np
from pyspark.sql import functions as F

from frondara.operators import spherical as sp
from frondara.operators.skew import heavy_keys, likely_heavy, salted_aggregate


def test_salted_aggregate_equals_plain(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 97).cast("string")).alias("k"), F.col("id").alias("v"), F.lit(1).alias("_salt"))
    got = salted_aggregate(df, "k", [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")], [F.sum("s").alias("s"), F.sum("n").alias("n")])
    want = df.groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 60 + [(None,)] * 30 + [("b",)] * 2 + [("c",)], "k string")
    assert {r.k for r in heavy_keys(df, "k").collect()} == {"a", "b"}
    assert heavy_keys(df.where("false"), "k").count() == 0
    assert salted_aggregate(df.where("false"), "k", [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")]).count() == 0


def test_likely_heavy_misses_none_and_spares_cold_keys(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 40 == 1, "warm").otherwise((F.col("id") % 6007).cast("string")).alias("k"))
    found = likely_heavy(df, "k")
    assert {"hot", "warm"} <= set(found) and len(found) <= 100
    assert {r.k for r in heavy_keys(df, "k").collect()} == {"hot"}
    assert likely_heavy(df.where("false"), "k") == [] and likely_heavy(df.select(F.lit(None).cast("string").alias("k")), "k") == []


def _brute(points, places):
    out = set()
    for i, x, y in points:
        for j, lon, lat, r, ring in places:
            if x is None or y is None or x != x or y != y:
                continue
            if ring is None and sp.great_circle(np.array([x]), np.array([y]), lon, lat)[0] <= r:
                out.add((i, j))
            if ring is not None and sp.inside_ring(np.array([x]), np.array([y]), np.array(ring))[0]:
                out.add((i, j))
    return out


def test_reach_join_both_ways(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-86, -82.5, 400), rng.uniform(7.9, 11.3, 400)))] + [(900, None, 9.0), (901, float("nan"), 9.0)] + [(902, -84.0, 9.0)] * 3
    places = [(j, float(x), float(y), 20_000.0, None) for j, (x, y) in enumerate(zip(rng.uniform(-86, -82.5, 60), rng.uniform(7.9, 11.3, 60)))]
    places.append((100, 0.0, 0.0, 0.0, [(-85.0, 8.5), (-83.5, 8.5), (-83.5, 10.5), (-85.0, 10.5), (-85.0, 8.5)]))
    p = spark.createDataFrame(pts, "point_id long, lon double, lat double")
    q = spark.createDataFrame([(j, x, y, r, None if g is None else [{"x": a, "y": b} for a, b in g]) for j, x, y, r, g in places], "place_id long, lon double, lat double, reach_m double, ring array<struct<x:double,y:double>>")
    want = _brute(pts, places)
    assert {tuple(r) for r in sp.reach_join(p, q).collect()} == want
    assert {tuple(r) for r in sp.reach_join(p, q, index_rows=10).collect()} == want
    assert sp.reach_join(p, q.where("false")).count() == 0
    assert sp.reach_join(p.where("false"), q).count() == 0


def test_reach_join_of_crowded_positions(spark):
    # 5,000 places at one position among 200 others, and a third of the points at one position: no recursion, blocks on both sides.
    rng = np.random.default_rng(3)
    lon, lat = rng.uniform(-86, -82.5, 5200), rng.uniform(7.9, 11.3, 5200)
    lon[:5000], lat[:5000] = -84.0, 9.5
    x, y = rng.uniform(-86, -82.5, 90), rng.uniform(7.9, 11.3, 90)
    x[:30], y[:30] = -84.01, 9.5
    rows = [(j, float(a), float(b), 20_000.0, None) for j, (a, b) in enumerate(zip(lon, lat))]
    q = spark.createDataFrame(rows, "place_id long, lon double, lat double, reach_m double, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "point_id long, lon double, lat double")
    want = {(i, j) for i in range(90) for j in np.flatnonzero(sp.great_circle(lon, lat, x[i], y[i]) <= 20_000)}
    for rows_at_most, kwargs in ((50_000, {}), (10, {"cell_rows": 7, "cell_places": 600}), (10, {})):
        assert {tuple(r) for r in sp.reach_join(p, q, index_rows=rows_at_most, **kwargs).collect()} == want


def test_reach_join_with_cells_on_two_levels(spark):
    # A self-join of 20,000 points in thousands of cells, against brute force for every hundredth.
    rng = np.random.default_rng(4)
    n = 20_000
    lon, lat = np.round(rng.normal(-84, 0.5, n), 4), np.round(rng.normal(9.6, 0.5, n), 4)
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "point_id long, lon double, lat double")
    q = p.select(F.col("point_id").alias("place_id"), "lon", "lat", F.lit(800.0).alias("reach_m"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    cells = sp.Cells(lon, lat, 3000)
    assert len(cells.below) == sp.PIVOTS and len(np.unique(cells.of_points(lon, lat))) > 1000
    got = sp.reach_join(p, q, index_rows=10, cell_rows=400, cell_places=400).where("point_id % 100 = 0").collect()
    want = {(i, j) for i in range(0, n, 100) for j in np.flatnonzero(sp.great_circle(lon, lat, lon[i], lat[i]) <= 800)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
