"""Queries of problems 3 and 7 over the flora tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frondara.operators.skew import heavy_keys, salted_aggregate
from frondara.operators.spherical import reach_join
from frondara.session import broadcast_if_small, table

#: The country's box: lon, lat bounds, both included.
BOX = (-86.0, -82.5, 7.9, 11.3)
#: Metres within which a locality is near.
NEAR_M = 500.0


def in_box(lon: Column, lat: Column) -> Column:
    return lon.between(BOX[0], BOX[1]) & lat.between(BOX[2], BOX[3])


def put_right(points: DataFrame) -> DataFrame:
    """Points in the box, with exchanged lon and lat put right; null, NaN and outside coordinates are left out."""
    lon, lat = F.col("lon"), F.col("lat")
    swapped = ~in_box(lon, lat) & in_box(lat, lon)
    return points.withColumns({"lon": F.when(swapped, lat).otherwise(lon), "lat": F.when(swapped, lon).otherwise(lat)}).where(in_box(F.col("lon"), F.col("lat")))


def without_junk(slope: Column) -> Column:
    """The slope without a ``NULL`` glued to its front."""
    return F.regexp_replace(slope, "^NULL", "")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and localities as places with a reach; (kind, ref_id) as ``place_id``."""
    regions = table(spark, sf_dir, "region_polygons").where(F.col("ring").isNotNull())
    zero = F.lit(0.0)
    near = table(spark, sf_dir, "localities")
    return regions.select(
        F.concat(F.lit("r"), "region_id").alias("place_id"), zero.alias("lon"), zero.alias("lat"), zero.alias("reach_m"), "ring"
    ).unionByName(
        near.select(F.concat(F.lit("l"), "locality_id").alias("place_id"), "lon", "lat", F.lit(NEAR_M).alias("reach_m"), F.lit(None).cast(regions.schema["ring"].dataType).alias("ring"))
    )


def _pairs(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of points, kind and ref_id."""
    points = put_right(table(spark, sf_dir, "points").select(*keep, "lon", "lat"))
    is_region = F.col("place_id").startswith("r")
    return reach_join(points, _places(spark, sf_dir), keep).select(
        *keep, F.when(is_region, "region").otherwise("near").alias("kind"), F.substring("place_id", 2, 20).cast("long").alias("ref_id")
    )


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, point_id, ref_id) of all points in a region or near a locality; repeated points give repeated rows."""
    return _pairs(spark, sf_dir, ["point_id"]).select("kind", "point_id", "ref_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a region of another name or slope than stored, and points near a locality; each case once."""
    regions = table(spark, sf_dir, "region_polygons").select(
        F.lit("region").alias("kind"), F.col("region_id").alias("ref_id"), F.col("nombre").alias("r_nombre"), without_junk(F.col("vertiente")).alias("r_vertiente")
    )
    pairs = _pairs(spark, sf_dir, ["point_id", "nombre", "vertiente"]).join(broadcast_if_small(regions), ["kind", "ref_id"], "left")
    same = F.col("nombre").eqNullSafe(F.col("r_nombre")) & without_junk(F.col("vertiente")).eqNullSafe(F.col("r_vertiente"))
    return pairs.where((F.col("kind") == "near") | ~same).select("kind", "point_id", "ref_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species holding at least 2 % of all rows of points."""
    return heavy_keys(table(spark, sf_dir, "points").select("species"), "species").select("species")


def p7_species_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, usable altitudes, their sum, least and greatest, of every species (null included), by salted aggregation."""
    alt = F.col("altitud")
    usable = alt.isNotNull() & ~F.isnan(alt) & (alt >= -500)
    points = table(spark, sf_dir, "points").select("species", F.when(usable, alt).alias("alt"))
    partial = [F.count(F.lit(1)).alias("n"), F.count("alt").alias("k"), F.sum(F.round(F.col("alt") * 10).cast("long")).alias("s"), F.min("alt").alias("lo"), F.max("alt").alias("hi")]
    merge = [F.sum("n").alias("n_rows"), F.sum("k").alias("n_alt"), F.sum("s").alias("sum_dm"), F.min("lo").alias("alt_min"), F.max("hi").alias("alt_max")]
    return salted_aggregate(points, "species", partial, merge)


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p7_found": p7_found, "p7_species_stats": p7_species_stats}

_USABLE = "altitud IS NOT NULL AND NOT isnan(altitud) AND altitud >= -500"
_FIXED = """box AS (SELECT point_id, nombre, regexp_replace(vertiente, '^NULL', '') AS vertiente,
  CASE WHEN sw THEN lat ELSE lon END AS x, CASE WHEN sw THEN lon ELSE lat END AS y FROM (SELECT *,
    (NOT (lon BETWEEN -86 AND -82.5 AND lat BETWEEN 7.9 AND 11.3)) AND (lat BETWEEN -86 AND -82.5 AND lon BETWEEN 7.9 AND 11.3) AS sw
    FROM points WHERE lon IS NOT NULL AND lat IS NOT NULL)),
pts AS (SELECT * FROM box WHERE x BETWEEN -86 AND -82.5 AND y BETWEEN 7.9 AND 11.3),
near AS (SELECT p.point_id, l.locality_id FROM pts p JOIN localities l ON abs(p.y - l.lat) < 0.006 AND abs(p.x - l.lon) < 0.006
  WHERE 2 * 6371008.8 * asin(sqrt(sin(radians(l.lat - p.y) / 2) ** 2 + cos(radians(p.y)) * cos(radians(l.lat)) * sin(radians(l.lon - p.x) / 2) ** 2)) <= 500),
edges AS (SELECT region_id, r.ring[i].x AS x1, r.ring[i].y AS y1, r.ring[i + 1].x AS x2, r.ring[i + 1].y AS y2
  FROM region_polygons r, unnest(range(1, len(r.ring))) AS t(i)),
inside AS (SELECT p.point_id, p.x, p.y, e.region_id FROM (SELECT DISTINCT point_id, x, y FROM pts) p JOIN edges e
  ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL HAVING count(*) % 2 = 1)"""

ORACLE = {
    "p7_found": "SELECT species FROM points WHERE species IS NOT NULL GROUP BY species HAVING count(*) >= 0.02 * (SELECT count(*) FROM points)",
    "p7_species_stats": f"""SELECT species, count(*) AS n_rows, count(a) AS n_alt, CAST(sum(CAST(round(a * 10) AS BIGINT)) AS BIGINT) AS sum_dm,
min(a) AS alt_min, max(a) AS alt_max FROM (SELECT species, CASE WHEN {_USABLE} THEN altitud END AS a FROM points) GROUP BY species""",
    "p3_pairs": f"""WITH {_FIXED} SELECT 'near' AS kind, point_id, locality_id AS ref_id FROM near
UNION ALL SELECT 'region', i.point_id, i.region_id FROM inside i JOIN pts p ON p.point_id = i.point_id AND p.x = i.x AND p.y = i.y""",
    "p3_found": f"""WITH {_FIXED} SELECT DISTINCT 'near' AS kind, point_id, locality_id AS ref_id FROM near
UNION SELECT DISTINCT 'region', i.point_id, i.region_id FROM inside i JOIN pts p ON p.point_id = i.point_id AND p.x = i.x AND p.y = i.y
JOIN region_polygons r ON r.region_id = i.region_id
WHERE p.nombre IS DISTINCT FROM r.nombre OR p.vertiente IS DISTINCT FROM regexp_replace(r.vertiente, '^NULL', '')""",
}
