"""Points with altitude and region, regions as cells, and the layers of distribution maps as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frondara.functions import spanish as es
from frondara.operators import ordered, raster
from frondara.operators.raster import Grid
from frondara.operators.spherical import reach_join
from frondara.plans import answers, catalog_queries as cq
from frondara.plans.core_problems import BOX, in_box, without_junk
from frondara.plans.registry import registry
from frondara.session import broadcast_if_small, table

QUERIES, ORACLE, query = registry()

#: The grid over the country's box.
GRID = Grid(BOX[0], BOX[3], 0.05, 70, 68)
#: Points that make a region likely for a species, points kept of a species by a capped fetch, metres of a buffer.
CLUSTER, CAP, BUFFER_M = 5, 900, 10_000.0
REGION_LEVELS = ("cordillera", "llanura", "valle", "península", "fila", "other")


# ---------------------------------------------------------------- layers as tables


def observed_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col, row, value): mean usable altitude of each cell's points; stands for an elevation model, which is not given."""
    p = table(spark, sf_dir, "points").where(cq._usable() & in_box(F.col("lon"), F.col("lat")))
    return p.groupBy(GRID.col(F.col("lon")).alias("col"), GRID.row(F.col("lat")).alias("row")).agg(F.avg("altitud").alias("value"))


def slope_class(slope: Column) -> Column:
    """carib where the slope says so, else pacifico, null included."""
    return F.when(F.contains(F.lower(slope), F.lit("carib")), "carib").otherwise("pacifico")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired regions: junk off their slopes, without rings of under four corners; their class and box."""
    r = table(spark, sf_dir, "region_polygons").where(F.size("ring") > 3).withColumn("vertiente", without_junk(F.col("vertiente")))
    corner = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    box = {"x_min": corner("x", F.array_min), "y_min": corner("y", F.array_min), "x_max": corner("x", F.array_max), "y_max": corner("y", F.array_max)}
    return r.withColumns({"vert_norm": slope_class(F.col("vertiente")), **box})


def region_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    return regions(spark, sf_dir).select(F.col("region_id").alias("place_id"), zero.alias("lon"), zero.alias("lat"), zero.alias("reach_m"), "ring")


def region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, col, row, lon, lat, value)."""
    return raster.cells_of_regions(region_places(spark, sf_dir), observed_raster(spark, sf_dir), GRID).withColumnRenamed("place_id", "region_id")


def tagged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean distinct points of every species with the raster's altitude and the region they lie in, null where in none."""
    clean = raster.sampled(cq.filter_coordinates(spark, sf_dir), observed_raster(spark, sf_dir), GRID)
    clean = clean.withColumns({"_x0": F.col("lon"), "_y0": F.col("lat")})
    placed = reach_join(clean, region_places(spark, sf_dir), ["species", "altitud", "_x0", "_y0"], how="left")
    named = regions(spark, sf_dir).select(F.col("region_id").alias("place_id"), "nombre", "vertiente")
    return placed.join(broadcast_if_small(named), "place_id", "left").select("species", F.col("_x0").alias("lon"), F.col("_y0").alias("lat"), "altitud", "nombre", "vertiente")


# ---------------------------------------------------------------- points

_RASTER = f"(SELECT CAST(floor((lon + 86) / 0.05) AS BIGINT) AS col, CAST(floor((11.3 - lat) / 0.05) AS BIGINT) AS row, avg(altitud) AS value FROM points WHERE {cq._ALT} AND lon BETWEEN -86 AND -82.5 AND lat BETWEEN 7.9 AND 11.3 GROUP BY ALL)"
_EDGES = "(SELECT region_id, r.ring[i].x AS x1, r.ring[i].y AS y1, r.ring[i + 1].x AS x2, r.ring[i + 1].y AS y2 FROM region_polygons r, unnest(range(1, len(r.ring))) AS t(i))"


def _inside(points: str, keys: str) -> str:
    return f"(SELECT {keys}, e.region_id FROM {points} p JOIN {_EDGES} e ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"


_REGIONS = """(SELECT region_id, nombre, regexp_replace(vertiente, '^NULL', '') AS vertiente, CASE WHEN contains(lower(vertiente), 'carib') THEN 'carib' ELSE 'pacifico' END AS vert_norm,
list_min(list_transform(ring, lambda p: p.x)) AS x_min, list_max(list_transform(ring, lambda p: p.x)) AS x_max, list_min(list_transform(ring, lambda p: p.y)) AS y_min, list_max(list_transform(ring, lambda p: p.y)) AS y_max FROM region_polygons WHERE len(ring) > 3)"""
_TAGGED = f"""(SELECT c.species, c.lon, c.lat, r.value AS altitud, g.nombre, g.vertiente FROM {cq._CLEAN} c LEFT JOIN {_RASTER} r ON r.col = floor((c.lon + 86) / 0.05) AND r.row = floor((11.3 - c.lat) / 0.05)
LEFT JOIN {_inside('(SELECT DISTINCT lon, lat FROM ' + cq._CLEAN + ')', 'p.lon, p.lat')} i ON i.lon = c.lon AND i.lat = c.lat LEFT JOIN {_REGIONS} g ON g.region_id = i.region_id)"""


@query(f"SELECT species, lon, lat, round(altitud, 6) AS altitud, nombre, vertiente FROM {_TAGGED}")
def comp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all species: cleaned, with altitude from the raster and the region by place; points in no region stay."""
    return tagged_points(spark, sf_dir).withColumn("altitud", F.round("altitud", 6))


@query(f"""SELECT species, n, round(100.0 * n_in / n, 4) AS pct_in, top FROM (SELECT species, sum(k) AS n, sum(CASE WHEN nombre IS NOT NULL THEN k ELSE 0 END) AS n_in, list(nombre ORDER BY k DESC, nombre) FILTER (nombre IS NOT NULL)[1:3] AS top
FROM (SELECT species, nombre, count(*) AS k FROM {_TAGGED} WHERE species IS NOT NULL GROUP BY ALL) GROUP BY species)""")
def agg_in_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each species' points inside any region, and its three commonest regions."""
    k = tagged_points(spark, sf_dir).where("species IS NOT NULL").groupBy("species", "nombre").agg(F.count(F.lit(1)).alias("k"))
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("nombre").isNotNull(), F.struct((-F.col("k")).alias("k"), "nombre")))), 1, 3), lambda x: x["nombre"])
    inside = F.sum(F.when(F.col("nombre").isNotNull(), F.col("k")).otherwise(0))
    out = k.groupBy("species").agg(F.sum("k").alias("n"), F.round(100.0 * inside / F.sum("k"), 4).alias("pct_in"), names.alias("top"))
    return out.withColumn("top", F.when(F.size("top") > 0, F.col("top")))


@query(f"SELECT f.species, count(p.species) AS n, '500–1500 m  ·  vert. Caribe' AS caption FROM (SELECT DISTINCT species FROM {answers._LIST}) f LEFT JOIN (SELECT * FROM {_TAGGED} WHERE altitud BETWEEN 500 AND 1500 AND contains({cq._NOACC.format('vertiente')}, 'cari')) p USING (species) GROUP BY f.species")
def comp_likely_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that support a list answer: those of its species that meet the question's own constraints, and the caption."""
    intent, found = answers.ask(spark, sf_dir, answers.LIST_QUESTION, answers.TOP_ANSWER)
    kept = filtered_points(tagged_points(spark, sf_dir), intent.elev_lo, intent.elev_hi, intent.vertiente, intent.region)
    n = kept.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    return found.select("species").distinct().join(n, "species", "left").select("species", F.coalesce("n", F.lit(0)).alias("n"), F.lit(caption(intent.elev_lo, intent.elev_hi, intent.vertiente, intent.region)).alias("caption"))


def filtered_points(points: DataFrame, lo: int | None = None, hi: int | None = None, vertiente: str | None = None, region: str | None = None) -> DataFrame:
    """Points within a band, on a slope, in a region whose name holds the wanted one or is held by it; nulls fail what is asked."""
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (F.col("altitud") >= lo)
    if hi is not None:
        keep = keep & (F.col("altitud") <= hi)
    if vertiente:
        keep = keep & F.contains(es.without_accents(F.lower("vertiente")), es.slope_key(F.lit(vertiente)))
    if region:
        own, wanted = es.without_accents(F.lower("nombre")), es.without_accents(F.lower(F.lit(region)))
        keep = keep & (F.contains(own, wanted) | F.contains(wanted, own))
    return points.where(keep)


def caption(lo: int | None, hi: int | None, vertiente: str | None, region: str | None) -> str:
    """What a map of points is restricted to."""
    band = f"{lo}–{hi} m" if lo is not None and hi is not None else f"≥{lo} m" if lo is not None else f"≤{hi} m" if hi is not None else None
    return "  ·  ".join(x for x in (band, vertiente and f"vert. {vertiente}", region) if x)


@query("SELECT species, point_id FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY point_id, loaded_at) AS rn FROM points WHERE species IS NOT NULL) WHERE rn <= 900")
def win_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 900 points of each species, the first by id: a capped fetch for all species at once."""
    p = table(spark, sf_dir, "points").where("species IS NOT NULL").select("species", "point_id", "loaded_at")
    return ordered.first_k_of(p, "species", ["point_id", "loaded_at"], CAP).select("species", "point_id")


# ---------------------------------------------------------------- cells

_CELLS = f"(SELECT c.col, c.row, -86 + (c.col + 0.5) * 0.05 AS lon, 11.3 - (c.row + 0.5) * 0.05 AS lat, CASE WHEN r.value >= -500 THEN r.value END AS value FROM (SELECT a.col, b.row FROM range(70) a(col), range(68) b(row)) c LEFT JOIN {_RASTER} r ON r.col = c.col AND r.row = c.row)"
_RCELLS = _inside(_CELLS, "p.col, p.row, p.lon, p.lat, p.value")


@query(f"SELECT region_id, count(*) AS n_cells, count(value) AS n_value, round(avg(value), 4) AS mean_value FROM {_RCELLS} GROUP BY region_id")
def agg_region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each region, and what the raster says of them."""
    return region_cells(spark, sf_dir).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count("value").alias("n_value"), F.round(F.avg("value"), 4).alias("mean_value"))


@query(f"SELECT g.vert_norm, count(DISTINCT c.col * 1000 + c.row) AS n_cells FROM {_RCELLS} c JOIN {_REGIONS} g USING (region_id) GROUP BY g.vert_norm")
def agg_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The land of each slope: the cells that any of its regions covers, each once."""
    cells = region_cells(spark, sf_dir).join(broadcast_if_small(regions(spark, sf_dir).select("region_id", "vert_norm")), "region_id")
    return cells.select("vert_norm", "col", "row").distinct().groupBy("vert_norm").agg(F.count(F.lit(1)).alias("n_cells"))


@query(f"""SELECT c.region_id, side, count(*) AS n_cells FROM {_RCELLS} c JOIN {_REGIONS} g USING (region_id), (VALUES ('N'), ('S'), ('E'), ('O')) s(side)
WHERE CASE side WHEN 'N' THEN lat >= (y_min + y_max) / 2 WHEN 'S' THEN lat <= (y_min + y_max) / 2 WHEN 'E' THEN lon >= (x_min + x_max) / 2 ELSE lon <= (x_min + x_max) / 2 END GROUP BY ALL""")
def filter_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region clipped to its four halves: how many cells are left."""
    box = ("x_min", "y_min", "x_max", "y_max")
    x = region_cells(spark, sf_dir).join(broadcast_if_small(regions(spark, sf_dir).select("region_id", *box)), "region_id")
    x = x.withColumn("side", F.explode(F.array(*[F.lit(s) for s in "NSEO"])))
    return x.where(raster.half_of(F.col("lon"), F.col("lat"), F.col("side"), *map(F.col, box))).groupBy("region_id", "side").agg(F.count(F.lit(1)).alias("n_cells"))


_NEAR = f"(SELECT l.locality_id, l.elev_min_m, l.elev_max_m, c.* FROM localities l JOIN {_CELLS} c ON abs(c.lat - l.lat) < 0.1 AND abs(c.lon - l.lon) < 0.1 WHERE 2 * 6371008.8 * asin(sqrt(sin(radians(l.lat - c.lat) / 2) ** 2 + cos(radians(c.lat)) * cos(radians(l.lat)) * sin(radians(l.lon - c.lon) / 2) ** 2)) <= 10000)"


@query(f"""SELECT n.locality_id, count(*) AS n_cells, count(i.region_id) AS n_land, coalesce(bool_or(n.value BETWEEN n.elev_min_m - 100 AND n.elev_max_m + 100), false) AS in_band FROM {_NEAR} n LEFT JOIN {_RCELLS} i ON i.col = n.col AND i.row = n.row GROUP BY n.locality_id""")
def join_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten kilometres around each locality as cells: how many, how many on land, and whether any is in the locality's band."""
    near = table(spark, sf_dir, "localities")
    places = near.select(F.col("locality_id").alias("place_id"), "lon", "lat", F.lit(BUFFER_M).alias("reach_m"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("ring"))
    cells = raster.cells_of_regions(places, observed_raster(spark, sf_dir), GRID).withColumnRenamed("place_id", "locality_id")
    land = region_cells(spark, sf_dir).select("col", "row").distinct().withColumn("land", F.lit(1))
    x = cells.join(broadcast_if_small(land), ["col", "row"], "left").join(broadcast_if_small(near.select("locality_id", "elev_min_m", "elev_max_m")), "locality_id")
    hit = F.col("value").between(F.col("elev_min_m") - 100, F.col("elev_max_m") + 100)
    return x.groupBy("locality_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count("land").alias("n_land"), F.coalesce(F.max(hit), F.lit(False)).alias("in_band"))


# ---------------------------------------------------------------- map layers of distributions


def matched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dist_id, region_id, nombre): regions that a distribution's entities stand for.

    Where the distribution names one slope only, regions of the other are left out, unless that leaves none.
    """
    key = lambda c: es.without_accents(F.lower(c))
    refs = table(spark, sf_dir, "entity_refs").where("canonical_name IS NOT NULL").select("dist_id", F.col("hierarchy_level").alias("level"), key("canonical_name").alias("name"))
    g = table(spark, sf_dir, "gazetteer").where("target_shapefile = 'regiones_botanicas'").select(F.col("hierarchy_level").alias("level"), key("canonical_name").alias("name"), key("target_value").alias("target"))
    r = regions(spark, sf_dir).select("region_id", "nombre", "vert_norm", key("nombre").alias("target"))
    hits = refs.join(broadcast_if_small(g.join(broadcast_if_small(r), "target").drop("target")), ["name", "level"]).select("dist_id", "region_id", "nombre", "vert_norm").distinct()
    d = table(spark, sf_dir, "distribution_fichas").select("dist_id", F.when(F.size("vertientes") == 1, slope_class(F.col("vertientes")[0])).alias("one"))
    x = hits.join(d, "dist_id", "left").withColumn("fits", F.col("one").isNull() | (F.col("one") == F.col("vert_norm")))
    some = x.groupBy("dist_id").agg(F.max("fits").alias("some"))
    return x.join(some, "dist_id").where(F.col("fits") | ~F.col("some")).select("dist_id", "region_id", "nombre")


def inferred_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dist_id, region_id, nombre): regions with at least CLUSTER points of the species by place, not matched by name."""
    seen = tagged_points(spark, sf_dir).where("species IS NOT NULL AND nombre IS NOT NULL").groupBy("species", "nombre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CLUSTER)
    d = table(spark, sf_dir, "distribution_fichas").select("dist_id", "species").join(seen.select("species", "nombre"), "species").drop("species")
    d = d.join(matched_regions(spark, sf_dir).select("dist_id", "nombre").distinct(), ["dist_id", "nombre"], "left_anti")
    return d.join(broadcast_if_small(regions(spark, sf_dir).select("nombre", "region_id")), "nombre").select("dist_id", "region_id", "nombre")


_MATCHED = f"""(SELECT dist_id, region_id, nombre FROM (SELECT *, max(CAST(fits AS INT)) OVER (PARTITION BY dist_id) AS n_fit FROM (SELECT DISTINCT e.dist_id, r.region_id, r.nombre, d.one IS NULL OR d.one = r.vert_norm AS fits
FROM entity_refs e JOIN gazetteer g ON {cq._NOACC.format('e.canonical_name')} = {cq._NOACC.format('g.canonical_name')} AND e.hierarchy_level = g.hierarchy_level AND g.target_shapefile = 'regiones_botanicas'
JOIN {_REGIONS} r ON {cq._NOACC.format('r.nombre')} = {cq._NOACC.format('g.target_value')}
LEFT JOIN (SELECT dist_id, CASE WHEN len(vertientes) = 1 THEN CASE WHEN contains(lower(vertientes[1]), 'carib') THEN 'carib' ELSE 'pacifico' END END AS one FROM distribution_fichas) d ON d.dist_id = e.dist_id)) WHERE fits OR n_fit = 0)"""
_SEEN = f"(SELECT species, nombre, count(*) AS n FROM {_TAGGED} WHERE species IS NOT NULL AND nombre IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)"
_INFERRED = f"(SELECT d.dist_id, r.region_id, r.nombre FROM distribution_fichas d JOIN {_SEEN} s USING (species) JOIN {_REGIONS} r USING (nombre) WHERE NOT EXISTS (SELECT 1 FROM {_MATCHED} m WHERE m.dist_id = d.dist_id AND m.nombre = s.nombre))"


@query(f"SELECT dist_id, region_id, 'matched' AS source FROM {_MATCHED} UNION ALL SELECT dist_id, region_id, 'inferred' FROM {_INFERRED}")
def join_region_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each distribution: named by its entities, or inferred from clusters of points."""
    a = matched_regions(spark, sf_dir).select("dist_id", "region_id", F.lit("matched").alias("source"))
    return a.unionByName(inferred_regions(spark, sf_dir).select("dist_id", "region_id", F.lit("inferred").alias("source")))


def clip_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dist_id, clip, region_id): the regions a map is clipped to, by the narrowest scope that has any.

    region, park, canton and district: the matched regions (areas without polygons of their own have none to give);
    vertiente: the regions of its slopes; otherwise, and where nothing matched, the country.
    """
    scope = cq.math_scope(spark, sf_dir).select("dist_id", "scope")
    matched = matched_regions(spark, sf_dir).select("dist_id", "region_id")
    have = matched.select("dist_id").distinct().withColumn("some", F.lit(True))
    d = table(spark, sf_dir, "distribution_fichas").select("dist_id", "vertientes").join(scope, "dist_id").join(have, "dist_id", "left")
    kind = F.when((F.col("scope") != "vertiente") & F.coalesce("some", F.lit(False)), "region").when((F.col("scope") == "vertiente") & (F.size("vertientes") > 0), "slope").otherwise("country")
    d = d.select("dist_id", "vertientes", kind.alias("clip"))
    r = regions(spark, sf_dir).select("region_id", "vert_norm")
    by_region = d.where("clip = 'region'").join(matched, "dist_id").select("dist_id", "clip", "region_id")
    slopes = d.where("clip = 'slope'").select("dist_id", "clip", F.explode(F.array_distinct(F.transform("vertientes", slope_class))).alias("vert_norm"))
    by_slope = slopes.join(broadcast_if_small(r), "vert_norm").select("dist_id", "clip", "region_id")
    every = [x[0] for x in r.select("region_id").collect()]  # the regions of one country
    whole = d.where("clip = 'country'").select("dist_id", "clip", F.explode(F.array(*[F.lit(x) for x in every])).alias("region_id")) if every else by_slope.where("false")
    return by_region.unionByName(by_slope).unionByName(whole)


_SCOPE = cq.ORACLE["math_scope"]
_CLIP = f"""(WITH sc AS ({_SCOPE}), k AS (SELECT d.dist_id, d.vertientes, CASE WHEN sc.scope <> 'vertiente' AND EXISTS (SELECT 1 FROM {_MATCHED} m WHERE m.dist_id = d.dist_id) THEN 'region' WHEN sc.scope = 'vertiente' AND len(d.vertientes) > 0 THEN 'slope' ELSE 'country' END AS clip FROM distribution_fichas d JOIN sc USING (dist_id))
SELECT k.dist_id, clip, m.region_id FROM k JOIN {_MATCHED} m ON m.dist_id = k.dist_id WHERE clip = 'region' UNION ALL
SELECT k.dist_id, clip, r.region_id FROM k JOIN {_REGIONS} r ON list_contains(list_transform(k.vertientes, lambda v: CASE WHEN contains(lower(v), 'carib') THEN 'carib' ELSE 'pacifico' END), r.vert_norm) WHERE clip = 'slope' UNION ALL
SELECT k.dist_id, clip, r.region_id FROM k, {_REGIONS} r WHERE clip = 'country')"""


@query(f"SELECT dist_id, clip, count(*) AS n_regions, (SELECT count(*) FROM {_REGIONS}) - count(*) AS n_context FROM {_CLIP} GROUP BY ALL")
def comp_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each map is clipped to: how many regions, and how many are left as context."""
    total = regions(spark, sf_dir).count()
    return clip_sets(spark, sf_dir).groupBy("dist_id", "clip").agg(F.count(F.lit(1)).alias("n_regions")).withColumn("n_context", F.lit(total) - F.col("n_regions"))


@query(f"""SELECT d.dist_id, count(*) AS n_cells, count(CASE WHEN c.value BETWEEN lo AND hi THEN 1 END) AS n_core, count(CASE WHEN c.value BETWEEN coalesce(olo, lo) AND coalesce(ohi, hi) AND NOT c.value BETWEEN lo AND hi THEN 1 END) AS n_outlier
FROM (SELECT dist_id, elevation.min_m AS lo, elevation.max_m AS hi, elevation.outlier_min_m AS olo, elevation.outlier_max_m AS ohi FROM distribution_fichas WHERE elevation.min_m IS NOT NULL AND elevation.max_m IS NOT NULL) d
JOIN (SELECT DISTINCT dist_id, region_id FROM (SELECT dist_id, region_id FROM {_CLIP} UNION ALL SELECT dist_id, region_id FROM {_INFERRED})) k USING (dist_id) JOIN {_RCELLS} c USING (region_id) GROUP BY d.dist_id""")
def comp_band_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation mask of each map: cells of its regions in the core band, and in the outlier band but not the core.

    The values of each region's cells are few beside the maps, so they go to the maps as one array for each region.
    """
    e = table(spark, sf_dir, "distribution_fichas").select("dist_id", F.col("elevation.min_m").alias("lo"), F.col("elevation.max_m").alias("hi"), F.coalesce("elevation.outlier_min_m", "elevation.min_m").alias("olo"), F.coalesce("elevation.outlier_max_m", "elevation.max_m").alias("ohi"))
    e = e.where("lo IS NOT NULL AND hi IS NOT NULL")
    mask = clip_sets(spark, sf_dir).select("dist_id", "region_id").unionByName(inferred_regions(spark, sf_dir).select("dist_id", "region_id")).distinct()
    cells = region_cells(spark, sf_dir).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("value").alias("v"))
    x = e.join(mask, "dist_id").join(broadcast_if_small(cells), "region_id")
    core = F.size(F.filter("v", lambda v: v.between(F.col("lo"), F.col("hi"))))
    outlier = F.size(F.filter("v", lambda v: v.between(F.col("olo"), F.col("ohi")) & ~v.between(F.col("lo"), F.col("hi"))))
    return x.groupBy("dist_id").agg(F.sum("n").alias("n_cells"), F.sum(core).alias("n_core"), F.sum(outlier).alias("n_outlier"))


@query(f"""SELECT r.region_id FROM {_REGIONS} r WHERE EXISTS (SELECT 1 FROM {_RCELLS} c WHERE c.region_id = r.region_id AND c.value BETWEEN 2000 AND 2500)""")
def join_semi_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with a cell in the band."""
    inside = region_cells(spark, sf_dir).where(F.col("value").between(2000, 2500)).select("region_id")
    return regions(spark, sf_dir).select("region_id").join(inside, "region_id", "left_semi")


@query(f"""SELECT floor((lon + 86) / 0.05) AS col, floor((11.3 - lat) / 0.05) AS row, count(*) AS n, count(r.value) AS with_value FROM (SELECT * FROM points WHERE lon BETWEEN -86 AND -82.5 AND lat BETWEEN 7.9 AND 11.3) p
LEFT JOIN {_RASTER} r ON r.col = floor((p.lon + 86) / 0.05) AND r.row = floor((11.3 - p.lat) / 0.05) GROUP BY floor((lon + 86) / 0.05), floor((11.3 - lat) / 0.05)""")
def join_grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points joined with the raster's table by cell: how many lie in each, and how many get a value."""
    p = table(spark, sf_dir, "points").where(in_box(F.col("lon"), F.col("lat"))).select("lon", "lat")
    x = raster.sampled(p, observed_raster(spark, sf_dir), GRID)
    return x.groupBy(GRID.col(F.col("lon")).alias("col"), GRID.row(F.col("lat")).alias("row")).agg(F.count(F.lit(1)).alias("n"), F.count("altitud").alias("with_value"))


def species_layers(spark: SparkSession, sf_dir: str, species: str) -> DataFrame:
    """(layer, feature, n) of one species' map: its regions with their cells in the band, inferred ones, and its points.

    The points of one species are read by a filter on the name, which reaches the scan.
    """
    one = table(spark, sf_dir, "distribution_fichas").where(F.col("species") == species).select("dist_id")
    names = broadcast_if_small(regions(spark, sf_dir).select("region_id", "nombre"))
    layers = join_region_layers(spark, sf_dir).join(one, "dist_id", "left_semi").join(names, "region_id").select(F.concat(F.lit("region_"), "source").alias("layer"), F.col("nombre").alias("feature"), F.lit(1).cast("long").alias("n"))
    band = comp_band_cells(spark, sf_dir).join(one, "dist_id", "left_semi")
    cells = band.select(F.explode(F.create_map(F.lit("core"), "n_core", F.lit("outlier"), "n_outlier")).alias("feature", "n")).groupBy(F.lit("elevation").alias("layer"), "feature").agg(F.sum("n").alias("n"))
    points = tagged_points(spark, sf_dir).where(F.col("species") == species).groupBy(F.lit("points").alias("layer"), F.coalesce("nombre", F.lit("–")).alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    return layers.distinct().unionByName(cells).unionByName(points)
