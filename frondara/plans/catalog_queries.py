"""The catalogue's own operators over the flora tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frondara.functions import spanish as es
from frondara.operators import bands, ordered
from frondara.plans.core_problems import in_box, put_right, without_junk
from frondara.plans.intent import Intent, condition, parse, superlative
from frondara.session import broadcast_if_small, table
from frondara.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# Pieces of SQL used more than once.
_LO, _HI = "coalesce(elev_outlier_min, elev_min)", "coalesce(elev_outlier_max, elev_max)"
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY extracted_at, ficha_id) AS rn_ FROM fichas) WHERE rn_ = 1)"
_CLEAN = """(SELECT DISTINCT species, CASE WHEN inb THEN lon ELSE lat END AS lon, CASE WHEN inb THEN lat ELSE lon END AS lat FROM (
SELECT *, (lon BETWEEN -86 AND -82.5 AND lat BETWEEN 7.9 AND 11.3) AS inb, (lat BETWEEN -86 AND -82.5 AND lon BETWEEN 7.9 AND 11.3) AS sw FROM points
WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT (abs(lon) < 0.01 AND abs(lat) < 0.01)
AND (coordinate_uncertainty_m IS NULL OR coordinate_uncertainty_m <= 10000)) WHERE inb OR sw)"""
_ALT = "altitud IS NOT NULL AND NOT isnan(altitud) AND altitud >= -500"
_NOACC = "translate(lower({}), 'áéíóúüñ', 'aeiouun')"


def _usable() -> Column:
    return F.col("altitud").isNotNull() & ~F.isnan("altitud") & (F.col("altitud") >= -500)


def first_fichas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first extraction of each species."""
    return ordered.best_of(table(spark, sf_dir, "fichas"), ["vector_id"], [F.col("extracted_at"), F.col("ficha_id")])


def effective_bounds() -> tuple[Column, Column]:
    return bands.effective(F.col("elev_min"), F.col("elev_outlier_min")), bands.effective(F.col("elev_max"), F.col("elev_outlier_max"))


# ---------------------------------------------------------------- predicates


@query("""SELECT ficha_id, coalesce(list_contains(habits, 'arbusto'), false) AS habit, coalesce(list_contains(vertientes, 'Caribe'), false) AS slope,
coalesce(list_contains(forest_types, 'húmedo'), false) AS forest, coalesce(list_contains(flowering_months, 5), false) AS month,
coalesce(family = 'Carilaceae', false) AS family_ok, coalesce(endemic_cr, false) AS endemic FROM fichas""")
def filter_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single membership predicates of each record."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    return table(spark, sf_dir, "fichas").select(
        "ficha_id", has("habits", "arbusto").alias("habit"), has("vertientes", "Caribe").alias("slope"), has("forest_types", "húmedo").alias("forest"),
        has("flowering_months", 5).alias("month"), F.coalesce(F.col("family") == "Carilaceae", F.lit(False)).alias("family_ok"), F.coalesce("endemic_cr", F.lit(False)).alias("endemic"),
    )


@query(f"""SELECT ficha_id, coalesce(least(1500, {_HI}) - greatest(1000, {_LO}) > 0, false) AND {_HI} IS NOT NULL AND {_LO} IS NOT NULL AS strict,
coalesce(elev_min <= 1500 AND elev_max >= 1000, false) AS core, coalesce({_LO} <= 1500 AND {_HI} >= 1000, false) AS effective,
elev_min IS NOT NULL AND elev_max IS NOT NULL AND least(1500, elev_max) - greatest(1000, elev_min) <= 0 AS occasional FROM fichas""")
def filter_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three overlap predicates for the window 1000-1500, and whether only the outliers reach it."""
    lo, hi = effective_bounds()
    a, b = F.lit(1000), F.lit(1500)
    core = F.col("elev_min").isNotNull() & F.col("elev_max").isNotNull()
    return table(spark, sf_dir, "fichas").select(
        "ficha_id", bands.strictly_overlaps(lo, hi, a, b).alias("strict"), F.coalesce(bands.touches(F.col("elev_min"), F.col("elev_max"), a, b), F.lit(False)).alias("core"),
        F.coalesce(bands.touches(lo, hi, a, b), F.lit(False)).alias("effective"), (core & ((F.least(b, "elev_max") - F.greatest(a, "elev_min")) <= 0)).alias("occasional"),
    )


@query(f"""SELECT ficha_id, species, family FROM fichas WHERE list_contains(habits, 'arbusto') AND list_contains(vertientes, 'Caribe')
AND {_LO} IS NOT NULL AND {_HI} IS NOT NULL AND least({_HI}, {_HI}) - greatest(1000, {_LO}) > 0""")
def filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constraints of an intent in one filter; the open upper side takes the record's bound."""
    return table(spark, sf_dir, "fichas").where(condition(Intent(habit="arbusto", vertiente="Caribe", elev_lo=1000))).select("ficha_id", "species", "family")


@query(f"SELECT species, lon, lat FROM {_CLEAN}")
def filter_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean distinct coordinates per species: no null, no (0,0), uncertainty up to 10 km, exchanged ones put right."""
    near_zero = (F.abs("lon") < 0.01) & (F.abs("lat") < 0.01)
    points = table(spark, sf_dir, "points").where(~near_zero & (F.col("coordinate_uncertainty_m").isNull() | (F.col("coordinate_uncertainty_m") <= 10_000)))
    return put_right(points).select("species", "lon", "lat").distinct()


@query(f"""SELECT point_id, altitud FROM points WHERE {_ALT} AND altitud BETWEEN 500 AND 1500 AND contains({_NOACC.format('vertiente')}, 'cari')
AND nombre IS NOT NULL AND (contains({_NOACC.format('nombre')}, 'cordillera') OR contains('cordillera', {_NOACC.format('nombre')}))""")
def filter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a band, on a slope, in a region whose name holds the wanted one or is held by it; null names never match."""
    name = es.without_accents(F.lower("nombre"))
    keep = _usable() & F.col("altitud").between(500, 1500) & F.contains(es.without_accents(F.lower("vertiente")), F.lit("cari"))
    return table(spark, sf_dir, "points").where(keep & (F.contains(name, F.lit("cordillera")) | F.contains(F.lit("cordillera"), name))).select("point_id", "altitud")


@query("""SELECT raw_id, species FROM raw_fichas WHERE distribution_paragraph IS NOT NULL AND NOT contains(species, ' sp. ')
AND regexp_matches(distribution_paragraph, '\\d+ m')""")
def filter_named_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named species with a distribution text that gives an elevation."""
    return table(spark, sf_dir, "raw_fichas").where(F.col("distribution_paragraph").isNotNull() & ~F.contains("species", F.lit(" sp. ")) & F.col("distribution_paragraph").rlike(r"\d+ m")).select("raw_id", "species")


@query("""SELECT item_id, first(name ORDER BY pos) AS species FROM (SELECT item_id, unnest(l) AS name, unnest(range(len(l))) AS pos
FROM (SELECT item_id, regexp_extract_all(q, '[A-Z][a-z]+ [a-z]{3,}') AS l FROM eval_items)) WHERE name IN (SELECT species FROM fichas) GROUP BY item_id""")
def filter_detected_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first binomial of a question that the catalogue holds."""
    asked = table(spark, sf_dir, "eval_items").select("item_id", F.posexplode(F.regexp_extract_all("q", F.lit("[A-Z][a-z]+ [a-z]{3,}"), F.lit(0))).alias("pos", "species"))
    return asked.join(table(spark, sf_dir, "fichas").select("species"), "species", "left_semi").groupBy("item_id").agg(F.min_by("species", "pos").alias("species"))


@query("""SELECT region_id, nombre, min(p.x) AS x_min, max(p.x) AS x_max, (min(p.y) + max(p.y)) / 2 AS y_mid FROM (SELECT region_id, nombre, unnest(ring) AS p FROM region_polygons) GROUP BY region_id, nombre""")
def filter_half_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each region and the latitude that parts its northern from its southern half."""
    r = table(spark, sf_dir, "region_polygons").select("region_id", "nombre", F.transform("ring", lambda p: p["x"]).alias("x"), F.transform("ring", lambda p: p["y"]).alias("y"))
    return r.select("region_id", "nombre", F.array_min("x").alias("x_min"), F.array_max("x").alias("x_max"), ((F.array_min("y") + F.array_max("y")) / 2).alias("y_mid"))


# ---------------------------------------------------------------- joins


def _similarity(vectors: DataFrame, question: list[float]) -> DataFrame:
    """Cosine with a query vector, in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in question])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("score", dot(F.col("embedding"), q) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(q, q)))


def _question(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else []


_COS = "list_sum(list_transform(list_zip(embedding, q.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(q.e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_HITS = f"(SELECT vec_id, {_COS} AS score FROM embeddings, (SELECT first(embedding ORDER BY vec_id) AS e FROM embeddings) q ORDER BY score DESC, vec_id LIMIT 25)"


@query(f"SELECT vec_id, round(score, 6) AS score FROM {_HITS} ORDER BY score DESC, vec_id LIMIT 10")
def top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest by cosine; the lower id on ties."""
    hits = _similarity(table(spark, sf_dir, "embeddings"), _question(spark, sf_dir))
    return hits.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 6).alias("score"))



@query("""SELECT r.ref_id, g.gaz_id, g.target_shapefile, g.target_attribute, g.target_value FROM entity_refs r JOIN gazetteer g
ON translate(lower(r.canonical_name), 'áéíóúüñ', 'aeiouun') = translate(lower(g.canonical_name), 'áéíóúüñ', 'aeiouun') AND r.hierarchy_level = g.hierarchy_level""")
def join_entity_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map feature of each named place, by normalized name and level."""
    key = es.without_accents(F.lower("canonical_name"))
    g = table(spark, sf_dir, "gazetteer").select("gaz_id", "hierarchy_level", "target_shapefile", "target_attribute", "target_value", key.alias("k"))
    r = table(spark, sf_dir, "entity_refs").select("ref_id", "hierarchy_level", key.alias("k"))
    return r.join(broadcast_if_small(g), ["k", "hierarchy_level"]).select("ref_id", "gaz_id", "target_shapefile", "target_attribute", "target_value")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gaz_id, hierarchy_level, alias): folded names and aliases of the gazetteer."""
    g = table(spark, sf_dir, "gazetteer")
    names = F.concat(F.array("canonical_name"), F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")))
    return g.select("gaz_id", "hierarchy_level", F.explode(F.array_distinct(F.transform(names, lambda a: es.without_accents(F.lower(F.trim(a)))))).alias("alias")).where("alias <> ''")


_ALIAS = "(SELECT DISTINCT gaz_id, hierarchy_level, translate(lower(trim(a)), 'áéíóúüñ', 'aeiouun') AS alias FROM (SELECT gaz_id, hierarchy_level, unnest(list_concat([canonical_name], coalesce(string_split(aliases, '|'), []))) AS a FROM gazetteer) WHERE trim(a) <> '')"


@query(f"SELECT gaz_id, hierarchy_level, alias FROM {_ALIAS}")
def join_alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias index of the gazetteer."""
    return aliases(spark, sf_dir)


@query(f"SELECT DISTINCT d.raw_id, a.gaz_id FROM (SELECT raw_id, translate(lower(distribution_paragraph), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunaeiouun') AS t FROM raw_fichas) d JOIN {_ALIAS} a ON contains(d.t, a.alias)")
def join_alias_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose name or alias stands anywhere in a text, without word boundaries."""
    from frondara.operators.phrases import phrase_matches

    texts = table(spark, sf_dir, "raw_fichas").select("raw_id", es.without_accents(F.lower("distribution_paragraph")).alias("text"))
    return phrase_matches(texts, aliases(spark, sf_dir), "raw_id", "text", longest=False).select("raw_id", "gaz_id").distinct()


# Aliases in the order in which they claim their places of a text, walked down one by one with what is taken so far.
_LONGEST = f"""(WITH RECURSIVE d AS (SELECT raw_id, {_NOACC.format('distribution_paragraph')} AS t FROM raw_fichas WHERE distribution_paragraph IS NOT NULL),
h AS (SELECT DISTINCT d.raw_id, a.hierarchy_level AS lv, a.alias, p.pos - 1 AS s, p.pos - 1 + length(a.alias) AS e FROM d JOIN {_ALIAS} a ON contains(d.t, a.alias), unnest(range(1, length(d.t) + 1)) AS p(pos) WHERE substr(d.t, p.pos, length(a.alias)) = a.alias),
r AS (SELECT *, row_number() OVER (PARTITION BY raw_id, lv ORDER BY length(alias) DESC, alias, s) AS n FROM h),
w AS (SELECT raw_id, lv, 0::BIGINT AS n, []::STRUCT(s BIGINT, e BIGINT)[] AS taken, '' AS alias, 0::BIGINT AS s, false AS kept FROM (SELECT DISTINCT raw_id, lv FROM h) UNION ALL
SELECT r.raw_id, r.lv, r.n, CASE WHEN len(list_filter(w.taken, lambda k: r.s < k.e AND k.s < r.e)) = 0 THEN list_append(w.taken, struct_pack(s := r.s, e := r.e)) ELSE w.taken END, r.alias, r.s,
len(list_filter(w.taken, lambda k: r.s < k.e AND k.s < r.e)) = 0 FROM w JOIN r ON r.raw_id = w.raw_id AND r.lv = w.lv AND r.n = w.n + 1)
SELECT w.raw_id, a.gaz_id, a.hierarchy_level, a.alias, CAST(w.s AS INT) AS start FROM w JOIN {_ALIAS} a ON a.alias = w.alias AND a.hierarchy_level = w.lv WHERE w.kept)"""


@query(f"SELECT raw_id, gaz_id, hierarchy_level, alias, start FROM {_LONGEST}")
def join_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level the longest aliases first, each consuming its place of the text; every entry of an alias is named."""
    from frondara.operators.phrases import phrase_matches

    texts = table(spark, sf_dir, "raw_fichas").select("raw_id", es.without_accents(F.lower("distribution_paragraph")).alias("text"))
    return phrase_matches(texts, aliases(spark, sf_dir), "raw_id", "text", longest=True)





_SPAN = "translate(lower(source_span), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunaeiouun')"



@query("SELECT f.ficha_id, coalesce(c.n, 0) AS n_points FROM fichas f LEFT JOIN (SELECT species, count(*) AS n FROM points WHERE species IS NOT NULL GROUP BY species) c USING (species)")
def join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each record's species, 0 where there are none; counted before the join."""
    counts = table(spark, sf_dir, "points").where(F.col("species").isNotNull()).groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "fichas").select("ficha_id", "species").join(counts, "species", "left").select("ficha_id", F.coalesce("n", F.lit(0)).alias("n_points"))


@query("""SELECT f.species, p.nombre, p.n FROM (SELECT species, nombre, count(*) AS n FROM points WHERE species IS NOT NULL AND nombre IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) p
JOIN (SELECT DISTINCT species FROM fichas) f USING (species) WHERE NOT EXISTS (SELECT 1 FROM (SELECT species, unnest(regions) AS r FROM fichas) g WHERE g.species = p.species AND g.r = p.nombre)""")
def join_new_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with at least five points of a catalogued species that its records don't name."""
    seen = table(spark, sf_dir, "points").where("species IS NOT NULL AND nombre IS NOT NULL").groupBy("species", "nombre").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    fichas = table(spark, sf_dir, "fichas")
    named = fichas.select("species", F.explode("regions").alias("nombre"))
    return seen.join(fichas.select("species"), "species", "left_semi").join(named, ["species", "nombre"], "left_anti").select("species", "nombre", "n")



@query("SELECT f.ficha_id, coalesce(g.fam, 'sin familia') AS family FROM fichas f LEFT JOIN (SELECT genus, min(family) AS fam FROM raw_fichas WHERE family IS NOT NULL GROUP BY genus) g USING (genus)")
def join_genus_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of each record's genus, with a fallback."""
    families = table(spark, sf_dir, "raw_fichas").where(F.col("family").isNotNull()).groupBy("genus").agg(F.min("family").alias("fam"))
    return table(spark, sf_dir, "fichas").select("ficha_id", "genus").join(families, "genus", "left").select("ficha_id", F.coalesce("fam", F.lit("sin familia")).alias("family"))


# ---------------------------------------------------------------- aggregates


@query("SELECT species, count(*) AS n, count(*) < 5 AS few FROM points WHERE species IS NOT NULL GROUP BY species")
def agg_species_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per species, with a flag for fewer than five."""
    return table(spark, sf_dir, "points").where(F.col("species").isNotNull()).groupBy("species").agg(F.count(F.lit(1)).alias("n")).withColumn("few", F.col("n") < 5)


@query("SELECT volume, count(*) AS n, count(elev_min) AS with_elevation, sum(CAST(coalesce(len(regions), 0) > 0 AS INT)) AS with_regions, sum(CAST(coalesce(endemic_cr, false) AS INT)) AS endemic FROM fichas GROUP BY volume")
def agg_volume_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per volume and what they hold."""
    return table(spark, sf_dir, "fichas").groupBy("volume").agg(
        F.count(F.lit(1)).alias("n"), F.count("elev_min").alias("with_elevation"), F.sum((F.size(F.coalesce("regions", F.array())) > 0).cast("int")).alias("with_regions"),
        F.sum(F.coalesce("endemic_cr", F.lit(False)).cast("int")).alias("endemic"),
    )


@query("SELECT nombre, count(*) AS n FROM points WHERE nombre IS NOT NULL GROUP BY nombre HAVING count(*) >= 5 ORDER BY n DESC, nombre LIMIT 3")
def agg_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three regions with most points, of those with at least five."""
    return table(spark, sf_dir, "points").where("nombre IS NOT NULL").groupBy("nombre").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "nombre").limit(3)


@query(f"SELECT nombre, min(altitud) AS alt_min, max(altitud) AS alt_max, round(avg(altitud), 1) AS alt_mean, round(100.0 * count(vertiente) / count(*), 4) AS pct_slope FROM points WHERE {_ALT} GROUP BY nombre")
def agg_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and mean altitude of each region, and the share of points with a slope."""
    return table(spark, sf_dir, "points").where(_usable()).groupBy("nombre").agg(
        F.min("altitud").alias("alt_min"), F.max("altitud").alias("alt_max"), F.round(F.avg("altitud"), 1).alias("alt_mean"), F.round(100.0 * F.count("vertiente") / F.count(F.lit(1)), 4).alias("pct_slope")
    )


_VALID = f"""(SELECT f.species, any_value(f.family) AS family, any_value(f.elev_min) AS elev_min, any_value(f.elev_max) AS elev_max, any_value(f.xlo) AS xlo, any_value(f.xhi) AS xhi, any_value(f.endemic_cr) AS endemic, count(*) AS n,
avg(CAST(p.altitud BETWEEN f.elev_min AND f.elev_max AS DOUBLE)) AS in_core, avg(CAST(p.altitud BETWEEN f.xlo AND f.xhi AS DOUBLE)) AS in_ext,
avg(CAST(p.altitud < f.xlo AS DOUBLE)) AS below, avg(CAST(p.altitud > f.xhi AS DOUBLE)) AS above,
avg(CASE WHEN p.vertiente IS NOT NULL AND len(f.vertientes) > 0 THEN CAST(list_contains(list_transform(f.vertientes, lambda v: substr(translate(lower(v), 'áéíóúüñ', 'aeiouun'), 1, 4)), substr(translate(lower(regexp_replace(p.vertiente, '^NULL', '')), 'áéíóúüñ', 'aeiouun'), 1, 4)) AS DOUBLE) END) AS vmatch,
quantile_cont(p.altitud, 0.5) AS median, quantile_cont(p.altitud, 0.05) AS q05, quantile_cont(p.altitud, 0.95) AS q95
FROM (SELECT *, {_LO} AS xlo, {_HI} AS xhi FROM {_FIRST} WHERE elev_min IS NOT NULL AND elev_max IS NOT NULL) f JOIN (SELECT * FROM points WHERE {_ALT}) p USING (species) GROUP BY f.species)"""


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue against points, one row a species: shares, slope agreement, quantiles.

    Points are counted by (species, altitude, slope) before they meet the catalogue, so that no task holds a hot species'
    rows; everything after works on weighted distinct altitudes, whose number the measuring step bounds. The quantiles
    are exact.
    """
    lo, hi = effective_bounds()
    f = first_fichas(spark, sf_dir).where("elev_min IS NOT NULL AND elev_max IS NOT NULL")
    f = f.select("species", "family", "elev_min", "elev_max", lo.alias("xlo"), hi.alias("xhi"), F.transform("vertientes", es.slope_key).alias("slopes"), "endemic_cr")
    p = table(spark, sf_dir, "points").where(_usable()).select("species", "altitud", es.slope_key(without_junk(F.col("vertiente"))).alias("slope"))
    x = p.groupBy("species", "altitud", "slope").agg(F.count(F.lit(1)).alias("k")).join(f, "species")
    alt, k = F.col("altitud"), F.col("k")
    share = lambda c: F.sum(F.when(c, k).otherwise(0)) / F.sum(F.when(c.isNotNull(), k))
    same = F.when(F.col("slope").isNotNull() & (F.size("slopes") > 0), F.array_contains("slopes", F.col("slope")))
    q = F.percentile(alt, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), k)
    out = x.groupBy("species").agg(
        F.first("family").alias("family"), F.first("elev_min").alias("elev_min"), F.first("elev_max").alias("elev_max"), F.first("xlo").alias("xlo"), F.first("xhi").alias("xhi"), F.first("endemic_cr").alias("endemic"),
        F.sum(k).alias("n"), share(alt.between(F.col("elev_min"), F.col("elev_max"))).alias("in_core"), share(alt.between(F.col("xlo"), F.col("xhi"))).alias("in_ext"),
        share(alt < F.col("xlo")).alias("below"), share(alt > F.col("xhi")).alias("above"), share(same).alias("vmatch"), q.alias("q"),
    )
    out = out.withColumns({"q05": F.col("q")[0], "median": F.col("q")[1], "q95": F.col("q")[2]}).drop("q")
    return out.withColumns({"median_in": F.col("median").between(F.col("xlo"), F.col("xhi")), "core_overlap": F.greatest("q05", "xlo") <= F.least("q95", "xhi")})


_VCOLS = ("in_core", "in_ext", "below", "above", "vmatch", "median", "q05", "q95")


@query("SELECT species, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _VCOLS) + f", median BETWEEN xlo AND xhi AS median_in, greatest(q05, xlo) <= least(q95, xhi) AS core_overlap FROM {_VALID}")
def agg_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of every catalogued species with its points."""
    return validation(spark, sf_dir).select("species", "n", *[F.round(c, 6).alias(c) for c in _VCOLS], "median_in", "core_overlap")


@query(f"SELECT count(*) AS n_species, round(avg(CAST(median BETWEEN xlo AND xhi AS DOUBLE)), 6) AS median_in, round(avg(CAST(greatest(q05, xlo) <= least(q95, xhi) AS DOUBLE)), 6) AS core_overlap, round(avg(in_core), 6) AS in_core, round(avg(vmatch), 6) AS vmatch FROM {_VALID} WHERE n >= 10")
def agg_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort of species with at least ten points."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return validation(spark, sf_dir).where("n >= 10").agg(F.count(F.lit(1)).alias("n_species"), *[share(c) for c in ("median_in", "core_overlap", "in_core", "vmatch")])


_IOU = "CASE WHEN greatest(elev_max, q95) - least(elev_min, q05) <= 0 THEN CASE WHEN elev_min = q05 AND elev_max = q95 THEN 1.0 ELSE 0.0 END ELSE greatest(0, least(elev_max, q95) - greatest(elev_min, q05)) / (greatest(elev_max, q95) - least(elev_min, q05)) END"


@query(f"""SELECT endemic, count(*) AS n, round(avg(iou), 6) AS iou_mean, round(median(iou), 6) AS iou_median, round(min(iou), 6) AS iou_min, round(max(iou), 6) AS iou_max
FROM (SELECT coalesce(endemic, false) AS endemic, {_IOU} AS iou FROM {_VALID} WHERE n >= 10) GROUP BY GROUPING SETS ((endemic), ())""")
def agg_iou_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the core bands over all species, the endemic and the others, in one pass of grouping sets."""
    v = validation(spark, sf_dir).where("n >= 10").select(F.coalesce("endemic", F.lit(False)).alias("endemic"), bands.iou(F.col("elev_min"), F.col("elev_max"), F.col("q05"), F.col("q95")).alias("iou"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return v.groupingSets([[F.col("endemic")], []], F.col("endemic")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("iou"), "iou_mean"), r(F.median("iou"), "iou_median"), r(F.min("iou"), "iou_min"), r(F.max("iou"), "iou_max")).select("endemic", "n", "iou_mean", "iou_median", "iou_min", "iou_max")


@query("""SELECT slice, count(*) AS n, min(width) AS width_min, max(width) AS width_max, round(avg(CAST(lower(trim(median_in)) = 'true' AS DOUBLE)), 6) AS median_in, round(avg(CAST(lower(trim(core_overlap)) = 'true' AS DOUBLE)), 6) AS core_overlap, round(median(iou), 6) AS iou_median
FROM (SELECT *, CAST(floor((4 * (row_number() OVER (ORDER BY width, species) - 1) + 3) / count(*) OVER ()) AS INT) + 1 AS slice FROM range_width) GROUP BY slice""")
def agg_width_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters by position in the order of width, and their statistics."""
    placed = ordered.slices(table(spark, sf_dir, "range_width"), ["width", "species"], 4)
    return placed.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("width").alias("width_min"), F.max("width").alias("width_max"),
        *[F.round(F.avg((F.lower(F.trim(c)) == "true").cast("double")), 6).alias(c) for c in ("median_in", "core_overlap")], F.round(F.median("iou"), 6).alias("iou_median"),
    )


@query("SELECT kind, value FROM (SELECT 'forest_type' AS kind, unnest(forest_types) AS value FROM fichas UNION SELECT 'region', unnest(regions) FROM fichas UNION SELECT 'family', family FROM fichas UNION SELECT 'habit', unnest(habits) FROM fichas) WHERE value IS NOT NULL")
def agg_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of the catalogue's controlled fields."""
    f = table(spark, sf_dir, "fichas")
    arrays = [f.select(F.lit(k).alias("kind"), F.explode(c).alias("value")) for k, c in (("forest_type", "forest_types"), ("region", "regions"), ("habit", "habits"))]
    out = f.select(F.lit("family").alias("kind"), F.col("family").alias("value"))
    for a in arrays:
        out = out.unionByName(a)
    return out.where(F.col("value").isNotNull()).distinct()


# ---------------------------------------------------------------- order, windows, sets


@query("SELECT ficha_id, position FROM (SELECT *, row_number() OVER (ORDER BY family, species, ficha_id) - 1 AS position, greatest(1, count(*) OVER () // 50) AS step FROM fichas) WHERE position % step = 0 AND position < step * 50")
def win_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty records at equal steps of the order by family and species."""
    f = table(spark, sf_dir, "fichas").select("ficha_id", "family", "species")
    order = [F.col("family").asc_nulls_last(), F.col("species").asc_nulls_last(), F.col("ficha_id")]
    return ordered.systematic_sample(f, order, 50).select("ficha_id", "position")


@query(f"SELECT vector_id, ficha_id FROM {_FIRST}")
def win_first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first extraction of each key."""
    return first_fichas(spark, sf_dir).select("vector_id", "ficha_id")


@query("SELECT species, raw_id FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY (distribution_paragraph IS NOT NULL) DESC, n_blocks DESC NULLS LAST, raw_id) AS rn FROM raw_fichas) WHERE rn = 1")
def win_best_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest entry of each species: with a distribution, most blocks, first."""
    order = [F.col("distribution_paragraph").isNotNull().desc(), F.col("n_blocks").desc_nulls_last(), F.col("raw_id")]
    return ordered.best_of(table(spark, sf_dir, "raw_fichas").select("species", "raw_id", "distribution_paragraph", "n_blocks"), ["species"], order).select("species", "raw_id")



#: A clause: no comma or semicolon but inside brackets; and what may stand before a slope's marker.
_CLAUSE, _SIDED = "(?:[^;,(]|\\([^)]*\\)|\\()+", "^(?:(?:[NSEO]{1,2}|centro|central)\\.?\\s+)?"


@query(f"""SELECT raw_id, pos, clause, last_value(mark IGNORE NULLS) OVER (PARTITION BY raw_id ORDER BY pos) AS slope FROM (SELECT raw_id, pos, clause,
CASE WHEN regexp_matches(clause, '(?i)^ambas\\s+verts?') THEN 'ambas' WHEN regexp_matches(clause, '(?i){_SIDED}vert(iente)?\\.?\\s+carib') THEN 'Caribe' WHEN regexp_matches(clause, '(?i){_SIDED}vert(iente)?\\.?\\s+pac') THEN 'Pacífico' END AS mark
FROM (SELECT raw_id, unnest(range(len(l))) AS pos, trim(unnest(l), e' \\t\\n\\r') AS clause FROM (SELECT raw_id, regexp_extract_all(distribution_paragraph, '{_CLAUSE}') AS l FROM raw_fichas WHERE distribution_paragraph IS NOT NULL)))""")
def win_slope_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope that holds for each clause: a marker, with or without a side, holds to the next one; brackets aren't cut."""
    parts = F.regexp_extract_all("distribution_paragraph", F.lit(_CLAUSE), F.lit(0))
    clauses = table(spark, sf_dir, "raw_fichas").where(F.col("distribution_paragraph").isNotNull()).select("raw_id", F.posexplode(parts).alias("pos", "clause"))
    clauses = clauses.withColumn("clause", F.regexp_replace("clause", r"^[ \t\n\r]+|[ \t\n\r]+$", ""))
    told = lambda p: F.col("clause").rlike("(?i)" + p)
    slope = lambda name: told(_SIDED + rf"vert(iente)?\.?\s+{name}")
    mark = F.when(told(r"^ambas\s+verts?"), "ambas").when(slope("carib"), "Caribe").when(slope("pac"), "Pacífico")
    return ordered.carried(clauses, "raw_id", "pos", mark, "slope").select("raw_id", "pos", "clause", "slope")


def _superlative_sql(value: str, desc: str) -> str:
    return f"SELECT ficha_id, species, family, CAST({value} AS BIGINT) AS value, (SELECT count(*) FROM fichas) AS n_candidates FROM fichas WHERE {value} IS NOT NULL ORDER BY {value} {desc}, ficha_id LIMIT 1"


@query(_superlative_sql("elev_max", "DESC"))
def top_superlative_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that reaches highest."""
    return superlative(table(spark, sf_dir, "fichas"), "elev_max", "max")


@query(_superlative_sql("elev_min", "ASC"))
def top_superlative_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that begins lowest."""
    return superlative(table(spark, sf_dir, "fichas"), "elev_min", "min")


@query(_superlative_sql("coalesce(len(regions), 0)", "DESC"))
def top_superlative_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of most regions."""
    return superlative(table(spark, sf_dir, "fichas"), "n_regions", "max")


@query(f"SELECT species, round(median, 6) AS median FROM {_VALID} WHERE n >= 10 AND NOT (median BETWEEN xlo AND xhi)")
def top_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species whose median is outside their range, by median."""
    return validation(spark, sf_dir).where("n >= 10 AND NOT median_in").select("species", F.round("median", 6).alias("median")).orderBy("median", "species")


@query("""WITH g AS (SELECT ficha_id FROM fichas WHERE list_contains(vertientes, 'Caribe') AND coalesce(endemic_cr, false)), p AS (SELECT ficha_id FROM fichas WHERE list_contains(vertientes, 'Caribe'))
SELECT count(g.ficha_id) AS n_gold, count(p.ficha_id) AS n_pred, count(CASE WHEN g.ficha_id IS NOT NULL AND p.ficha_id IS NOT NULL THEN 1 END) AS n_hit,
round(count(CASE WHEN g.ficha_id IS NOT NULL AND p.ficha_id IS NOT NULL THEN 1 END) / count(p.ficha_id), 6) AS prec, round(count(CASE WHEN g.ficha_id IS NOT NULL AND p.ficha_id IS NOT NULL THEN 1 END) / count(g.ficha_id), 6) AS rec, round(2.0 * count(CASE WHEN g.ficha_id IS NOT NULL AND p.ficha_id IS NOT NULL THEN 1 END) / (count(p.ficha_id) + count(g.ficha_id)), 6) AS f1 FROM g FULL JOIN p ON g.ficha_id = p.ficha_id""")
def set_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicted set against a gold set, by full outer join."""
    f = table(spark, sf_dir, "fichas")
    gold = f.where(condition(Intent(vertiente="Caribe", endemic=True))).select("ficha_id", F.lit(1).alias("g"))
    pred = f.where(condition(Intent(vertiente="Caribe"))).select("ficha_id", F.lit(1).alias("p"))
    x = gold.join(pred, "ficha_id", "full_outer").agg(F.count("g").alias("n_gold"), F.count("p").alias("n_pred"), F.count(F.col("g") + F.col("p")).alias("n_hit"))
    p, r, f1 = bands.precision_recall(F.col("n_hit"), F.col("n_pred"), F.col("n_gold"))
    return x.select("n_gold", "n_pred", "n_hit", F.round(p, 6).alias("prec"), F.round(r, 6).alias("rec"), F.round(f1, 6).alias("f1"))


_UNION = "list_concat(coalesce(d.vertientes, []), coalesce(f.v, []))"


@query(f"""SELECT d.dist_id, list_filter({_UNION}, lambda x, i: list_position({_UNION}, x) = i) AS slopes FROM distribution_fichas d
LEFT JOIN (SELECT species, arg_min(vertientes, ficha_id) AS v FROM fichas WHERE vertientes IS NOT NULL GROUP BY species) f USING (species)""")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of a distribution and of its species' record, each once, in the order of first mention."""
    none = F.array().cast("array<string>")
    f = table(spark, sf_dir, "fichas").where("vertientes IS NOT NULL").groupBy("species").agg(F.min_by("vertientes", "ficha_id").alias("v"))
    d = table(spark, sf_dir, "distribution_fichas").select("dist_id", "species", "vertientes").join(f, "species", "left")
    return d.select("dist_id", F.array_distinct(F.concat(F.coalesce("vertientes", none), F.coalesce("v", none))).alias("slopes"))


# ---------------------------------------------------------------- text


_T = "distribution_paragraph"
_COMPACT = "regexp_replace(regexp_replace(translate({}, '—‒-+', '–––'), '–{{2,}}', '–', 'g'), '\\s*([–()])\\s*', '\\1', 'g')"
_BAND = "(\\((\\d{1,4})–\\))?(\\d{1,4})–(\\d{1,4})–?(\\(–?(\\d{1,4})\\))?\\s*m\\b"


def _g(k: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({_COMPACT.format(_T)}, '{_BAND}', {(2, 3, 4, 6)[k - 1]}), '') AS INT)"


@query(f"""SELECT raw_id, CASE WHEN {_g(2)} IS NOT NULL THEN {_g(2)} ELSE ca END AS lo, CASE WHEN {_g(2)} IS NOT NULL THEN {_g(3)} ELSE ca END AS hi, {_g(1)} AS outlier_lo, {_g(4)} AS outlier_hi
FROM (SELECT *, TRY_CAST(nullif(regexp_extract({_T}, '(?i)ca\\.?\\s*(\\d{{1,4}})\\s*m\\b', 1), '') AS INT) AS ca FROM raw_fichas)""")
def text_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation band of each distribution text."""
    return table(spark, sf_dir, "raw_fichas").select("raw_id", es.elevation(F.col(_T)).alias("e")).select("raw_id", "e.*")


def _rx(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("SELECT dist_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches({'clause' if k == 'muy húmedo' else 'rest'}, '(?i){_rx(p)}') THEN '{k}' END" for k, p in es.FORESTS.items()) + "], lambda x: x IS NOT NULL) AS forests FROM (SELECT *, regexp_replace(clause, '(?i)muy\\s+h[úu]medo', ' ', 'g') AS rest FROM (SELECT *, CASE WHEN regexp_matches(habitat_raw, '(?i)bosque([^\\p{L}\\p{N}]|$)') THEN regexp_extract(habitat_raw, '(?i)bosque([^\\p{L}\\p{N}][^\\d]*|$)', 1) ELSE split_part(habitat_raw, ';', 1) END AS clause FROM distribution_fichas))")
def text_forest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest types of each habitat text."""
    return table(spark, sf_dir, "distribution_fichas").select("dist_id", es.forest_types(F.col("habitat_raw")).alias("forests"))


@query(f"SELECT raw_id, list_filter([CASE WHEN b OR regexp_matches({_T}, '(?i)vert(iente)?\\.?\\s*carib') THEN 'Caribe' END, CASE WHEN b OR regexp_matches({_T}, '(?i)vert(iente)?\\.?\\s*pac') THEN 'Pacífico' END], lambda x: x IS NOT NULL) AS slopes, regexp_matches({_T}, '(?i)end[ée]mic') AS endemic FROM (SELECT *, regexp_matches({_T}, '(?i)ambas\\s*vert') AS b FROM raw_fichas)")
def text_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes and endemism told by each distribution text."""
    return table(spark, sf_dir, "raw_fichas").select("raw_id", es.slopes(F.col(_T)).alias("slopes"), es.is_endemic(F.col(_T)).alias("endemic"))


_HAB = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(substr({c}, 1, 160), '(?i){_rx(p)}') THEN '{k}' END" for k, p in es.HABITS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT raw_id, CASE WHEN family = 'Arecaceae' AND NOT list_contains(h, 'palma') THEN list_concat(['palma'], h) ELSE h END AS habits FROM (
SELECT raw_id, family, CASE WHEN len({_HAB("coalesce(morphology, '')")}) > 0 THEN {_HAB("coalesce(morphology, '')")} ELSE {_HAB("coalesce(genus_description, '')")} END AS h FROM raw_fichas)""")
def text_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth forms told by the description, else by the genus' description; a family's own form always."""
    return table(spark, sf_dir, "raw_fichas").select("raw_id", es.entry_habits(F.col("morphology"), F.col("genus_description"), F.col("family")).alias("habits"))


_LABEL = """CASE WHEN lo IS NULL OR hi IS NULL THEN 'elevación no disponible' ELSE lo || '–' || hi || ' m' || CASE WHEN olo IS NULL AND ohi IS NULL THEN '' ELSE '  (atípicos — ' ||
concat_ws(', ', CASE WHEN olo IS NOT NULL THEN 'inf: ' || olo || '–' || lo || ' m' END, CASE WHEN ohi IS NOT NULL THEN 'sup: ' || hi || '–' || ohi || ' m' END) || ')' END END"""


@query(f"SELECT dist_id, {_LABEL} AS label FROM (SELECT dist_id, CAST(elevation.min_m AS INT) AS lo, CAST(elevation.max_m AS INT) AS hi, CAST(elevation.outlier_min_m AS INT) AS olo, CAST(elevation.outlier_max_m AS INT) AS ohi FROM distribution_fichas)")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation of each distribution in words."""
    e = [F.col(f"elevation.{c}") for c in ("min_m", "max_m", "outlier_min_m", "outlier_max_m")]
    return table(spark, sf_dir, "distribution_fichas").select("dist_id", es.elevation_label(*e).alias("label"))


@query(f"SELECT raw_id, trim(regexp_extract({_T}, '(?s)^(.*?m)\\s*;', 1)) AS habitat, trim(regexp_replace(regexp_replace({_T}, '(?s)^.*?m\\s*;', ''), '(?s)(\\bFls?\\.\\s|\\bFr\\.\\s).*$', '')) AS geo FROM raw_fichas")
def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Habitat and places of each distribution text."""
    return table(spark, sf_dir, "raw_fichas").select("raw_id", es.habitat_part(F.col(_T)).alias("habitat"), es.geographic_part(F.col(_T)).alias("geo"))


def _months_sql(marker: str) -> str:
    part = f"regexp_extract({_T}, '{marker}\\.?\\s*([a-z][a-z.,–\\-\\s]*)', 1)"
    names = "|".join(es.MONTHS)
    number = "(CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in es.MONTHS.items()) + " END)"
    one = f"list_transform(regexp_extract_all({part}, '\\b({names})\\b', 1), lambda m: {number.format('m')})"
    a, b = number.format("substr(r, 1, 3)"), number.format("right(r, 3)")
    span = f"list_transform(regexp_extract_all({part}, '\\b(?:{names})\\.?\\s*[–-]\\s*(?:{names})\\b'), lambda r: list_filter(range(1, 13), lambda k: CASE WHEN {a} <= {b} THEN k BETWEEN {a} AND {b} ELSE k >= {a} OR k <= {b} END))"
    return f"coalesce(list_sort(list_distinct(list_concat({one}, flatten({span})))), [])"


@query(f"SELECT raw_id, {_months_sql('Fl')} AS flowering, {_months_sql('Fr')} AS fruiting FROM raw_fichas")
def text_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flowering and fruiting months of each distribution text."""
    return table(spark, sf_dir, "raw_fichas").select("raw_id", es.months(F.col(_T)).alias("flowering"), es.months(F.col(_T), "Fr").alias("fruiting"))


@query("SELECT ref_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(source_span), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunaeiouun'), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'), '([a-z])- ([a-z])', '\\1\\2', 'g')) AS norm FROM entity_refs")
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places in lower case without accents."""
    return table(spark, sf_dir, "entity_refs").select("ref_id", es.normalized(F.col("source_span")).alias("norm"))


#: Usual abbreviations written out; any list of readers.corrections has this shape.
CORRECTIONS = (("cordill.", "cordillera"), ("penins.", "peninsula"), ("cdra.", "cordillera"), ("vle.", "valle"))


@query("SELECT ref_id, " + "".join("replace(" for _ in CORRECTIONS) + "norm" + "".join(f", '{a}', '{b}')" for a, b in CORRECTIONS) + f" AS norm FROM ({ORACLE['text_normalized']})")
def text_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places in lower case without accents, their abbreviations written out, the longest first."""
    return table(spark, sf_dir, "entity_refs").select("ref_id", es.corrected(es.normalized(F.col("source_span")), CORRECTIONS).alias("norm"))


@query("SELECT species, CAST(list_min(l) AS INT) AS lo, CAST(list_max(l) AS INT) AS hi FROM (SELECT species, list_transform(regexp_extract_all(manual_ext, '\\d+'), lambda x: CAST(x AS INT)) AS l FROM range_width)")
def text_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each stored range text."""
    return table(spark, sf_dir, "range_width").select("species", es.range_bounds(F.col("manual_ext")).alias("r")).select("species", "r.lo", "r.hi")


@query("SELECT locality_id, list_filter(list_transform(regexp_split_to_array(description, '\\s*,\\s*|\\s+y\\s+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM localities")
def text_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a list ``X, Y y Z``."""
    return table(spark, sf_dir, "localities").select("locality_id", es.listed(F.col("description")).alias("parts"))



@query("""SELECT ficha_id, elev_ok, slope_ok, endem_ok FROM (SELECT f.ficha_id, CASE WHEN len(b) > 0 THEN list_bool_and(list_transform(b, lambda v: list_contains(nums, CAST(v AS VARCHAR)))) END AS elev_ok,
CASE WHEN len(f.vertientes) > 0 THEN regexp_matches(t, '(?i)ambas\\s+verts?\\.?') OR list_bool_and(list_transform(f.vertientes, lambda v: CASE WHEN starts_with(v, 'Carib') THEN regexp_matches(t, '(?i)vert\\w*\\.?\\s*carib|carib(e|ena|eno)\\b') ELSE regexp_matches(t, '(?i)vert\\w*\\.?\\s*pac|pacif(ico|ica)\\b') END)) END AS slope_ok,
coalesce(f.endemic_cr, false) = regexp_matches(t, '(?i)endemic') AS endem_ok FROM (SELECT *, list_filter([elev_min, elev_max, elev_outlier_min, elev_outlier_max], lambda x: x IS NOT NULL) AS b FROM fichas) f
JOIN (SELECT species, t, regexp_extract_all(t, '\\d+') AS nums FROM (SELECT species, translate(lower(coalesce(first(distribution_paragraph ORDER BY raw_id), '')), 'áéíóúüñ', 'aeiouun') AS t FROM raw_fichas GROUP BY species)) r USING (species))""")
def text_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first entry's text of a species says what its records store."""
    raw = table(spark, sf_dir, "raw_fichas").groupBy("species").agg(F.min_by("distribution_paragraph", "raw_id").alias("text"))
    x = table(spark, sf_dir, "fichas").join(raw, "species")
    stored = F.array("elev_min", "elev_max", "elev_outlier_min", "elev_outlier_max")
    return x.select("ficha_id", *es.supported(F.col("text"), stored, F.coalesce("vertientes", F.array().cast("array<string>")), F.col("endemic_cr")))


# ---------------------------------------------------------------- composites


@query("""SELECT dist_id, CASE WHEN d > 0 AND r <= 1 AND p = 0 THEN 'district' WHEN c > 0 AND r <= 1 AND p = 0 THEN 'canton' WHEN p > 0 THEN 'park' WHEN r > 0 THEN 'region' WHEN v > 0 THEN 'vertiente' ELSE 'country' END AS scope, least(1.0, (d + c + p + r) / 3.0) AS geographic
FROM (SELECT f.dist_id, coalesce(len(f.vertientes), 0) AS v, count(CASE WHEN hierarchy_level = 'district' THEN 1 END) AS d, count(CASE WHEN hierarchy_level = 'canton' THEN 1 END) AS c, count(CASE WHEN hierarchy_level = 'park' THEN 1 END) AS p,
count(CASE WHEN hierarchy_level NOT IN ('district', 'canton', 'park') THEN 1 END) AS r FROM distribution_fichas f LEFT JOIN (SELECT DISTINCT dist_id, canonical_name, hierarchy_level FROM entity_refs WHERE canonical_name IS NOT NULL) e USING (dist_id) GROUP BY f.dist_id, f.vertientes)""")
def math_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest scope of each distribution, and the confidence of its places: a third for each, 1 at most."""
    refs = table(spark, sf_dir, "entity_refs").where("canonical_name IS NOT NULL").select("dist_id", "canonical_name", "hierarchy_level").distinct()
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    level = F.col("hierarchy_level")
    per = refs.groupBy("dist_id").agg(count(level == "district", "d"), count(level == "canton", "c"), count(level == "park", "p"), count(~level.isin("district", "canton", "park"), "r"))
    x = table(spark, sf_dir, "distribution_fichas").select("dist_id", F.size(F.coalesce("vertientes", F.array())).alias("v")).join(per, "dist_id", "left").na.fill(0, ["d", "c", "p", "r"])
    d, c, p, r = (F.col(k) for k in "dcpr")
    few = (r <= 1) & (p == 0)
    scope = F.when((d > 0) & few, "district").when((c > 0) & few, "canton").when(p > 0, "park").when(r > 0, "region").when(F.col("v") > 0, "vertiente").otherwise("country")
    return x.select("dist_id", scope.alias("scope"), F.least(F.lit(1.0), (d + c + p + r) / 3.0).alias("geographic"))


def vocabulary(spark: SparkSession, sf_dir: str) -> dict[str, set[str]]:
    """The vocabulary of question parsing: gazetteer regions, and the families, habits and forest types of the catalogue."""
    out: dict[str, set[str]] = {"vertiente": {"Caribe", "Pacífico"}, "habit": set(es.HABITS)}
    for kind, value in agg_vocabulary(spark, sf_dir).where("kind IN ('family', 'forest_type')").collect():  # controlled lists, not data
        out.setdefault(kind, set()).add(value)
    out["region"] = {r[0] for r in table(spark, sf_dir, "region_polygons").select("nombre").distinct().collect()}
    return out


QUESTION = "¿Qué arbustos endémicos de la vertiente Caribe crecen sobre 1000 m?"


@query(f"""SELECT ficha_id, species, coalesce(n, 0) AS n_points, coalesce(n, 0) < 5 AS few FROM (SELECT ficha_id, species, family, {_LO} AS lo_, {_HI} AS hi_ FROM fichas WHERE list_contains(habits, 'arbusto') AND list_contains(vertientes, 'Caribe') AND coalesce(endemic_cr, false)) f
LEFT JOIN (SELECT species, count(*) AS n FROM points WHERE {_ALT} AND altitud >= 1000 GROUP BY species) p USING (species) WHERE lo_ IS NOT NULL AND hi_ IS NOT NULL AND hi_ - greatest(1000, lo_) > 0""")
def comp_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question parsed, its records filtered, and the points of each that meet the same band counted."""
    intent = parse(QUESTION, vocabulary(spark, sf_dir))
    found = table(spark, sf_dir, "fichas").where(condition(intent)).select("ficha_id", "species")
    pts = table(spark, sf_dir, "points").where(_usable() & (F.col("altitud") >= intent.elev_lo)).groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return found.join(pts, "species", "left").select("ficha_id", "species", n.alias("n_points"), (n < 5).alias("few"))


@query(f"""SELECT DISTINCT dist_id, layer, feature, source FROM (SELECT e.dist_id, j.target_shapefile AS layer, j.target_value AS feature, 'named' AS source FROM ({ORACLE['join_entity_feature']}) j JOIN entity_refs e USING (ref_id)
UNION ALL SELECT d.dist_id, 'regiones_botanicas', n.nombre, 'inferred' FROM distribution_fichas d JOIN ({ORACLE['join_new_regions']}) n USING (species))""")
def comp_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map layers of each distribution as (dist_id, layer, feature, source): named features and inferred regions."""
    named = join_entity_feature(spark, sf_dir).join(table(spark, sf_dir, "entity_refs").select("ref_id", "dist_id"), "ref_id").select("dist_id", F.col("target_shapefile").alias("layer"), F.col("target_value").alias("feature"), F.lit("named").alias("source"))
    inferred = table(spark, sf_dir, "distribution_fichas").select("dist_id", "species").join(join_new_regions(spark, sf_dir), "species").select("dist_id", F.lit("regiones_botanicas").alias("layer"), F.col("nombre").alias("feature"), F.lit("inferred").alias("source"))
    return named.unionByName(inferred).distinct()


_CLEAN_RAW = """given AS (SELECT * FROM raw_fichas), raw_fichas AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(distribution_paragraph, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '(\\p{L})-\\s*\\r?\\n\\s*(\\p{L})', '\\1\\2', 'g'), '\\s*\\r?\\n\\s*', ' ', 'g') AS distribution_paragraph)
FROM given WHERE distribution_paragraph IS NOT NULL)"""
_CATALOG_FORESTS = ORACLE["text_forest_types"].replace("dist_id", "raw_id").replace("distribution_fichas", f"(SELECT raw_id, trim(regexp_extract({_T}, '(?s)^(.*?m)\\s*;', 1)) AS habitat_raw FROM raw_fichas)")


@query(f"""WITH {_CLEAN_RAW} SELECT replace(r.species, ' ', '_') AS vector_id, r.species, r.authority, r.genus, r.family, r.volume, r.page AS page_index, e.lo AS elev_min, e.hi AS elev_max, e.outlier_lo AS elev_outlier_min, e.outlier_hi AS elev_outlier_max,
s.slopes AS vertientes, f.forests AS forest_types, h.habits, s.endemic AS endemic_cr, m.flowering AS flowering_months, m.fruiting AS fruiting_months
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n_blocks DESC NULLS LAST, raw_id) AS rn FROM raw_fichas) WHERE rn = 1) r
JOIN ({ORACLE['text_elevation']}) e USING (raw_id) JOIN ({ORACLE['text_slopes']}) s USING (raw_id) JOIN ({_CATALOG_FORESTS}) f USING (raw_id) JOIN ({ORACLE['text_habits']}) h USING (raw_id) JOIN ({ORACLE['text_months']}) m USING (raw_id)""")
def comp_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue built from raw entries: richest entry of each species, its text parsed into typed fields."""
    order = [F.col("distribution_paragraph").isNotNull().desc(), F.col("n_blocks").desc_nulls_last(), F.col("raw_id")]
    raw = ordered.best_of(table(spark, sf_dir, "raw_fichas").where(F.col(_T).isNotNull()), ["species"], order)
    text = es.cleaned(F.col(_T))
    habitat, e = es.habitat_part(text), es.elevation(text)
    return raw.select(
        F.regexp_replace("species", " ", "_").alias("vector_id"), "species", "authority", "genus", "family", "volume", F.col("page").alias("page_index"),
        e["lo"].alias("elev_min"), e["hi"].alias("elev_max"), e["outlier_lo"].alias("elev_outlier_min"), e["outlier_hi"].alias("elev_outlier_max"),
        es.slopes(text).alias("vertientes"), es.forest_types(habitat).alias("forest_types"), es.entry_habits(F.col("morphology"), F.col("genus_description"), F.col("family")).alias("habits"),
        es.is_endemic(text).alias("endemic_cr"), es.months(text).alias("flowering_months"), es.months(text, "Fr").alias("fruiting_months"),
    )


# ---------------------------------------------------------------- stored forms


@query("SELECT ficha_id, species, elev_min, elev_max, endemic_cr, len(synonyms) AS n_synonyms, len(regions) AS n_regions, len(flowering_months) AS n_months FROM fichas")
def comp_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record written as one JSON text and read back under the catalogue's schema."""
    f = table(spark, sf_dir, "fichas")
    back = writers.from_documents(writers.documents(f), f.schema).select("r.*")
    return back.select("ficha_id", "species", "elev_min", "elev_max", "endemic_cr", F.when(F.col("synonyms").isNotNull(), F.size("synonyms")).alias("n_synonyms"), F.when(F.col("regions").isNotNull(), F.size("regions")).alias("n_regions"), F.when(F.col("flowering_months").isNotNull(), F.size("flowering_months")).alias("n_months"))


@query(f"""SELECT vector_id, coalesce(elev_min, -1) AS elev_min, coalesce(elev_max, -1) AS elev_max, coalesce({_LO}, -1) AS elev_min_eff, coalesce({_HI}, -1) AS elev_max_eff, list_transform(flowering_months, lambda m: m::VARCHAR) AS months FROM {_FIRST}""")
def comp_index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat records of a vector index: effective bounds, -1 for missing numbers, months as texts."""
    out = writers.index_records(first_fichas(spark, sf_dir))
    return out.select("vector_id", "elev_min", "elev_max", "elev_min_eff", "elev_max_eff", F.col("flowering_months").alias("months"))


@query("SELECT vector_id, arg_max(ficha_id, (extracted_at, ficha_id)) AS ficha_id FROM fichas GROUP BY vector_id")
def set_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first extraction of each key with the last one merged in: the later wins."""
    last = ordered.best_of(table(spark, sf_dir, "fichas"), ["vector_id"], [F.desc("extracted_at"), F.desc("ficha_id")])
    return ordered.upsert(first_fichas(spark, sf_dir), last, "vector_id").select("vector_id", "ficha_id")
