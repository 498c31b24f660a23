"""Places of distribution texts resolved to the gazetteer and to collecting localities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frondara.functions import places as pl, spanish as es
from frondara.operators.phrases import phrase_matches
from frondara.operators.similar import CUTOFF, similar_pairs
from frondara.plans import catalog_queries as cq
from frondara.plans.registry import registry
from frondara.session import broadcast_if_small, cut, table

QUERIES, ORACLE, query = registry()

#: Levels of regions in the order in which a record lists them.
REGION_LEVELS = ("cordillera", "llanura", "valle", "península", "fila", "other")
#: Kinds of places that are looked up again by their own names, and levels that a similar name may fill.
REGION_KINDS = ("cordillera", "llanura", "valle", "fila", "peninsula", "region_informal")
FUZZY_LEVELS = (*REGION_LEVELS, "park", "canton")
#: Least letters of a name that is compared, least similarity of a locality's name, and of a region's.
LEAST_NAME, LOCALITY_CUTOFF, REGION_CUTOFF = 4, 0.82, 0.75


def folded(text: Column) -> Column:
    return F.lower(es.without_accents(text))


def named_entities(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gaz_id, level, start, alias): entities named anywhere in a text by the longest alias of each level, each once."""
    found = phrase_matches(texts.select(id_col, folded(F.col(text_col)).alias("text")), names, id_col, "text", longest=True)
    return found.groupBy(id_col, "gaz_id", F.col("hierarchy_level").alias("level")).agg(F.min(F.struct("start", "alias")).alias("m")).select(id_col, "gaz_id", "level", "m.start", "m.alias")


def resolved(texts: DataFrame, gazetteer: DataFrame, names: DataFrame, id_col: str, habitat: str, geo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, slopes, unresolved) of all texts.

    entities: (id, gaz_id, level, source), each entity of a text once, by the first way that finds it: ``text``, its alias
    stands in the text; ``place``, in the name of a place without a side (a list names each of its members); ``bracket``,
    a park named in brackets; ``similar``, a locality's name is like an entity's. slopes: (id, slopes) told by the places,
    else by the text's markers. unresolved: (id, name) of localities that nothing resolves. Null parts count as empty.
    """
    whole = texts.withColumns({"_h": F.coalesce(habitat, F.lit("")), "_g": F.coalesce(geo, F.lit(""))}).withColumn("_both", F.trim(F.concat_ws(" ", "_h", "_g")))
    found = cut(pl.occurrences(whole.withColumn("_t", F.when(F.trim("_g") != "", F.col("_g")).otherwise(F.col("_both"))), id_col, "_t", names))
    key = [id_col, "gaz_id", "level"]
    by_text = named_entities(whole, names, id_col, "_both").select(*key, F.lit(0).alias("way"))
    # Names repeat over the texts, so each distinct one is looked up once.
    regions = found.where(F.col("kind").isin(*REGION_KINDS) & F.col("side").isNull()).select(id_col, "name")
    of_names = named_entities(regions.select("name").distinct().withColumn("own", F.col("name")), names, "own", "name").where(F.col("level").isin(*REGION_LEVELS))
    by_place = regions.join(of_names.withColumnRenamed("own", "name"), "name").select(*key, F.lit(1).alias("way"))
    areas = found.select(id_col, F.explode("areas").alias("name"))
    of_areas = named_entities(areas.select("name").distinct().withColumn("own", F.col("name")), names, "own", "name").where("level = 'park'")
    by_bracket = areas.join(of_areas.withColumnRenamed("own", "name"), "name").select(*key, F.lit(2).alias("way"))
    local = found.where((F.col("kind") == "localidad") & (F.length("name") >= LEAST_NAME)).select(id_col, "name").distinct()
    like = most_similar(local.select("name").distinct(), gazetteer, "name").where(F.col("level").isin(*FUZZY_LEVELS))
    like = cut(like)
    by_likeness = local.join(like.select("name", "gaz_id", "level"), "name").select(*key, F.lit(3).alias("way"))
    every = by_text.unionByName(by_place).unionByName(by_bracket).unionByName(by_likeness).groupBy(*key).agg(F.min("way").alias("way"))
    ways = F.array(*[F.lit(w) for w in ("text", "place", "bracket", "similar")])
    entities = every.select(*key, ways[F.col("way")].alias("source"))
    told = pl.slopes_of(found, id_col).withColumnRenamed("slopes", "_told")
    slopes = whole.join(told, id_col, "left").select(id_col, F.coalesce("_told", es.slopes(F.col("_both"))).alias("slopes"))
    return entities, slopes, local.join(like.select("name"), "name", "left_anti").select(id_col, "name")


def most_similar(tokens: DataFrame, gazetteer: DataFrame, token: str, cutoff: float = CUTOFF) -> DataFrame:
    """(token, gaz_id, level, similarity): the most similar canonical name of each token, the lower id on ties."""
    names = gazetteer.where("canonical_name IS NOT NULL").select("gaz_id", F.col("hierarchy_level").alias("level"), folded(F.col("canonical_name")).alias("_name"))
    asked = tokens.where(F.length(token) >= LEAST_NAME).select(token, folded(F.col(token)).alias("_token"))
    pairs = similar_pairs(asked, names, "_token", "_name", cutoff)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "gaz_id", "level"))
    return pairs.groupBy(token).agg(best.alias("b")).select(token, "b.gaz_id", "b.level", (-F.col("b.s")).alias("similarity"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_fichas").where("distribution_paragraph IS NOT NULL")
    text = es.cleaned(F.col("distribution_paragraph"))
    return raw.select("raw_id", es.habitat_part(text).alias("habitat"), es.geographic_part(text).alias("geo"))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return resolved(_texts(spark, sf_dir), table(spark, sf_dir, "gazetteer"), cq.aliases(spark, sf_dir), "raw_id", "habitat", "geo")


# ---------------------------------------------------------------- queries


@query(f"SELECT raw_id, gaz_id, hierarchy_level AS level, min(start) AS start FROM {cq._LONGEST} GROUP BY ALL")
def join_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named in each distribution text by the longest alias of each level, each once, where it first stands."""
    return named_entities(table(spark, sf_dir, "raw_fichas"), cq.aliases(spark, sf_dir), "raw_id", "distribution_paragraph").select("raw_id", "gaz_id", "level", "start")


@query()
def comp_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of every distribution text, with the way that found them."""
    return _resolved(spark, sf_dir)[0]


@query()
def comp_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a text: slopes, how many regions, parks, cantons and districts, scope, confidences, names left over."""
    entities, slopes, left = _resolved(spark, sf_dir)
    n = lambda levels, name: F.count(F.when(F.col("level").isin(*levels), 1)).alias(name)
    per = entities.groupBy("raw_id").agg(n(REGION_LEVELS, "regions"), n(["park"], "parks"), n(["canton"], "cantons"), n(["district"], "districts"))
    rest = left.groupBy("raw_id").agg(F.sort_array(F.collect_list("name")).alias("unresolved"))
    x = slopes.join(per, "raw_id", "left").join(rest, "raw_id", "left").na.fill(0, ["regions", "parks", "cantons", "districts"])
    x = x.join(_texts(spark, sf_dir).select("raw_id", es.elevation(F.concat_ws(" ", "habitat", "geo")).alias("e")), "raw_id")
    few = (F.col("regions") <= 1) & (F.col("parks") == 0)
    scope = F.when((F.col("districts") > 0) & few, "district").when((F.col("cantons") > 0) & few, "canton").when(F.col("parks") > 0, "park").when(F.col("regions") > 0, "region").when(F.size("slopes") > 0, "vertiente").otherwise("country")
    total = F.col("regions") + F.col("parks") + F.col("cantons") + F.col("districts")
    sure = F.create_map(F.lit("overall"), (total > 0).cast("double"), F.lit("geographic"), F.least(F.lit(1.0), total / 3), F.lit("elevation"), F.col("e.lo").isNotNull().cast("double"))
    return x.select("raw_id", "slopes", "regions", "parks", "cantons", "districts", scope.alias("scope"), sure.alias("confidence"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"))


@query()
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each distribution text as rows."""
    return pl.occurrences(_texts(spark, sf_dir), "raw_id", "geo", cq.aliases(spark, sf_dir))


_TOKEN = f"(SELECT DISTINCT {cq._SPAN} AS token FROM entity_refs WHERE length(source_span) >= {LEAST_NAME})"


@query(f"""SELECT token, arg_min(gaz_id, (-s, gaz_id)) AS gaz_id, round(max(s), 6) AS similarity FROM (SELECT t.token, g.gaz_id, 1 - levenshtein(t.token, {cq._NOACC.format('g.canonical_name')}) / greatest(length(t.token), length(g.canonical_name)) AS s FROM {_TOKEN} t, gazetteer g) WHERE s >= 0.88 GROUP BY token""")
def join_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar canonical name of each typed place, of all at or above the cutoff."""
    tokens = table(spark, sf_dir, "entity_refs").where(F.length("source_span") >= LEAST_NAME).select(folded(F.col("source_span")).alias("token")).distinct()
    return most_similar(tokens, table(spark, sf_dir, "gazetteer"), "token").select("token", "gaz_id", F.round("similarity", 6).alias("similarity"))


def park_names(texts: DataFrame, parks: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """(id, name): parks whose folded name stands in a text; names under five letters only as whole words."""
    named = parks.select(F.col(name_col).alias("park"), folded(F.col(name_col)).alias("alias")).where("alias <> ''").distinct()
    numbered = named.select("park", "alias", F.xxhash64("alias").alias("gaz_id"), F.lit("park").alias("hierarchy_level"))
    text = texts.select(id_col, folded(F.col(text_col)).alias("text"))
    hits = phrase_matches(text, numbered.select("alias", "gaz_id", "hierarchy_level").distinct(), id_col, "text", longest=False)
    short = hits.where(F.length("alias") < 5).select(id_col, "alias").distinct().join(text, id_col)
    whole = short.where(F.regexp_like("text", F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), "alias", F.lit(r"\E(?![\p{L}\p{N}_])")))).select(id_col, "alias")
    kept = hits.where(F.length("alias") >= 5).select(id_col, "alias").unionByName(whole).distinct()
    return kept.join(broadcast_if_small(named), "alias").select(id_col, F.col("park").alias("name"))


@query(f"""SELECT DISTINCT r.raw_id, g.canonical_name AS name FROM (SELECT raw_id, {cq._NOACC.format('distribution_paragraph')} AS t FROM raw_fichas WHERE distribution_paragraph IS NOT NULL) r JOIN gazetteer g ON g.hierarchy_level IN ('park', 'other') AND contains(r.t, {cq._NOACC.format('g.canonical_name')})""")
def join_parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parks and other areas whose names stand in a distribution text."""
    areas = table(spark, sf_dir, "gazetteer").where("hierarchy_level IN ('park', 'other')")
    return park_names(table(spark, sf_dir, "raw_fichas").where("distribution_paragraph IS NOT NULL"), areas, "raw_id", "distribution_paragraph", "canonical_name")


def locality_tiers(asked: DataFrame, localities: DataFrame, key: str, name: str, region: bool = False) -> DataFrame:
    """(key, locality_id, tier) of the best locality for each asked name, or with ``region`` of all that hold it.

    Tiers: 1 equal; 2 the name stands in the locality's, the shortest such; 3 all its words of more than three letters do;
    4 the most similar of at least LOCALITY_CUTOFF. Ties go to the lower id; names under three letters match nothing.
    region: every locality that holds the name, tier 2; where none does, the most similar of at least REGION_CUTOFF.

    Distinct names are few beside the rows that ask for them; each is searched in the localities' names by its own
    substrings of three letters, since a name that stands in another shares all of them.
    """
    q = asked.select(folded(F.trim(name)).alias("q")).where(F.length("q") >= 3).distinct()
    own = localities.where("name IS NOT NULL").select("locality_id", folded(F.col("name")).alias("n"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    n_grams = own.where(F.length("n") >= 3).select("locality_id", "n", F.explode(F.array_distinct(grams(F.col("n")))).alias("g"))
    # A name's first three letters must stand in the other; so must those of each of its long words.
    words = F.filter(F.split("q", " "), lambda w: F.length(w) > 3)
    first = q.select("q", F.substring("q", 1, 3).alias("g"), F.lit(2).alias("how"))
    second = q.select("q", F.substring(F.get(words, F.lit(0)), 1, 3).alias("g"), F.lit(3).alias("how")).where("g IS NOT NULL")
    pairs = first.unionByName(second).join(broadcast_if_small(n_grams), "g")
    all_words = F.forall(words, lambda w: F.contains(F.col("n"), w)) & (F.size(words) > 0)
    tier = F.when(F.col("n") == F.col("q"), 1).when(F.contains("n", "q"), 2).when((F.col("how") == 3) & all_words, 3)
    exact = pairs.withColumn("tier", tier).where("tier IS NOT NULL").select("q", "locality_id", "n", "tier").distinct()
    if region:
        exact = exact.where("tier <= 2").withColumn("tier", F.lit(2))
    rest = q.join(exact.select("q"), "q", "left_anti").where(F.length("q") >= 5)
    alike = similar_pairs(rest, own, "q", "n", REGION_CUTOFF if region else LOCALITY_CUTOFF)
    close = alike.groupBy("q").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "locality_id")).alias("b")).select("q", "b.locality_id", F.lit(4).alias("tier"))
    if region:
        best = exact.select("q", "locality_id", "tier")
    else:
        order = F.struct("tier", F.when(F.col("tier") == 2, F.length("n")).otherwise(0).alias("l"), "locality_id")
        best = exact.groupBy("q").agg(F.min(order).alias("b")).select("q", "b.locality_id", "b.tier")
    found = best.unionByName(close)
    return asked.select(key, folded(F.trim(name)).alias("q")).join(found, "q").select(key, "locality_id", "tier")


_ASKED = f"""(SELECT ref_id, {cq._NOACC.format('trim(source_span)')} AS q FROM entity_refs WHERE source_span IS NOT NULL UNION ALL SELECT -locality_id, {cq._NOACC.format('trim(canton)')} FROM localities WHERE canton IS NOT NULL
UNION ALL SELECT -1000 - locality_id, split_part({cq._NOACC.format('trim(name)')}, ' ', 2) FROM localities WHERE name IS NOT NULL UNION ALL SELECT -2000 - locality_id, {cq._NOACC.format('trim(name)')} || 'x' FROM localities WHERE name IS NOT NULL)"""
_LOCAL = f"(SELECT locality_id, {cq._NOACC.format('name')} AS n FROM localities WHERE name IS NOT NULL)"
_LONG = "list_filter(string_split(q, ' '), lambda w: length(w) > 3)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places, and localities' cantons, last words and misspelt names, all asked for as localities."""
    loc = table(spark, sf_dir, "localities")
    named = loc.where("name IS NOT NULL")
    return (
        table(spark, sf_dir, "entity_refs").where("source_span IS NOT NULL").select("ref_id", F.col("source_span").alias("asked"))
        .unionByName(loc.where("canton IS NOT NULL").select((-F.col("locality_id")).alias("ref_id"), F.col("canton").alias("asked")))
        .unionByName(named.select((-1000 - F.col("locality_id")).alias("ref_id"), F.split_part(F.trim("name"), F.lit(" "), F.lit(2)).alias("asked")))
        .unionByName(named.select((-2000 - F.col("locality_id")).alias("ref_id"), F.concat("name", F.lit("x")).alias("asked")))
    )


@query(f"""SELECT ref_id, locality_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, CASE WHEN tier = 2 THEN length(n) ELSE 0 END, CASE WHEN tier = 4 THEN -s ELSE 0 END, locality_id) AS rn FROM (
SELECT a.ref_id, l.locality_id, l.n, 1 - levenshtein(q, n) / greatest(length(q), length(n)) AS s, CASE WHEN q = n THEN 1 WHEN contains(n, q) THEN 2 WHEN len({_LONG}) > 0 AND len(list_filter({_LONG}, lambda w: NOT contains(n, w))) = 0 THEN 3
WHEN length(q) >= 5 AND 1 - levenshtein(q, n) / greatest(length(q), length(n)) >= 0.82 THEN 4 END AS tier FROM {_ASKED} a, {_LOCAL} l WHERE length(q) >= 3) WHERE tier IS NOT NULL) WHERE rn = 1""")
def join_locality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best locality for each asked name, by four tiers."""
    return locality_tiers(_asked(spark, sf_dir), table(spark, sf_dir, "localities"), "ref_id", "asked")


@query(f"""WITH p AS (SELECT a.ref_id, l.locality_id, contains(n, q) AS inside, 1 - levenshtein(q, n) / greatest(length(q), length(n)) AS s, length(q) AS lq FROM {_ASKED} a, {_LOCAL} l WHERE length(q) >= 3)
SELECT ref_id, locality_id, 2 AS tier FROM p WHERE inside UNION ALL SELECT ref_id, arg_min(locality_id, (-s, locality_id)), 4 FROM p WHERE NOT inside AND s >= 0.75 AND lq >= 5 AND ref_id NOT IN (SELECT ref_id FROM p WHERE inside) GROUP BY ref_id""")
def join_locality_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All localities that hold each asked name, or the most similar one."""
    return locality_tiers(_asked(spark, sf_dir), table(spark, sf_dir, "localities"), "ref_id", "asked", region=True)
