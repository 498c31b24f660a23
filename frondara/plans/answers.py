"""Answers to questions over the catalogue: lookup, filtered list and superlative, with their evidence and citations.

A question that names a catalogued species is looked up; one that asks for the most extreme species is answered from the
whole filtered catalogue; any other gives the nearest records that pass its constraints. Each answer is a table of
records with the points that support them; the text of an answer only restates that table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frondara.functions import spanish as es
from frondara.operators import bands, ordered
from frondara.plans import catalog_queries as cq
from frondara.plans.intent import FILTERS, Intent, condition, parse
from frondara.plans.registry import registry
from frondara.session import broadcast_if_small, table

QUERIES, ORACLE, query = registry()

#: Numbers of records that the entries give by default: a search, a filtered list, a question, an answer.
TOP_SEARCH, TOP_LIST, TOP_ASK, TOP_ANSWER = 10, 25, 15, 12
#: Points under which the evidence for a species is called thin.
FEW_POINTS = 5
#: Length of the lexical vectors.
DIMS = 64
# What the criteria of a superlative are called.
CRITERIA = {
    "elev_max": "elevación máxima reportada (m)", "elev_min": "elevación mínima reportada (m)", "n_regions": "número de regiones botánicas reportadas",
    "n_points": "registros de presencia (esfuerzo de colecta, no abundancia)",
}
NOTHING = "No se encontraron especies que cumplan los criterios de la pregunta."


# ---------------------------------------------------------------- the catalogue and its index


def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(species, text): the distribution text of the richest raw entry of each species."""
    raw = table(spark, sf_dir, "raw_fichas").select("species", F.col("distribution_paragraph").alias("text"), "n_blocks", "raw_id").where("text IS NOT NULL AND species IS NOT NULL")
    return raw.groupBy("species").agg(F.max_by("text", F.struct(F.coalesce("n_blocks", F.lit(-1)), -F.col("raw_id"))).alias("text"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each key, with the text of its species; the shape all answers are drawn from."""
    return cq.first_fichas(spark, sf_dir).join(best_texts(spark, sf_dir), "species", "left")


def lexical_vector(text: Column) -> Column:
    """How many words of a text fall into each of DIMS classes by their digest: a vector without a model, in the JVM.

    Any other embedding of the same shape may take its place in :func:`indexed`.
    """
    words = F.filter(F.split(es.normalized(text), "[^a-z0-9]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % DIMS)
    # The classes stand in an array of one, so that the words are digested once and not for each class.
    return F.transform(F.array(slots), lambda own: F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))[0]


def indexed(records: DataFrame) -> DataFrame:
    """The catalogue with the vector of each text; records without a text can't be searched and are left out."""
    return records.where(F.col("text").isNotNull()).withColumn("vector", lexical_vector(F.col("text")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def touching(i: Intent) -> Column:
    """The constraints as an index filters them: bands only need to touch the window."""
    rest = condition(Intent(**{f: getattr(i, f) for f in FILTERS if f not in ("elev_lo", "elev_hi")}))
    if i.elev_lo is None and i.elev_hi is None:
        return rest
    lo, hi = cq.effective_bounds()
    a, b = (F.lit(x) if x is not None else None for x in (i.elev_lo, i.elev_hi))
    return rest & F.coalesce(bands.touches(lo, hi, a, b), F.lit(False))


def search(index: DataFrame, text: str, k: int = TOP_SEARCH, keep: Column | None = None, key: str = "vector_id") -> DataFrame:
    """The k records nearest to a text of those that pass ``keep``, filtered before they are ranked; the lower key on ties."""
    kept = index if keep is None else index.where(keep)
    scored = kept.withColumn("score", F.round(cosine(F.col("vector"), lexical_vector(F.lit(text))), 9))
    return scored.orderBy(F.desc("score"), key).limit(k)


def filtered_list(index: DataFrame, text: str, i: Intent, k: int = TOP_LIST) -> DataFrame:
    """Filter, rank, keep k, drop bands that only touch the window, order by relevance: fewer than k rows may be left."""
    hits = search(index, text, k, touching(i)).where(condition(i))
    if i.elev_lo is None and i.elev_hi is None:
        return hits.withColumn("relevance", F.col("score"))
    lo, hi = F.col("elev_min"), F.col("elev_max")
    a, b = (F.lit(x) if x is not None else own for x, own in ((i.elev_lo, lo), (i.elev_hi, hi)))
    told = lo.isNotNull() & hi.isNotNull()
    return hits.withColumn("relevance", F.when(told, bands.relevance(lo, hi, a, b, F.col("score"))).otherwise(0.1 * F.col("score")))


def lookup(spark: SparkSession, sf_dir: str, species: str) -> DataFrame:
    """The record of a species by its key; the key filter reaches the scan."""
    return catalogue(spark, sf_dir).where(F.col("vector_id") == species.replace(" ", "_"))


def detected(asked: DataFrame, catalog: DataFrame, key: str, question: str) -> DataFrame:
    """(key, species): the first binomial of each question that the catalogue holds."""
    names = asked.select(key, F.posexplode(F.regexp_extract_all(question, F.lit(r"\b\p{Lu}[a-záéíóúñ]+\s+[a-záéíóúñ]{3,}"), F.lit(0))).alias("pos", "found"))
    names = names.withColumn("vector_id", F.regexp_replace("found", r"\s+", "_"))
    return names.join(catalog.select("vector_id", "species"), "vector_id").groupBy(key).agg(F.min_by("species", "pos").alias("species"))


# ---------------------------------------------------------------- evidence


def evidence(records: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records`` with n_points, the distinct clean points of the species, and whether they are few."""
    wanted = records.select("species").distinct()
    points = cq.filter_coordinates(spark, sf_dir).join(broadcast_if_small(wanted), "species", "left_semi")
    n = points.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0))
    return records.join(n, "species", "left").withColumns({"n_points": count, "few": count < FEW_POINTS}).drop("n")


def context(records: DataFrame, k: int = TOP_ANSWER) -> DataFrame:
    """(context): the cited lines of up to k records in their order, all that an answer may be composed from."""
    line = F.concat(F.lit("- "), "species", F.lit(" (Tomo "), F.coalesce("volume", F.lit("?")), F.lit(", p."), F.coalesce("pages", F.lit("?")), F.lit("): "), F.coalesce("text", F.lit("–")))
    lines = records.where(F.col("rank") <= k).select("rank", line.alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


@dataclass
class Answer:
    """question, recipe, constraints, what picked a single record, the records with their evidence in ``rank`` order."""

    question: str
    mode: str
    constraints: dict
    selector: str | None
    records: DataFrame

    def text(self) -> str:
        """The answer in words, from its records only (at most TOP_ANSWER of them); each statement with its citation."""
        rows = self.records.where(F.col("rank") <= TOP_ANSWER).orderBy("rank").collect()
        if not rows:
            return NOTHING
        said = [self.selector] if self.selector else []
        for r in rows:
            where = ", ".join(r["vertientes"] or []) or "sin vertiente indicada"
            said.append(f"{r['species']}: {label(r['elev_min'], r['elev_max'])}, {where} (Tomo {r['volume']}, p. {r['pages']}).")
        return "\n".join(said)

    def markdown(self) -> str:
        """A report: question, constraints, text, table of at most TOP_ANSWER records, and how many more there are."""
        rows = self.records.where(F.col("rank") <= TOP_ANSWER).orderBy("rank").collect()
        more = self.records.where(F.col("rank") > TOP_ANSWER).count()
        out = [f"# {self.question}", "", f"**Modo:** {self.mode}  ·  **Filtro:** `{json.dumps(self.constraints, ensure_ascii=False)}`"]
        if self.selector:
            out.append(f"**Criterio de selección:** {self.selector}")
        out += ["", self.text(), "", "| especie | familia | elev (m) | vertiente | Tomo·pág | n |", "|---|---|---|---|---|---|"]
        for r in rows:
            flag = f" <{FEW_POINTS}" if r["few"] else ""
            out.append(f"| *{r['species']}* | {r['family']} | {label(r['elev_min'], r['elev_max'])} | {', '.join(r['vertientes'] or []) or '–'} | {r['volume']}·{r['pages']} | {r['n_points']}{flag} |")
        return "\n".join([*out, *([f"... (+{more} más)"] if more else [])])


def label(lo: int | None, hi: int | None) -> str:
    """A band in words; an open side is left open."""
    if lo is None and hi is None:
        return "sin elevación indicada"
    return f"{lo} m" if lo == hi else f"{'' if lo is None else lo}–{'' if hi is None else hi} m"


RECORD = ("rank", "vector_id", "species", "family", "volume", "pages", "elev_min", "elev_max", "vertientes", "text", "score")


def _ranked(df: DataFrame, score: str) -> DataFrame:
    """At most a top-k's rows, numbered by falling score."""
    from pyspark.sql.window import Window

    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "vector_id"))).withColumn("score", F.col(score).cast("double")).select(*RECORD)


def ask(spark: SparkSession, sf_dir: str, question: str, k: int = TOP_ASK) -> tuple[Intent, DataFrame]:
    """The constraints of a question and the records of its filtered list."""
    intent = parse(question, cq.vocabulary(spark, sf_dir))
    return intent, _ranked(filtered_list(indexed(catalogue(spark, sf_dir)), question, intent, k), "relevance")


def answer(spark: SparkSession, sf_dir: str, question: str, k: int = TOP_ANSWER) -> Answer:
    """One of three recipes for a question: A a named species, B a filtered list, B>A the most extreme of all that pass."""
    catalog = catalogue(spark, sf_dir)
    named = detected(spark.createDataFrame([(0, question)], "q int, question string"), cq.first_fichas(spark, sf_dir), "q", "question").first()
    if named is not None:
        found = catalog.where(F.col("species") == named["species"]).withColumn("score", F.lit(1.0))
        return Answer(question, "A (especie)", {}, None, evidence(_ranked(found, "score"), spark, sf_dir))
    intent = parse(question, cq.vocabulary(spark, sf_dir))
    told = {f: v for f in FILTERS if (v := getattr(intent, f)) is not None}
    if intent.intent_type == "superlative":
        best, n = extreme(catalog.where(condition(intent)), intent.criterion, intent.direction, spark, sf_dir)
        row = best.select("_value").first()
        if row is None:
            return Answer(question, "B>A (superlativo, sin resultados)", told, None, evidence(_ranked(best.withColumn("score", F.lit(1.0)), "score"), spark, sf_dir))
        why = f"{CRITERIA[intent.criterion]} = {row[0]} (entre {n} especies candidatas que cumplen el filtro)"
        return Answer(question, "B>A (superlativo)", told, why, evidence(_ranked(best.withColumn("score", F.lit(1.0)), "score"), spark, sf_dir))
    _, found = ask(spark, sf_dir, question, k)
    return Answer(question, "B (geoespacial)", told, None, evidence(found, spark, sf_dir))


def extreme(candidates: DataFrame, criterion: str, direction: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(the one record with the greatest or least criterion, the lower id on ties; the number of candidates).

    Records whose criterion is null are candidates but can't win. Points are counted under the accepted name.
    """
    if criterion == "n_points":
        candidates = with_counts(candidates, spark, sf_dir)
    value = {"elev_max": F.col("elev_max"), "elev_min": F.col("elev_min"), "n_regions": F.size(F.coalesce("regions", F.array())), "n_points": F.col("n_points") if criterion == "n_points" else F.lit(None)}[criterion]
    scored = candidates.withColumn("_value", value.cast("long"))
    order = F.desc("_value") if direction == "max" else F.asc("_value")
    return scored.where(F.col("_value").isNotNull()).orderBy(order, "ficha_id").limit(1), candidates.count()


# ---------------------------------------------------------------- names of another source


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, taxon_key, accepted, is_synonym): the binomials of the backbone; an accepted name goes before a synonym, then the lower key."""
    b = table(spark, sf_dir, "taxon_backbone")
    two = lambda c: F.regexp_extract(c, r"^(\S+\s+\S+)", 1)
    own = b.select(F.col("scientific_name").alias("name"), "taxon_key", F.col("scientific_name").alias("accepted"), F.lit(False).alias("is_synonym"))
    other = b.select(F.explode("other_names").alias("raw"), "taxon_key", "scientific_name").select(two(F.col("raw")).alias("name"), "taxon_key", F.col("scientific_name").alias("accepted"), F.lit(True).alias("is_synonym"))
    every = own.unionByName(other).where("name IS NOT NULL AND name <> '' AND accepted IS NOT NULL")
    return every.groupBy("name").agg(F.min(F.struct("is_synonym", "taxon_key", "accepted")).alias("t")).select("name", "t.taxon_key", "t.accepted", "t.is_synonym")


def with_taxon(records: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records`` with taxon_key, accepted and is_synonym of the exact name; null where there is none."""
    return records.join(taxa(spark, sf_dir).withColumnRenamed("name", "species"), "species", "left")


def with_counts(records: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records`` with n_points: rows of points under the accepted name, or the own one where none is known; 0 for none."""
    n = table(spark, sf_dir, "points").where("species IS NOT NULL").groupBy(F.col("species").alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    named = with_taxon(records, spark, sf_dir).withColumn("_name", F.coalesce("accepted", "species")).drop("taxon_key", "accepted", "is_synonym")
    return named.join(n, "_name", "left").withColumn("n_points", F.coalesce("_n", F.lit(0))).drop("_name", "_n")


# ---------------------------------------------------------------- queries

_CAT = f"(SELECT f.*, t.text FROM {cq._FIRST} f LEFT JOIN (SELECT species, arg_max(distribution_paragraph, (coalesce(n_blocks, -1), -raw_id)) AS text FROM raw_fichas WHERE distribution_paragraph IS NOT NULL AND species IS NOT NULL GROUP BY species) t USING (species))"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({}), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunaeiouun'), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'), '([a-z])- ([a-z])', '\\1\\2', 'g'))"
_VEC = (
    "list_transform(range(64), lambda i: CAST(len(list_filter(list_transform(list_filter(regexp_split_to_array(" + _NORM
    + ", '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 64), lambda s: s = i)) AS DOUBLE))"
)
_DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]))"
_COUNTS = f"(SELECT species, count(*) AS n FROM {cq._CLEAN} WHERE species IS NOT NULL GROUP BY species)"


def _scored(text: str, where: str, k: int) -> str:
    cos = f"round(coalesce({_DOT.format('v', 'q')} / nullif(sqrt({_DOT.format('v', 'v')} * {_DOT.format('q', 'q')}), 0), 0), 9)"
    return f"""(SELECT *, {cos} AS score FROM (SELECT *, {_VEC.format('text')} AS v, {_VEC.format("'" + text + "'")} AS q FROM {_CAT} WHERE text IS NOT NULL AND {where})
ORDER BY score DESC, vector_id LIMIT {k})"""


LIST_QUESTION = "arbustos de la vertiente Caribe entre 500 y 1500 m"
SUPERLATIVE_QUESTION = "¿Cuál es la epífita de mayor altitud en la vertiente Pacífico?"
COMMON_QUESTION = "¿Cuál es el árbol más común de la vertiente Caribe?"
_LO, _HI = cq._LO, cq._HI
_TOUCH = f"coalesce(list_contains(habits, 'arbusto'), false) AND coalesce(list_contains(vertientes, 'Caribe'), false) AND coalesce({_LO} <= 1500 AND {_HI} >= 500, false)"
_STRICT = f"least(1500, {_HI}) - greatest(500, {_LO}) > 0"
_INTER = "greatest(0, least(1500, elev_max) - greatest(500, elev_min))"
_RELEV = f"CASE WHEN elev_min IS NOT NULL AND elev_max IS NOT NULL THEN 0.6 * {_INTER} / greatest(1, elev_max - elev_min) + 0.3 * {_INTER} / 1000.0 + 0.1 * score ELSE 0.1 * score END"
_LIST = f"(SELECT *, row_number() OVER (ORDER BY relevance DESC, vector_id) AS rank FROM (SELECT *, {_RELEV} AS relevance FROM {_scored(LIST_QUESTION, _TOUCH, TOP_ANSWER)} WHERE {_STRICT}))"


@query(f"SELECT vector_id, round(score, 6) AS score FROM {_scored('bosque nublado con lagunas temporales', 'endemic_cr AND family IS NOT NULL', TOP_SEARCH)}")
def top_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten endemic records nearest to a text: filtered first, so that there are ten if so many pass."""
    index = indexed(catalogue(spark, sf_dir))
    return search(index, "bosque nublado con lagunas temporales", keep=F.col("endemic_cr") & F.col("family").isNotNull()).select("vector_id", F.round("score", 6).alias("score"))


@query(f"""SELECT vector_id, round({_RELEV}, 6) AS relevance FROM {_scored(LIST_QUESTION, _TOUCH, TOP_LIST)} WHERE {_STRICT}""")
def top_pattern_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter by the index, rank, keep 25, drop mere touches, order by relevance."""
    i = Intent(habit="arbusto", vertiente="Caribe", elev_lo=500, elev_hi=1500)
    return filtered_list(indexed(catalogue(spark, sf_dir)), LIST_QUESTION, i).select("vector_id", F.round("relevance", 6).alias("relevance"))


@query(f"""SELECT l.rank, l.vector_id, l.species, l.family, l.elev_min, l.elev_max, round(l.relevance, 6) AS score, coalesce(c.n, 0) AS n_points, coalesce(c.n, 0) < 5 AS few FROM {_LIST} l LEFT JOIN {_COUNTS} c USING (species)""")
def comp_answer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question without a species: its parsed constraints, the nearest records that pass them, their evidence."""
    a = answer(spark, sf_dir, LIST_QUESTION)
    return a.records.select("rank", "vector_id", "species", "family", "elev_min", "elev_max", F.round("score", 6).alias("score"), "n_points", "few")


@query(f"""SELECT coalesce(string_agg('- ' || species || ' (Tomo ' || coalesce(volume, '?') || ', p.' || coalesce(pages, '?') || '): ' || coalesce(text, '–'), chr(10) ORDER BY rank), '') AS context FROM {_LIST}""")
def comp_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited lines an answer may be composed from."""
    return context(answer(spark, sf_dir, LIST_QUESTION).records)


@query(f"""SELECT q.item_id, q.species, f.vector_id, f.volume, f.pages, coalesce(c.n, 0) AS n_points, coalesce(c.n, 0) < 5 AS few FROM (
SELECT item_id, first(name ORDER BY pos) AS species FROM (SELECT item_id, unnest(l) AS name, unnest(range(len(l))) AS pos FROM (SELECT item_id, regexp_extract_all(q, '[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\\s+[a-záéíóúñ]{{3,}}') AS l FROM eval_items))
WHERE replace(name, ' ', '_') IN (SELECT vector_id FROM fichas) GROUP BY item_id) q JOIN {_CAT} f ON f.vector_id = replace(q.species, ' ', '_') LEFT JOIN {_COUNTS} c ON c.species = q.species""")
def comp_answer_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions that name a catalogued species, each with its record, citation and evidence."""
    catalog = catalogue(spark, sf_dir)
    named = detected(table(spark, sf_dir, "eval_items").select("item_id", "q"), catalog, "item_id", "q")
    found = named.join(catalog.select("species", "vector_id", "volume", "pages"), "species")
    return evidence(found, spark, sf_dir).select("item_id", "species", "vector_id", "volume", "pages", "n_points", "few")


@query(f"""SELECT ficha_id, vector_id, species, family, CAST(elev_max AS BIGINT) AS value, n_candidates FROM (SELECT *, count(*) OVER () AS n_candidates FROM {cq._FIRST} WHERE list_contains(habits, 'epífita') AND list_contains(vertientes, 'Pacífico'))
WHERE elev_max IS NOT NULL ORDER BY elev_max DESC, ficha_id LIMIT 1""")
def comp_answer_superlative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most extreme record of all that pass a question's constraints."""
    i = parse(SUPERLATIVE_QUESTION, cq.vocabulary(spark, sf_dir))
    best, n = extreme(catalogue(spark, sf_dir).where(condition(i)), i.criterion, i.direction, spark, sf_dir)
    return best.select("ficha_id", "vector_id", "species", "family", F.col("_value").alias("value"), F.lit(n).cast("long").alias("n_candidates"))


_TAXA = """(SELECT name, min(s) AS k, arg_min(taxon_key, (s, taxon_key)) AS taxon_key, arg_min(accepted, (s, taxon_key)) AS accepted, min(s) = 1 AS is_synonym FROM (
SELECT scientific_name AS name, taxon_key, scientific_name AS accepted, 0 AS s FROM taxon_backbone UNION ALL
SELECT regexp_extract(raw, '^(\\S+\\s+\\S+)', 1), taxon_key, scientific_name, 1 FROM (SELECT unnest(other_names) AS raw, taxon_key, scientific_name FROM taxon_backbone))
WHERE name IS NOT NULL AND name <> '' AND accepted IS NOT NULL GROUP BY name)"""


@query(f"SELECT f.ficha_id, t.taxon_key, t.accepted, t.is_synonym FROM fichas f LEFT JOIN {_TAXA} t ON t.name = f.species")
def join_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backbone's key and accepted name of each record's exact name, and whether the name is a synonym there."""
    return with_taxon(table(spark, sf_dir, "fichas").select("ficha_id", "species"), spark, sf_dir).select("ficha_id", "taxon_key", "accepted", "is_synonym")


@query(f"SELECT f.ficha_id, coalesce(c.n, 0) AS n_points FROM fichas f LEFT JOIN {_TAXA} t ON t.name = f.species LEFT JOIN (SELECT species, count(*) AS n FROM points GROUP BY species) c ON c.species = coalesce(t.accepted, f.species)")
def join_accepted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each record under its accepted name."""
    return with_counts(table(spark, sf_dir, "fichas").select("ficha_id", "species"), spark, sf_dir).select("ficha_id", "n_points")


@query(f"""SELECT ficha_id, vector_id, species, family, CAST(n_points AS BIGINT) AS value, n_candidates FROM (SELECT f.*, coalesce(c.n, 0) AS n_points, count(*) OVER () AS n_candidates FROM {cq._FIRST} f
LEFT JOIN {_TAXA} t ON t.name = f.species LEFT JOIN (SELECT species, count(*) AS n FROM points GROUP BY species) c ON c.species = coalesce(t.accepted, f.species)
WHERE list_contains(habits, 'árbol') AND list_contains(vertientes, 'Caribe')) ORDER BY n_points DESC, ficha_id LIMIT 1""")
def comp_answer_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record with most points of those that pass a question's constraints."""
    i = parse(COMMON_QUESTION, cq.vocabulary(spark, sf_dir))
    best, n = extreme(catalogue(spark, sf_dir).where(condition(i)), i.criterion, i.direction, spark, sf_dir)
    return best.select("ficha_id", "vector_id", "species", "family", F.col("_value").alias("value"), F.lit(n).cast("long").alias("n_candidates"))


@query(f"""SELECT taxon_key, arg_min(vector_id, position) AS vector_id, min(position) AS position FROM (SELECT f.vector_id, f.position, t.taxon_key FROM (SELECT vector_id, species, row_number() OVER (ORDER BY family NULLS LAST, species NULLS LAST, ficha_id) - 1 AS position FROM {cq._FIRST} WHERE elev_min IS NOT NULL) f
JOIN {_TAXA} t ON t.name = f.species) GROUP BY taxon_key""")
def win_first_of_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each taxon in the order by family and species; names of one taxon count once."""
    f = cq.first_fichas(spark, sf_dir).where("elev_min IS NOT NULL").select("vector_id", "species", "family", "ficha_id")
    placed, _ = ordered.with_position(f, [F.col("family").asc_nulls_last(), F.col("species").asc_nulls_last(), F.col("ficha_id")])
    known = with_taxon(placed, spark, sf_dir).where(F.col("taxon_key").isNotNull())
    return known.groupBy("taxon_key").agg(F.min_by("vector_id", "position").alias("vector_id"), F.min("position").alias("position"))


@query(f"SELECT vector_id, species, elev_min FROM {cq._FIRST} WHERE vector_id = (SELECT min(vector_id) FROM fichas)")
def scan_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record read by its key."""
    key = table(spark, sf_dir, "fichas").agg(F.min("vector_id")).first()[0] or ""
    return lookup(spark, sf_dir, key.replace("_", " ")).select("vector_id", "species", "elev_min")

