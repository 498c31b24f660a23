"""Evaluations: parsed questions against gold constraints, stored values against texts, answers against records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frondara.functions import spanish as es
from frondara.operators import bands
from frondara.plans import answers, catalog_queries as cq
from frondara.plans.intent import FILTERS, Intent, condition, parse
from frondara.plans.registry import registry
from frondara.session import table

QUERIES, ORACLE, query = registry()

# Public test questions and the constraints each stands for.
QUESTIONS = [
    (1, "arbustos endémicos de bosque nuboso sobre 2000 m en la Cordillera de Talamanca", dict(habit="arbusto", forest_type="nuboso", elev_lo=2000, region="Cordillera de Talamanca", endemic=True)),
    (2, "árboles del bosque seco en la Península de Nicoya", dict(habit="árbol", forest_type="seco", region="Península de Nicoya")),
    (3, "epífitas de la vertiente Caribe entre 500 y 1500 m", dict(habit="epífita", vertiente="Caribe", elev_lo=500, elev_hi=1500)),
    (4, "Orchidaceae que florecen en enero", dict(family="Orchidaceae", flowering_month=1)),
    (5, "hierbas endémicas sobre 3000 m", dict(habit="hierba", endemic=True, elev_lo=3000)),
    (6, "palmas de la Península de Osa - Golfito", dict(habit="palma", region="Península de Osa - Golfito")),
    (7, "bejucos de bosque muy húmedo en la vertiente Pacífico", dict(habit="bejuco", forest_type="muy húmedo", vertiente="Pacífico")),
    (8, "especies de páramo en la Cordillera de Talamanca", dict(forest_type="páramo", region="Cordillera de Talamanca")),
    (9, "Poaceae de las Llanuras de Guanacaste", dict(family="Poaceae", region="Llanuras de Guanacaste")),
    (10, "árboles endémicos del Valle Central", dict(habit="árbol", endemic=True, region="Valle Central")),
    (11, "plantas acuáticas bajo 100 m", dict(habit="acuática", elev_hi=100)),
    (12, "arbustos de bosque pluvial entre 1000 y 2000 m", dict(habit="arbusto", forest_type="pluvial", elev_lo=1000, elev_hi=2000)),
    (13, "Asteraceae endémicas de la Cordillera Central", dict(family="Asteraceae", endemic=True, region="Cordillera Central")),
    (14, "árboles de manglar", dict(habit="árbol", forest_type="manglar")),
    (15, "epífitas del bosque de roble sobre 1500 m", dict(habit="epífita", forest_type="roble", elev_lo=1500)),
    (16, "hierbas de la vertiente Caribe que florecen en marzo", dict(habit="hierba", vertiente="Caribe", flowering_month=3)),
    (17, "Melastomataceae de la Cordillera de Tilarán", dict(family="Melastomataceae", region="Cordillera de Tilarán")),
    (18, "especies endémicas de la Península de Osa - Golfito", dict(endemic=True, region="Península de Osa - Golfito")),
    (19, "árboles sobre 2500 m", dict(habit="árbol", elev_lo=2500)),
    (20, "sufrútices de bosque húmedo", dict(habit="sufrútice", forest_type="húmedo")),
    (21, "Araceae de bosque muy húmedo en la vertiente Caribe bajo 500 m", dict(family="Araceae", forest_type="muy húmedo", vertiente="Caribe", elev_hi=500)),
    (22, "arbustos endémicos que florecen en diciembre", dict(habit="arbusto", endemic=True, flowering_month=12)),
    (23, "plantas parásitas de Costa Rica", dict(habit="parásita")),
    (24, "Bromeliaceae del Valle del General", dict(family="Bromeliaceae", region="Valle del General")),
    (25, "hierbas de páramo endémicas", dict(habit="hierba", forest_type="páramo", endemic=True)),
    (26, "árboles de bosque seco en las Llanuras de Guanacaste que florecen en febrero", dict(habit="árbol", forest_type="seco", region="Llanuras de Guanacaste", flowering_month=2)),
    (27, "bejucos entre 0 y 300 m", dict(habit="bejuco", elev_lo=0, elev_hi=300)),
    (28, "Cyperaceae de la vertiente Pacífico", dict(family="Cyperaceae", vertiente="Pacífico")),
    (29, "epífitas endémicas de la Cordillera de Talamanca sobre 2000 m", dict(habit="epífita", endemic=True, region="Cordillera de Talamanca", elev_lo=2000)),
    (30, "arbustos de matorral", dict(habit="arbusto", forest_type="matorral")),
]


# ---------------------------------------------------------------- questions


def question_vocabulary(spark: SparkSession, sf_dir: str) -> dict[str, set[str]]:
    """The catalogue's vocabulary with the controlled forest types, and the values that the test questions name."""
    out = {k: set(v) for k, v in cq.vocabulary(spark, sf_dir).items()} | {"forest_type": set(es.FORESTS)}
    for _, _, gold in QUESTIONS:
        for field in ("habit", "forest_type", "vertiente", "region", "family"):
            if field in gold:
                out.setdefault(field, set()).add(gold[field])
    return out


def constraints(i: Intent) -> Column:
    """The set fields of an intent as a map of texts."""
    told = [(f, v) for f in FILTERS if (v := getattr(i, f)) is not None]
    return F.create_map(*[F.lit(str(x)) for kv in told for x in kv]) if told else F.create_map().cast("map<string,string>")


def retrieval(catalog: DataFrame, cases: list[tuple[int, Intent, Intent]]) -> DataFrame:
    """One row a case (id, gold, parsed): fields that agree, sizes of both answer sets, precision, recall, F1.

    All cases are evaluated in one pass: each species is put out under every case and side that it answers, and the sides
    of a species meet by one partial aggregation.
    """
    spark = catalog.sparkSession
    sides = []
    for key, gold, parsed in cases:
        g, p = condition(gold).cast("int"), condition(parsed).cast("int")
        sides.append(F.when((g == 1) | (p == 1), F.struct(F.lit(key).alias("id"), F.coalesce(g, F.lit(0)).alias("g"), F.coalesce(p, F.lit(0)).alias("p"))))
    hits = catalog.select("species", F.explode(F.array_compact(F.array(*sides))).alias("h")).select("species", "h.*")
    each = hits.groupBy("id", "species").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sets = each.groupBy("id").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("n_hit"))
    rows = [(key, [getattr(gold, f) == getattr(parsed, f) for f in FILTERS]) for key, gold, parsed in cases]
    fields = spark.createDataFrame(rows, "id int, same array<boolean>")
    x = fields.join(sets, "id", "left").na.fill(0, ["n_gold", "n_pred", "n_hit"])
    p, r, f1 = bands.precision_recall(F.col("n_hit"), F.col("n_pred"), F.col("n_gold"))
    right = F.size(F.filter("same", lambda s: s))
    return x.select("id", "same", (right == len(FILTERS)).alias("exact_filter"), right.alias("fields_correct"), "n_gold", "n_pred", p.alias("prec"), r.alias("rec"), f1.alias("f1"))


def _cases(spark: SparkSession, sf_dir: str) -> list[tuple[int, Intent, Intent]]:
    vocab = question_vocabulary(spark, sf_dir)
    return [(key, Intent(**gold), parse(q, vocab)) for key, q, gold in QUESTIONS]


def _sql_condition(gold: dict) -> str:
    """A gold constraint as SQL, written apart from the engine's own."""
    array = {"habit": "habits", "forest_type": "forest_types", "vertiente": "vertientes", "region": "regions", "flowering_month": "flowering_months"}
    out = [f"coalesce(list_contains({array[k]}, {v if k == 'flowering_month' else repr(v)}), false)" for k, v in gold.items() if k in array]
    if "family" in gold:
        out.append(f"coalesce(family = '{gold['family']}', false)")
    if "endemic" in gold:
        out.append(f"coalesce(endemic_cr, false) = {str(gold['endemic']).lower()}")
    if "elev_lo" in gold or "elev_hi" in gold:
        lo, hi = gold.get("elev_lo", cq._LO), gold.get("elev_hi", cq._HI)
        out.append(f"coalesce({cq._LO} IS NOT NULL AND {cq._HI} IS NOT NULL AND least({hi}, {cq._HI}) - greatest({lo}, {cq._LO}) > 0, false)")
    return " AND ".join(out) or "true"


_SETS = " UNION ALL ".join(f"SELECT {key} AS id, (SELECT count(DISTINCT species) FROM fichas WHERE {_sql_condition(gold)}) AS n" for key, _, gold in QUESTIONS)


@query(f"""SELECT id, true AS exact_filter, 9 AS fields_correct, n AS n_gold, n AS n_pred, CAST(n > 0 AS INT)::DOUBLE AS prec, CAST(n > 0 AS INT)::DOUBLE AS rec, CAST(n > 0 AS INT)::DOUBLE AS f1 FROM ({_SETS})""")
def agg_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test questions: parsed against gold constraints, and the species both select."""
    return retrieval(table(spark, sf_dir, "fichas"), _cases(spark, sf_dir)).drop("same")


@query(f"""SELECT count(*) AS n, 1.0::DOUBLE AS exact_filter, 1.0::DOUBLE AS fields, round(avg(CAST(n > 0 AS INT)::DOUBLE), 6) AS prec, round(avg(CAST(n > 0 AS INT)::DOUBLE), 6) AS rec,
round(avg(CAST(n > 0 AS INT)::DOUBLE), 6) AS f1, count(*) FILTER (n > 0) AS full_recall FROM ({_SETS})""")
def agg_retrieval_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up: exact filters, fields, mean precision, recall and F1, questions of full recall."""
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    r = retrieval(table(spark, sf_dir, "fichas"), _cases(spark, sf_dir))
    return r.agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("exact_filter").cast("double"), "exact_filter"), mean(F.col("fields_correct") / len(FILTERS), "fields"),
        mean("prec", "prec"), mean("rec", "rec"), mean("f1", "f1"), F.count(F.when(F.col("rec") == 1, 1)).alias("full_recall"),
    )


@query("SELECT field, 30 AS n_right, 30 AS n FROM (VALUES " + ", ".join(f"('{f}')" for f in FILTERS) + ") t(field)")
def agg_retrieval_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many test questions have each field right."""
    r = retrieval(table(spark, sf_dir, "fichas"), _cases(spark, sf_dir))
    each = r.select(F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in FILTERS]).alias("field"), F.col("same").alias("ok"))).alias("x")).select("x.*")
    return each.groupBy("field").agg(F.count(F.when(F.col("ok"), 1)).cast("int").alias("n_right"), F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT id, key, value FROM (VALUES " + ", ".join(f"({i}, '{k}', '{str(v)}')" for i, _, g in QUESTIONS for k, v in g.items()) + ") t(id, key, value)")
def set_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constraints that are set in each test question, as rows."""
    vocab = question_vocabulary(spark, sf_dir)
    parts = [spark.range(1).select(F.lit(key).alias("id"), F.explode(constraints(parse(q, vocab))).alias("key", "value")) for key, q, _ in QUESTIONS]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- stored values against texts


@query("""SELECT audit, count(ok) AS n, sum(CAST(ok AS INT)) AS n_ok, round(100.0 * sum(CAST(ok AS INT)) / count(ok), 4) AS pct FROM (SELECT unnest(['elevation', 'endemism', 'slope']) AS audit, unnest([elev_ok, endem_ok, slope_ok]) AS ok FROM ("""
       + cq.ORACLE["text_support"] + """)) GROUP BY audit""")
def agg_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the records that store a value, how many have it in their text."""
    told = F.array(*[F.struct(F.lit(a).alias("audit"), F.col(c).alias("ok")) for a, c in (("elevation", "elev_ok"), ("endemism", "endem_ok"), ("slope", "slope_ok"))])
    x = cq.text_support(spark, sf_dir).select(F.explode(told).alias("x")).select("x.*")
    n, ok = F.count("ok"), F.sum(F.col("ok").cast("int"))
    return x.groupBy("audit").agg(n.alias("n"), ok.alias("n_ok"), F.round(100.0 * ok / n, 4).alias("pct"))


# ---------------------------------------------------------------- answers against records


def scores(lo: Column, hi: Column, slopes: Column, regions: Column) -> dict[str, Column]:
    """An answer (lo, hi, slopes, regions) against elev_min, elev_max, vertientes and regions of its record.

    iou: 0 without both bands, or where the union is a point. mid_err: null without both. vert: whether both name the same
    slopes by their first four letters, accents kept; null where the record names none. region: share of the record's
    regions of which a word of more than four letters stands in the answer's; null where the record names none.
    """
    told = lo.isNotNull() & hi.isNotNull() & F.col("elev_min").isNotNull() & F.col("elev_max").isNotNull()
    iou = F.when(told, bands.iou(F.col("elev_min"), F.col("elev_max"), lo, hi, points_equal=0.0)).otherwise(0.0)
    key = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda v: F.substring(F.lower(v), 1, 4))))
    none = F.array().cast("array<string>")
    own, said = F.coalesce("vertientes", none), F.coalesce(slopes, none)
    names = F.array_distinct(F.transform(F.coalesce("regions", none), F.lower))
    text = F.lower(F.array_join(F.coalesce(regions, none), " "))
    found = F.filter(names, lambda r: F.exists(F.split(r, r"\s+"), lambda w: (F.length(w) > 4) & F.contains(text, w)))
    return {
        "iou": iou, "mid_err": F.when(told, F.abs((lo + hi) / 2 - (F.col("elev_min") + F.col("elev_max")) / 2)),
        "vert": F.when(F.size(own) > 0, (F.size(said) > 0) & (key(said) == key(own))), "region": F.when(F.size(names) > 0, F.size(found) / F.size(names)),
    }


def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of answers about each species against its record: an earlier parse (base), and its text (text)."""
    truth = cq.first_fichas(spark, sf_dir).where("elev_min IS NOT NULL AND NOT contains(species, ' sp. ')").select("vector_id", "species", "family", "endemic_cr", "elev_min", "elev_max", "vertientes", "regions")
    d = table(spark, sf_dir, "distribution_fichas").groupBy("species").agg(F.min_by(F.struct("dist_id", "elevation", F.col("vertientes").alias("slopes")), "dist_id").alias("d"))
    spans = table(spark, sf_dir, "entity_refs").where("canonical_name IS NOT NULL OR source_span IS NOT NULL").groupBy("dist_id").agg(F.array_sort(F.collect_list("canonical_name")).alias("canon"), F.array_sort(F.collect_list("source_span")).alias("spans"))
    base = d.select("species", "d.*").join(spans, "dist_id", "left")
    text = answers.best_texts(spark, sf_dir).select("species", es.elevation(F.col("text")).alias("e"), es.slopes(F.col("text")).alias("told"))
    x = truth.join(base, "species", "left").join(text, "species", "left")
    arms = {"base": (F.col("elevation.min_m"), F.col("elevation.max_m"), F.col("slopes"), F.col("canon")), "text": (F.col("e.lo"), F.col("e.hi"), F.col("told"), F.col("spans"))}
    cols = [c.alias(f"{arm}_{name}") for arm, a in arms.items() for name, c in scores(*a).items()]
    return x.select("vector_id", "species", "family", F.coalesce("endemic_cr", F.lit(False)).alias("endemic"), *cols)


def _score_sql(arm: str, lo: str, hi: str, slopes: str, regions: str) -> str:
    told = f"{lo} IS NOT NULL AND {hi} IS NOT NULL AND elev_max IS NOT NULL"
    key = lambda a: f"list_sort(list_distinct(list_transform({a}, lambda v: substr(lower(v), 1, 4))))"
    names = "list_distinct(list_transform(coalesce(regions, []), lambda r: lower(r)))"
    text = f"lower(array_to_string(coalesce({regions}, []), ' '))"
    return f"""CASE WHEN {told} AND greatest({hi}, elev_max) - least({lo}, elev_min) > 0 THEN greatest(0, least({hi}, elev_max) - greatest({lo}, elev_min)) / (greatest({hi}, elev_max) - least({lo}, elev_min)) ELSE 0.0 END AS {arm}_iou,
CASE WHEN {told} THEN abs(({lo} + {hi}) / 2.0 - (elev_min + elev_max) / 2.0) END AS {arm}_mid_err,
CASE WHEN len(vertientes) > 0 THEN len(coalesce({slopes}, [])) > 0 AND {key(f'coalesce({slopes}, [])')} = {key('vertientes')} END AS {arm}_vert,
CASE WHEN len({names}) > 0 THEN len(list_filter({names}, lambda r: len(list_filter(regexp_split_to_array(r, '\\s+'), lambda w: length(w) > 4 AND contains({text}, w))) > 0)) / len({names}) END AS {arm}_region"""


_SCORED = f"""(SELECT f.vector_id, f.species, f.family, coalesce(f.endemic_cr, false) AS endemic, {_score_sql('base', 'd.elevation.min_m', 'd.elevation.max_m', 'd.vertientes_', 'e.canon')}, {_score_sql('text', 't.lo', 't.hi', 's.slopes', 'e.spans')}
FROM (SELECT * FROM {cq._FIRST} WHERE elev_min IS NOT NULL AND NOT contains(species, ' sp. ')) f
LEFT JOIN (SELECT species, arg_min(dist_id, dist_id) AS dist_id, arg_min(elevation, dist_id) AS elevation, arg_min(vertientes, dist_id) AS vertientes_ FROM distribution_fichas GROUP BY species) d ON d.species = f.species
LEFT JOIN (SELECT dist_id, list(canonical_name ORDER BY canonical_name) FILTER (canonical_name IS NOT NULL) AS canon, list(source_span ORDER BY source_span) FILTER (source_span IS NOT NULL) AS spans FROM entity_refs GROUP BY dist_id) e ON e.dist_id = d.dist_id
LEFT JOIN (SELECT species, arg_max(raw_id, (coalesce(n_blocks, -1), -raw_id)) AS raw_id FROM raw_fichas WHERE distribution_paragraph IS NOT NULL GROUP BY species) b ON b.species = f.species
LEFT JOIN ({cq.ORACLE['text_elevation']}) t ON t.raw_id = b.raw_id LEFT JOIN ({cq.ORACLE['text_slopes']}) s ON s.raw_id = b.raw_id)"""
_SCORES = ("iou", "mid_err", "region")


@query("SELECT vector_id, " + ", ".join(f"round({a}_{c}, 6) AS {a}_{c}" for a in ("base", "text") for c in _SCORES) + f", base_vert, text_vert FROM {_SCORED}")
def math_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both answers about each species scored against its record."""
    return scored_answers(spark, sf_dir).select("vector_id", *[F.round(f"{a}_{c}", 6).alias(f"{a}_{c}") for a in ("base", "text") for c in _SCORES], "base_vert", "text_vert")


def _arm_sql(a: str) -> str:
    return f"round(avg({a}_iou), 6) AS {a}_iou, round(median({a}_mid_err), 4) AS {a}_mid_err, round(avg(CAST({a}_vert AS DOUBLE)), 6) AS {a}_vert, round(avg({a}_region), 6) AS {a}_region"


@query(f"SELECT endemic, count(*) AS n, {_arm_sql('base')}, {_arm_sql('text')}, round(avg(text_iou) - avg(base_iou), 6) AS iou_gain FROM {_SCORED} GROUP BY GROUPING SETS ((endemic), ())")
def agg_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources over all species, the endemic and the others: mean overlap, median midpoint error, slopes, regions."""
    x = scored_answers(spark, sf_dir)
    cols = []
    for a in ("base", "text"):
        cols += [F.round(F.avg(f"{a}_iou"), 6).alias(f"{a}_iou"), F.round(F.median(f"{a}_mid_err"), 4).alias(f"{a}_mid_err"), F.round(F.avg(F.col(f"{a}_vert").cast("double")), 6).alias(f"{a}_vert"), F.round(F.avg(f"{a}_region"), 6).alias(f"{a}_region")]
    out = x.groupingSets([[F.col("endemic")], []], F.col("endemic")).agg(F.count(F.lit(1)).alias("n"), *cols, F.round(F.avg("text_iou") - F.avg("base_iou"), 6).alias("iou_gain"))
    return out.select("endemic", "n", *[f"{a}_{c}" for a in ("base", "text") for c in ("iou", "mid_err", "vert", "region")], "iou_gain")


@query(f"SELECT vector_id, round(text_iou - base_iou, 6) AS gain FROM {_SCORED} ORDER BY round(text_iou - base_iou, 9) DESC, vector_id LIMIT 6")
def top_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six species whose text tells most more than the earlier parse."""
    gain = F.round(F.col("text_iou") - F.col("base_iou"), 9)
    return scored_answers(spark, sf_dir).orderBy(F.desc(gain), "vector_id").limit(6).select("vector_id", F.round(F.col("text_iou") - F.col("base_iou"), 6).alias("gain"))


def token_overlap(answer: Column, reference: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of the distinct words two texts share; not a model's similarity, and named apart from it."""
    words = lambda c: F.array_distinct(F.filter(F.split(es.normalized(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    a, b = words(answer), words(reference)
    return bands.precision_recall(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


_W = "list_distinct(list_filter(regexp_split_to_array(" + answers._NORM + ", '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""SELECT r.raw_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS prec, round(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END, 6) AS rec
FROM (SELECT raw_id, {_W.format("coalesce(discussion, '')")} AS a, {_W.format("coalesce(distribution_paragraph, '')")} AS b FROM raw_fichas) r""")
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each discussion that its distribution text has, too."""
    p, r, _ = token_overlap(F.col("discussion"), F.col("distribution_paragraph"))
    return table(spark, sf_dir, "raw_fichas").select("raw_id", F.round(p, 6).alias("prec"), F.round(r, 6).alias("rec"))


# ---------------------------------------------------------------- cohort


@query(f"""SELECT count(*) AS n_species, round(100.0 * avg(CAST(coalesce(t.is_synonym, false) AS INT)), 4) AS synonym_pct, round(avg(CAST(median BETWEEN xlo AND xhi AS DOUBLE)), 6) AS median_in FROM {cq._VALID} v LEFT JOIN {answers._TAXA} t ON t.name = v.species""")
def agg_synonymy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all species with a point: how many names are synonyms elsewhere."""
    v = answers.with_taxon(cq.validation(spark, sf_dir), spark, sf_dir)
    syn = F.coalesce("is_synonym", F.lit(False)).cast("int")
    return v.agg(F.count(F.lit(1)).alias("n_species"), F.round(100.0 * F.avg(syn), 4).alias("synonym_pct"), F.round(F.avg(F.col("median_in").cast("double")), 6).alias("median_in"))
