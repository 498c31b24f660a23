"""Queries of the llm problems over the flora tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frondara.llm import gazetteer, leaks, lookalikes, matching, percentiles, scans, tokens
from frondara.session import broadcast_if_small, table

PROBS, NAMES = (0.05, 0.25, 0.5, 0.75, 0.95), ("p05", "p25", "p50", "p75", "p95")


def _altitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a usable altitude: not null, not NaN, not below -500."""
    points = table(spark, sf_dir, "points")
    return points.where(percentiles.usable(F.col("altitud")) & (F.col("altitud") >= -500))


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of altitude per species, by four passes."""
    named = _altitudes(spark, sf_dir).where(F.col("species").isNotNull())
    out = percentiles.radix_percentiles(named, ["species"], "altitud", PROBS, NAMES)
    return out.select("species", "n", *[F.round(c, 6).alias(c) for c in NAMES])


def p1_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per species from histograms of each load day, within a factor of 2**-20."""
    daily = _altitudes(spark, sf_dir).where(F.col("species").isNotNull()).withColumn("load_day", F.to_date("loaded_at"))
    return percentiles.merged_percentiles(percentiles.histograms(daily, ["species"], "load_day", "altitud"), ["species"], PROBS, NAMES)


def p1_day_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles from the days' histograms lie within 2**-20 of the exact ones, per species."""
    exact = p1_percentiles(spark, sf_dir).select("species", *[F.col(c).alias("x" + c) for c in NAMES])
    both = p1_by_day(spark, sf_dir).join(exact.hint("merge"), "species")
    near = [F.abs(F.col(c) - F.col("x" + c)) <= F.abs(F.col("x" + c)) * 2.0**-20 + 2e-6 for c in NAMES]
    return both.select("species", "n", *[x.alias(c + "_ok") for x, c in zip(near, NAMES)])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species of range_width whose stored median_in contradicts the median of their points' usable altitudes."""
    said = F.lower(F.trim("median_in"))
    stored = table(spark, sf_dir, "range_width").where(F.col("median_in").isNotNull()).select(
        "species",
        F.when(said.isin("true", "t", "yes", "1"), True).when(said.isin("false", "f", "no", "0"), False).alias("said"),
        F.regexp_extract("manual_ext", r"^\s*(-?[\d.]+)\s*[-–]\s*(-?[\d.]+)", 1).try_cast("double").alias("lo"),
        F.regexp_extract("manual_ext", r"^\s*(-?[\d.]+)\s*[-–]\s*(-?[\d.]+)", 2).try_cast("double").alias("hi"),
    )
    rows = _altitudes(spark, sf_dir).select("species", "altitud").join(broadcast_if_small(stored.select("species")), "species", "left_semi")
    medians = percentiles.radix_percentiles(rows, ["species"], "altitud", [0.5], ["median"], levels=2)
    return stored.join(medians, "species").where(F.col("said") != F.col("median").between(F.col("lo"), F.col("hi"))).select("species")


P2_FIELDS = (("raw_fichas", "raw_id", "distribution_paragraph"), ("raw_fichas", "raw_id", "header_block"), ("distribution_fichas", "dist_id", "habitat_raw"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, rec_id, clean, kinds): continuous readable text of the three fields."""
    parts = [table(spark, sf_dir, t).select(F.lit(c).alias("field"), F.col(i).alias("rec_id"), F.col(c).alias("text")) for t, i, c in P2_FIELDS]
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return scans.readable(texts, ("habitat_raw",)).select("field", "rec_id", "clean", "kinds")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each kind of scanning trace that a text has."""
    return p2_clean(spark, sf_dir).select("field", "rec_id", F.explode("kinds").alias("kind")).distinct()


P4_FIELDS = (("fichas", "ficha_id", "species"), ("entity_refs", "ref_id", "canonical_name"), ("distribution_fichas", "dist_id", "habitat_raw"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, rec_id, text, unified) of every non-null text of the three fields."""
    texts = None
    for name, rec, col in P4_FIELDS:
        part = table(spark, sf_dir, name).where(F.col(col).isNotNull()).select(F.lit(col).alias("field"), F.col(rec).alias("rec_id"), F.col(col).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    return lookalikes.unified(texts, "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a character that is not the usual one for what is seen: those whose form differs."""
    return p4_forms(spark, sf_dir).where(F.col("text") != F.col("unified")).select("field", "rec_id")


#: Confidence from which a pair counts as found.
MATCH_CONFIDENCE = 0.5


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ficha_id, taxon_key, confidence) of all candidate pairs."""
    fichas = {"rec": "ficha_id", "name": "species", "authority": "authority", "synonyms": "synonyms", "family": "family"}
    taxa = {"rec": "taxon_key", "name": "scientific_name", "authority": "authorship", "synonyms": "other_names", "family": "family"}
    out = matching.match_names(table(spark, sf_dir, "fichas"), table(spark, sf_dir, "taxon_backbone"), fichas, taxa)
    return out.select(F.col("left").alias("ficha_id"), F.col("right").alias("taxon_key"), "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that name the same species."""
    return p5_pairs(spark, sf_dir).where(F.col("confidence") >= MATCH_CONFIDENCE).select("ficha_id", "taxon_key")


REGION_LEVELS = ["cordillera", "llanura", "valle", "península", "fila", "other"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, rec_id, pos, value, levels) of all typed place names; a row without a level may have any."""
    refs = table(spark, sf_dir, "entity_refs").select(
        F.lit("source_span").alias("field"), F.col("ref_id").alias("rec_id"), F.lit(0).alias("pos"), F.col("source_span").alias("value"),
        F.when(F.col("hierarchy_level").isNotNull(), F.array("hierarchy_level")).alias("levels"),
    )
    regions = table(spark, sf_dir, "fichas").select(F.lit("regions").alias("field"), F.col("ficha_id").alias("rec_id"), F.posexplode("regions").alias("pos", "value"))
    return refs.unionByName(regions.withColumn("levels", F.array(*[F.lit(x) for x in REGION_LEVELS])))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry, or -1, of every typed place name that is not letter for letter a canonical name."""
    names = table(spark, sf_dir, "gazetteer")
    return gazetteer.map_values(gazetteer.not_canonical(_typed(spark, sf_dir), names), names).select("field", "rec_id", "pos", "gaz_id")


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, gaz_id, canonical_name) of every entity_refs row with a source_span, the name put right; null where no entry is meant."""
    names = table(spark, sf_dir, "gazetteer")
    mapped = gazetteer.map_values(_typed(spark, sf_dir).where((F.col("field") == "source_span") & F.col("value").isNotNull()), names)
    return mapped.join(broadcast_if_small(names.select("gaz_id", "canonical_name")), "gaz_id", "left").select(F.col("rec_id").alias("ref_id"), "gaz_id", "canonical_name")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a held-out passage or a long run of it; each pair once."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).distinct()


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents over the limit."""
    return tokens.pieces(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_percentiles": p1_percentiles, "p1_by_day": p1_by_day, "p1_day_error": p1_day_error, "p2_found": p2_found, "p2_clean": p2_clean, "p4_found": p4_found, "p4_forms": p4_forms, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_found": p6_found, "p6_canonical": p6_canonical, "p8_ids": p8_ids, "p9_found": p9_found, "p10_pieces": p10_pieces,
}

_ALT = "altitud IS NOT NULL AND NOT isnan(altitud) AND altitud >= -500"
ORACLE = {
    "p1_percentiles": "SELECT species, count(*) AS n, " + ", ".join(f"round(quantile_cont(altitud, {p}), 6) AS {n}" for p, n in zip(PROBS, NAMES))
    + f" FROM points WHERE species IS NOT NULL AND {_ALT} GROUP BY species",
    "p1_day_error": "SELECT species, count(*) AS n, " + ", ".join(f"true AS {n}_ok" for n in NAMES) + f" FROM points WHERE species IS NOT NULL AND {_ALT} GROUP BY species",
    "p1_found": f"""SELECT r.species FROM range_width r JOIN (SELECT species, median(altitud) AS m FROM points WHERE {_ALT} GROUP BY species) p
ON p.species = r.species WHERE r.median_in IS NOT NULL AND (lower(trim(r.median_in)) = 'true')
<> (p.m BETWEEN CAST(split_part(r.manual_ext, '-', 1) AS DOUBLE) AND CAST(split_part(r.manual_ext, '-', 2) AS DOUBLE))""",
}
