"""Entries from text blocks in reading order: headers open them, and they run on over page ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frondara.functions import blocks as b
from frondara.operators import ordered
from frondara.plans.registry import registry
from frondara.session import table

QUERIES, ORACLE, query = registry()


def block_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume, page, raw_id, seq, block): the blocks of each volume, one line each; a volume is one document."""
    raw = table(spark, sf_dir, "raw_fichas")
    parts = raw.select("volume", "page", "raw_id", F.posexplode(F.array("header_block", "morphology", "distribution_paragraph", "discussion")).alias("seq", "block"))
    return parts.withColumn("block", b.flattened(F.col("block"))).where("block <> ''")


def entries(stream: DataFrame, part: str, order: list[str]) -> DataFrame:
    """(part, session, position columns, block, kind, head): each block with the number of its entry in the document.

    Blocks before the first header are entry 0, the preamble.
    """
    placed = ordered.running(stream, part, order, b.opens_entry(F.col("block")))
    x = placed.withColumn("kind", b.kind(F.col("block"))).where("kind <> 'furniture'")
    return x.withColumn("head", F.when(F.col("kind") == "header", b.header(F.col("block"))))


def segmented(stream: DataFrame, part: str, order: list[str]) -> DataFrame:
    """One row an entry: species, authority, genus, n_blocks, morphology, distribution, discussion, where it begins.

    The first distribution, the first description, and as discussion the first other block after the distribution; rows
    of keys count nowhere; entries of the preamble are left out.
    """
    at = F.struct(*[F.col(c) for c in order])
    x = entries(stream, part, order).where("session > 0").withColumn("at", at)
    body = F.col("kind").isin("distribution", "morphology", "other")
    w = Window.partitionBy(part, "session")
    x = x.withColumn("dist_at", F.min(F.when(F.col("kind") == "distribution", F.col("at"))).over(w)).withColumn("morph_at", F.min(F.when(F.col("kind") == "morphology", F.col("at"))).over(w))
    later = body & (F.col("at") > F.col("dist_at")) & (F.col("morph_at").isNull() | (F.col("at") != F.col("morph_at")))
    first = lambda c: F.min_by(F.when(c, F.col("block")), F.when(c, F.col("at")))
    e = x.groupBy(part, "session").agg(
        F.max("head").alias("head"), F.min("at").alias("at"), F.count(F.when(body, 1)).alias("n_blocks"), first(F.col("at") == F.col("morph_at")).alias("morphology"),
        first(F.col("at") == F.col("dist_at")).alias("distribution"), first(later).alias("discussion"),
    )
    return e.select(part, "session", "at.*", "head.species", "head.genus", "head.authority", "n_blocks", "morphology", "distribution", "discussion")


def deduplicated(found: DataFrame, part: str, order: list[str]) -> DataFrame:
    """The richest entry of each species and document: with a distribution, most blocks, first; entries without any block go."""
    best = [F.col("distribution").isNotNull().desc(), F.col("n_blocks").desc(), *order]
    return ordered.best_of(found.where("n_blocks > 0"), [part, "species"], best)


ORDER = ["page", "raw_id", "seq"]
_SPACED = "trim(regexp_replace(regexp_replace(regexp_replace(block, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g'), '[-­]\\r?\\n', '', 'g'), '\\s+', ' ', 'g'))"
_STREAM = f"""(SELECT * FROM (SELECT volume, page, raw_id, seq, {_SPACED} AS block FROM (SELECT volume, page, raw_id, unnest(range(4)) AS seq, unnest([header_block, morphology, distribution_paragraph, discussion]) AS block FROM raw_fichas)) WHERE block <> '')"""
_OPEN = lambda words: "(" + " OR ".join(f"starts_with(block, '{w}')" for w in words) + ")"
_NAMED = f"""regexp_matches(block, '^[A-ZÁÉÍÓÚÑ][a-záéíóúñ-]+\\s') AND NOT list_contains([{', '.join(repr(w) for w in b.NO_GENUS)}], split_part(block, ' ', 1)) AND regexp_matches(block, '^\\S+\\s+[a-záéíóúñ-]{{3,}}([^\\p{{L}}\\p{{N}}_]|$)')
AND regexp_matches(substr(block, 1, 140), '\\d(\\(\\d+[a-z]?\\))?:\\s*\\d') AND regexp_matches(substr(block, 1, 140), '(1[6-9]|20)\\d\\d')"""
_KIND = f"""CASE WHEN regexp_matches(block, '^\\d+\\s+Manual de') THEN 'furniture' WHEN regexp_matches(block, '^[A-ZÁÉÍÓÚÑ][a-záéíóúñ-]+\\s+sp\\.\\s*\\d+') OR ({_NAMED}) THEN 'header'
WHEN regexp_matches(block, '\\d[\\d\\s().+?–—-]*m([^\\p{{L}}\\p{{N}}_]|$)') AND NOT {_OPEN(b.GROWTH)} AND (regexp_matches(block, 'verts?\\.|ambas\\s+vert|END[ÉE]MIC') OR {_OPEN(b.HABITATS)}) THEN 'distribution'
WHEN contains(block, '....') OR contains(block, '. . .') OR regexp_matches(block, '^\\d\\d?\\s+\\S') THEN 'key' WHEN {_OPEN(b.GROWTH)} THEN 'morphology' ELSE 'other' END"""
_ENTRIES = f"(SELECT *, sum(CAST(kind = 'header' AS INT)) OVER (PARTITION BY volume ORDER BY page, raw_id, seq) AS session FROM (SELECT *, {_KIND} AS kind FROM {_STREAM}) WHERE kind <> 'furniture')"
_SEGMENTS = f"""(SELECT volume, session, min(page * 1e12 + raw_id * 10 + seq) AS at_, any_value(CASE WHEN kind = 'header' THEN CASE WHEN regexp_matches(block, '^\\S+\\s+sp\\.\\s*\\d') THEN regexp_extract(block, '^\\S+\\s+sp\\.\\s*\\d+') ELSE split_part(block, ' ', 1) || ' ' || regexp_extract(block, '^\\S+\\s+([a-záéíóúñ-]+)', 1) END END) AS species,
any_value(CASE WHEN kind = 'header' THEN CASE WHEN regexp_matches(block, '^\\S+\\s+sp\\.\\s*\\d') THEN '' ELSE trim(regexp_extract(block, '^\\S+\\s+[a-záéíóúñ-]+([^.]*)', 1), ' ,') END END) AS authority,
count(CASE WHEN kind IN ('distribution', 'morphology', 'other') THEN 1 END) AS n_blocks, min(CASE WHEN p = morph_at THEN block END) AS morphology, min(CASE WHEN p = dist_at THEN block END) AS distribution,
arg_min(block, p) FILTER (kind IN ('distribution', 'morphology', 'other') AND p > dist_at AND p IS DISTINCT FROM morph_at) AS discussion
FROM (SELECT *, min(CASE WHEN kind = 'distribution' THEN p END) OVER w AS dist_at, min(CASE WHEN kind = 'morphology' THEN p END) OVER w AS morph_at FROM (SELECT *, page * 1e12 + raw_id * 10 + seq AS p FROM {_ENTRIES} WHERE session > 0) WINDOW w AS (PARTITION BY volume, session)) GROUP BY volume, session)"""


@query(f"SELECT raw_id, seq, kind FROM (SELECT *, {_KIND} AS kind FROM {_STREAM})")
def filter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every text block."""
    return block_stream(spark, sf_dir).select("raw_id", "seq", b.kind(F.col("block")).alias("kind"))


@query(f"SELECT volume, raw_id, seq, session FROM {_ENTRIES}")
def win_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of every block of a volume, counted over page ends."""
    return entries(block_stream(spark, sf_dir), "volume", ORDER).select("volume", "raw_id", "seq", "session")


@query(f"SELECT volume, session, species, authority, n_blocks, morphology, distribution, discussion FROM {_SEGMENTS}")
def comp_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their header's parts and their sections."""
    return segmented(block_stream(spark, sf_dir), "volume", ORDER).select("volume", "session", "species", "authority", "n_blocks", "morphology", "distribution", "discussion")


@query(f"SELECT volume, species, session, n_blocks FROM (SELECT *, row_number() OVER (PARTITION BY volume, species ORDER BY distribution IS NOT NULL DESC, n_blocks DESC, at_) AS rn FROM {_SEGMENTS} WHERE n_blocks > 0) WHERE rn = 1")
def win_best_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest entry of each species of a volume; headers with nothing below them are left out."""
    return deduplicated(segmented(block_stream(spark, sf_dir), "volume", ORDER), "volume", ORDER).select("volume", "species", "session", "n_blocks")


@query("""SELECT raw_id, CASE WHEN g.genus = genus_ THEN g.text END AS genus_text FROM (SELECT raw_id, genus AS genus_, last_value(CASE WHEN genus_description <> '' THEN struct_pack(genus := genus, text := genus_description) END IGNORE NULLS)
OVER (PARTITION BY volume ORDER BY page, raw_id ROWS UNBOUNDED PRECEDING) AS g FROM raw_fichas)""")
def win_genus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of its genus for each entry: the last one given in the volume, if it is of the same genus."""
    raw = table(spark, sf_dir, "raw_fichas").select("raw_id", "volume", "page", "genus", "genus_description")
    told = F.when(F.col("genus_description") != "", F.struct("genus", F.col("genus_description").alias("text")))
    out = ordered.running(raw, "volume", ["page", "raw_id"], states={"told": told})
    return out.select("raw_id", F.when(F.col("told.genus") == F.col("genus"), F.col("told.text")).alias("genus_text"))

