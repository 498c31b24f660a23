"""Sources: tables, question sets, correction lists, snapshots and text blocks as DataFrames with given schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frondara.functions.blocks import flattened

# Files of a corpus that hold no entries, volumes that folders number, and families of continuation files.
SKIP = r"(?i)\bFM\b|ix_xviii|vii_xvi|index|indices|clave|gimno|\.ps1|z\d[a-z]{4}"
VOLUMES = {"2": "II", "3": "III", "4": "IV", "5": "V", "6": "VI"}
#: What begins a file that names only the work: its initials.
WORK = r"^[A-Z]{3,}(?![a-z]{2})"
FAMILIES = {
    "LauraPersea": "Lauraceae", "MalpStigmaphyllon": "Malpighiaceae", "MalvaModiola": "Malvaceae", "MelaTococa": "Melastomataceae",
    "MelastoMiconia": "Melastomataceae", "MelastomHenriettella": "Melastomataceae",
}
GAZETTEER = "canonical_name string, hierarchy_level string, target_shapefile string, target_attribute string, target_value string, aliases string"


def corpus_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, volume, family) of the content files below ``pattern`` in the order of their paths; contents aren't read.

    The volume is told by the folder (``Vol IV``, ``...v3``), null for an unknown one; a file without a family of its own is named by its volume.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    parts = F.split(F.regexp_replace("path", "%20", " "), "/")
    name = F.element_at(parts, -1)
    folder = F.element_at(parts, -2)
    number = F.regexp_extract(folder, r"v(\d)\b", 1)
    roman = F.regexp_extract(folder, r"\bVol\.? ([IVX]+)\b", 1)
    known = F.create_map(*[F.lit(x) for kv in VOLUMES.items() for x in kv])
    volume = F.when(roman.isin(list(VOLUMES.values())), roman).otherwise(known[number])
    own = family_from_file(name)
    family = F.when(own != "", own).otherwise(F.concat(F.lit("Vol "), F.coalesce(volume, F.lit("?"))))
    return files.where(~name.rlike(SKIP)).select("path", "length", volume.alias("volume"), family.alias("family")).orderBy("path")


def family_from_file(name: Column) -> Column:
    """The family in a file name such as ``01 Araceae.pdf``; empty where it only names the work."""
    stem = F.regexp_extract(F.regexp_replace(name, r"^\d+\s*", ""), r"^([\p{L}_]+)", 1)
    known = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.when(stem.rlike(WORK), "").otherwise(F.coalesce(known[stem], stem))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer CSV, nulls as empty text."""
    return spark.read.csv(path, header=True, schema=GAZETTEER).na.fill("")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """(raw, corrected) pairs, ``#`` lines skipped, longest first."""
    return spark.read.csv(path, header=True, schema="raw string, corrected string", comment="#").orderBy(F.length("raw").desc(), "raw")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """One row a question of a JSON file ``{"queries": [...]}``."""
    return spark.read.json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def snapshot_species(spark: SparkSession, path: str) -> DataFrame:
    """The species column of an occurrence snapshot: tab-separated text, plain, compressed, or in a zip archive.

    Bad lines are dropped. Files of an archive are read line by line in the task that holds it, never whole; an archive
    can't be divided, so a large snapshot should be kept unpacked.
    """
    if not path.endswith(".zip"):
        return spark.read.csv(path, sep="\t", header=True, mode="DROPMALFORMED").select("species")
    archives = spark.sparkContext.binaryFiles(path)

    def rows(item):
        import csv
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(item[1])) as z:
            for name in z.namelist():
                if name.endswith((".csv", ".tsv", ".txt")):
                    with z.open(name) as f:
                        lines = csv.reader(io.TextIOWrapper(f, "utf-8", newline=""), delimiter="\t", quoting=csv.QUOTE_NONE)
                        head = next(lines, [])
                        if "species" in head:
                            at, width = head.index("species"), len(head)
                            yield from ((x[at] or None,) for x in lines if len(x) == width)

    return spark.createDataFrame(archives.flatMap(rows), "species string")


def reading_order(blocks: DataFrame, titles: str = r"^\d+\s+Manual de|^[A-Z]{3,}v\d|^Manual de [\p{L} ]+$") -> DataFrame:
    """Blocks (page, x0, y0, text, page_height) in reading order, with ``seq``.

    Running heads by ``titles``, and short blocks at the page's edges, are left out. A page is one unit of order, so pages
    are sorted side by side.
    """
    text = flattened(F.col("text"))
    edge = (F.length(text) < 40) & ((F.col("y0") < 100) | (F.col("y0") > F.col("page_height") - 80))
    w = Window.partitionBy("page").orderBy(F.bround("y0"), "x0")
    return blocks.where(~edge & (text != "") & ~text.rlike(titles)).withColumn("seq", F.row_number().over(w)).withColumn("text", text)
