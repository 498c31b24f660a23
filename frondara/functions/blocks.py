"""Text blocks of a flora: what kind each is, and the parts of a species header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open a distribution, a description, and sentences that only look like a species name.
HABITATS = "Bosque Sabana Manglar Páramo Charral Vegetaci Matorral Pastizal".split()
GROWTH = "Arbusto Árbol Arbol Hierba Bejuco Liana Epífit Hemiep Sufrút Planta Hojas".split()
NO_GENUS = (
    "Bosque Se Las Los El La En Por Como Esta Este Arbusto Árbol Arbol Hierba Bejuco Liana Planta Plantas Hojas Fls Frs Infl Infls Lámina Láminas "
    "Yemas Ramitas Vegetativamente Entre Sin Con Burger Werff"
).split()
#: Titles that running heads print, besides a page number in front.
TITLES = ["Manual de"]
#: Characters of a header in which its place of publication stands.
HEAD = 140

_LOW = "a-záéíóúñ"


def flattened(text: Column) -> Column:
    """One line: no control characters, words broken at line ends joined, blanks single."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[-­]\r?\n", ""), r"\s+", " "))


def opens_with(block: Column, words: list[str]) -> Column:
    """Whether the block begins with one of the words, or of their beginnings."""
    return block.rlike("^(?:" + "|".join(words) + ")")


def _parts(block: Column) -> tuple[Column, Column, Column]:
    """(genus, number of an unnamed species, epithet) that a block begins with; empty where it doesn't."""
    return (
        F.regexp_extract(block, rf"^(\p{{Lu}}[{_LOW}-]+)\s", 1), F.regexp_extract(block, r"^\S+\s+(sp\.\s*\d+)", 1),
        F.regexp_extract(block, rf"^\S+\s+([{_LOW}-]{{3,}})(?![\p{{L}}\p{{N}}_])", 1),
    )


def opens_entry(block: Column) -> Column:
    """Whether a block opens an entry: ``Genus sp. 3``, or a binomial with a volume, a page and a year within HEAD characters."""
    genus = rf"^\p{{Lu}}[{_LOW}-]+\s+"
    front = F.substring(block, 1, HEAD)
    cited = front.rlike(r"\d(\(\d+[a-z]?\))?:\s*\d") & front.rlike(r"(?:1[6-9]|20)\d\d")
    named = block.rlike(genus + rf"[{_LOW}-]{{3,}}(?![\p{{L}}\p{{N}}_])") & ~block.rlike("^(?:" + "|".join(NO_GENUS) + r")\s")
    return block.rlike(genus + r"sp\.\s*\d") | (named & cited)


def header(block: Column) -> Column:
    """Struct (genus, species, authority) of a block that opens an entry, else null; the authority runs to the first full
    stop after the binomial."""
    genus, number, epithet = _parts(block)
    authority = F.regexp_replace(F.regexp_extract(block, rf"^\S+\s+[{_LOW}-]+([^.]*)", 1), "^[ ,]+|[ ,]+$", "")
    unnamed = number != ""
    name = F.when(unnamed, number).otherwise(epithet)
    return F.when(opens_entry(block), F.struct(genus.alias("genus"), F.concat_ws(" ", genus, name).alias("species"), F.when(unnamed, "").otherwise(authority).alias("authority")))


def is_distribution(block: Column) -> Column:
    """An elevation, no description's opening, and a slope, an endemism or a habitat's opening."""
    elevation = block.rlike(r"(?:\d[\s().+?–—-]*)+m(?![\p{L}\p{N}_])")
    cue = F.contains(block, F.lit("vert.")) | F.contains(block, F.lit("verts.")) | block.rlike(r"ambas\s+vert|END[ÉE]MIC")
    return elevation & ~opens_with(block, GROWTH) & (cue | opens_with(block, HABITATS))


def is_furniture(block: Column) -> Column:
    """A page number before a title, or nothing but a title."""
    out = F.lit(False)
    for t in TITLES:
        out = out | block.rlike(rf"^\d+\s+{t}")
    return out


def is_key(block: Column) -> Column:
    """A row of an identification key: leader dots, or a number in front."""
    return F.contains(block, F.lit("....")) | F.contains(block, F.lit(". . .")) | block.rlike(r"^\d\d?\s+\S")


def kind(block: Column) -> Column:
    """header, distribution, furniture, key, morphology or other."""
    return (
        F.when(is_furniture(block), "furniture").when(opens_entry(block), "header").when(is_distribution(block), "distribution")
        .when(is_key(block), "key").when(opens_with(block, GROWTH), "morphology").otherwise("other")
    )
