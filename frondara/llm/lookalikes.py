"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import re
import unicodedata as u
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Letters of other scripts and styles, and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌаеѕіјорсухһԁԛԝґӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGaesijopcyxhdqwrl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜονικρυχγϲϳα"
GREEK_AS = "ABEZHIKMNOPTYXFovikpuxycja"
PHONETIC = "ɑɡıɩʏʀɴʜʟᴀʙᴄᴅᴇɢᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜱȷɪ"
PHONETIC_AS = "agiiyrnhlabcdegjkmoptuvwzsji"
ARMENIAN = "օսոհցզԼՏՕ"
ARMENIAN_AS = "ounhgqLSO"
DASHES = "‐‑‒―−﹣⁃"
DASHES_AS = "-------"
#: Characters with a compatibility decomposition that are usual ones all the same.
USUAL = "ªº¬·–—"
#: Greek letters that are taken for Latin ones even where they stand alone, since as Spanish words they would.
LONE_LATIN = "ο"


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    """Character -> the Latin letter it looks like."""
    pairs = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (PHONETIC, PHONETIC_AS), (ARMENIAN, ARMENIAN_AS), (DASHES, DASHES_AS))
    out: dict[str, str] = {}
    for a, b in pairs:
        if len(a) != len(b):
            raise ValueError("look-alike lists of unequal length")
        out |= dict(zip(a, b))
    return out


def _invisible(c: str) -> bool:
    n = ord(c)
    return u.category(c) == "Cf" or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or n in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)


@lru_cache(maxsize=1 << 16)
def decomposed(c: str) -> str:
    """What a character is made of; itself where it is its own."""
    if c < "\x80" or "\ud800" <= c <= "\udfff" or c in USUAL:
        return c
    if _invisible(c):
        return ""
    if u.category(c) == "Zs":
        return " "
    if c in "\u2028\u2029":
        return "\n"
    to = u.normalize("NFKD", c)
    if to != c and to[0] == " ":
        return c
    same = lookalikes()
    return "".join(same.get(x, x) for x in to)


@lru_cache(maxsize=1)
def decompositions() -> dict[str, str]:
    """Character -> what it is made of, of every character that isn't its own: by rule from the Unicode database."""
    made = decomposed.__wrapped__
    return {c: to for n in range(0x80, 0x110000) if (to := made(c := chr(n))) != c}


@lru_cache(maxsize=1)
def apart() -> dict[str, str]:
    """Letter and the spacing accent written after it -> the mark, where both compose."""
    same = lookalikes()
    accents = {c: d[1] for n in range(0x80, 0x10000) if not 0xD800 <= n <= 0xDFFF and len(d := u.normalize("NFKD", c := chr(n))) == 2 and d[0] == " " and u.combining(d[1])}
    letters = [c for n in range(0x41, 0x250) if (c := chr(n)).isalpha() and c not in USUAL] + [c for c in same if c.isalpha()]
    out: dict[str, str] = {}
    for c in letters:
        base = u.normalize("NFC", decomposed(c))
        out |= {c + a: m for a, m in accents.items() if decomposed(a) == a and len(u.normalize("NFC", base + m)) == len(base)}
    return out


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Base with its marks in canonical order -> the composed character."""
    out: dict[str, str] = {}
    for n in range(0xC0, 0x2FFFF):
        c = chr(n)
        if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3:
            continue
        parts = u.normalize("NFD", c)
        if len(parts) > 1 and u.normalize("NFC", c) == c:
            out[parts] = c
    return out


def _lone_greek(c: str, before: str, after: str) -> bool:
    return "Α" <= c <= "ω" and c.islower() and c not in LONE_LATIN and not before.isalpha() and not after.isalpha()


#: Anything but ASCII and characters that are their own form whatever stands beside them.
UNUSUAL = r"[^\x00-\x7fáéíóúüñÁÉÍÓÚÜÑªº¬·–—¿¡]"
_UNUSUAL = re.compile(UNUSUAL)


def unify(text: str) -> str:
    """The same form for one string in Python, for stages that follow on it; compared with the operator in the tests."""
    if not _UNUSUAL.search(text):
        return text
    accents = apart()
    out = []
    for i, c in enumerate(text):
        if i and text[i - 1 : i + 1] in accents:
            out.append(accents[text[i - 1 : i + 1]])
        elif _lone_greek(c, text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "):
            out.append(c)
        else:
            out.append(decomposed(c))
    return u.normalize("NFC", "".join(out))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mappings as tables; their size is bounded by Unicode."""
    marks = [(chr(n), u.combining(chr(n))) for n in range(0x300, 0x1E950) if u.combining(chr(n))]
    return (
        spark.createDataFrame(list(decompositions().items()), "_ch string, _to string"),
        spark.createDataFrame(marks, "_c string, _ccc int"),
        spark.createDataFrame(list(compositions().items()), "_cluster string, _composed string"),
    )


def unified(df: DataFrame, text_col: str, out_col: str = "unified") -> DataFrame:
    """``df`` with ``out_col``, the one consistent form of ``text_col``.

    Every distinct text with a character that may not be its own form is exploded to positioned code points, which are joined with the
    decomposition and look-alike mapping; combining marks are put in the order of their classes, bases and marks
    composed again, and the text rebuilt. Texts of ASCII and usual composed letters only are their own form, null stays null,
    the empty text stays empty. A spacing accent after a letter with which it composes is its mark. A lowercase Greek letter
    that stands alone is kept. Repeated texts are worked on once. All other columns are kept, whatever their names.
    """
    spark = df.sparkSession
    to, marks, composed = _tables(spark)
    key = [F.xxhash64(F.col(text_col)).alias("_h1"), F.xxhash64(F.reverse(F.col(text_col)), F.lit(7)).alias("_h2")]
    texts = df.select(F.col(text_col).alias("_text")).where(F.col("_text").rlike(UNUSUAL))
    texts = texts.distinct().select(F.xxhash64("_text").alias("_h1"), F.xxhash64(F.reverse("_text"), F.lit(7)).alias("_h2"), "_text")
    points = texts.select("_h1", "_h2", F.posexplode(F.split("_text", "")).alias("_pos", "_ch")).where(F.col("_ch") != "")
    by_text = Window.partitionBy("_h1", "_h2").orderBy("_pos")
    letter = r"^\p{L}$"
    points = points.withColumn("_before", F.lag("_ch").over(by_text)).withColumn("_after", F.lead("_ch").over(by_text))
    alone = ~F.coalesce(F.col("_before").rlike(letter), F.lit(False)) & ~F.coalesce(F.col("_after").rlike(letter), F.lit(False))
    lone_greek = F.col("_ch").rlike("^[α-ω]$") & ~F.col("_ch").isin(list(LONE_LATIN)) & alone
    points = points.join(F.broadcast(to), "_ch", "left").withColumn("_to", F.when(lone_greek | F.col("_to").isNull(), F.col("_ch")).otherwise(F.col("_to")))
    accents = {pair[1]: mark for pair, mark in apart().items()}
    separate = F.concat("_before", "_ch").isin(list(apart()))
    points = points.withColumn("_to", F.when(separate, F.translate("_ch", "".join(accents), "".join(accents.values()))).otherwise(F.col("_to")))
    # An accented letter that is usual is taken apart here and composed again below, like any other.
    parts = points.select("_h1", "_h2", "_pos", F.posexplode(F.split("_to", "")).alias("_sub", "_c")).where(F.col("_c") != "")
    parts = parts.join(F.broadcast(marks), "_c", "left").withColumn("_ccc", F.coalesce("_ccc", F.lit(0)))
    in_order = Window.partitionBy("_h1", "_h2").orderBy("_pos", "_sub")
    parts = parts.withColumn("_start", F.sum((F.col("_ccc") == 0).cast("int")).over(in_order))
    ordered = F.array_sort(F.collect_list(F.struct("_ccc", "_pos", "_sub", "_c")))
    clusters = parts.groupBy("_h1", "_h2", "_start").agg(F.array_join(ordered["_c"], "").alias("_cluster"))
    clusters = clusters.join(F.broadcast(composed), "_cluster", "left")
    two = composed.select(F.col("_cluster").alias("_two"), F.col("_composed").alias("_first"))
    clusters = clusters.withColumn("_two", F.when(F.col("_composed").isNull() & (F.length("_cluster") > 2), F.substring("_cluster", 1, 2)))
    clusters = clusters.join(F.broadcast(two), "_two", "left")
    piece = F.coalesce("_composed", F.concat("_first", F.expr("substring(_cluster, 3)")), "_cluster")
    rebuilt = clusters.groupBy("_h1", "_h2").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_start", piece.alias("_s"))))["_s"], "").alias(out_col))
    rebuilt = texts.select("_h1", "_h2").join(rebuilt, ["_h1", "_h2"], "left").withColumn(out_col, F.coalesce(out_col, F.lit("")))
    changed = F.coalesce(F.col(text_col).rlike(UNUSUAL), F.lit(False))
    return df.withColumns({"_h1": F.when(changed, key[0]), "_h2": F.when(changed, key[1])}).join(rebuilt, ["_h1", "_h2"], "left").withColumn(
        out_col, F.when(changed, F.col(out_col)).otherwise(F.col(text_col))
    ).drop("_h1", "_h2")
