"""Places of a distribution text as rows: kind, name, side, slope in force, what brackets say.

A text is read from left to right. A slope marker holds until the next one. A clause ends at a semicolon, or at a comma
after which a new place begins; brackets hold everything inside together. A place begins with the word for its kind, or is
known to the gazetteer; its names may be a list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frondara.functions.spanish import ACCENTS, FEATURES

# Markers of slopes, sides, protected areas, and the kinds that gazetteer levels stand for.
SLOPES = {"ambas": r"ambas\s+verts?\.?", "Caribe": r"vert(?:iente)?\.?\s+carib\w*\.?|carib(?:eña|eno)\b", "Pacífico": r"vert(?:iente)?\.?\s+pac\w*\.?"}
SIDES = {"norte": "N", "sur": "S", "este": "E", "oeste": "O"} | {s.lower(): s for s in ("N", "S", "E", "O", "NO", "NE", "SE", "SO")}
AREAS = "P\\.?N\\.?|R\\.?B\\.?|Z\\.?P\\.?|A\\.?N\\.?|R\\.?F\\.?|R\\.?N\\.?A\\.?|R\\.?N\\.?|Parque (?:Nacional|Internacional)|Reserva (?:Biol[óo]gica|Forestal|Natural Absoluta|Natural)|Zona Protectora"
LEVEL_KINDS = {"cordillera": "cordillera", "llanura": "llanura", "valle": "valle", "fila": "fila", "península": "peninsula", "other": "region_informal", "park": "area_protegida"}
#: Least letters of a name that is looked up, and of a locality that counts as unresolved.
LEAST_NAME = 4

_MARK = [(name, re.compile(rf"(?:(?:[NSEO]{{1,2}}|centro|central)\.?\s+)?(?:{p})", re.I)) for name, p in SLOPES.items()]
_SIDE = re.compile(r"(?:(?:al|lado|falda|parte)\s+)?(" + "|".join(sorted(SIDES, key=len, reverse=True)) + r")\b\.?\s+(?:de\s+(?=\S))?", re.I)
_OF = r"(?:\s+del?(?:\s+l[aeo]s?)?)?"
_KIND = [(k, re.compile(rf"(?<!\w)(?:{p}){_OF}\s+", re.I)) for k, p in FEATURES.items()]
_ALL_RANGES = re.compile(r"todas\s+las\s+cord(?:s?\.?|illeras?)\s+principales?", re.I)
_AREA = re.compile(rf"\b(?:{AREAS})\s+\w[^,;()]*", re.I)
_LIST = re.compile(r",\s*|\s+[ye]\s+", re.I)
_STOP = re.compile(r"\s*[,;(]|\.\s+[A-ZÁÉÍÓÚ]|\s*\b(?:Fls?\.|Fr\.|CR\b|Nic\.|Pan\.)")
_SENTENCE = re.compile(r"\.\s+(?=[A-ZÁÉÍÓÚ])")
_PLAIN = str.maketrans(*ACCENTS)


@dataclass
class Place:
    """One place; areas are protected areas named in its brackets, note is any other content of them."""

    slope: str | None
    side: str | None
    kind: str
    name: str
    note: str | None = None
    areas: list[str] = field(default_factory=list)
    span: str = ""


def prepared(text: str) -> str:
    """One kind of dash, words broken at line ends joined, one line, and usual misreadings of markers put right."""
    text = re.sub(r"[-¬­]\r?\n\s*", "", re.sub("[—‒]", "–", text))
    text = re.sub(r"\s*\r?\n\s*", " ", text)
    text = re.sub(r"\bF1\.", "Fl.", text)
    return re.sub(r"\bEN\s+D[ÉE]MICA\b", "ENDÉMICA", text, flags=re.I).strip()


def plain(text: str) -> str:
    return " ".join(text.lower().translate(_PLAIN).split())


class Names:
    """The gazetteer's folded names and aliases, found anywhere in a text; the longest tells the kind."""

    def __init__(self, aliases: Iterable[tuple[str, str]] = ()):
        self.auto = ahocorasick.Automaton()
        for alias, level in aliases:
            kind = LEVEL_KINDS.get(level)
            if kind:
                self.auto.add_word(alias, (len(alias), kind))
        self.some = len(self.auto) > 0
        if self.some:
            self.auto.make_automaton()

    def kind(self, text: str) -> str | None:
        if not self.some or len(text) < LEAST_NAME:
            return None
        return max((found for _, found in self.auto.iter(plain(text))), default=(0, None))[1]


def _begins(text: str) -> bool:
    """Whether a slope marker or a place begins here, perhaps after its side."""
    if any(p.match(text) for _, p in _MARK) or any(p.match(text) for _, p in _KIND):
        return True
    m = _SIDE.match(text)
    return bool(m) and any(p.match(text, m.end()) for _, p in _KIND)


def clauses(text: str) -> list[str]:
    """The clauses of a text; brackets are never cut."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        if not depth and (c == ";" or (c == "," and _begins(text[i + 1 :].lstrip()))):
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def _bracket(text: str) -> tuple[str, str]:
    """(content of the bracket that the text begins with, the rest)."""
    if not text.startswith("("):
        return "", text
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return text[1:i], text[i + 1 :]
    return text[1:], ""


def _chunk(text: str, names: Names) -> int:
    """Where the names of a place end: at a bracket, a new place, a marker, a sentence's end, or a name known otherwise."""
    ends = [len(text)]
    at = text.find("(")
    if at >= 0:
        ends.append(at)
    for _, p in [*_KIND, *_MARK]:
        m = next((m for m in p.finditer(text) if m.start() > 3), None)
        if m:
            ends.append(m.start())
    m = _SENTENCE.search(text)
    if m:
        ends.append(m.start())
    end = min(ends)
    for m in re.finditer(r",\s*([A-ZÁÉÍÓÚ][^,;(]+)", text[:end]):
        if names.kind(m[1].strip().rstrip(".")):
            return min(end, m.start())
    return end


def _clause(text: str, slope: str | None, names: Names, out: list[Place]) -> None:
    rest = text
    while rest := rest.strip(" ,;"):
        side = None
        m = _SIDE.match(rest)
        if m:
            side, rest = SIDES[m[1].lower()], rest[m.end() :]
        m = _ALL_RANGES.match(rest)
        if m:
            out.append(Place(slope, side, "cordillera", m[0], span=m[0]))
            rest = rest[m.end() :]
            continue
        kind, prefix = next(((k, m[0]) for k, p in _KIND if (m := p.match(rest))), (None, ""))
        if kind is None:
            first = re.split(r"[,;(]", rest)[0].strip().rstrip(".")
            kind = names.kind(first)
            if kind is None:
                if name := rest.strip().rstrip(".,;"):
                    out.append(Place(slope, side, "localidad", name, span=rest))
                return
        body = rest[len(prefix) :]
        if kind == "area_protegida":
            m = _STOP.search(body)
            end = m.start() if m else len(body)
            listed = [body[:end]]
        else:
            end = _chunk(body, names)
            listed = _LIST.split(body[:end].strip(" ,;"))
        inner, tail = _bracket(body[end:].lstrip())
        areas = [a.strip().rstrip(".,;") for a in _AREA.findall(inner)]
        found = [x for n in listed if (x := re.sub(r"\s+[ye]$", "", n.strip()).rstrip(".,;"))]
        for k, name in enumerate(found):
            last = k == len(found) - 1
            bare = re.sub(r"^del?\s+", "", name, flags=re.I) if re.search(r"\sdel?\s+$", prefix, re.I) else name
            out.append(Place(slope, side, kind, (prefix.strip() + " " + bare).strip(), (inner or None) if last and not areas else None, areas if last else [], prefix + body[:end]))
        if not found and not inner and not prefix:
            return
        rest = tail


def parse_places(text: str | None, names: Names | None = None) -> list[Place]:
    """All places of a text in their order; null and empty texts have none."""
    out: list[Place] = []
    slope: str | None = None
    known = names or Names()
    for clause in clauses(prepared(text or "")):
        for name, pattern in _MARK:
            m = pattern.match(clause)
            if m:
                slope, clause = name, clause[m.end() :].lstrip(" :")
                break
        _clause(clause, slope, known, out)
    return out


COLUMNS = ("slope", "side", "kind", "name", "note", "areas", "span")


def occurrences(df: DataFrame, id_col: str, text_col: str, aliases: DataFrame | None = None, most_aliases: int = 500_000) -> DataFrame:
    """(id, pos, slope, side, kind, name, note, areas, span) of every place of every text; null texts have none.

    aliases: (alias, hierarchy_level) of a gazetteer, folded, for places without a word for their kind; a list of more
    than ``most_aliases`` is refused, since each task holds it whole.
    """
    rows = []
    if aliases is not None:
        rows = aliases.select("alias", "hierarchy_level").where(F.col("hierarchy_level").isin(list(LEVEL_KINDS))).limit(most_aliases + 1).collect()
        if len(rows) > most_aliases:
            raise ValueError(f"more than {most_aliases} aliases")
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    text = T.StringType()
    fields = [T.StructField("pos", T.IntegerType()), *(T.StructField(c, T.ArrayType(text) if c == "areas" else text) for c in COLUMNS)]
    schema = T.StructType([df.schema[id_col], *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names(shared.value)
        for pdf in batches:
            rows = [(key, k, *[getattr(p, c) for c in COLUMNS]) for key, t in zip(pdf[id_col], pdf[text_col]) for k, p in enumerate(parse_places(t, known))]
            yield pd.DataFrame(rows, columns=[f.name for f in schema]).astype({"pos": "int32"})

    return df.select(id_col, text_col).mapInPandas(run, schema)


def of_kind(places: DataFrame, *kinds: str) -> DataFrame:
    return places.where(F.col("kind").isin(*kinds))


def slopes_of(places: DataFrame, id_col: str) -> DataFrame:
    """(id, slopes): slopes of the places in the order of first mention; ``ambas`` is both."""
    both = F.when(F.col("slope") == "ambas", F.array(F.lit("Caribe"), F.lit("Pacífico"))).otherwise(F.array("slope"))
    per = places.where("slope IS NOT NULL").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", both.alias("s")))).alias("a"))
    return per.select(id_col, F.array_distinct(F.flatten(F.transform("a", lambda x: x["s"]))).alias("slopes"))


def areas_of(places: DataFrame, id_col: str) -> DataFrame:
    """(id, areas): protected areas named as places or in brackets, each once in the order of first mention."""
    own = F.when(F.col("kind") == "area_protegida", F.array("name")).otherwise(F.array().cast("array<string>"))
    per = places.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(own, "areas").alias("s")))).alias("a"))
    out = per.select(id_col, F.array_distinct(F.flatten(F.transform("a", lambda x: x["s"]))).alias("areas"))
    return out.where(F.size("areas") > 0)
