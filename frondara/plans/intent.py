"""A question as a validated set of constraints, read by rules; and the catalogue filter it stands for."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frondara.functions.spanish import FORESTS, HABITS
from frondara.operators.bands import effective, strictly_overlaps

# Month names, criteria and directions of superlatives.
MONTH_NAMES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
CRITERIA = ("elev_max", "elev_min", "n_regions", "n_points")


@dataclass(frozen=True)
class Intent:
    """The constraints of a question; None leaves a field unconstrained."""

    habit: str | None = None
    forest_type: str | None = None
    vertiente: str | None = None
    region: str | None = None
    family: str | None = None
    elev_lo: int | None = None
    elev_hi: int | None = None
    flowering_month: int | None = None
    endemic: bool | None = None
    intent_type: str = "list"
    criterion: str | None = None
    direction: str | None = None


FILTERS = [f.name for f in fields(Intent)][:9]


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def validated(intent: Intent, vocab: dict[str, set[str]]) -> Intent:
    """Without values outside the vocabulary, wrong types or months; a superlative without a criterion is a list."""
    out = asdict(intent)
    for name in ("habit", "forest_type", "vertiente", "region", "family"):
        if out[name] is not None and out[name] not in vocab.get(name, set()):
            out[name] = None
    for name in ("elev_lo", "elev_hi", "flowering_month"):
        if type(out[name]) is not int:
            out[name] = None
    if out["flowering_month"] is not None and not 1 <= out["flowering_month"] <= 12:
        out["flowering_month"] = None
    if type(out["endemic"]) is not bool:
        out["endemic"] = None
    if out["criterion"] not in CRITERIA:
        out["criterion"] = None
    if out["intent_type"] != "superlative" or out["criterion"] is None:
        out |= {"intent_type": "list", "criterion": None, "direction": None}
    elif out["direction"] not in ("max", "min"):
        out["direction"] = "max"
    return Intent(**out)


def parse(question: str, vocab: dict[str, set[str]]) -> Intent:
    """The constraints a question names, by rules over the vocabulary; the longest name of a region or family wins."""
    q = _plain(question)
    out = Intent()
    for name, words in (("region", vocab.get("region", set())), ("family", vocab.get("family", set()))):
        hits = [w for w in words if re.search(rf"\b{re.escape(_plain(w))}\b", q)]
        if hits:
            out = replace(out, **{name: max(sorted(hits), key=len)})
    bare = q.replace(_plain(out.region), " ") if out.region else q
    for word in sorted(HABITS, key=len, reverse=True):
        if re.search(rf"\b{_plain(word)}(s|es)?\b", bare):
            out = replace(out, habit=word)
            break
    for word in sorted({*FORESTS, *vocab.get("forest_type", set())}, key=len, reverse=True):
        if re.search(rf"\b{_plain(word)}\b", bare) and (word in vocab.get("forest_type", FORESTS)):
            out = replace(out, forest_type=word)
            break
    if re.search(r"\b(caribe|caribena|atlantica)\b", bare):
        out = replace(out, vertiente="Caribe")
    elif re.search(r"\b(pacifico|pacifica)\b", bare):
        out = replace(out, vertiente="Pacífico")
    number = r"(\d{1,4})"
    if m := re.search(rf"entre {number} y {number}", q):
        out = replace(out, elev_lo=int(m[1]), elev_hi=int(m[2]))
    elif m := re.search(rf"(?:sobre|arriba de|mas de|encima de)\s+(?:los\s+)?{number}", q):
        out = replace(out, elev_lo=int(m[1]))
    elif m := re.search(rf"(?:bajo|debajo de|menos de)\s+(?:los\s+)?{number}", q):
        out = replace(out, elev_hi=int(m[1]))
    elif m := re.search(rf"(?:a|alrededor de)\s+(?:los\s+)?{number}\s*m?\b", q):
        out = replace(out, elev_lo=int(m[1]) - 150, elev_hi=int(m[1]) + 150)
    if re.search(r"endemic|solo de costa rica|exclusiv", q):
        out = replace(out, endemic=True)
    for k, month in enumerate(MONTH_NAMES, 1):
        if re.search(rf"florecen? en {month}", q):
            out = replace(out, flowering_month=k)
    for pattern, criterion, direction in (
        (r"mayor (altitud|elevacion)|mas alt[oa]", "elev_max", "max"), (r"menor (altitud|elevacion)|mas baj[oa]", "elev_min", "min"),
        (r"mas amplia", "n_regions", "max"), (r"mas restringida", "n_regions", "min"), (r"mas (comun|abundante)", "n_points", "max"),
    ):
        if re.search(pattern, q):
            out = replace(out, intent_type="superlative", criterion=criterion, direction=direction)
            break
    return validated(out, vocab)


def condition(i: Intent) -> Column:
    """One predicate over the catalogue; no constraint gives every row."""
    c: list[Column] = []
    for value, column in ((i.habit, "habits"), (i.vertiente, "vertientes"), (i.region, "regions"), (i.forest_type, "forest_types"), (i.flowering_month, "flowering_months")):
        if value is not None:
            c.append(F.array_contains(column, value))
    if i.family is not None:
        c.append(F.col("family") == i.family)
    if i.endemic is not None:
        c.append(F.coalesce("endemic_cr", F.lit(False)) == i.endemic)
    if i.elev_lo is not None or i.elev_hi is not None:
        window = [F.lit(x) if x is not None else None for x in (i.elev_lo, i.elev_hi)]
        c.append(strictly_overlaps(effective(F.col("elev_min"), F.col("elev_outlier_min")), effective(F.col("elev_max"), F.col("elev_outlier_max")), *window))
    return reduce(lambda a, b: a & b, c, F.lit(True))


def superlative(candidates: DataFrame, criterion: str, direction: str, seq: str = "ficha_id") -> DataFrame:
    """The one row with the greatest or least non-null criterion, the lower ``seq`` on ties, and the number of candidates."""
    value = {"elev_max": F.col("elev_max"), "elev_min": F.col("elev_min"), "n_regions": F.size(F.coalesce("regions", F.array())), "n_points": F.col("n_points") if "n_points" in candidates.columns else F.lit(None)}[criterion]
    c = candidates.withColumn("_value", value.cast("long"))
    row = F.struct(seq, "species", "family", F.col("_value").alias("value"))
    ok = F.col("_value").isNotNull()
    pick = F.max_by(F.when(ok, row), F.when(ok, F.struct("_value", -F.col(seq)))) if direction == "max" else F.min_by(F.when(ok, row), F.when(ok, F.struct("_value", seq)))
    return c.agg(pick.alias("w"), F.count(F.lit(1)).alias("n_candidates")).where(F.col("w").isNotNull()).select("w.*", "n_candidates")
