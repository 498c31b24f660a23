"""The same things in two tables without a common key: species by name, synonyms and author.

1. Every name of a record (accepted or synonym) is taken apart into genus, epithet and author; equal pairs of genus and
   epithet are compared once, whatever their authors.
2. Candidates are all pairs of names with at most MOST_EDITS edits in genus and epithet together. One of the two words
   then has at most one edit, and two such words share a form with at most one letter left out. These forms are made of
   the distinct words only, which are far fewer than the names; names meet under a near word, and what the other word
   may differ by is tested within that join, before anything is written. All joins are shuffled by hint, since the sizes
   Spark guesses are too low for its own broadcasts.
3. Name pairs get features (edits in genus and epithet, agreement of authors), record pairs the best of their name
   pairs, how many agree, and the families.
4. A logistic classifier is trained on weak labels, some of them with the author hidden, and calibrated on held-out ones.
"""

from __future__ import annotations

import re
import unicodedata as u
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frondara.llm.gazetteer import distance
from frondara.llm.lookalikes import unify
from frondara.session import broadcast_if_small, cut

#: Most edits of a name pair, genus and epithet together; below 4, so that one of the two has one at most.
MOST_EDITS = 3
#: Labelled pairs used for training at most, taken in the order of a hash; the bound of the training set.
TRAIN_ROWS = 20_000
#: Penalties of the weights that training tries; the held-out pairs decide.
RIDGES = (1e-2, 1e-3, 1e-4)
#: Letters of a surname that must agree; abbreviations keep at least these.
SURNAME = 4
_JOINING = frozenset("y et and ex in e f filius fil".split())


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in u.normalize("NFKD", unify(text).lower()) if not u.combining(c))


def surnames(author: str | None) -> tuple[list[str], list[str]]:
    """(authors of the name, authors in brackets): surnames in lower case, without initials, years and joining words."""
    if not author:
        return [], []
    text = _plain(author)
    inner = " ".join(re.findall(r"\(([^)]*)\)", text))
    outer = re.sub(r"\([^)]*\)", " ", text)

    def names(x: str) -> list[str]:
        return [w for w in re.findall(r"[^\W\d_]+", x) if len(w) > 2 and w not in _JOINING]

    return names(outer), names(inner)


def _same_surname(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return n >= SURNAME and a[:n] == b[:n]


def author_agreement(a: str | None, b: str | None) -> float:
    """Share of surnames in common, from 0 (unrelated) to 1; -1 where one side says nothing."""
    (ao, ai), (bo, bi) = surnames(a), surnames(b)
    scores = []
    for x, y in ((ao, bo), (ai, bi)):
        if x and y:
            hit = sum(any(_same_surname(p, q) for q in y) for p in x) + sum(any(_same_surname(p, q) for p in x) for q in y)
            scores.append(hit / (len(x) + len(y)))
    if scores:
        return float(min(scores)) if min(scores) == 0 else float(np.mean(scores))
    x, y = ao + ai, bo + bi
    if not x or not y:
        return -1.0
    # One side names only the combining authors, the other only those in brackets: they say nothing about each other.
    return -1.0 if not any(_same_surname(p, q) for p in x for q in y) else 1.0


def split_name(raw: str | None) -> tuple[str, str, str]:
    """(genus, epithet, author) of a name string; empty where missing."""
    words = unify(raw or "").split()
    genus, epithet = (_plain(w) for w in (words + ["", ""])[:2])
    return re.sub(r"[^a-z]", "", genus), re.sub(r"[^a-z]", "", epithet), " ".join(words[2:])


_TEXT = T.StringType()
_PARSED = T.StructType([T.StructField(c, _TEXT) for c in ("genus", "epithet", "author")])
_EDITS = T.StructType([T.StructField("d_key", T.IntegerType()), T.StructField("d_other", T.IntegerType())])


@F.pandas_udf(_PARSED)
def _parsed(raw: pd.Series, authority: pd.Series) -> pd.DataFrame:
    rows = []
    for r, a in zip(raw, authority):
        genus, epithet, inline = split_name(r)
        rows.append((genus, epithet, a or inline))
    return pd.DataFrame(rows, columns=["genus", "epithet", "author"])


@F.pandas_udf(_EDITS)
def _edits(k1: pd.Series, o1: pd.Series, k2: pd.Series, o2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(distance(p, r), distance(q, s)) for p, q, r, s in zip(k1, o1, k2, o2)], columns=["d_key", "d_other"])


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str | None, str | None], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = author_agreement(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)


def _names(df: DataFrame, rec: str, name: str, authority: str, synonyms: str, family: str) -> DataFrame:
    """(rec, family, accepted, raw, authority): one row for each name of each record.

    An accepted name without an author takes that of a synonym of the same epithet in brackets, since it is its basionym.
    """
    syn = F.coalesce(synonyms, F.array().cast("array<string>"))
    word2 = r"^\s*\S+\s+(\S+)"
    epithet = F.regexp_extract(F.col(name), word2, 1)
    same = F.filter(syn, lambda s: (epithet != "") & (F.regexp_extract(s, word2, 1) == epithet) & (F.size(F.split(s, r"\s+")) > 2))
    implied = F.when(F.size(same) > 0, F.concat(F.lit("("), F.regexp_replace(F.regexp_replace(same[0], r"^\S+\s+\S+\s+", ""), r"[()]", " "), F.lit(")")))
    accepted = F.struct(F.lit(True).alias("accepted"), F.col(name).alias("raw"), F.coalesce(F.nullif(F.trim(authority), F.lit("")), implied).alias("authority"))
    others = F.transform(syn, lambda s: F.struct(F.lit(False).alias("accepted"), s.alias("raw"), F.lit(None).cast("string").alias("authority")))
    return df.select(F.col(rec).alias("rec"), F.col(family).alias("family"), F.explode(F.concat(F.array(accepted), others)).alias("x")).select("rec", "family", "x.*").where(
        F.col("raw").isNotNull()
    )


def _forms(names: DataFrame) -> DataFrame:
    """``names`` taken apart, with the id of their pair of genus and epithet; those without one of the two are left out."""
    parsed = names.withColumn("p", _parsed("raw", "authority")).select("rec", "family", "accepted", "p.*")
    return parsed.where((F.col("genus") != "") & (F.col("epithet") != "")).withColumn("name", F.xxhash64("genus", "epithet"))


def _blocked(forms: DataFrame) -> DataFrame:
    """(name, genus, epithet): one row for each pair of genus and epithet, under whatever authors."""
    return forms.select("name", "genus", "epithet").distinct()


def _by_word(genus_epithet: DataFrame, n: str) -> DataFrame:
    """(kind, key, other): each name under its genus (kind 0) and under its epithet (kind 1); columns begin with ``n``."""
    both = [F.struct(F.lit(k).cast("byte").alias("kind"), F.col(a).alias(n + "key"), F.col(b).alias(n + "other")) for k, a, b in ((0, "genus", "epithet"), (1, "epithet", "genus"))]
    return genus_epithet.select(F.explode(F.array(*both)).alias("x")).select("x.*")


def _shuffled(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """An inner join that Spark never turns into a broadcast; crowded keys are split by its skew handling."""
    return a.join(b.hint("merge"), on)


def _near_words(forms: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, lkey, rkey): genera, and epithets, of both sides that are equal once a letter of each may be left out; all
    within one edit, exchanged neighbours too, are among them."""
    sides = []
    for f, n in zip(forms, "lr"):
        words = _by_word(f, n).select("kind", n + "key").distinct()
        word = F.col(n + "key")
        without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
        sides.append(words.select("kind", n + "key", F.explode(F.array_distinct(F.concat(F.array(word), without))).alias("left_out")))
    return cut(_shuffled(*sides, ["kind", "left_out"]).select("kind", "lkey", "rkey").distinct())


def _letters(n: str) -> Column:
    """The set of letters of the other word, a bit for each."""
    return F.expr(f"aggregate(split({n}other, ''), 0, (a, x) -> a | shiftleft(1, ascii(x) - 97))").alias(n + "letters")


def _near_names(forms: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(lname, rname, d_genus, d_epithet) of all names within MOST_EDITS, each pair once.

    With k edits, t of them exchanges, plain edits are at most k + t, and at most 2 (k - t) letters are in one word only:
    so the JVM tells from both what can't be within k.
    """
    lw, rw = (_by_word(_blocked(f), n).select("*", _letters(n)) for f, n in zip(forms, "lr"))
    near = broadcast_if_small(_near_words(forms))
    met = _shuffled(lw, rw.join(near, ["kind", "rkey"]), ["kind", "lkey"])
    most = F.when(F.col("lkey") == F.col("rkey"), MOST_EDITS).otherwise(MOST_EDITS - 1)
    apart = F.bit_count(F.col("lletters").bitwiseXOR(F.col("rletters")))
    plain = F.levenshtein("lother", "rother", 2 * MOST_EDITS)
    met = met.where((apart <= 2 * most) & (F.abs(F.octet_length("lother") - F.octet_length("rother")) <= most))
    met = met.where((plain >= 0) & (apart <= 2 * (2 * most - plain)))
    met = met.withColumn("c", _edits("lkey", "lother", "rkey", "rother")).where(F.col("c.d_key") + F.col("c.d_other") <= MOST_EDITS)
    # A pair that meets under both words counts under the genus.
    met = met.where(F.when(F.col("kind") == 0, F.col("c.d_key") <= 1).otherwise(F.col("c.d_other") > 1))
    genus, epithet = (lambda n: F.when(F.col("kind") == 0, F.col(n[0])).otherwise(F.col(n[1]))), (lambda n: F.when(F.col("kind") == 0, F.col(n[1])).otherwise(F.col(n[0])))
    ids = [F.xxhash64(genus(n), epithet(n)).alias(alias) for n, alias in ((("lkey", "lother"), "lname"), (("rkey", "rother"), "rname"))]
    return met.select(*ids, genus(("c.d_key", "c.d_other")).alias("d_genus"), epithet(("c.d_key", "c.d_other")).alias("d_epithet"))


@dataclass
class Classifier:
    """Logistic weights over FEATURES, and the calibration of its score."""

    weights: np.ndarray
    scale: float
    shift: float

    def confidence(self) -> Column:
        score = F.lit(float(self.weights[0]))
        for w, c in zip(self.weights[1:], FEATURES):
            score = score + F.lit(float(w)) * F.col(c)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.scale) * score + F.lit(self.shift))))


#: Features of a record pair.
FEATURES = ("d_genus", "d_epithet", "agree", "disagree", "more_agree", "family_same", "family_other", "both_accepted")


def _shares(y: np.ndarray) -> np.ndarray:
    """What each row weighs: both classes weigh alike."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the intercept. Both classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    share = _shares(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * np.r_[0, w[1:]] / 10
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge / 10
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(pairs: DataFrame) -> Classifier:
    """Fit on weak labels: at most two edits and agreeing authors, against unrelated authors.

    Each labelled pair counts a second time with its author hidden if its names are equal and it is positive, or if its
    names differ by more than two edits and it is negative, so that the names alone get their weight too. Of the penalties,
    that with the least loss on the held-out pairs is taken: how much it holds the weights of the authors down depends on how
    many far pairs there are.
    """
    near = F.col("d_genus") + F.col("d_epithet")
    label = F.when((F.col("agree") == 1) & (near <= 2) & (F.col("disagree") == 0), 1).when((F.col("disagree") == 1) & (F.col("agree") == 0), 0)
    sample = pairs.withColumn("label", label).where(F.col("label").isNotNull()).orderBy(F.xxhash64("left", "right")).limit(TRAIN_ROWS).select(*FEATURES, "label").toPandas()
    if sample["label"].nunique() < 2:
        # Without both labels the weights are the plain reading of the features.
        return Classifier(np.array([1.0, -1.0, -1.0, 4.0, -6.0, 1.0, 0.5, -0.5, 0.0]), 1.0, 0.0)
    hidden = sample[((sample["label"] == 1) | (sample["d_genus"] + sample["d_epithet"] > 2))].copy()
    hidden[["agree", "disagree", "more_agree"]] = 0
    both = pd.concat([sample, hidden], ignore_index=True)
    x, y = both[list(FEATURES)].to_numpy(float), both["label"].to_numpy(float)
    held = np.arange(len(y)) % 4 == 0
    fits = []
    for ridge in RIDGES:
        w = _logistic(x[~held], y[~held], ridge)
        score = np.column_stack([np.ones(held.sum()), x[held]]) @ w
        fits.append(((_shares(y[held]) * np.logaddexp(0, np.where(y[held] == 1, -score, score))).sum(), w, score))
    _, w, score = min(fits, key=lambda fit: fit[0])
    c = _logistic(score[:, None], y[held]) if len(set(y[held])) == 2 else np.array([0.0, 1.0])
    return Classifier(w, float(c[1]), float(c[0]))


def _packed(*digits: Column) -> Column:
    """Whole numbers from 0 to 3 as one that sorts as they do one after the other; rows of it take little room."""
    out = F.lit(0)
    for x in digits:
        out = out * 4 + x
    return out


def _unpacked(code: Column, n: int) -> list[Column]:
    return [F.shiftright(code, 2 * (n - 1 - k)).bitwiseAND(F.lit(3)) for k in range(n)]


def match_names(left: DataFrame, right: DataFrame, left_cols: dict[str, str], right_cols: dict[str, str]) -> DataFrame:
    """(left, right, confidence) of all candidate record pairs.

    ``left_cols`` and ``right_cols`` name the columns rec, name, authority, synonyms and family of each table; others are
    not read. Records without a name, and names of one word, match nothing; null authors and families say nothing;
    repeated records count each; an empty table gives no pairs.
    """
    order = ("rec", "name", "authority", "synonyms", "family")
    forms = tuple(_forms(_names(df, *(cols[c] for c in order))) for df, cols in ((left, left_cols), (right, right_cols)))
    full = _near_names(forms)
    for f, n in zip(forms, "lr"):
        full = _shuffled(full, f.select(*[F.col(c).alias(n + c) for c in ("name", "rec", "family", "accepted", "author")]), n + "name")
    agreement, family = F.col("agreement"), (F.lower("lfamily"), F.lower("rfamily"))
    agrees, unrelated = agreement >= 0.5, (agreement >= 0) & (agreement < 0.34)
    rank = F.when(agrees, 2).when(unrelated, 0).otherwise(1)
    kin = F.when(family[0] == family[1], 2).when(family[0] != family[1], 1).otherwise(0)
    both = (F.col("laccepted") & F.col("raccepted")).cast("int")
    best = _packed(rank, MOST_EDITS - F.col("d_genus") - F.col("d_epithet"), F.col("d_genus"), F.col("d_epithet"), kin, both)
    full = full.withColumn("agreement", _agreement("lauthor", "rauthor"))
    edits = F.col("d_genus") + F.col("d_epithet")
    grouped = full.groupBy(F.col("lrec").alias("left"), F.col("rrec").alias("right")).agg(
        F.max(best).alias("b"), F.sum(agrees.cast("int")).alias("k"), F.min(F.when(agrees, edits)).alias("agreeing"), F.min(F.when(unrelated, edits)).alias("other")
    )
    # Unrelated authors say nothing where names nearer than theirs agree: a record's own names can be near each other.
    disagrees = F.coalesce(F.col("other") <= F.coalesce("agreeing", F.lit(MOST_EDITS)), F.lit(False)).cast("int")
    rank, _, d_genus, d_epithet, kin, both = _unpacked(F.col("b"), 6)
    more = F.least(F.greatest(F.col("k") - 1, F.lit(0)), F.lit(2)).cast("int")
    features = (d_genus, d_epithet, (rank == 2).cast("int"), disagrees, more, (kin == 2).cast("int"), (kin == 1).cast("int"), both)
    rows = cut(grouped.select("left", "right", _packed(*features).alias("code")))
    rows = rows.select("left", "right", *[x.cast("double").alias(c) for x, c in zip(_unpacked(F.col("code"), len(FEATURES)), FEATURES)])
    return rows.select("left", "right", train(rows).confidence().alias("confidence"), *FEATURES)
