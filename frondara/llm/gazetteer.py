"""Freely typed values mapped to the entries of a reference list, by trees under a true edit metric.

Equal values are worked on once. A value is folded (case, accents, look-alikes) and taken apart into forms: its words
without those that the reference itself puts before its names and without those that the values put beside very many
different words, the rest glued together, and the whole. Each form is looked up in a BK-tree over the folded names and
aliases of its level; the Damerau-Levenshtein distance is a metric, so the triangle inequality prunes the tree without
losing an entry within the threshold. The trees are searched by whole batches, node by node.
"""

from __future__ import annotations

import re
import unicodedata as u
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frondara.llm.lookalikes import unify
from frondara.session import broadcast_if_small, cut, spread

#: Entries up to which all trees go to every task; a longer list is divided into shards of as many entries.
SHARD_ENTRIES = 50_000
#: Most differences for forms of at least so many characters, longest first.
THRESHOLDS = ((6, 2), (5, 1), (0, 0))
#: A word says something about a place, and names none, if it stands in so many sequences of words, as a share of the
#: distinct values (and so many at least). At most words of a value / FILLER_SHARE words can.
FILLER_SHARE, FILLER_LEAST = 0.005, 5
#: Searches remembered per task; speed only.
MEMORY = 300_000
#: Letters counted apart for the bound of a distance; speed only.
LETTERS = 32
#: Pairs compared, and pairs bounded, at a time; speed only.
SLICE, PAIRS = 2048, 1 << 17
_SPLIT = re.compile(r"[\s_,;:()\[\]?/]+")
_GLUED = re.compile(r"(?<=[a-záéíóúüñ])(?=[A-ZÁÉÍÓÚÜÑ])")


def fold(text: str) -> str:
    """Letters and digits in lower case without accents."""
    return "".join(c for c in u.normalize("NFKD", unify(text).lower()) if c.isalnum())


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, which obeys the triangle inequality."""
    if a == b:
        return 0
    far = len(a) + len(b)
    last: dict[str, int] = {}
    before: list[list[int]] = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        up = before[i]
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), seen
            cost = 1
            if x == y:
                cost, seen = 0, j
            best = up[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if up[j + 1] + 1 < best:
                best = up[j + 1] + 1
            swap = before[k][l] + i - k + j - l - 1
            row.append(swap if swap < best else best)
        last[x] = i
        before.append(row)
    return before[-1][-1]


def _codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one row a word, 0 beyond its end; lengths)."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, size


def distances(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """The Damerau-Levenshtein distance of each row of a from that of b, cell by cell for all pairs together."""
    out = np.zeros(len(a_size), np.int64)
    order = np.lexsort((b_size, a_size))  # pairs of about equal length share their cells
    for start in range(0, len(order), SLICE):
        k = order[start : start + SLICE]
        out[k] = _slice_distances(a[k], a_size[k], b[k], b_size[k])
    return out


def _slice_distances(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    n, rows, cols = len(a_size), int(a_size.max()), int(b_size.max())
    d = np.full((rows + 2, cols + 2, n), rows + cols, np.int16)
    d[1:, 1] = np.arange(rows + 1)[:, None]
    d[1, 1:] = np.arange(cols + 1)[:, None]
    letters = np.ascontiguousarray(b[:, :cols].T)
    row_of = np.zeros((cols, n), np.int16)  # last row before this one whose letter is that of the column
    for i in range(1, rows + 1):
        same = letters == a[:, i - 1]
        other = ~same
        col_of = np.zeros(n, np.int16)  # last column before this one whose letter is that of the row
        for j in range(1, cols + 1):
            best = np.minimum(d[i, j] + other[j - 1], np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            swap = np.flatnonzero((row_of[j - 1] > 0) & (col_of > 0)) if i > 1 and j > 1 else ()
            if len(swap):
                k, l = row_of[j - 1, swap], col_of[swap]
                best[swap] = np.minimum(best[swap], d[k, l, swap] + (i - k - 1) + 1 + (j - l - 1))
            d[i + 1, j + 1] = best
            col_of[same[j - 1]] = j
        row_of[same] = i
    return d[a_size + 1, b_size + 1, np.arange(n)].astype(np.int64)


def _bags(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row; letters that share a count make the bound below lower, never wrong."""
    out = np.zeros((len(codes), LETTERS), np.int8)
    for col in codes.T:
        out[np.flatnonzero(col), col[col > 0] % LETTERS] += 1
    return out


class Tree:
    """BK-tree of forms, each with the entries it stands for.

    A search works out the distance from a node only where the letters allow it to be within the radius; elsewhere their
    difference, which no edit lowers by more than one, takes its place as a lower bound in the triangle inequality.
    """

    def __init__(self, entries: dict[str, set[int]]):
        self.entries = entries
        self.forms = sorted(entries)
        self.codes, self.size = _codes(self.forms)
        self.bags = _bags(self.codes)
        edges: list[tuple[int, int, int]] = []
        stack = [(-1, 0, np.arange(len(self.forms)))] if self.forms else []
        while stack:
            above, d, members = stack.pop()
            node, rest = int(members[0]), members[1:]
            if above >= 0:
                edges.append((above, d, node))
            if len(rest):
                one = np.full(len(rest), node)
                away = distances(self.codes[rest], self.size[rest], self.codes[one], self.size[one])
                stack += [(node, int(k), rest[away == k]) for k in np.unique(away)]
        below = np.array(sorted(edges), np.int64).reshape(-1, 3)
        #: Children of node i: edge and child from first[i] to first[i + 1].
        self.first = np.searchsorted(below[:, 0], np.arange(len(self.forms) + 1))
        self.edge, self.child = below[:, 1], below[:, 2]

    def within(self, forms: Sequence[str], most: int) -> list[list[tuple[int, str]]]:
        """For each form (distance, name) of every name within ``most``; all forms go down the tree together."""
        every: list[list[tuple[int, str]]] = [[] for _ in forms]
        fit = [i for i, f in enumerate(forms) if self.forms and len(f) <= self.size.max() + most]  # longer ones are too far from all
        if not fit:
            return every
        forms, out = [forms[i] for i in fit], [every[i] for i in fit]
        codes, size = _codes(forms)
        bags = _bags(codes)
        stack = [(np.zeros(len(forms), np.int64), np.arange(len(forms)))]
        while stack:
            node, q = stack.pop()
            if len(q) > PAIRS:
                stack += [(node[k : k + PAIRS], q[k : k + PAIRS]) for k in range(0, len(q), PAIRS)]
                continue
            more = np.maximum(bags[q] - self.bags[node], 0).sum(axis=1, dtype=np.int64)
            low = np.maximum(more, more - size[q] + self.size[node])
            high = np.maximum(size[q], self.size[node])
            near = np.flatnonzero(low <= most)
            if len(near):
                d = distances(codes[q[near]], size[q[near]], self.codes[node[near]], self.size[node[near]])
                low[near] = high[near] = d
                for k in np.flatnonzero(d <= most):
                    out[q[near[k]]].append((int(d[k]), self.forms[node[near[k]]]))
            start, n = self.first[node], self.first[node + 1] - self.first[node]
            pair = np.repeat(np.arange(len(q)), n)
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(pair))
            keep = (low[pair] - most <= self.edge[at]) & (self.edge[at] <= high[pair] + most)
            if keep.any():
                stack.append((self.child[at[keep]], q[pair[keep]]))
        return every


def _names(name: str, aliases: str | None) -> list[str]:
    return [x for x in [name, *(aliases or "").split("|")] if x and x.strip()]


def _words(name: str) -> list[str]:
    return [fold(w) for w in _SPLIT.split(name) if fold(w)]


def _by_length(prefixes: set[str]) -> list[str]:
    return sorted((p for p in prefixes if len(p) > 2), key=lambda p: (-len(p), p))


def words_of(value: str) -> list[str]:
    """The folded words of a typed value."""
    return [w for x in _SPLIT.split(_GLUED.sub(" ", unify(value))) if (w := fold(x))]


class Reference:
    """Trees of a reference list, one a level; kinds: the words that stand before names.

    before: the kinds and prefixes of the whole list, where the rows are only a part of it. filler: words of the values
    that name no place; those that are names themselves stay.
    """

    def __init__(self, rows: Sequence[tuple[int, str, str | None, str | None]], before: tuple[set[str], set[str]] | None = None, filler: Iterable[str] = ()):
        self.full: dict[int, list[str]] = {}
        self.kinds: set[str] = set()
        prefixes: set[str] = set()
        self.memory: dict[tuple[str | None, str, int], list[tuple[int, str]]] = {}
        forms: dict[str | None, dict[str, set[int]]] = {}
        for gid, name, level, aliases in rows:
            names = _names(name, aliases)
            self.full[gid] = [fold(x) for x in names]
            at = forms.setdefault(level, {})
            for x in names:
                words = _words(x)
                if not words:
                    continue
                self.kinds.update(words[:-1])
                if len(words) > 1:
                    prefixes.add("".join(words[:-1]))
                at.setdefault("".join(words), set()).add(gid)
                at.setdefault(words[-1], set()).add(gid)
        self.trees = {level: Tree(x) for level, x in forms.items()}
        # A word that is itself a name stays one.
        self.kinds -= {f for x in forms.values() for f in x}
        if before is not None:
            self.kinds, prefixes = before
        self.filler = set(filler) - {f for x in forms.values() for f in x}
        self.prefixes = _by_length(prefixes)

    def forms(self, words: Sequence[str]) -> list[str]:
        """The forms under which a value of these words is looked up."""
        told = [w for w in words if w not in self.filler]
        names = [w for w in told if w not in self.kinds]
        out = list(names)
        for w in [*names, "".join(words)]:
            for p in self.prefixes:
                if w.startswith(p) and len(w) - len(p) >= 4:
                    out.append(w[len(p) :])
                    break
        out += ["".join(told), "".join(words)]
        return list(dict.fromkeys(f for f in out if len(f) > 2))

    def _look(self, wanted: dict[str | None, set[str]], most: int) -> None:
        """Searches the trees for all wanted forms at once and remembers what stands within ``most``."""
        for level, forms in wanted.items():
            new = sorted(f for f in forms if (level, f, most) not in self.memory)
            if new:
                if len(self.memory) > MEMORY:
                    self.memory.clear()
                    new = sorted(forms)
                known = self.trees[level].entries
                hits = [[(0, f)] if f in known else [] for f in new] if most == 0 else self.trees[level].within(new, most)
                self.memory.update(((level, f, most), h) for f, h in zip(new, hits))

    def within(self, asked: Sequence[tuple[Sequence[str], Sequence[str | None]]], least: bool = False) -> list[dict[int, int]]:
        """For each (words, levels) the entries within the threshold of any of its forms, and their distance.

        least: only those of the least radius that has any, which hold the nearest; most typed values have one slip, and
        a wider radius visits far more of a tree.
        """
        forms = [self.forms(words) for words, _ in asked]
        levels = [[k for k in ls if k in self.trees] for _, ls in asked]
        top = THRESHOLDS[0][1]
        found: list[dict[int, int]] = [{} for _ in asked]
        todo = range(len(asked))
        for most in range(top + 1) if least else [None]:
            wanted: dict[int, dict[str | None, set[str]]] = {}
            plan = []
            for i in todo:
                for f in forms[i]:
                    limit = next(t for n, t in THRESHOLDS if len(f) >= n)
                    if most is None or most <= limit:
                        radius = limit if most is None else most
                        plan.append((i, f, radius))
                        for k in levels[i]:
                            wanted.setdefault(radius, {}).setdefault(k, set()).add(f)
            for radius, by_level in wanted.items():
                self._look(by_level, radius)
            for i, f, radius in plan:
                for k in levels[i]:
                    for d, name in self.memory[k, f, radius]:
                        for gid in self.trees[k].entries[name]:
                            found[i][gid] = min(found[i].get(gid, d), d)
            todo = [i for i in todo if not found[i]]
        return found

    def nearest(self, values: Sequence[str], asked: Sequence[tuple[Sequence[str], Sequence[str | None]]], part: bool = False) -> list[tuple[int, int, int]]:
        """(entry, distance, distance of the full names) of the closest entry; -1 each if none is within the threshold.

        The full names are compared to break ties only, unless the list is part of a longer one.
        """
        out = []
        for value, found in zip(values, self.within(asked, least=True)):
            if not found:
                out.append((-1, -1, -1))
                continue
            least = min(found.values())
            best, full = [g for g, d in found.items() if d == least], 0
            if part or len(best) > 1:
                whole = fold(value)
                full, best[0] = min((min(distance(whole, f) for f in self.full[g]), g) for g in best)
            out.append((best[0], least, full))
        return out


def _before_names(ref: DataFrame) -> tuple[set[str], set[str]]:
    """(kinds, prefixes) of the whole list, as Reference finds them; only words before names come to the driver."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: set[tuple[str, str]] = set()
            for name, aliases in zip(b["canonical_name"], b["aliases"]):
                for words in filter(None, map(_words, _names(name, aliases))):
                    out.update(("kind", w) for w in words[:-1])
                    out.update({("form", "".join(words)), ("form", words[-1])})
                    if len(words) > 1:
                        out.add(("prefix", "".join(words[:-1])))
            yield pd.DataFrame(sorted(out), columns=["what", "word"])

    found = ref.select("canonical_name", "aliases").mapInPandas(parts, "what string, word string").distinct()
    of = lambda what: found.where(F.col("what") == what).select("word")
    kinds = of("kind").join(of("form"), "word", "left_anti").collect()
    return {r.word for r in kinds}, {r.word for r in of("prefix").collect()}


_WORDED = T.ArrayType(T.StringType())


@F.pandas_udf(_WORDED)
def _worded(values: pd.Series) -> pd.Series:
    return values.map(words_of)


def _asked(values: DataFrame) -> DataFrame:
    """(value, levels, words) of every distinct non-null value, written once."""
    return cut(spread(values.where(F.col("value").isNotNull()).select("value", "levels").distinct()).withColumn("words", _worded("value")))


def _fillers(asked: DataFrame) -> list[str]:
    """Words that stand in very many different sequences of words; see FILLER_SHARE for their number."""
    least = max(FILLER_LEAST, FILLER_SHARE * asked.count())
    each = asked.select(F.xxhash64("words").alias("whole"), F.explode(F.array_distinct("words")).alias("word"))
    return [r[0] for r in each.groupBy("word").agg(F.approx_count_distinct("whole", 0.02).alias("n")).where(F.col("n") >= least).select("word").collect()]


def _searched(values: DataFrame, reference: DataFrame, shard_entries: int, search, schema: str) -> tuple[DataFrame, int]:
    """The rows that ``search(reference, batch, asked, whether the list is part of a longer one)`` gives of all distinct values, from every shard, and the number of shards.

    A short list is one shard. Each shard's trees are built once and go to the tasks in turn; nothing is shuffled.
    """
    spark = values.sparkSession
    ref = reference.select(F.col("gaz_id").cast("long"), "canonical_name", "hierarchy_level", "aliases").where(F.col("canonical_name").isNotNull())
    asked = _asked(values)
    filler = _fillers(asked)
    head = ref.limit(shard_entries + 1).collect()
    shards = 1 if len(head) <= shard_entries else -(-ref.count() // shard_entries)
    before = None if shards == 1 else _before_names(ref)
    if shards > 1:
        own = _names_among(ref, filler)
        filler = [w for w in filler if w not in own]
    out = None
    for k in range(shards):
        rows = head if shards == 1 else ref.where(F.pmod(F.xxhash64("gaz_id"), F.lit(shards)) == k).collect()
        shared = spark.sparkContext.broadcast(Reference([tuple(r) for r in rows], before, filler))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = shared.value
            for b in batches:
                every = list(known.trees)
                levels = [every if ls is None else list(ls) for ls in b["levels"]]
                yield search(known, b, list(zip(b["words"].map(list), levels)), shards > 1)

        part = asked.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out, shards


def _names_among(ref: DataFrame, words: list[str]) -> set[str]:
    """Which of a few words are names of the list themselves, whole or by their last word."""
    wanted = set(words)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit: set[str] = set()
            for name, aliases in zip(b["canonical_name"], b["aliases"]):
                for w in filter(None, map(_words, _names(name, aliases))):
                    hit |= {"".join(w), w[-1]} & wanted
            yield pd.DataFrame({"word": sorted(hit)}, dtype=object)

    return {r[0] for r in ref.mapInPandas(parts, "word string").distinct().collect()} if words else set()


def _back(values: DataFrame, won: DataFrame) -> DataFrame:
    """``won`` (by value and levels) joined to all rows, its columns in place of theirs of the same names; broadcast if its
    counted size allows it, else by shuffle."""
    new = [c for c in won.columns if c not in ("value", "levels")]
    won = broadcast_if_small(won.select([F.col(c).alias("_fr_won_" + c) for c in won.columns]))
    same = F.col("value").eqNullSafe(F.col("_fr_won_value")) & F.col("levels").eqNullSafe(F.col("_fr_won_levels"))
    kept = [c for c in values.columns if c not in new]
    return values.select(kept).join(won, same, "left").select(*kept, *[F.col("_fr_won_" + c).alias(c) for c in new])


_FOUND = "value string, levels array<string>, gaz_id bigint, distance int"


def map_values(values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``values`` with ``gaz_id`` and ``distance``: the closest entry, or -1 and -1 where none is meant.

    values: ``value`` string and ``levels`` array of the levels it may have (null: any level), and any other columns,
    which are kept but for ``gaz_id`` and ``distance``. reference: ``gaz_id``, ``canonical_name``, ``hierarchy_level``, ``aliases``. Null values get null;
    empty ones are unmatched; ties go to the entry whose full name is nearest, then to the lower id. Each distinct value
    is searched once; a short list goes to the tasks whole, a longer one shard by shard, and the shards' winners are
    merged.
    """

    def search(known: Reference, b: pd.DataFrame, asked: list, part: bool) -> pd.DataFrame:
        got = known.nearest(b["value"], asked, part)
        return b[["value", "levels"]].assign(gaz_id=[g[0] for g in got], distance=[g[1] for g in got], full=[g[2] for g in got])

    won, shards = _searched(values, reference, shard_entries, search, _FOUND + ", full int")
    if shards > 1:
        won = won.groupBy("value", "levels").agg(F.min(F.when(F.col("gaz_id") >= 0, F.struct("distance", "full", "gaz_id"))).alias("w"))
        won = won.select("value", "levels", *[F.coalesce(F.col(f"w.{c}"), F.lit(-1)).alias(c) for c in ("gaz_id", "distance")])
    won = cut(won.select("value", "levels", "gaz_id", "distance"))
    return _back(values, won)


def entries_within(values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(value, levels, gaz_id, distance): every entry within the threshold of each distinct non-null value.

    Values without any give no rows; otherwise as :func:`map_values`.
    """

    def search(known: Reference, b: pd.DataFrame, asked: list, part: bool) -> pd.DataFrame:
        rows = [(v, ls, g, d) for v, ls, found in zip(b["value"], b["levels"], known.within(asked)) for g, d in sorted(found.items())]
        return pd.DataFrame(rows, columns=["value", "levels", "gaz_id", "distance"])

    return _searched(values, reference, shard_entries, search, _FOUND)[0]


def not_canonical(values: DataFrame, reference: DataFrame) -> DataFrame:
    """The non-null values that are not letter for letter a canonical name."""
    names = reference.select(F.col("canonical_name").alias("value")).where(F.col("value").isNotNull()).distinct()
    return values.where(F.col("value").isNotNull()).join(names, "value", "left_anti")
