"""Held-out passages inside a corpus, whole or in part, altered here and there: spaced-seed hashing and verification.

Texts become sequences of folded words. Each mask of MASKS looks at some of as many neighbouring words and ignores the
others; a passage's hashes at every place are kept in one sorted table, and every place of every document is looked up
in it. A run of LEAST_WORDS words or more with at most one in ten altered, added or missing keeps 7 unaltered words in a
row somewhere (at 30 words, 3 of them missing: 27 in four stretches), so the first mask hits it there, besides wherever
only the ignored word is altered; a passage under LEAST_WORDS keeps 5, which the second mask looks at. All hits are
extended to both sides with differences allowed, and kept if they cover such a run.
"""

from __future__ import annotations

import unicodedata as u
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frondara.llm.lookalikes import decomposed, unify

#: Words in a row that make a case, and words per allowed difference.
LEAST_WORDS, PER_DIFFERENCE = 25, 10
#: Most differences of a case that holds no shorter one. Call the words of a run less ten for each difference its balance,
#: at least 0 in a case. Split such a case at any group of differences: a side of 25 words or more has a balance below 0,
#: or it would be a case; not both sides have one, so one is under 25 words with a balance of at least 0. Take the last
#: group whose front is so: its back is so too (else the front of the next group, or the back of this one, would make the
#: whole balance negative). Two balances of at most 24, less ten for each difference inside, pay 9 for each of the group.
MOST_DIFFERENCES = 2 * (LEAST_WORDS - 1) // (PER_DIFFERENCE - 1)
#: Which words under a mask it looks at, the first always, and the passages it serves: all, or those under LEAST_WORDS.
#: A hit of any mask is extended.
MASKS = (("1110111", False), ("11111", True))
#: Passages, and characters of them, that go to the tasks at a time; more of them are searched block by block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000
#: Documents worked on together.
SLICE = 256
#: Hits looked over together; speed only.
POSSIBLE_SLICE = 2048
_BROKEN = regex.compile(r"(?<=\w)[-‐¬­]\s+(?=\w)")
_TABLE = 0x2500
_RARE = regex.compile(f"[^\\u0000-\\u{_TABLE - 1:04x}]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> folded letter or digit; 0 between words, 1 for what is left out."""
    out = np.zeros(_TABLE, np.uint64)
    for n in range(_TABLE):
        c = decomposed(chr(n))
        base = u.normalize("NFD", c)[:1].lower()[:1]
        if c == "" or (base and u.category(base) in ("Mn", "Cf")):
            out[n] = 1
        elif base and u.category(base)[0] in "LN":
            out[n] = ord(base)
    return out


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.ones(size, np.uint64)
        a, b = one * _BASE, one * _INVERSE
        a[0] = b[0] = 1
        return np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, (size - 1).bit_length()))


def _beyond(m: regex.Match) -> str:
    """A character beyond the table: letters and digits are kept, marks left out, others stand between words."""
    c = m[0]
    base, kind = u.normalize("NFD", c)[0], u.category(c)
    if ord(base) < _TABLE:
        return base
    return c.lower()[0] if kind[0] in "LN" else "" if kind in ("Mn", "Cf") else " "


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total): letter case, accents, punctuation, spacing and
    words broken at line ends make no difference; null is a text without words. In scripts without spaces a word is what
    stands between punctuation."""
    plain = []
    for t in texts:
        t = t or ""
        if not t.isascii() and _RARE.search(t):
            t = unify(t)
            t = _RARE.sub(_beyond, t)
        if "-" in t or not t.isascii():
            t = _BROKEN.sub("", t)
        plain.append(t)
    whole = "\n".join(plain) + "\n"
    point = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    beyond = point >= _TABLE
    code = np.where(beyond, point, _folding()[np.where(beyond, 0, point)]) if beyond.any() else _folding()[point]
    ends = np.cumsum([len(t) + 1 for t in plain]) if plain else np.zeros(0, int)
    left = code != 1
    if not left.all():
        ends = np.cumsum(left)[ends - 1]
        code = code[left]
    n = len(code)
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code * up[:n], out=sums[1:])
        inside = code != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        h = (sums[b] - sums[a]) * down[a]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, np.concatenate([[0], np.searchsorted(a, ends)])


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each place at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ words[k : k + n]) * np.uint64(0x94D049BB133111EB)
                out ^= out >> np.uint64(31)
    return out


class Passages:
    """Seed hashes of the held-out passages, sorted, with a bit table in front of the search."""

    BITS = 22

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words, self.first = word_hashes(texts)
        owner = np.repeat(np.arange(len(ids)), np.diff(self.first))
        self.tables = []
        short = np.diff(self.first) < LEAST_WORDS
        for mask, only_short in MASKS:
            h = seed_hashes(self.words, mask)
            at = np.arange(len(h))
            whole = owner[at] == owner[at + len(mask) - 1] if len(h) else np.zeros(0, bool)
            if only_short:
                whole &= short[owner[at]]
            if not whole.any():
                continue
            h, at = h[whole], at[whole]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << self.BITS, bool)
            bits[(h >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((mask, h[order], at[order], bits))
        self.owner = owner

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, place in passages) of a pair of equal words in each seed hit of any mask, once each.

        The pair is that at a multiple of the mask's length, so that neighbouring hits share it and every run of so many
        unaltered words holds one; where the mask ignores that word and it differs, it is the first pair.
        """
        size, found = max(1, len(self.words)), [np.zeros(0, np.int64)]
        for mask, table, at, bits in self.tables:
            h = seed_hashes(words, mask)
            maybe = np.flatnonzero(bits[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
            lo = np.searchsorted(table, h[maybe], "left")
            n = np.searchsorted(table, h[maybe], "right") - lo
            q = np.repeat(maybe, n)
            inner = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            p = at[np.repeat(lo, n) + inner]
            ok = q + len(mask) <= first[np.searchsorted(first, q, "right")]
            for d, bit in enumerate(mask):
                if bit == "1":
                    ok &= words[q + d] == self.words[p + d]
            q, p = q[ok], p[ok]
            step = -q % len(mask)
            step[words[q + step] != self.words[p + step]] = 0
            found.append((q + step) * size + p + step)
        return np.divmod(np.unique(np.concatenate(found)), size)


def possible(words: np.ndarray, known: Passages, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a shortest case can run through each pair of equal words; holds() decides.

    A word of the passage counts as unaltered if the document has it at most MOST_DIFFERENCES places off the pair's
    diagonal, as every unaltered word of a case is; LEAST_WORDS or more of them in a row around the pair must hold enough.
    """
    edge, off = 2 * LEAST_WORDS + MOST_DIFFERENCES, MOST_DIFFERENCES
    x = np.concatenate([np.zeros(edge + off, np.uint64), words, np.zeros(edge + off, np.uint64)])
    y = np.concatenate([np.ones(edge, np.uint64), known.words, np.ones(edge, np.uint64)])
    ends = np.arange(edge + 1, 2 * edge + 1)
    starts = np.minimum(edge, ends - LEAST_WORDS)
    out = np.zeros(len(at), bool)
    for a in range(0, len(at), POSSIBLE_SLICE):
        q, p = at[a : a + POSSIBLE_SLICE], place[a : a + POSSIBLE_SLICE]
        near = x[q[:, None] + np.arange(2 * (edge + off))]
        item = y[p[:, None] + np.arange(2 * edge)]
        same = np.zeros(item.shape, bool)
        for k in range(2 * off + 1):
            same |= item == near[:, k : k + 2 * edge]
        gain = np.zeros((len(q), 2 * edge + 1), np.int32)
        np.cumsum(np.where(same, 1, 1 - PER_DIFFERENCE), axis=1, out=gain[:, 1:])
        least = np.minimum.accumulate(gain[:, : edge + 1], axis=1)
        out[a : a + POSSIBLE_SLICE] = (gain[:, ends] >= least[:, starts]).any(axis=1)
    return out | (np.diff(known.first)[known.owner[place]] < LEAST_WORDS)


def _reach(x: np.ndarray, y: np.ndarray, differences: int) -> list[int]:
    """For each number of differences up to the given: most words of y's front that x's front can cover, the last of
    them equal, so that a run never ends in differences.

    Bit j of a diagonal k says that j words of y can be covered by j + k words of x.
    """
    equal: dict[int, int] = {}
    for k in range(-differences, differences + 1):
        j = max(0, -k)
        n = min(len(y), len(x) - k) - j
        same = np.packbits(x[j + k : j + k + n] == y[j : j + n], bitorder="little") if n > 0 else np.zeros(0, np.uint8)
        equal[k] = int.from_bytes(same.tobytes(), "little") << j
    reached, covered, out = {0: 1}, 0, []
    for d in range(differences + 1):
        if d:
            at = reached.get
            # Altered, added, missing.
            reached = {k: at(k, 0) << 1 | at(k - 1, 0) | at(k + 1, 0) << 1 for k in range(-d, d + 1)}
        for k, r in reached.items():
            e = equal[k]
            # The carry of the sum runs through equal words.
            reached[k] = r = (((r & e) + e) ^ e) | r
            covered = max(covered, ((r & e) << 1).bit_length() - 1)
        out.append(covered)
    return out


def holds(doc: np.ndarray, item: np.ndarray, i: int, j: int) -> bool:
    """Whether a case runs through the pair of equal words doc[i], item[j]."""
    # Of the passage, two sides and the altered or missing words between them; of the document, as many more as were added.
    span = 2 * LEAST_WORDS + 2 * MOST_DIFFERENCES
    right = _reach(doc[i : i + span], item[j : j + span - MOST_DIFFERENCES], MOST_DIFFERENCES)
    left = _reach(doc[max(0, i - span) : i][::-1], item[max(0, j - span) : j][::-1], MOST_DIFFERENCES)
    least = min(LEAST_WORDS, len(item))
    for a, la in enumerate(left):
        for b, rb in enumerate(right):
            if la + rb >= least and a + b <= (la + rb) // PER_DIFFERENCE:
                return True
    return False


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", passage_col: str = "reference") -> DataFrame:
    """(doc_id, item_id) of every document that holds an item's passage or LEAST_WORDS of its words in a row.

    Passages shorter than five words can't be found and give no rows; shorter than LEAST_WORDS they must occur whole, with
    no more differences than one in ten. A run begins and ends with equal words.
    Null and empty texts give no rows; repeated rows give repeated rows. The corpus is read once for each BLOCK_ITEMS
    items and never shuffled.
    """
    spark = docs.sparkSession
    items = items.select(item_id, passage_col).where(F.col(passage_col).isNotNull())
    n_items, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(passage_col)), F.lit(0))).first()
    blocks = max(-(-n_items // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    schema = T.StructType([docs.schema[doc_id], items.schema[item_id]])
    out = spark.createDataFrame([], schema)
    for k in range(max(1, blocks)):
        block = items.where(F.pmod(F.xxhash64(F.col(item_id)), F.lit(max(1, blocks))) == k).toPandas()
        if not len(block):
            continue
        shared = spark.sparkContext.broadcast(Passages(block[item_id].tolist(), block[passage_col].tolist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    b = whole.slice(at, SLICE)
                    pairs = find_in(known, b.column(1).to_pylist())
                    if pairs:
                        rows = pa.array([p[0] for p in pairs], pa.int64())
                        found = pa.array([known.ids[p[1]] for p in pairs])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), found], names=[doc_id, item_id])

        part = docs.select(doc_id, text_col).mapInArrow(run, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def find_in(known: Passages, texts: list[str | None]) -> list[tuple[int, int]]:
    """(text, passage) numbers of all cases in a few texts."""
    words, first = word_hashes(texts)
    at, place = known.hits(words, first)
    maybe = possible(words, known, at, place)
    at, place = at[maybe], place[maybe]
    out: set[tuple[int, int]] = set()
    for i, j in zip(at.tolist(), place.tolist()):
        d, k = int(np.searchsorted(first, i, "right")) - 1, int(known.owner[j])
        if (d, k) in out:
            continue
        if holds(words[first[d] : first[d + 1]], known.words[known.first[k] : known.first[k + 1]], i - int(first[d]), j - int(known.first[k])):
            out.add((d, k))
    return sorted(out)
