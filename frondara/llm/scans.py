"""Readable paragraphs from the text of scanned pages: running heads, page numbers, broken words, misread characters.

Two passes. The first counts, over all records and in the JVM, how often every word occurs, which hyphenated compounds
the corpus itself writes inside a line, which lines stand next to a page number again and again (folded, so that a
misread running head counts with the right one), and which endings the words in capitals of such lines share, since heads
that name the page's own contents each come a few times only. Only what reaches a share of the records is kept, so these
tables are bounded by the words of a record divided by the share, whatever the number of records. The second pass repairs
record by record: furniture out, lines joined where the corpus' words say so, misread words replaced.
"""

from __future__ import annotations

import re
import unicodedata as u
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frondara.llm.lookalikes import unify

#: A word is a known one from this share of a field's records; words are counted down to LOW_SHARE.
KNOWN_SHARE, LOW_SHARE = 0.003, 0.0003
#: A known word replaces a misread one only if it is so many times as frequent.
TIMES = 8
#: Share of the records (and least number) that show a folded line beside a page number, for a running head.
HEAD_SHARE, HEAD_LEAST = 0.0002, 3
#: Letters of an ending shared by heads in capitals, their least length, and the share of all numbered lines that have it.
ENDING, CAPITALS, ENDING_SHARE = 5, 6, 0.1
#: Share of a field's records from which a word that is mostly capitalised counts as a word of the text, not a name.
CAPITAL_SHARE = 0.08

# What is read for what, in scanned type.
MISREAD = {
    "rn": "m", "nt": "m", "cl": "d", "ii": "u", "li": "h", "ri": "n", "vv": "w", "im": "un", "iii": "m",
    "c": "e", "e": "c", "i": "rlt", "f": "t", "t": "fl", "n": "au", "a": "n", "u": "n", "b": "h", "h": "b", "y": "v", "v": "y", "g": "q", "q": "g", "l": "it", "o": "e", "r": "i",
    "0": "o", "1": "li", "5": "s", "6": "bó", "8": "b", "9": "gq", "2": "z", "3": "e", "4": "a", "7": "t",
}
#: Letters read for digits.
DIGIT_LIKE = "oOlISBZbEgqGDQT"
#: Conjunctions that follow a suspended hyphen.
SUSPENDED = {"y", "e", "o", "u", "and", "or", "et", "a"}

CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
_END_MARK = re.compile(r"[‐¬­](?=[ \t]*(?:\r?\n|$))")
_LINE = re.compile(r"\r?\n")
_NUMBER = r"\d{1,4}"
_PAGE_LINE = re.compile(rf"\s*(?:{_NUMBER}|\[\s*{_NUMBER}\s*\]|[—–-]\s*{_NUMBER}\s*[—–-]|p[aá]g\.?\s*{_NUMBER})\s*")
_PAGE_INLINE = re.compile(rf"\[\s*{_NUMBER}\s*\]|(?<!\S)[—–-]\s+{_NUMBER}\s+[—–-](?!\S)|\bp[aá]g\.\s*{_NUMBER}\b")
#: A word in capitals, as running heads print names, with another word before a dash.
_CAPITALS = re.compile(rf"(?:\b[^\W\d_]+\s*[—–]\s*)?\b([A-ZÁÉÍÓÚÑÜ0-9]{{{CAPITALS},}})\b")
_BEFORE = re.compile(rf"(?<![\w.–-]){_NUMBER}\s*[·—|]?\s*$")
_AFTER = re.compile(rf"\s*[·—|]?\s*{_NUMBER}(?![\w.:(–-])")
#: From the start of a word only, so that a long run of letters is read once.
_HYPHEN = re.compile(r"(?<![^\W_])([^\W_]+)([-¬])(\s+|)([^\W_]*)")
#: Characters before a head in which its page number is looked for.
NEAR = 40
_WORD = re.compile(r"[^\W_]+")
_LETTER_NUMBER = re.compile(rf"(?<![^\W_])[{DIGIT_LIKE}]{{1,4}}(?=–\d|–[{DIGIT_LIKE}\d]{{2,4}}\b|\(–\d)|(?<=\d–)[{DIGIT_LIKE}]{{2,4}}(?![^\W_])")
_FOLD = str.maketrans("l1|0586q92", "iiiosbbggz")
_QUICK = {n: None for n in range(0x2100) if not chr(n).isalnum()} | _FOLD | {ord(a): b for a, b in zip("áéíóúüñàèìòùâêîôûç", "aeiouunaeiouaeiouc")}


def fold(text: str) -> str:
    """Letters without accents, case and blanks; characters that scans confuse become one."""
    quick = text.lower().translate(_QUICK)
    if quick.isascii():
        return quick
    return "".join(c for c in u.normalize("NFD", text.lower()).translate(_FOLD) if c.isalnum())


def _folded_line(line: Column) -> Column:
    """The same folding for lines in the JVM, digits of page numbers taken off."""
    plain = F.lower(F.regexp_replace(line, r"^\s*\d{1,4}[\s·—|]+(?=\p{L})|(?<=\p{L})[\s·—|]+\d{1,4}\s*$", ""))
    plain = F.translate(plain, "áéíóúüñàèìòùâêîôûç", "aeiouunaeiouaeiouc")
    return F.regexp_replace(F.translate(plain, "l1|0586q92", "iiiosbbggz"), r"[^\p{L}\p{N}]", "")


@dataclass
class Corpus:
    """What the whole corpus says: shares of words, compounds, running heads."""

    share: dict[str, float] = field(default_factory=dict)
    lower: dict[str, float] = field(default_factory=dict)
    compounds: set[str] = field(default_factory=set)
    heads: list[str] = field(default_factory=list)
    endings: set[str] = field(default_factory=set)

    @cached_property
    def by_length(self) -> dict[int, list[str]]:
        """The heads, and at each length those that a line of that length can be a misreading of."""
        out: dict[int, list[str]] = {}
        for h in self.heads:
            for n in range(len(h) - 2, len(h) + 3):
                out.setdefault(n, []).append(h)
        return out

    @cached_property
    def inside(self) -> ahocorasick.Automaton | None:
        """Finds all heads in a folded text at once."""
        if not self.heads:
            return None
        out = ahocorasick.Automaton()
        for h in self.heads:
            out.add_word(h, h)
        out.make_automaton()
        return out

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("share", "lower", "compounds", "heads", "endings")}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.known), default=0)

    @cached_property
    def _lines(self) -> dict[str, bool]:
        return {}

    @cached_property
    def known(self) -> set[str]:
        return {w for w, s in self.share.items() if s >= KNOWN_SHARE and (self.lower.get(w, 0) >= 0.5 or s >= CAPITAL_SHARE) and w.isalpha()}

    @cached_property
    def parts(self) -> tuple[set[str], set[str]]:
        return {c.split("-")[0] for c in self.compounds}, {c.split("-")[-1] for c in self.compounds}

    @cached_property
    def _memory(self) -> dict[tuple[str, bool], str | None]:
        return {}

    def right_form(self, word: str, loose: bool) -> str | None:
        """The known word that this one is misread from; None if it is right or simply unknown.

        ``loose``: in running prose without names any known word within one difference (two from seven letters)
        will do; elsewhere only the confusions of MISREAD.
        """
        w = word.lower()
        key = (w, loose)
        if key not in self._memory:
            if len(self._memory) > 500_000:
                self._memory.clear()
            self._memory[key] = self._right_form(w, loose)
        return self._memory[key]

    @cached_property
    def _misreadings(self) -> dict[str, list[str]]:
        """What each known word becomes by one confusion -> the known words."""
        out: dict[str, list[str]] = {}
        for y in sorted(self.known):
            for bad, goods in MISREAD.items():
                for good in [goods] if len(bad) > 1 else goods:
                    for x in _replaced(y, good, bad):
                        out.setdefault(x, []).append(y)
        return out

    @cached_property
    def _shortened(self) -> dict[str, list[str]]:
        """The known words with up to two letters left out -> the known words."""
        out: dict[str, list[str]] = {}
        for y in sorted(self.known):
            for x in _left_out(y, 2):
                out.setdefault(x, []).append(y)
        return out

    def _right_form(self, w: str, loose: bool) -> str | None:
        if len(w) > self.longest + 2:
            return None  # two confusions take off two letters at most
        own = self.share.get(w, 0.0)
        least = max(own * TIMES, KNOWN_SHARE)

        def best(found: set[str]) -> str | None:
            fit = [y for y in found if y != w and self.share[y] >= least and (len(y) > 1 or w == "rn") and (len(w) > 2 or len(y) < len(w) or not w.isalpha())]
            return max(fit, key=lambda y: (self.share[y], y), default=None)

        right = best(set(self._misreadings.get(w, ())))
        if right is None and len(w) > 3:
            once = {x for bad, goods in MISREAD.items() for good in ([goods] if len(bad) > 1 else goods) for x in _replaced(w, bad, good)}
            right = best({y for x in once for y in self._misreadings.get(x, ())})
        if right is None and loose and own < KNOWN_SHARE and len(w) >= 4:
            most = 2 if len(w) >= 7 else 1
            near = {y for x in _left_out(w, most) for y in self._shortened.get(x, ())}
            right = min(((d, -self.share[y], y) for y in near if (d := _distance(w, y, most)) <= most), default=(0, 0, None))[2]
        return right


def _replaced(word: str, old: str, new: str) -> Iterator[str]:
    """The word with one occurrence of ``old`` put as ``new``, for each of them."""
    at = word.find(old)
    while at >= 0:
        yield word[:at] + new + word[at + len(old) :]
        at = word.find(old, at + 1)


def _left_out(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out; words within so many edits share one of these."""
    out = front = {word}
    for _ in range(most):
        front = {x[:i] + x[i + 1 :] for x in front for i in range(len(x))}
        out = out | front
    return out


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is greater."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def learn(texts: DataFrame) -> Corpus:
    """The corpus tables from all rows of (field, text); null texts don't count."""
    texts = texts.where(F.col("text").isNotNull()).select("field", "text")
    sizes = {r["field"]: r["n"] for r in texts.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a field
    if not sizes:
        return Corpus()
    records = F.create_map(*[F.lit(x) for kv in sizes.items() for x in (kv[0], float(kv[1]))])[F.col("field")]
    unbroken = F.regexp_replace("text", r"[\p{L}\p{N}]+[-‐¬­]\s+[\p{L}\p{N}]*", " ")
    words = F.array_distinct(F.regexp_extract_all(unbroken, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}]+)?"), F.lit(0)))
    tokens = texts.select("field", F.explode(words).alias("w")).withColumn("low", F.lower("w"))
    counts = tokens.groupBy("field", "low").agg(F.count(F.lit(1)).alias("n"), F.avg((F.substring("w", 1, 1) == F.substring("low", 1, 1)).cast("double")).alias("lower"))
    kept = counts.withColumn("share", F.col("n") / records).where((F.col("share") >= LOW_SHARE) & (F.col("n") >= 2))
    out = Corpus()
    for r in kept.collect():  # at most fields * words of a record / LOW_SHARE rows
        w = r["low"]
        if r["share"] > out.share.get(w, 0):
            out.share[w], out.lower[w] = r["share"], r["lower"]
        if "-" in w and r["share"] >= KNOWN_SHARE:
            out.compounds.add(w)
            for part in w.split("-"):
                out.share[part] = max(out.share.get(part, 0), r["share"])
                out.lower[part] = max(out.lower.get(part, 0), r["lower"])
    lines = texts.select("field", F.explode(F.split("text", r"\r?\n")).alias("line")).where(
        F.col("line").rlike(r"^\s*\d{1,4}[\s·—|]+\p{L}[\p{L}\p{N} ]{6,}\s*$|^\s*\p{L}[\p{L}\p{N} ]{6,}[\s·—|]+\d{1,4}\s*$")
    )
    least = max(HEAD_LEAST, HEAD_SHARE * sum(sizes.values()))
    heads = lines.groupBy(_folded_line(F.col("line")).alias("head")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.length("head") >= 10))
    out.heads = sorted((r["head"] for r in heads.collect()), key=len, reverse=True)  # at most lines of a record / HEAD_SHARE rows
    capitals = F.regexp_extract("line", rf"\b(\p{{Lu}}{{{CAPITALS},}})(?:[\s·—|]+\d{{1,4}})?\s*$", 1)
    ended = lines.groupBy(F.when(capitals != "", F.substring(_folded_line(capitals), -ENDING, ENDING)).alias("ending")).agg(F.count(F.lit(1)).alias("n"))
    total = ended.agg(F.sum("n")).scalar()
    often = ended.where(F.col("ending").isNotNull() & (F.col("n") >= HEAD_LEAST) & (F.col("n") >= ENDING_SHARE * total))
    out.endings = {r["ending"] for r in often.select("ending").collect()}  # at most 1 / ENDING_SHARE rows
    return out


def _squeezed(text: str) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters, its place in the text."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in fold(c):
            out.append(x)
            at.append(i)
    return "".join(out), at


_NUMBERED = re.compile(rf"^\s*{_NUMBER}[\s·—|]+|[\s·—|]+{_NUMBER}\s*$")


def _is_capital_head(word: str, corpus: Corpus) -> bool:
    """Whether a word in capitals ends like the heads in capitals, up to one misread letter."""
    end = fold(word)[-ENDING:]
    return any(end == x or _distance(end, x, 1) <= 1 for x in corpus.endings) and sum(c.isalpha() for c in word) * 2 > len(word)


def _near_head(line: str, corpus: Corpus) -> bool:
    """Whether a line, but for its page number, is a running head or a misread one."""
    if line not in corpus._lines:
        bare = _NUMBERED.sub("", line)
        x = fold(bare)
        near = any(x == h or _distance(x, h, len(h) // 8) <= len(h) // 8 for h in corpus.by_length.get(len(x), ()))
        m = None if near else _CAPITALS.fullmatch(bare.strip())
        if len(corpus._lines) > 500_000:
            corpus._lines.clear()
        corpus._lines[line] = near or bool(m and _is_capital_head(m[1], corpus))
    return corpus._lines[line]


def without_furniture(text: str, corpus: Corpus) -> tuple[str, bool]:
    """The text without running heads and page numbers, and whether there were any.

    A head is a line of its own, repeated over the corpus or in capitals that end like the repeated ones; inside a line
    it must be a repeated one, or in such capitals beside a number.
    """
    found = False
    lines = text.split("\n")
    if len(lines) > 1:
        kept = []
        for line in lines:
            bare = line.strip()
            if bare and (_PAGE_LINE.fullmatch(bare) or _near_head(bare, corpus)):
                found = True
            else:
                kept.append(line)
        text = "\n".join(kept)
    spans = [m.span() for m in _PAGE_INLINE.finditer(text)]
    heads = []
    if corpus.inside is not None and next(corpus.inside.iter(text.lower().translate(_QUICK)), None):
        squeezed, at = _squeezed(text)
        for end, h in corpus.inside.iter(squeezed):
            a, b = at[end - len(h) + 1], at[end] + 1
            if not (a and text[a - 1].isalpha()) and not (b < len(text) and text[b].isalpha()):
                heads.append((a, b, False))
    if corpus.endings:
        heads += [(*m.span(), True) for m in _CAPITALS.finditer(text) if _is_capital_head(m[1], corpus)]
    for a, b, capital in heads:
        before = _BEFORE.search(text, max(0, a - NEAR), a)
        after = _AFTER.match(text, b)
        if before or after or not capital:
            spans.append((before.start() if before else a, b if before or not after else after.end()))
    kept, at = [], 0
    for a, b in sorted(spans):
        found = True
        if a >= at:  # heads may lie inside one another
            kept.append(text[at:a])
        at = max(at, b)
    return "".join([*kept, text[at:]]) if spans else text, found


def _is_break(a: str, mark: str, gap: str, b: str, corpus: Corpus) -> bool:
    """Whether the hyphen between a and b is that of a line end, by the corpus' words: it writes both as one word, or does
    not know a part as a word of its own; never where it writes the compound, nor before a capital without that evidence."""
    x, y = a.lower(), b.lower()
    if a.isdigit() or not a or not any(c.isalpha() for c in a):
        return False
    if mark == "¬":
        return not (x in corpus.known and y in corpus.known and x + y not in corpus.share)
    if not b:
        return False
    if not gap:
        return x + y in corpus.known and f"{x}-{y}" not in corpus.compounds
    first, second = corpus.parts
    if f"{x}-{y}" in corpus.compounds or (x in first and (y in second or corpus.right_form(y, True) in second)) or (y in second and corpus.right_form(x, True) in first):
        return False
    if x + y in corpus.share:
        return True
    if y in SUSPENDED or not corpus.share or (b[0].isupper() and not a.isupper()):
        return False
    return x not in corpus.share or y not in corpus.share


def joined(text: str, corpus: Corpus) -> tuple[str, bool]:
    """The text in one line, words broken at line ends put together, and whether there were any."""
    found = False

    def put(m: re.Match) -> str:
        nonlocal found
        a, mark, gap, b = m.groups()
        if _is_break(a, mark, gap, b, corpus):
            found = True
            return a + b
        return a + ("-" if mark == "-" or b else "") + (" " if gap and b.lower() in SUSPENDED else "" if b and gap and "\n" in gap else gap) + b

    while len(new := _HYPHEN.sub(put, text)) < len(text):  # a word can be broken again
        text = new
    text = new
    return re.sub(r"[ \t]*\r?\n\s*", " ", text), found


def repaired(text: str, corpus: Corpus, scanned_prose: bool) -> tuple[str, bool]:
    """The text with misread words and numbers put right, and whether there were any."""
    found = bool(CONTROL.search(text))
    text = CONTROL.sub("", text)
    edge = re.search(r"\bm\s*;", text)
    loose_to = len(text) if scanned_prose else edge.start() if edge else 0

    def put(m: re.Match) -> str:
        nonlocal found
        w = m[0]
        if w.isdigit():
            return w
        if not w.isalpha():
            number = w.translate(str.maketrans("oOlISBZbEgqGDQT", "001158268996007"))
            right = corpus.right_form(w, False)
            if right is None and not (number.isdigit() and len(w) > 1) and not any(c.islower() for c in w):
                return w
            found = True
            right = right or (number if number.isdigit() else None) or corpus.right_form(w, True)
            return (right.capitalize() if w[0].isupper() or w[0] == "8" else right) if right else w
        right = corpus.right_form(w, m.start() < loose_to and not w.isupper())
        if right is None:
            return w
        found = True
        return right.upper() if w.isupper() and len(w) > 1 else right.capitalize() if w[0].isupper() else right

    text = _WORD.sub(put, text)
    new = _LETTER_NUMBER.sub(lambda m: m[0].translate(str.maketrans("oOlISBZbEgqGDQT", "001158268996007")), text)
    return new, found or new != text


def repair(text: str | None, corpus: Corpus, scanned_prose: bool) -> tuple[str | None, list[str]]:
    """The readable text and the kinds of trace it had: hyphen, chars, furniture."""
    if text is None or not text.strip():
        return text, []
    t = unify(_END_MARK.sub("¬", text).replace("\r\n", "\n"))
    t, furniture = without_furniture(t, corpus)
    marked = CONTROL.sub("", t)
    one, hyphen = joined(marked, corpus)
    one, chars = repaired(one, corpus, scanned_prose)
    chars = chars or marked != t
    kinds = [k for k, there in (("hyphen", hyphen), ("chars", chars), ("furniture", furniture)) if there]
    return re.sub(r"[ \t]{2,}", " ", one).strip(), kinds


def readable(texts: DataFrame, prose_fields: tuple[str, ...] = ()) -> DataFrame:
    """(field, rec_id, text, clean, kinds) of all rows of (field, rec_id, text).

    Null stays null and blank texts stay as they are, without kinds; repeated rows are repaired alike. Fields named in
    ``prose_fields`` hold no names, so that any unknown word near a known one is taken for misread there. Other columns
    are dropped. The corpus tables are sent to the tasks; see :func:`learn` for their bound.
    """
    corpus = texts.sparkSession.sparkContext.broadcast(learn(texts))
    texts = texts.select("field", "rec_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = corpus.value
        for pdf in batches:
            done = [repair(t, known, f in prose_fields) for f, t in zip(pdf["field"], pdf["text"])]
            yield pdf.assign(clean=[d[0] for d in done], kinds=[d[1] for d in done])

    return texts.mapInPandas(run, "field string, rec_id bigint, text string, clean string, kinds array<string>")
