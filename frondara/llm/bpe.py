"""Exact byte-pair encoding in linear time by backtracking, for public vocabularies of ranked byte strings.

A list of tokens is the exact merge result if and only if every two neighbours are: merging greedily by rank inside the
two tokens' joined bytes never crosses their border. So the encoder takes the longest token at each place (from an
Aho-Corasick automaton over the vocabulary), checks it against the last token in the pair-compatibility table, falls
back to the next shorter prefix token, and drops the last token where none fits. The table is filled as pairs occur.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: Pretokens kept per process with their ids; the memory is emptied when full. It changes the speed only.
MEMORY = 400_000


def vocabulary_folder() -> str:
    """The folder of the public vocabulary files."""
    if os.path.isdir("/opt/tokenizers"):
        return "/opt/tokenizers"
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


#: How byte_bpe_50k divides a text before merging (fixed by the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Code points whose class is looked up in a table; texts with others are divided by the pattern itself.
_TABLE = 0x2500
_RARE = re.compile(f"[^\\u0000-\\u{_TABLE - 1:04x}]")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other."""
    kinds = [regex.compile(p) for p in (r"\s", r"\p{L}", r"\p{N}")]
    return np.array([next((k for k, p in enumerate(kinds) if p.match(chr(c))), 3) for c in range(_TABLE)], np.uint8)


def common_words(texts: list[str]) -> list[list[str]]:
    """The pretokens of non-empty texts without rare characters, as PATTERN gives them.

    Runs of one class are pretokens, with three rules: the last of several white-space characters before a run stands
    alone, a blank there joins the run, and an apostrophe that begins a pretoken takes s, d, m, t, ll, ve or re.
    """
    if not texts:
        return []
    whole = "".join(texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[code]
    first = np.cumsum([0] + [len(t) for t in texts])
    n = len(code)
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    new[1:n] = kind[1:] != kind[:-1]
    new[first] = True
    begin = np.zeros(n + 1, bool)  # a text begins here
    begin[first] = True
    run = np.flatnonzero(new)
    start, stop = run[:-1], run[1:]
    space = (kind[start] == 0) & ~begin[stop]
    last = stop[space] - 1
    token = new.copy()
    token[last] = True
    blank = last[code[last] == 32]
    token[blank + 1] = False
    apostrophe = start[(stop - start == 1) & (code[start] == 39) & ~begin[stop]]
    apostrophe = apostrophe[token[apostrophe] & (kind[apostrophe + 1] == 1)]
    if len(apostrophe):
        after = code[apostrophe + 1]
        one = np.isin(after, [ord(c) for c in "sdmt"])
        pad = np.append(code, 0)
        second = np.where(begin[apostrophe + 2], 0, pad[np.minimum(apostrophe + 2, n)])
        two = np.zeros(len(apostrophe), bool)
        for pair in ("ll", "ve", "re"):
            two |= (after == ord(pair[0])) & (second == ord(pair[1]))
        for at, width in ((apostrophe[one], 2), (apostrophe[two], 3)):
            token[at + 1] = False
            token[at + width] = True
    cut = np.flatnonzero(token)
    share = np.searchsorted(cut, first).tolist()
    cut = cut.tolist()
    words = [whole[a:b] for a, b in zip(cut, cut[1:])]
    return [words[a:b] for a, b in zip(share, share[1:])]


class _Memory(dict):
    """Pretoken -> ids as little-endian int32 bytes, encoded on first sight."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word.encode("utf-8", "surrogatepass")), "<i4").tobytes()
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encoder of one vocabulary; ids are the ranks of the file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        self.length = np.array([len(b) for b in self.bytes_of], np.int32)
        self.words = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.size = [len(b) for b in self.bytes_of]
        self.prefix: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memory = _Memory(self.encode_bytes)

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; (-1, -1) for single bytes and for what no merge makes."""
        known = self.parts.get(token)
        if known is None:
            rank, bytes_of = self.rank.get, self.bytes_of
            pieces = [rank(bytes([b])) for b in bytes_of[token]]
            while len(pieces) > 2:
                made = [min(rank(bytes_of[x] + bytes_of[y], token), token) for x, y in zip(pieces, pieces[1:])]
                best = min(range(len(made)), key=made.__getitem__)
                if made[best] == token:
                    break
                pieces[best : best + 2] = [made[best]]
            known = self.parts[token] = (pieces[0], pieces[1]) if len(pieces) == 2 else (-1, -1)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the exact merging of the joined bytes keeps the border between the two tokens.

        The two tokens at the border are taken apart, the later made first; a merge across the border that comes
        before the one just undone would have broken it.
        """
        rank, bytes_of, parts = self.rank.get, self.bytes_of, self.parts.get
        a, b, before = left, right, len(bytes_of)
        while True:
            across = rank(bytes_of[a] + bytes_of[b])
            if across is not None and across < before and self._parts(across) == (a, b):
                return False
            pa, pb = parts(a) or self._parts(a), parts(b) or self._parts(b)
            if pa[0] < 0 and pb[0] < 0:
                return True
            # Of merges of the same rank the left one comes first, so the right one is undone first.
            if pb[0] < 0 or (pa[0] >= 0 and a > b):
                before, a = a, pa[1]
            else:
                before, b = b + 1, pb[0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            at = end - size + 1
            if longest[at] < 0 or self.size[longest[at]] < size:
                longest[at] = token
        fits, size_of = self.fits, self.size
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + size_of[token]]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self.compatible(*pair)
                    if good:
                        break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at += size_of[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
                token = self._shorter(token)
        return out

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if there is none."""
        known = self.prefix.get(token)
        if known is None:
            data, known = self.bytes_of[token], -1
            for size in range(len(data) - 1, 0, -1):
                t = self.rank.get(data[:size])
                if t is not None:
                    known = t
                    break
            self.prefix[token] = known
        return known

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of many texts; pretokens of texts of common characters are found in one pass over all of them."""
        out: list[np.ndarray] = [np.zeros(0, "<i4")] * len(texts)
        common = []
        for i, t in enumerate(texts):
            if t:
                if t.isascii() or not _RARE.search(t):
                    common.append(i)
                else:
                    out[i] = self.encode(t)
        for i, words in zip(common, common_words([texts[i] for i in common])):
            out[i] = np.frombuffer(b"".join(map(self.memory.__getitem__, words)), "<i4")
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; no ids for an empty or null one."""
        if not text:
            return np.zeros(0, "<i4")
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.words.findall(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, from one table of all tokens' bytes and their offsets."""
        table, starts = self._offsets()
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        index = np.repeat(starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return table[index].tobytes()

    def _offsets(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_table"):
            self._table = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(self.length) - self.length
        return self._table


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path)
