"""Token ids of a whole column, and pieces of oversized texts cut at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frondara.llm.bpe import encoder, vocabulary_folder

#: Vocabulary file used unless another is named.
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: Rows handed on at a time, so that long texts don't pile up.
SLICE = 512
#: Pieces: most tokens of a piece, tokens shared by neighbours, and the least share of the limit a piece may fill.
LIMIT, OVERLAP, LEAST_FILL = 1024, 64, 0.5
#: Strength of the boundaries at which a text may be cut, strongest first: blank line, line end, sentence, clause, word.
BOUNDARIES = ((r"\s*\n\s*\n\s*", 5), (r"[^\S\n]*\n\s*", 4), (r"(?<=[.!?…][\"'»”)\]]?)\s+", 3), (r"(?<=[,;:])\s+", 2), (r"\s+", 1))
_CUTS = [(regex.compile(p), s) for p, s in BOUNDARIES]


def vocabulary_path(path: str | None = None) -> str:
    return path or f"{vocabulary_folder()}/{DEFAULT_FILE}"


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row; null and empty texts give an empty list. No shuffle.

    Special tokens are none: their strings are ordinary text. Repeated rows stay repeated; other columns are not read.
    """
    path = vocabulary_path(path)
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                ids = enc.encode_batch(b.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


class StrongestCut:
    """Sparse table over boundary strengths: the rightmost strongest cut of any window in constant time."""

    def __init__(self, strength: np.ndarray):
        n = len(strength)
        self.best = [np.arange(n)]
        self.strength = strength
        width = 1
        while 2 * width <= n:
            a, b = self.best[-1][: n - 2 * width + 1], self.best[-1][width : n - width + 1]
            self.best.append(np.where(strength[b] >= strength[a], b, a))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """The rightmost strongest place in [lo, hi]."""
        k = int(hi - lo + 1).bit_length() - 1
        a, b = int(self.best[k][lo]), int(self.best[k][hi - (1 << k) + 1])
        return b if self.strength[b] >= self.strength[a] else a


def boundary_strengths(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strength, character offset) of each token border (byte offsets ``ends``); -1 inside a character."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    lead = (data & 0xC0) != 0x80
    char_at = np.append(np.cumsum(lead) - 1, int(lead.sum()))  # the character a byte belongs to
    by_char = np.zeros(len(text) + 1, np.int8)
    for pattern, s in _CUTS:
        for m in pattern.finditer(text):
            for x in (m.start(), m.end()):
                by_char[x] = max(by_char[x], s)
    strength = by_char[char_at[ends]].astype(np.int8)
    inner = ends < len(data)
    strength[inner] = np.where(lead[ends[inner]], strength[inner], -1)
    return strength, char_at[ends]


def cut_pieces(text: str, enc, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of a text, in characters; one piece if the text is within the limit.

    A piece ends at the strongest boundary of its last tokens (at least LEAST_FILL of the limit are filled where the
    text goes on), the rightmost of equal ones; if there is none, between two characters. The next piece starts
    ``overlap`` of the whole text's tokens before the cut, further left if that is inside a character. Every piece encodes to at most
    ``limit`` tokens.
    """
    if not 0 <= overlap < limit // 2 or limit < 16:
        raise ValueError("limit must be at least 16 and overlap less than half of it")
    ids = enc.encode(text)
    n = len(ids)
    if n <= limit:
        return [(0, len(text), n)] if n else []
    ends = np.concatenate([[0], np.cumsum(enc.length[ids])])
    strength, char = boundary_strengths(text, ends)
    table = StrongestCut(strength)
    out: list[tuple[int, int, int]] = []
    start = 0
    while True:
        room = limit
        while True:
            if n - start <= room:
                stop = n
            else:
                stop = table.query(start + max(overlap + 8, int(room * LEAST_FILL)), start + room)
            size = len(enc.encode(text[char[start] : char[stop]]))
            if size <= limit:
                break
            room -= size - limit
        out.append((int(char[start]), int(char[stop]), size))
        if stop == n:
            return out
        start = stop - overlap
        while strength[start] < 0:
            start -= 1


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """(id, piece, start, end, n_tokens, text) of every text with more than ``limit`` tokens, pieces numbered from 0.

    Texts within the limit, null and empty ones have no pieces. No shuffle; a text is one unit of work.
    """
    path = vocabulary_path(path)
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.IntegerType()) for c in ("piece", "start", "end", "n_tokens")), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = [f.name for f in schema]
        types = [None, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for whole in batches:
            types[0] = whole.schema.field(0).type
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                rows: list[tuple] = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    # A token covers at least one byte, so a text of no more bytes than the limit is within it.
                    if text and (len(text) > limit or len(text.encode("utf-8", "surrogatepass")) > limit):
                        cut = cut_pieces(text, enc, limit, overlap)
                        if len(cut) > 1:
                            rows += [(i, k, s, e, m, text[s:e]) for k, (s, e, m) in enumerate(cut)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
