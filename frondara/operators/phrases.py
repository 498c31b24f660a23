"""Phrases of a reference list in texts: all of them, or the longest first with their places consumed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frondara.session import cut

#: Phrases that go to the tasks in one automaton at most; a longer list is searched in as many blocks as it needs.
PHRASES = 500_000


def _longest(hits: list[tuple[int, str, list[tuple[int, str | None]]]]) -> Iterator[tuple[int, str | None, str, int]]:
    """(entry, level, alias, start) of the longest aliases first, in alphabetical order, each consuming its span of its level."""
    taken: dict[str | None, list[tuple[int, int]]] = {}
    for start, alias, entries in sorted(hits, key=lambda h: (-len(h[1]), h[1], h[0])):
        end = start + len(alias)
        free = {level for _, level in entries if not any(start < e and s < end for s, e in taken.get(level, ()))}
        for level in free:
            taken.setdefault(level, []).append((start, end))
        for gid, level in sorted(entries, key=lambda e: (e[1] or "", e[0])):
            if level in free:
                yield gid, level, alias, start


def phrase_matches(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str, longest: bool) -> DataFrame:
    """(id, gaz_id, hierarchy_level, alias, start) of phrase occurrences in folded texts, without word boundaries.

    With ``longest``, for each level longer aliases come first (equally long ones in alphabetical order, then the earlier place) and consume their span; every
    entry of an alias is given. Null texts and an empty list give no rows; repeated texts repeated rows. Each block of
    PHRASES phrases is one pass over the texts by an Aho-Corasick automaton; with several blocks the longest are chosen
    from the hits of all of them, a text's hits together.
    """
    schema = T.StructType([texts.schema[id_col], T.StructField("gaz_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("hierarchy_level", "alias")), T.StructField("start", T.IntegerType())])
    names = [f.name for f in schema]
    blocks = max(1, -(-phrases.count() // PHRASES))
    texts = texts.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    if blocks > 1 and longest:
        texts = cut(texts.withColumn("_row", F.monotonically_increasing_id()))

    def found(part: DataFrame, keep: list[str], out: T.StructType, choose: bool) -> DataFrame:
        by_alias: dict[str, list[tuple[int, str | None]]] = {}
        for r in part.select("alias", "gaz_id", "hierarchy_level").collect():  # a block
            by_alias.setdefault(r["alias"], []).append((r["gaz_id"], r["hierarchy_level"]))
        shared = texts.sparkSession.sparkContext.broadcast(by_alias)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            auto = ahocorasick.Automaton()
            for a in known:
                auto.add_word(a, a)
            auto.make_automaton()
            for pdf in batches:
                rows = []
                for *key, text in pdf[[*keep, "_text"]].itertuples(index=False, name=None):
                    hits = [(end - len(a) + 1, a, known[a]) for end, a in auto.iter(text)] if known and text else []
                    each = _longest(hits) if choose else ((g, level, a, start) for start, a, entries in hits for g, level in entries)
                    rows += [(*key, *x) for x in each]
                yield pd.DataFrame(rows, columns=[f.name for f in out]).astype({"gaz_id": "int64", "start": "int32"})

        return texts.mapInPandas(run, out)

    if blocks == 1:
        return found(phrases, [id_col], schema, longest)
    # Equal aliases stay in one block, so that every entry of an alias is given together.
    parts = [phrases.where(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == k) for k in range(blocks)]
    if not longest:
        return reduce(DataFrame.unionByName, [found(p, [id_col], schema, False) for p in parts])
    wide = T.StructType([*schema, T.StructField("_row", T.LongType())])
    every = reduce(DataFrame.unionByName, [found(p, [id_col, "_row"], T.StructType([wide[id_col], wide["_row"], *list(schema)[1:]]), False) for p in parts])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        hits: dict[tuple[int, str], list[tuple[int, str | None]]] = {}
        for g, level, alias, start in pdf[["gaz_id", "hierarchy_level", "alias", "start"]].itertuples(index=False, name=None):
            hits.setdefault((int(start), alias), []).append((int(g), level))
        rows = [(pdf[id_col].iloc[0], *x) for x in _longest([(s, a, e) for (s, a), e in hits.items()])]
        return pd.DataFrame(rows, columns=names).astype({"gaz_id": "int64", "start": "int32"})

    return every.groupBy("_row").applyInPandas(choose, schema)
