"""Operators of the llm subpackage against brute force, exact round trips and defined edge cases."""

import base64
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from frondara.llm import bpe, gazetteer, leaks, lookalikes, matching, percentiles, scans, tokens

NAMES = ["p05", "p50"]


def test_percentiles_exact_and_merged(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.uniform(-500, 4000), 0.0, -0.0, 1e-300, -3.5]), i % 5) for i in range(4000)] + [("a", None, 1), ("a", float("nan"), 1), ("z", None, 2), ("one", 7.0, 2)]
    df = spark.createDataFrame(rows, "k string, v double, day int")
    want = {k: np.percentile([v for g, v, _ in rows if g == k and v is not None and v == v], [5, 50]) for k in ("a", "b", None, "one")}
    got = {r.k: (r.n, r.p05, r.p50) for r in percentiles.radix_percentiles(df, ["k"], "v", [0.05, 0.5], NAMES).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][1:] == pytest.approx(want[k], rel=1e-12)
    merged = {r.k: (r.p05, r.p50) for r in percentiles.merged_percentiles(percentiles.histograms(df, ["k"], "day", "v"), ["k"], [0.05, 0.5], NAMES).collect()}
    for k in want:
        assert merged[k] == pytest.approx(want[k], rel=2**-20, abs=1e-9)
    assert percentiles.radix_percentiles(df.where("false"), ["k"], "v", [0.5], ["m"]).count() == 0


def test_percentiles_shuffled_prefixes(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "FOLLOWED_ROWS", 0)
    df = spark.range(999).select((F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("v"))
    got = {r.k: r.m for r in percentiles.radix_percentiles(df, ["k"], "v", [0.5], ["m"]).collect()}
    assert got == {k: float(np.median([i * 1.5 for i in range(999) if i % 3 == k])) for k in range(3)}


TEXTS = ["", "abc", "ＡＢＣ ñandú", "Pе́nínsula", "éệx̧́", "ﬁn ﬂor", "a​b­c d", "(facies γ) ο γα", "𝗯𝗈𝗌que", "A–B — ¬ · ª\nx", "q̣́z"]


def test_lookalikes_equal_plain_form(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[3], None])], "id int, text string, unified_ string")
    got = {r.id: r.unified for r in lookalikes.unified(df, "text").collect()}
    assert len(got) == len(TEXTS) + 2 and got[len(TEXTS) + 1] is None
    for i, t in enumerate(TEXTS):
        assert unicodedata.normalize("NFC", got[i]) == lookalikes.unify(t), t
    assert got[2] == "ABC ñandú" and got[6] == "abc d" and got[7] == "(facies γ) o ya" or got[7].startswith("(facies γ) o")
    assert lookalikes.unified(df.where("false"), "text").count() == 0


def test_lookalikes_separate_accents_and_alpha(spark):
    want = {"Macegu´r": "Macegúr", "Ag¨ero, n˜andu": "Ag¨ero, ñandu", "pingu¨ino": "pingüino", "dos ´ tres": "dos ´ tres", "mαpa": "mapa", "facies α": "facies α"}
    df = spark.createDataFrame([(t,) for t in want], "text string")
    assert {t: lookalikes.unify(t) for t in want} == want
    assert {r.text: r.unified for r in lookalikes.unified(df, "text").collect()} == want


def reference_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact():
    enc, ref, rng = bpe.encoder(tokens.vocabulary_path()), reference_encoder(), random.Random(5)
    texts = ["", None, " ", "\n\n x", "don't we'll 's '' 'tis", "<|endoftext|>", "a" * 3000, " " * 2000 + "x", "日本語 😀 é̀", "ab　 c"]
    texts += ["".join(rng.choice("ab s'tdlvre\n 1.ñé€😀") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    for text, ids in zip(texts, enc.encode_batch(texts)):
        assert ids.tolist() == (ref.encode_ordinary(text) if text else [])
        assert enc.decode(ids).decode() == (text or "")
        assert enc.encode(text).tolist() == ids.tolist()


def test_token_ids_and_pieces(spark):
    long = "\n\n".join(" ".join(f"palabra{i}{j} verde," for j in range(30)) + " fin." for i in range(60))
    rows = [(1, None), (2, ""), (3, "uno dos"), (4, long), (5, "x" * 9000), (3, "uno dos"), (6, "😀" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    ids = tokens.token_ids(df).collect()
    assert len(ids) == len(rows) and {r.doc_id for r in ids if r.ids == []} == {1, 2}
    enc = bpe.encoder(tokens.vocabulary_path())
    for key, text in ((4, long), (5, "x" * 9000), (6, "😀" * 3000)):
        got = sorted((r for r in tokens.pieces(df, limit=256, overlap=32).collect() if r.doc_id == key), key=lambda r: r.piece)
        assert got[0].start == 0 and got[-1].end == len(text)
        assert all(r.text == text[r.start : r.end] and r.n_tokens == len(enc.encode(r.text)) <= 256 for r in got)
        borders = np.concatenate([[0], np.cumsum(enc.length[enc.encode(text)])])  # the overlap counts the whole text's tokens
        at = lambda char: int(np.searchsorted(borders, len(text[:char].encode())))
        for a, b in zip(got, got[1:]):
            assert a.start < b.start < a.end
            assert 32 <= at(a.end) - at(b.start) <= 34
    assert not {1, 2, 3} & {r.doc_id for r in tokens.pieces(df, limit=256, overlap=32).collect()}


def test_strongest_cut_against_brute_force():
    rng = np.random.default_rng(2)
    s = rng.integers(-1, 6, 300)
    table = tokens.StrongestCut(s)
    for _ in range(500):
        lo, hi = sorted(rng.integers(0, 300, 2))
        best = max(range(lo, hi + 1), key=lambda i: (s[i], i))
        assert table.query(lo, hi) == best


def test_leaks(spark):
    rng = random.Random(7)
    words = [f"palabra{chr(97 + i % 26)}{i}" for i in range(4000)]
    passage = rng.sample(words, 60)
    noise = lambda n: rng.sample(words, n)

    def changed(ws, where):
        return [w + "x" if i in where else w for i, w in enumerate(ws)]

    docs = [
        (1, " ".join(noise(50) + passage + noise(50))), (2, " ".join(noise(9) + passage[10:35] + noise(9)).upper()), (3, " ".join(noise(9) + passage[10:33] + noise(9))),
        (4, ", ".join(changed(passage[5:35], {8, 17, 26}))), (5, " ".join(passage[:12] + ["extra"] + passage[12:20] + passage[21:34])), (6, " ".join(changed(passage[5:30], {4, 9, 14, 19}))),
        (7, None), (8, ""), (9, " ".join(w[:3] + "-\n" + w[3:] for w in passage)), (1, " ".join(noise(50) + passage + noise(50))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, " ".join(passage)), (11, " ".join(noise(5))), (12, None)], "item_id long, reference string")
    got = sorted({tuple(r) for r in leaks.leaks(d, items).collect()})
    assert got == [(1, 10), (2, 10), (4, 10), (5, 10), (9, 10)]
    assert leaks.leaks(d, items.where("false")).count() == 0


def holds_case(doc, passage):
    """The rule by brute force: a run of the passage between two equal words, by edit distance from every equal pair."""
    least = min(leaks.LEAST_WORDS, len(passage))
    for i0, j0 in ((i, j) for j in range(len(passage)) for i in range(len(doc)) if doc[i] == passage[j]):
        x, y = doc[i0 + 1 :], passage[j0 + 1 :]
        row = list(range(len(x) + 1))
        for j, w in enumerate(y, 1):
            up, row = row, [j]
            for i, v in enumerate(x, 1):
                row.append(min(up[i - 1] + (v != w), up[i] + 1, row[i - 1] + 1))
                if v == w and j + 1 >= least and up[i - 1] <= (j + 1) // leaks.PER_DIFFERENCE:
                    return True
    return False


def edited(words, ops):
    """words with an altered, added or missing word at each place of ops."""
    out = []
    for i, w in enumerate(words):
        op = ops.get(i)
        out += [w] if op is None else ["neu" + w] if op == "altered" else ["neu" + w, w] if op == "added" else []
    return out


def test_leaks_between_differences():
    rng, kinds = random.Random(11), ("altered", "added", "missing")
    words = [f"w{i}" for i in range(60)]
    known = leaks.Passages([1], [" ".join(words)])
    lost, cases = [], 0
    for n in (30, 31):
        places = [(7, 15, 23)] + [tuple(sorted(rng.sample(range(1, n - 1), 3))) for _ in range(4)]
        for at in places:
            for ops in [(a, b, c) for a in kinds for b in kinds for c in kinds]:
                doc = ["x", "y"] + edited(words[20 : 20 + n], dict(zip(at, ops))) + ["z"]
                want = holds_case(doc, words)
                cases += want
                if (leaks.find_in(known, [" ".join(doc)]) == [(0, 0)]) != want:
                    lost.append((n, at, ops, want))
    assert not lost and cases > 100


def test_leaks_of_clustered_differences():
    rng, kinds = random.Random(13), ("altered", "added", "missing")
    words = [f"w{i}" for i in range(80)]
    known = leaks.Passages([1], [" ".join(words)])
    lost, cases = [], 0
    tried = [(24, 5, 24, ("altered",)), (24, 5, 24, ("missing",)), (24, 4, 24, ("added",))]
    tried += [(rng.randint(18, 24), rng.randint(3, 6), rng.randint(18, 24), kinds) for _ in range(60)]
    for a, group, b, which in tried:
        ops = {a + i: rng.choice(which) for i in range(group)}
        if rng.random() < 0.3 and which is kinds:
            ops[rng.randint(3, a - 3)] = rng.choice(kinds)
        doc = ["x"] * 30 + edited(words[9 : 9 + a + group + b], ops) + ["z"] * 30
        want = holds_case(doc, words)
        cases += want
        if (leaks.find_in(known, [" ".join(doc)]) == [(0, 0)]) != want:
            lost.append((a, ops, b, want))
    assert not lost and cases > 10


def test_leaks_of_short_passages():
    rng = random.Random(12)
    for n in range(5, 25):
        words = [f"w{i}" for i in range(n)]
        known = leaks.Passages([1], [" ".join(words)])
        for _ in range(20):
            at = rng.sample(range(1, n - 1), min(n - 2, n // 10 + rng.randint(0, 1)))
            doc = ["x"] + edited(words, {i: rng.choice(("altered", "added", "missing")) for i in at}) + ["z"]
            assert (leaks.find_in(known, [" ".join(doc)]) == [(0, 0)]) == holds_case(doc, words), (n, at)


def test_each_mask_adds_hits(monkeypatch):
    # The first mask ignores an altered word that a plain seed of as many words stumbles over; the second serves short passages.
    words = [f"w{i}" for i in range(31)]
    docs = [edited(words, {k: "altered" for k in at}) for at in ((3, 10, 17), (4, 11, 18), (7, 15, 23))]
    docs += [edited(words[:12], {6: how}) for how in ("missing", "added", "altered")]  # stretches of 6 and 5 clean words

    def found(masks):
        monkeypatch.setattr(leaks, "MASKS", masks)
        long, short = leaks.Passages([1], [" ".join(words)]), leaks.Passages([1], [" ".join(words[:12])])
        hits = len(long.hits(*leaks.word_hashes([" ".join(d) for d in docs]))[0])
        return hits, sum(leaks.find_in(short, [" ".join(d)]) != [] for d in docs)

    both, plain, first = found(leaks.MASKS), found((("1111111", False), ("11111", True))), found((leaks.MASKS[0],))
    assert both[0] > plain[0] and both[1] > first[1]


def test_word_hashes_fold():
    a, _ = leaks.word_hashes(["Árbol—VERDE, ñandú 12", None, ""])
    b, first = leaks.word_hashes(["arbol verde nandu 12"])
    assert a.tolist() == b.tolist() and first.tolist() == [0, 4]


def test_word_hashes_keep_all_scripts():
    h, first = leaks.word_hashes(["森林、海拔 숲은 깊다。", "森林 海抜 숲은 깊고", "─ 😀"])
    assert first.tolist() == [0, 4, 8, 8]
    assert (h[:4] == h[4:]).tolist() == [True, False, True, False]
    known = leaks.Passages([1], [" ".join(chr(0x4E00 + 7 * i) + chr(0xAC00 + i) for i in range(30))])
    text = " ".join(chr(0x4E00 + 7 * i) + chr(0xAC00 + i) for i in range(2, 29))
    assert leaks.find_in(known, [text, text[:20]]) == [(0, 0)]


def test_tree_is_complete():
    rng = random.Random(1)
    forms = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    tree = gazetteer.Tree({f: {i} for i, f in enumerate(forms)})
    asked = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(60)] + ["é", "日本語の山"]
    for most in (0, 1, 2):
        for q, got in zip(asked, tree.within(asked, most)):
            assert sorted(got) == sorted({(d, f) for f in forms if (d := gazetteer.distance(q, f)) <= most})
    for q in asked[:60]:
        x, y = rng.choice(forms), rng.choice(forms)
        assert gazetteer.distance(q, y) <= gazetteer.distance(q, x) + gazetteer.distance(x, y)


def test_map_values_whole_and_sharded(spark):
    ref = spark.createDataFrame([(1, "Cordillera de Macegúr", "cordillera", "Cordill. Macegúr"), (2, "Macegúr", "canton", None), (3, "Fila Muvazar", "fila", "Montes de Zorelir")], "gaz_id long, canonical_name string, hierarchy_level string, aliases string")
    rows = [("cord. macegur", ["cordillera"]), ("MACEGÚR", ["canton"]), ("filamuvzar", ["fila"]), ("Zorelir, Montes de", ["fila"]), ("falda N de Mucazar", None), ("frontera", ["fila"]), ("", ["fila"]), (None, ["fila"]), ("frontera", ["fila"])]
    v = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, value string, levels array<string>")
    want = [1, 2, 3, 3, 3, -1, -1, None, -1]
    assert [r.gaz_id for r in gazetteer.map_values(v, ref).orderBy("id").collect()] == want
    assert [r.gaz_id for r in gazetteer.map_values(v, ref, shard_entries=2).orderBy("id").collect()] == want
    assert gazetteer.map_values(v.where("false"), ref).count() == 0


def test_map_values_shards_make_no_difference(spark):
    # Ties between shards, and prefixes that only other shards' entries have.
    rows = [(i, f"{kind} {name}", "fila", None) for i, (kind, name) in enumerate((k, n) for n in ("Muvazar", "Zorelir", "Tacobem") for k in ("Fila", "Cerro", "Alto Cerro", "Monte"))]
    ref = spark.createDataFrame([*rows, (90, "Ribacolu", "fila", None)], "gaz_id long, canonical_name string, hierarchy_level string, aliases string")
    typed = ["Monte Muvazar", "Monte Muvazr", "Alto Cerro Zorelir", "Cerro Tacobm", "filaribacolu", "montezorelir", "altocerroribacol"]
    v = spark.createDataFrame([(i, t, ["fila"]) for i, t in enumerate(typed)], "id int, value string, levels array<string>")
    whole, parts = ([(r.gaz_id, r.distance) for r in gazetteer.map_values(v, ref, shard_entries=n).orderBy("id").collect()] for n in (99, 3))
    assert parts == whole and whole[0] == (3, 0)


def test_map_values_against_brute_force(spark):
    # 500 entries with shared prefixes and near names; sharded and whole, every entry within the threshold and the nearest.
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfmnrtz") + rng.choice("aeiou") for _ in range(rng.choice([2, 3, 4])))
    names = [word().capitalize() for _ in range(250)]
    rows = [(i, f"{rng.choice(['Cerro', 'Fila', 'Alto de'])} {names[i // 2]}", rng.choice(["fila", "other"]), rng.choice([None, f"Cerro {word()}"])) for i in range(500)]
    ref = spark.createDataFrame(rows, "gaz_id long, canonical_name string, hierarchy_level string, aliases string")
    typed = []
    for _ in range(300):
        n = list(rng.choice(names).lower())
        for _ in range(rng.randrange(3)):
            n[rng.randrange(len(n))] = rng.choice("aeioubcd")
        typed.append(rng.choice(["cerro ", "", "FILA ", "alto de ", "junto a "]) + "".join(n))
    v = spark.createDataFrame([(i, t, rng.choice([["fila"], ["other"], None])) for i, t in enumerate(typed)], "id int, value string, levels array<string>")
    every = {n: {(r.value, tuple(r.levels or ()), r.gaz_id, r.distance) for r in gazetteer.entries_within(v, ref, shard_entries=n).collect()} for n in (999, 90)}
    assert every[999] == every[90]
    known = gazetteer.Reference(rows)
    for value, levels in {(t, tuple(ls or ())) for _, t, ls in (tuple(r) for r in v.collect())}:
        best: dict[int, int] = {}
        for f in known.forms(gazetteer.words_of(value)):
            most = next(t for n, t in gazetteer.THRESHOLDS if len(f) >= n)
            for level, tree in known.trees.items():
                for name in tree.entries if not levels or level in levels else ():
                    if (d := gazetteer.distance(f, name)) <= most:
                        for g in tree.entries[name]:
                            best[g] = min(best.get(g, d), d)
        assert {(g, d) for x, ls, g, d in every[999] if (x, ls) == (value, levels)} == set(best.items()), value
    nearest = [[(r.gaz_id, r.distance) for r in gazetteer.map_values(v, ref, shard_entries=n).orderBy("id").collect()] for n in (999, 90)]
    assert nearest[0] == nearest[1] and sum(g >= 0 for g, _ in nearest[0]) > 100


def test_map_values_of_odd_rows(spark):
    # Clashing columns, very long values beside short ones, repeated rows, an empty reference.
    ref = spark.createDataFrame([(1, "Cerro Macegur", "fila", None), (2, None, "fila", None), (3, "Alto Zor", None, "")], "gaz_id long, canonical_name string, hierarchy_level string, aliases string")
    rows = [(1, "macegr", ["fila"]), (2, "x" * 300_000, None), (3, "zor " * 20_000, None), (4, "macegr", ["fila"]), (5, "?!", None), (6, "macegur", [])]
    v = spark.createDataFrame(rows, "id int, value string, levels array<string>").withColumns({"gaz_id": F.lit(7), "_value": F.lit("c"), "words": F.lit("c"), "w": F.lit(1)})
    got = gazetteer.map_values(v, ref)
    assert sorted(got.columns) == sorted([*v.columns, "distance"])
    assert {r.id: r.gaz_id for r in got.collect()} == {1: 1, 2: -1, 3: 3, 4: 1, 5: -1, 6: -1}
    assert {r.gaz_id for r in gazetteer.map_values(v, ref.where("false")).collect()} == {-1}


def test_fillers_come_from_the_values(spark):
    # "junto" and "loma" stand beside many different words; "Loma" is also a name of the list and stays one.
    names = ["".join(p) for p in zip("bcdfghjklm" * 3, "aeiou" * 6, "rstvz" * 6, "oaiue" * 6, "nlmr" * 7 + "zz")]
    v = spark.createDataFrame([(f"{w} {n}", None) for n in names for w in ("junto", "loma", "x")], "value string, levels array<string>")
    assert {"junto", "loma"} <= set(gazetteer._fillers(gazetteer._asked(v)))
    ref = spark.createDataFrame([(1, "Cerro Loma", "fila", None), (2, "Cerro Juntox", "fila", None)], "gaz_id long, canonical_name string, hierarchy_level string, aliases string")
    got = {r.value: r.gaz_id for r in gazetteer.map_values(v, ref).collect()}
    assert got[f"loma {names[0]}"] == 1 and got[f"junto {names[0]}"] == -1


def test_scans(spark):
    habitats = ["Bosque húmedo, suelos volcánicos, centro-oriental, sub- y suprapáramo, 100–900 m", "Bosque seco, laderas empinadas, troncos caídos, 50–450 m"] * 60
    rows = [("h", i, t) for i, t in enumerate(habitats)]
    head = "Flora de las Tierras Altas"
    bad = {
        500: ("Bosque húmedo, suelos vol-\ncánicos, 100–900 m", {"hyphen"}), 501: ("Bosquc húmedo, suelos volcánic0s, 1O0–900 m", {"chars"}), 502: (f"{head}   12\nBosque seco, 50–450 m", {"furniture"}),
        503: (f"Bosque húmedo, suelos vol- 77 {head} cánicos, 100–900 m", {"hyphen", "furniture"}), 504: ("Bosque seco, centro-\noriental, sub-\ny suprapáramo,\n50–450 m", set()), 505: ("Bosque\x02 seco, 50–450 m", {"chars"}),
        506: ("— 196 —\nBosque seco, 50–450 m", {"furniture"}), 507: (None, set()), 508: ("", set()), 509: ("F1ora de 1as Tierras A1tas 31\nBosque seco, 50–450 m", {"furniture"}),
    }
    rows += [("h", k, t) for k, (t, _) in bad.items()] + [("h", 600 + i, f"{head}   {i}\nBosque seco, 50–450 m") for i in range(5)]
    df = spark.createDataFrame(rows, "field string, rec_id long, text string")
    got = {r.rec_id: r for r in scans.readable(df, ("h",)).collect()}
    assert len(got) == len(rows)
    for k, (_, kinds) in bad.items():
        assert set(got[k].kinds) == kinds, (k, got[k])
    assert all(got[i].kinds == [] for i in range(len(habitats)))
    assert got[500].clean == "Bosque húmedo, suelos volcánicos, 100–900 m" == got[503].clean == got[501].clean
    assert got[504].clean == "Bosque seco, centro-oriental, sub- y suprapáramo, 50–450 m"
    assert scans.readable(df.where("false")).count() == 0


def test_scans_keep_what_the_corpus_does_not_speak_against():
    corpus = scans.Corpus(share={"vol": 0.01, "montes": 0.2, "bosque": 0.9}, lower={"montes": 1.0, "bosque": 0.9}, endings={"aceae"}, heads=["manuaideiafioradeiistmo"])
    for c in (scans.Corpus(), corpus):
        assert scans.without_furniture("Especie de la familia ROSACEAE con 12 géneros.", c) == ("Especie de la familia ROSACEAE con 12 géneros.", False)
        assert scans.joined("de Puntarenas-\nGolfito", c) == ("de Puntarenas-Golfito", False)
    assert scans.joined("Cenope-\njedea", scans.Corpus()) == ("Cenope-jedea", False)  # no corpus, no evidence
    assert scans.joined("Cenope-\njedea y bos-\nque", corpus) == ("Cenopejedea y bosque", True)
    assert scans.without_furniture("uno\nMIRVACEAE 77\ndos", corpus) == ("uno\ndos", True)
    assert scans.without_furniture("uno 77 MIRVACEAE dos", corpus)[1] and not scans.without_furniture("uno MIRVACEAE dos", corpus)[1]
    long = " ".join(["Manual de la Flora del Istmo"] * 5)  # heads of any length
    assert scans.without_furniture(f"uno\n{long}\ndos", scans.Corpus(heads=[scans.fold(long)])) == ("uno\ndos", True)
    broken = "a" + "-\nx" * 9  # a word broken many times
    assert scans.joined(broken, scans.Corpus(share={"bosque": 1.0}))[0] == "a" + "x" * 9


def test_scans_of_very_long_texts():
    corpus = scans.Corpus(share={"bosque": 0.9}, lower={"bosque": 1.0}, heads=["manuaideiafioradeiistmo"], endings={"aceae"})
    for text in ("x" * 300_000, "a-\n" * 50_000, "Manual de la Flora del Istmo 12 " * 5_000, "12 MIRVACEAE " * 5_000, "(" * 50_000):
        begun = time.process_time()
        scans.repair(text, corpus, True)
        assert time.process_time() - begun < 20  # seconds; anything that is not linear takes minutes


def test_matching(spark):
    cols = "id long, name string, auth string, syn array<string>, fam string"
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(n))
    base = [(word(4).capitalize(), word(4) + rng.choice(["ana", "ensis", "osa"]), word(3).capitalize() + "n", word(2).capitalize() + "aceae") for _ in range(150)]
    left = [(i, f"{g} {e}", f"{a[:5]}.", [], f) for i, (g, e, a, f) in enumerate(base)]
    right = [(i, f"{g} {e[:2] + e[2] + e[2:]}" if i % 3 == 0 else f"{g} {e}", a, None, f) for i, (g, e, a, f) in enumerate(base)]
    right += [(1000 + i, f"{g} {e}", "Qwert & Zuiop", None, "Otheraceae") for i, (g, e, a, f) in enumerate(base[:20])]
    right += [(2000, "Novum genus", "X. Ykl", [f"{base[0][0]} {base[0][1]} {base[0][2]}"], None), (2001, None, None, None, None), (2002, "Uno", None, None, None)]
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}
    got = matching.match_names(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), c, c)
    found = {(r.left, r.right) for r in got.collect() if r.confidence >= 0.5}
    assert found == {(i, i) for i in range(150)} | {(0, 2000)}
    empty = matching.match_names(spark.createDataFrame(left, cols).where("false"), spark.createDataFrame(right, cols), c, c)
    assert empty.count() == 0


def test_matching_keeps_exchanged_letters(spark):
    # Three exchanges are 3 edits for the operator and 6 plain ones; two and a change are 3 and 5.
    cols = "id long, name string, auth string, syn array<string>, fam string"
    names = [("Bacodufige marotilupensis", "abcodufige amrotilupenssi"), ("Bacodufige marotilupensis", "Bacodufige amrotilupnesiz")]
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}
    sides = [spark.createDataFrame([(i, pair[k], "Zorelin", [], "Mirvaceae") for i, pair in enumerate(names)], cols) for k in (0, 1)]
    got = {(r.left, r.right): r.d_genus + r.d_epithet for r in matching.match_names(*sides, c, c).collect()}
    assert got[0, 0] == 3 and got[1, 1] == 3


def test_matching_recall_against_brute_force(spark):
    # Every pair of names within two edits, found by comparing all names, is a candidate; authors agree or say nothing.
    cols = "id long, name string, auth string, syn array<string>, fam string"
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(n))

    def slip(w):
        k = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + rng.choice("aeioulnr") + w[k + 1 :]])

    base = [(word(rng.choice([3, 4, 5])), word(rng.choice([3, 4, 5])) + rng.choice(["ana", "ensis", "osa", "ica"]), word(3).capitalize() + "n") for _ in range(400)]
    left = [(i, f"{g.capitalize()} {e}", a, [], None) for i, (g, e, a) in enumerate(base)]
    right = []
    for i, (g, e, a) in enumerate(base):
        for k in range(1 + i % 2):
            g, e = (slip(g), e) if rng.random() < 0.5 else (g, slip(e))
        right.append((i, f"{g.capitalize()} {e}", a, [], None))
    want = set()
    for i, a, *_ in left:
        for j, b, *_ in right:
            (p, q), (r, s) = a.lower().split(), b.lower().split()
            if abs(len(a) - len(b)) <= 2 and gazetteer.distance(p, r) + gazetteer.distance(q, s) <= 2:
                want.add((i, j))
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}
    got = {(r.left, r.right) for r in matching.match_names(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), c, c).collect()}
    assert len(want) >= 380 and len(want & got) >= 0.97 * len(want)


def test_matching_hot_name_and_no_broadcast(spark):
    # One species holds a third of the rows under ever other authors; the plan has no broadcast but those of counted sides.
    cols = "id long, name string, auth string, syn array<string>, fam string"
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(n))
    left = [(i, "Bacodufige marotilupensis" if i % 3 == 0 else f"{word(4).capitalize()} {word(4)}", f"Zorelin{chr(97 + i % 26)}", None, None) for i in range(300)]
    right = [(0, "Bacodufige marotilupensis", None, None, None), (1, f"{word(4).capitalize()} {word(4)}", None, None, None)]
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}
    got = matching.match_names(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), c, c)
    assert {r.left for r in got.collect() if r.right == 0} == set(range(0, 300, 3))
    keys = [matching._blocked(matching._forms(matching._names(spark.createDataFrame(x, cols), "id", "name", "auth", "syn", "fam"))) for x in (left, right)]
    assert max(r.n for r in keys[0].groupBy("name").agg(F.count("*").alias("n")).collect()) == 1


def test_matching_finds_all_within_three_edits(spark):
    # Names of few genera, so that many differ by three edits; all pairs within three by brute force, and no others.
    cols = "id long, name string, auth string, syn array<string>, fam string"
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("bdgl") + rng.choice("aio") for _ in range(n))
    genera = [word(4) for _ in range(12)]
    genera += [g[:k] + g[k + 1] + g[k] + g[k + 2 :] for g in genera[:4] for k in (1, 4)] + [g[2:] + "n" for g in genera[4:7]] + [g[:-3] for g in genera[7:9]]
    sides = [[(i, f"{rng.choice(genera).capitalize()} {word(3)}{rng.choice(['ana', 'osa', 'na'])}", f"{word(3).capitalize()}n", [], None) for i in range(200)] for _ in range(2)]
    sides[1] += [(1000 + i, f"{g} {e}", None, None, None) for i, (g, e) in enumerate(n.split() for _, n, *_ in sides[0][:20])]
    sides[1] += [(2000 + i, f"{g[:-3]} {e}", None, None, None) for i, (g, e) in enumerate(n.split() for _, n, *_ in sides[0][:20])]
    apart = {}
    for i, a, *_ in sides[0]:
        for j, b, *_ in sides[1]:
            (p, q), (r, s) = a.lower().split(), b.lower().split()
            apart[i, j] = gazetteer.distance(p, r), gazetteer.distance(q, s)
    want = {k: d for k, d in apart.items() if sum(d) <= 3}
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}
    got = {(r.left, r.right): (r.d_genus, r.d_epithet) for r in matching.match_names(*[spark.createDataFrame(x, cols) for x in sides], c, c).collect()}
    assert got == want
    assert set(want.values()) >= {(0, 0), (0, 3), (1, 2), (2, 1), (3, 0)}


def test_matching_writes_little(spark):
    # Names that meet nothing, under two authors each: what is shuffled for one of them.
    cols = "id long, name string, auth string, syn array<string>, fam string"
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(n))
    genera, epithets = [word(5).capitalize() for _ in range(300)], [word(5) for _ in range(600)]
    sides = [[(i, f"{rng.choice(genera)} {rng.choice(epithets)}", f"{word(3)}n & {word(4)}s", [], None) for i in range(4000)] for _ in range(2)]
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}

    def written():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = written()
    matching.match_names(*[spark.createDataFrame(x, cols) for x in sides], c, c).count()
    assert (written() - before) / 8000 < 400  # bytes a name


def test_matching_own_near_names_do_not_disagree(spark):
    # The synonym is three edits from the accepted name and has another author, in both records: the equal names agree.
    cols = "id long, name string, auth string, syn array<string>, fam string"
    rec = (0, "Taliruzolus satifunilis", "Burvira", ["Taliruzolus ravinunilis Brauckisch"], None)
    c = {"rec": "id", "name": "name", "authority": "auth", "synonyms": "syn", "family": "fam"}
    got = matching.match_names(spark.createDataFrame([rec], cols), spark.createDataFrame([rec, (1, "Taliruzolus satifunilis", "Zognulo", [], None)], cols), c, c)
    assert {r.right: (r.agree, r.disagree) for r in got.collect()} == {0: (1, 0), 1: (0, 1)}


def test_matching_homonyms_beside_many_far_pairs(spark):
    # Equal names of unrelated authors are apart, however many pairs three edits apart there are to learn from.
    kinds = [((0, 0, 1, 0, 0, 1, 0, 1), 900), ((0, 1, 1, 0, 0, 1, 0, 0), 100), ((0, 0, 0, 1, 0, 0, 1, 0), 60), ((0, 0, 0, 1, 0, 1, 0, 1), 4), ((0, 3, 0, 1, 0, 1, 0, 0), 600)]
    rows = [(n, i, *map(float, x)) for n, (x, times) in enumerate(kinds) for i in range(times)]
    pairs = spark.createDataFrame(rows, ["left", "right", *matching.FEATURES])
    got = {r.left: r.c for r in pairs.select("left", matching.train(pairs).confidence().alias("c")).distinct().collect()}
    assert got[0] > 0.5 and got[1] > 0.5 and max(got[2], got[3], got[4]) < 0.5
