"""Places, phrases, similar names, entries and answers, against brute force and golden cases."""

import random

import pytest
from pyspark.sql import functions as F

from frondara.functions import blocks, places as pl, spanish as es
from frondara.operators import ordered, phrases, raster, similar, spherical as sp
from frondara.plans import answers, resolve, segments

SF = "/root/testdata/sf0.001"
NAMES = pl.Names([("baja talamanca", "other"), ("cabo x", "canton")])


def read(text):
    return [(p.slope, p.side, p.kind, p.name, p.note, p.areas) for p in pl.parse_places(text, NAMES)]


def test_clauses_hold_brackets_and_lists_together():
    assert pl.clauses("a, b (c, d; e); f") == ["a, b (c, d; e)", "f"]
    assert pl.clauses("Cord. de X, cerca de Y, Fila Z, N Valle W, vert. Pac.") == ["Cord. de X, cerca de Y", "Fila Z", "N Valle W", "vert. Pac."]


def test_places_golden():
    got = read("vert. Carib., Cordillera de X y Valle de Y (P.N. Z), falda N de Sierra W; ambas verts., N Llanura V")
    assert [g[:4] for g in got] == [("Caribe", None, "cordillera", "Cordillera de X"), ("Caribe", None, "valle", "Valle de Y"), ("Caribe", "N", "cordillera", "Sierra W"), ("ambas", "N", "llanura", "Llanura V")]
    assert got[1][5] == ["P.N. Z"]
    got = read("Cords. de Guanacaste, Tilarán y Central (P.N. Braulio); S vert. Pac. S Pen. de Nicoya (costa (sur))")
    assert [g[3] for g in got] == ["Cords. de Guanacaste", "Cords. de Tilarán", "Cords. de Central", "Pen. de Nicoya"]
    assert got[2][5] == ["P.N. Braulio"] and got[0][5] == [] and got[3] == ("Pacífico", "S", "peninsula", "Pen. de Nicoya", "costa (sur)", [])
    assert read("todas las cords. principales, vecindad de Puerto, Baja Talamanca; P.N. Corcovado (costa), río Sierpe") == [
        (None, None, "cordillera", "todas las cords. principales", None, []), (None, None, "localidad_buffer", "vecindad de Puerto", None, []),
        (None, None, "region_informal", "Baja Talamanca", None, []), (None, None, "area_protegida", "P.N. Corcovado", "costa", []), (None, None, "cuenca", "río Sierpe", None, []),
    ]
    assert read("vert. Pac., Kano-\nlazuyá y\nalrededores; vert. Carib.") == [("Pacífico", None, "localidad", "Kanolazuyá y alrededores", None, [])]
    assert read(None) == read("") == read("  ;, ;") == []
    assert len(read("Fila A, " * 5000)) == 5000


def test_place_accessors(spark):
    df = spark.createDataFrame([(1, "ambas verts., P.N. Uno; vert. Carib., Fila X (P.N. Dos, P.N. Uno)"), (2, None), (3, "Fila Y")], "id int, t string")
    found = pl.occurrences(df, "id", "t")
    assert {r.id: r.slopes for r in pl.slopes_of(found, "id").collect()} == {1: ["Caribe", "Pacífico"]}
    assert {r.id: r.areas for r in pl.areas_of(found, "id").collect()} == {1: ["P.N. Uno", "P.N. Dos"]}
    assert pl.of_kind(found, "fila").count() == 2 and pl.occurrences(df.where("false"), "id", "t").count() == 0


def longest_by_hand(text, names):
    out, taken = set(), {}
    for alias in sorted({a for _, _, a in names}, key=lambda a: (-len(a), a)):
        for start in (i for i in range(len(text)) if text.startswith(alias, i)):
            levels = {lv for _, lv, a in names if a == alias and not any(start < e and s < start + len(alias) for s, e in taken.get(lv, []))}
            for lv in levels:
                taken.setdefault(lv, []).append((start, start + len(alias)))
            out |= {(g, lv, alias, start) for g, lv, a in names if a == alias and lv in levels}
    return out


@pytest.mark.parametrize("most", [500_000, 7])
def test_phrases_in_one_and_many_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "PHRASES", most)
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    names = list({(i, rng.choice(["x", "y"]), word(1, 4)) for i in range(25)})
    texts = [(i, word(0, 30)) for i in range(40)] + [(99, None)]
    t = spark.createDataFrame(texts, "id int, t string")
    p = spark.createDataFrame(names, "gaz_id long, hierarchy_level string, alias string")
    for longest in (True, False):
        got = sorted(tuple(r) for r in phrases.phrase_matches(t, p, "id", "t", longest).collect())
        want = []
        for i, text in texts:
            hits = longest_by_hand(text or "", names) if longest else {(g, lv, a, s) for g, lv, a in names for s in range(len(text or "")) if text.startswith(a, s)}
            want += [(i, *h) for h in hits]
        assert got == sorted(want)
    assert phrases.phrase_matches(t, p.where("false"), "id", "t", True).count() == 0


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(0, 26)))
    left = [(i, word()) for i in range(60)] + [(77, None)]
    right = []
    for i, (_, w) in enumerate(left[:60]):
        x = list(w)
        for _ in range(rng.randrange(4)):
            x.insert(rng.randrange(len(x) + 1), rng.choice("abcde"))
            if rng.random() < 0.5:
                x.pop(rng.randrange(len(x)))
        right.append((i, "".join(x)))
    a, b = spark.createDataFrame(left, "i int, a string"), spark.createDataFrame([*right, (88, None)], "j int, b string")
    for cutoff in (0.88, 0.75):
        got = {(r.i, r.j) for r in similar.similar_pairs(a, b, "a", "b", cutoff).collect()}
        every = a.crossJoin(b).where("a IS NOT NULL AND b IS NOT NULL").where(similar.similarity(F.col("a"), F.col("b")) >= cutoff - 1e-12)
        assert got == {(r.i, r.j) for r in every.collect()} and len(got) > 30


def test_running_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["d", "e", None]), i, rng.random() < 0.01, rng.choice([None] * 50 + ["p", "q"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc string, seq int, h boolean, s string").repartition(7)
    got = {r.seq: (r.session, r.state) for r in ordered.running(df, "doc", ["seq"], F.col("h"), {"state": F.col("s")}).collect()}
    n, last = {}, {}
    for doc, seq, h, s in rows:
        n[doc], last[doc] = n.get(doc, 0) + h, s or last.get(doc)
        assert got[seq] == (n[doc], last[doc])
    assert len(got) == len(rows) and ordered.running(df.where("false"), "doc", ["seq"], F.col("h")).count() == 0


def test_first_k_of_hot_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    got = ordered.first_k_of(df, "k", ["v"], 5, salts=8)
    want = df.withColumn("rn", F.expr("row_number() over (partition by k order by v)")).where("rn <= 5").drop("rn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_left_join_and_edges(spark):
    ring = [{"x": a, "y": b} for a, b in [(-85.0, 9.0), (-84.0, 9.0), (-84.0, 10.0), (-85.0, 10.0), (-85.0, 9.0)]]
    q = spark.createDataFrame([(7, 0.0, 0.0, 0.0, ring)], "place_id long, lon double, lat double, reach_m double, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1, -84.5, 9.5), (1, -84.5, 9.5), (2, -83.0, 9.5), (3, None, 9.0), (4, -84.0, 10.0), (5, -84.0, 9.5)], "point_id long, lon double, lat double")
    ways = [sorted((r.point_id, r.place_id or 0) for r in sp.reach_join(p, q, how="left", index_rows=n).collect()) for n in (99, 0)]
    got = ways[0]
    assert ways[0] == ways[1] and got[:4] == [(1, 7), (1, 7), (2, 0), (3, 0)] and len(got) == 6
    assert {r.point_id for r in sp.reach_join(p, q, edges=True).collect()} == {1, 4, 5}


def test_raster_sampling(spark):
    grid = raster.Grid(-86.0, 11.0, 1.0, 4, 3)
    r = spark.createDataFrame([(0, 0, 100.0), (1, 0, -9999.0), (2, 1, float("nan"))], "col int, row int, value double")
    p = spark.createDataFrame([(1, -85.5, 10.5), (2, -84.5, 10.5), (3, -83.5, 9.5), (4, 0.0, 0.0), (5, None, 1.0)], "id int, lon double, lat double")
    assert {x.id: x.altitud for x in raster.sampled(p, r, grid).collect()} == {1: 100.0, 2: None, 3: None, 4: None, 5: None}
    assert grid.cells(spark).count() == 12


def test_headers_and_kinds(spark):
    rows = [
        ("Abuta xalisca Mez & Orb. ex Lind., Bol. Herb. 46(2): 73. 1938. Nombre.", ("Abuta", "Abuta xalisca", "Mez & Orb"), "header"), ("Abuta sp. 3 con hojas", ("Abuta", "Abuta sp. 3", ""), "header"),
        ("Bosque húmedo con 46: 73 y 1938", None, "other"), ("Bosque seco, (100–)600–2500 m; ambas verts.", None, "distribution"), ("Arbusto, 3–30 m; vert. Pac.", None, "morphology"),
        ("12 Manual de Plantas", None, "furniture"), ("3 Yemas glabras", None, "key"), ("Hojas . . . 4", None, "key"), ("", None, "other"), ("Abuta xalisca, véase 1938", None, "other"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "i int, t string")
    got = {r.i: (r.h and tuple(r.h), r.k) for r in df.select("i", blocks.header(F.col("t")).alias("h"), blocks.kind(F.col("t")).alias("k")).collect()}
    assert got == {i: (h, k) for i, (_, h, k) in enumerate(rows)}


def test_entries_run_over_pages(spark):
    head = "Abuta {} Mez, Bol. Herb. 46: 73. 1938."
    rows = [("v", 1, 0, "Arbusto del género"), ("v", 1, 1, head.format("xalisca")), ("v", 2, 0, "3 Yemas"), ("v", 2, 1, "Bosque seco, 50–90 m; vert. Pac."), ("v", 3, 0, "Nota larga"), ("v", 3, 1, head.format("xalisca")), ("v", 3, 2, head.format("minor")), ("v", 4, 0, "Hojas verdes")]
    found = segments.segmented(spark.createDataFrame(rows, "vol string, page int, seq int, block string"), "vol", ["page", "seq"])
    got = sorted((r.session, r.species, r.n_blocks, r.morphology, r.distribution, r.discussion) for r in found.collect())
    assert got == [(1, "Abuta xalisca", 2, None, "Bosque seco, 50–90 m; vert. Pac.", "Nota larga"), (2, "Abuta xalisca", 0, None, None, None), (3, "Abuta minor", 1, "Hojas verdes", None, None)]
    assert sorted(r.session for r in segments.deduplicated(found, "vol", ["page", "seq"]).collect()) == [1, 3]


def test_elevation_parts(spark):
    cases = {
        "(100–)400–1850 m;": (400, 1850, 100, None), "0—700 ( – 1200+) m": (0, 700, None, 1200), "200-- 450 m": (200, 450, None, None), "3 m; (50–)100–200(–900) m": (100, 200, 50, 900),
        "ca 15 m": (15, 15, None, None), "700–900 mm": (None,) * 4, "Ca. 1150 m": (1150, 1150, None, None), "900–1200+ m": (900, 1200, None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: tuple(r.e) for r in df.select("t", es.elevation(F.col("t")).alias("e")).collect()} == cases


def test_habits_fall_back_and_family_adds(spark):
    df = spark.createDataFrame([(1, "Tallos verdes", "Hierba alta", "Araceae"), (2, None, None, "Arecaceae"), (3, "Arbusto", "Hierba", None), (4, "Palma alta", None, "Arecaceae")], "i int, d string, g string, f string")
    got = {r.i: r.h for r in df.select("i", es.entry_habits(F.col("d"), F.col("g"), F.col("f")).alias("h")).collect()}
    assert got == {1: ["hierba"], 2: ["palma"], 3: ["arbusto"], 4: ["palma"]}


def test_resolve_by_four_ways(spark):
    g = spark.createDataFrame([(1, "Cordillera de Tovar", "cordillera", None), (2, "Cordillera de Melur", "cordillera", "Melur"), (3, "Parque Zaru", "park", "P.N. Zaru"), (4, "Valle Kirobenas", "valle", None), (5, "Gavilanes", "canton", None)], "gaz_id long, canonical_name string, hierarchy_level string, aliases string")
    names = g.select("gaz_id", "hierarchy_level", F.explode(F.array_compact(F.array("canonical_name", "aliases"))).alias("a")).select("gaz_id", "hierarchy_level", resolve.folded(F.col("a")).alias("alias"))
    t = spark.createDataFrame([(1, "Bosque, 100–200 m", "vert. Pac., Cordillera de Tovar, Melur (P.N. Zaru); Gavillanes"), (2, None, None), (3, "", "Lomas sin nombre conocido")], "id int, h string, g string")
    entities, slopes, left = resolve.resolved(t, g, names, "id", "h", "g")
    assert {(r.id, r.gaz_id, r.source) for r in entities.collect()} == {(1, 1, "text"), (1, 2, "text"), (1, 3, "text"), (1, 5, "similar")}
    assert {r.id: r.slopes for r in slopes.collect()}[1] == ["Pacífico"]
    assert {(r.id, r.name) for r in left.collect()} == {(3, "Lomas sin nombre conocido")}


def test_answers_in_words(spark):
    a = answers.answer(spark, SF, answers.LIST_QUESTION)
    assert a.mode.startswith("B (") and a.constraints == {"habit": "arbusto", "vertiente": "Caribe", "elev_lo": 500, "elev_hi": 1500}
    said, page = a.text(), a.markdown()
    rows = a.records.orderBy("rank").collect()
    assert 0 < len(rows) <= 12 and all(r.species in said and f"p. {r.pages}" in said for r in rows) and page.count("| *") == len(rows)
    one = answers.answer(spark, SF, f"¿Dónde crece {rows[0].species}?")
    assert one.mode.startswith("A") and [r.species for r in one.records.collect()] == [rows[0].species]
    top = answers.answer(spark, SF, answers.SUPERLATIVE_QUESTION)
    assert top.mode == "B>A (superlativo)" and "elevación máxima" in top.selector and top.records.count() == 1
    none = answers.answer(spark, SF, "¿Cuál es la hierba de mayor altitud sobre 9000 m?")
    assert none.text() == answers.NOTHING and "sin resultados" in none.mode


def test_reports_and_layers(spark):
    from frondara.plans import geography, reports

    page = reports.retrieval_report(spark, SF)
    assert "| forest_type | 30 | 30 |" in page and page.startswith("# Preguntas")
    assert "| slice |" in reports.validation_report(spark, SF) and "Mayores ganancias" in reports.grounding_report(spark, SF)
    one = geography.join_region_layers(spark, SF).first()["dist_id"]
    species = spark.read.parquet(f"{SF}/distribution_fichas.parquet").where(F.col("dist_id") == one).first()["species"]
    layers = {r.layer for r in geography.species_layers(spark, SF, species).collect()}
    assert layers & {"region_matched", "region_inferred"}
    assert geography.species_layers(spark, SF, "Nulla species").count() == 0


def test_broadcast_only_of_counted_sides(spark):
    from frondara.session import broadcast_if_small

    df = spark.range(100).withColumn("t", F.lit("x" * 100))
    plan = lambda side: spark.range(9).join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(broadcast_if_small(df))
    assert "strategy=merge" in plan(broadcast_if_small(df, rows=10)) and "strategy=merge" in plan(broadcast_if_small(df, size=500))
