"""Golden cases of the catalogue's functions, and its queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from frondara.functions import spanish as es
from frondara.operators import bands, ordered
from frondara.plans.intent import Intent, parse, validated


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("(100–)400–1850 m;", (400, 1850, 100, None)), ("0–700(–1200) m", (0, 700, None, 1200)), ("ca. 1150 m", (1150, 1150, None, None)), ("1300 m", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4)],
)
def test_elevation(spark, text, want):
    assert tuple(one(spark, text, es.elevation)) == want


def test_text_functions(spark):
    assert one(spark, "Bosque húmedo, muy húmedo y pluvial, 600–1900 m", es.forest_types) == ["muy húmedo", "húmedo", "pluvial"]
    assert one(spark, "Fl. ene., abr.–ago., oct.", es.months) == [1, 4, 5, 6, 7, 8, 10]
    assert one(spark, "Fr. nov.–feb.", lambda c: es.months(c, "Fr")) == [1, 2, 11, 12]
    assert one(spark, None, es.months) == []
    assert one(spark, "Arbusto o árbol, 3–30 m", es.habits) == ["árbol", "arbusto"]
    assert one(spark, "Planta hemiepífita", es.habits) == ["hemiepífita"]
    assert tuple(one(spark, "100-300", es.range_bounds)) == (100, 300)
    assert tuple(one(spark, "800", es.range_bounds)) == (800, 800)
    assert one(spark, "", es.range_bounds) is None
    assert one(spark, "ambas verts., Valle", es.slopes) == ["Caribe", "Pacífico"]
    assert one(spark, "X, Y y Z", es.listed) == ["X", "Y", "Z"]


def test_bands(spark):
    df = spark.createDataFrame([(400, 1850, 100)], "lo int, hi int, olo int")
    lo, hi, elo = F.col("lo"), F.col("hi"), bands.effective(F.col("olo"), F.col("lo"))
    elo = F.coalesce("olo", "lo")
    got = lambda a, b: tuple(df.select(bands.strictly_overlaps(elo, hi, a, b), bands.touches(lo, hi, a, b), bands.touches(elo, hi, a, b)).first())
    assert got(F.lit(2000), None) == (False, False, False)
    assert got(F.lit(1850), F.lit(2500)) == (False, True, True)
    assert got(None, F.lit(200)) == (True, False, True)
    assert got(F.lit(1000), F.lit(2000)) == (True, True, True)
    r = df.select(bands.relevance(F.lit(400), F.lit(1850), F.lit(1000), F.lit(2000), F.lit(0.8))).first()[0]
    assert abs(r - 0.686724) < 1e-6
    i = lambda *x: df.select(bands.iou(*[F.lit(v) for v in x])).first()[0]
    assert i(5, 5, 5, 5) == 1.0 and i(2, 29, 800, 800) == 0.0


def test_slices_and_sample(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "x int")
    got = [r.slice for r in ordered.slices(df, ["x"], 4).orderBy("x").collect()]
    assert got == [1, 2, 2, 3, 4, 4]
    assert ordered.slices(df.where("false"), ["x"], 4).count() == 0
    assert [r.x for r in ordered.systematic_sample(df, ["x"], 2).orderBy("x").collect()] == [0, 3]


def test_upsert_and_sessions(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, ordered.upsert(a, b, "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, ordered.upsert(a, b, "k", "first").collect())) == [(1, "a"), (2, "b"), (3, "C")]
    rows = spark.createDataFrame([("d", 0, False), ("d", 1, True), ("d", 2, False), ("d", 3, True)], "doc string, seq int, h boolean")
    assert [r.session for r in ordered.sessions(rows, "doc", "seq", F.col("h")).orderBy("seq").collect()] == [0, 1, 1, 2]


VOCAB = {"habit": set(es.HABITS), "forest_type": {"húmedo", "muy húmedo", "seco", "roble"}, "vertiente": {"Caribe", "Pacífico"}, "region": {"Cordillera de Talamanca", "Valle Central"}, "family": {"Araceae"}}


@pytest.mark.parametrize(
    "q, want",
    [
        ("epífitas de la vertiente Caribe entre 500 y 1500 m", Intent(habit="epífita", vertiente="Caribe", elev_lo=500, elev_hi=1500)),
        ("árboles endémicos del Valle Central", Intent(habit="árbol", endemic=True, region="Valle Central")),
        ("Araceae de bosque muy húmedo bajo 500 m", Intent(family="Araceae", forest_type="muy húmedo", elev_hi=500)),
        ("hierbas que florecen en marzo", Intent(habit="hierba", flowering_month=3)),
        ("plantas de Costa Rica", Intent()),
        ("la especie de mayor altitud en la Cordillera de Talamanca", Intent(region="Cordillera de Talamanca", intent_type="superlative", criterion="elev_max", direction="max")),
    ],
)
def test_parse(q, want):
    assert parse(q, VOCAB) == want


def test_validation():
    assert validated(Intent(intent_type="superlative", direction="max"), VOCAB) == Intent()
    assert validated(Intent(region="Nada", elev_lo=2000.0, flowering_month=True), VOCAB) == Intent()


def test_queries_against_sql(spark):
    import importlib

    from frondara import compare

    entry = importlib.import_module("__spark_entry__")
    names = [n for m in entry._MODULES for n in m.QUERIES]
    said = compare.compare(spark, "/root/testdata/sf0.001", names)
    assert set(said) == set(names)
    assert [k for k, v in said.items() if v.startswith(("DIFF", "ERR"))] == []
    assert set(entry.oracle_sql()) <= set(entry.queries())
