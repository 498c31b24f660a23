import json

from pyspark.sql import functions as F

from frondara.sources import readers, writers
from frondara.streaming.occurrences import daily_counts

POINTS = "/root/testdata/sf0.001/points.parquet"


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("raw,corrected\n# note\nab,AB\nabcd,ABCD\n")
    assert [r.raw for r in readers.corrections(spark, str(tmp_path / "c.csv")).collect()] == ["abcd", "ab"]
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]}))
    assert readers.question_set(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "s.tsv").write_text("id\tspecies\n1\tA b\n2\tC d\n")
    assert sorted(r.species for r in readers.snapshot_species(spark, str(tmp_path / "s.tsv")).collect()) == ["A b", "C d"]
    (tmp_path / "f").mkdir()
    for n in ("01 Araceae.pdf", "02 index.pdf"):
        (tmp_path / "f" / n).write_text("x")
    assert [r.family for r in readers.corpus_files(spark, str(tmp_path / "f")).collect()] == ["Araceae"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("occ.csv", "id\tspecies\n1\tA b\n2\n3\tC d\n4\t\n")
    assert sorted(str(r.species) for r in readers.snapshot_species(spark, str(tmp_path / "s.zip")).collect()) == ["A b", "C d", "None"]
    (tmp_path / "Vol VI").mkdir()
    for n in ("01 MelaTococa.pdf", "ABCDv6 x.pdf", "03 z1abcd.pdf"):
        (tmp_path / "Vol VI" / n).write_text("x")
    assert [(r.family, r.volume) for r in readers.corpus_files(spark, str(tmp_path / "Vol VI")).collect()] == [("Melastomataceae", "VI"), ("Vol VI", "VI")]
    (tmp_path / "ABCDv3 PDFs").mkdir()
    (tmp_path / "ABCDv3 PDFs" / "Poaceae.pdf").write_text("x")
    assert [(r.family, r.volume) for r in readers.corpus_files(spark, str(tmp_path / "ABCDv3 PDFs")).collect()] == [("Poaceae", "III")]
    b = spark.createDataFrame([(1, 0.0, 500.0, "b " * 30, 800.0), (1, 0.0, 200.0, "a " * 30, 800.0), (1, 0.0, 50.0, "head", 800.0), (1, 0.0, 300.0, "12 Manual de Plantas " + "x" * 40, 800.0)], "page int, x0 double, y0 double, text string, page_height double")
    assert [r.text[0] for r in readers.reading_order(b).orderBy("seq").collect()] == ["a", "b"]


def test_writers(spark, tmp_path):
    f = spark.read.parquet("/root/testdata/sf0.001/fichas.parquet").dropDuplicates(["vector_id"])
    writers.rebuild(f, str(tmp_path / "a"))
    writers.merge_into(f.limit(3).withColumn("volume", F.lit("new")), str(tmp_path / "a"), str(tmp_path / "b"), "vector_id")
    out = spark.read.parquet(str(tmp_path / "b"))
    assert out.count() == f.count() and out.where("volume = 'new'").count() == 3
    back = writers.from_documents(writers.documents(f), f.schema)
    assert back.select("r.species").exceptAll(f.select("species")).count() == 0
    assert writers.index_records(f).where("elev_min_eff is null").count() == 0
    writers.csv_report(f, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == f.count()
    assert "+" in writers.markdown(f.select("species"), "x", 5).splitlines()[-1]


def test_stream_equals_batch(spark, tmp_path):
    points = spark.read.parquet(POINTS)
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").exceptAll(daily_counts(points)).count() == 0
    assert spark.table("daily").agg(F.sum("n")).first()[0] == daily_counts(points).agg(F.sum("n")).first()[0]


def test_caches_and_incremental_rows(spark, tmp_path):
    points = spark.read.parquet(POINTS).where("species IS NOT NULL")
    one = points.select("species").first()[0]
    writers.point_cache(points, str(tmp_path / "p"))
    assert writers.cached_points(spark, str(tmp_path / "p"), one).exceptAll(points.where(F.col("species") == one)).count() == 0
    assert writers.cached_points(spark, str(tmp_path / "p"), one).count() == points.where(F.col("species") == one).count()
    counts = writers.count_cache(points, "species", str(tmp_path / "n"))
    assert counts.agg(F.sum("n")).first()[0] == points.count()
    assert writers.count_cache(points.where("false"), "species", str(tmp_path / "n")).count() == counts.count()
    f = spark.read.parquet("/root/testdata/sf0.001/fichas.parquet")
    assert writers.append_missing(f.where("ficha_id <= 20"), str(tmp_path / "f"), "ficha_id") == 20
    assert writers.append_missing(f.where("ficha_id <= 30"), str(tmp_path / "f"), "ficha_id") == 10
    assert spark.read.parquet(str(tmp_path / "f")).count() == 30
    sizes = [len(r.records) for r in writers.in_batches(f.repartition(2), "ficha_id", 9).collect()]
    assert sum(sizes) == f.count() and max(sizes) <= 9
