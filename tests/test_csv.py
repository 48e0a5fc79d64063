"""CSV by the library's writer and back: nothing that a text may hold is lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from marigold.sources import readers, sinks

TEXTS = ['"', '""', 'a "quoted" word', '\\', 'back\\slash "and" quote\\"', " lead", "trail ", "\ttabs\t", "", None, " ", ",", "a,b", "line\nend", "line\r\nend\r", "\r", "\n", "#no comment", "'", "é漢 ", "null", "NULL", '\\"', "x" * 100_000]


def test_texts_come_back_as_they_were(spark, tmp_path):
    rows = [(i, t, TEXTS[-1 - i], float(i) if i % 3 else None) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, text string, `odd name.x` string, n double").repartition(3)
    sinks.export(df, str(tmp_path / "t.csv"), "csv")
    back = readers.by_suffix(spark, str(tmp_path / "t.csv"), df.schema)
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows))
    untyped = readers.by_suffix(spark, str(tmp_path / "t.csv"))
    assert {(int(r.id), r.text) for r in untyped.collect()} == {(i, t) for i, t, _, _ in rows}


def test_arrays_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.0], None), (2, None, "")], "id long, v array<double>, t string")
    sinks.export(df, str(tmp_path / "a.csv"), "csv")
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", "[1.5,2.0]", None), ("2", None, "")]
    sinks.export(df.where("id < 0"), str(tmp_path / "e.csv"), "csv")
    assert readers.csv(spark, str(tmp_path / "e.csv")).columns == ["id", "v", "t"] and readers.csv(spark, str(tmp_path / "e.csv")).agg(F.count("*")).first()[0] == 0
