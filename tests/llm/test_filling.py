"""The digit search of mixing with sources that finish at different levels."""

from pyspark.sql import functions as F

from quern.llm import mixing


def test_a_source_that_fits_is_taken_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_FEW", 0)
    rows = [("a", 1, (i + 1) << 50, i) for i in range(5)] + [("b", 1, (7 << 54) + i, 100 + i) for i in range(40)] + [(None, 1, i << 40, 200 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "source string, size long, key long, row long")
    rest = spark.createDataFrame([("a", 100.0), ("b", 20.0), (None, 3.0), ("none", 5.0)], "source string, rest double")
    of = lambda table, s: table.join(s.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    got = sorted(r.row for r in mixing._filling(df, rest, of).collect())
    assert got == [*range(5), *range(100, 120), *range(200, 203)]
