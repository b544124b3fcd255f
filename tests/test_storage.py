from quern import storage


def test_cut_and_release(spark):
    df = spark.range(5)
    back = storage.cut(df, "numbers")
    assert back.count() == 5 and back.dtypes == df.dtypes
    assert storage.release(spark) >= 1 and storage.release(spark) == 0
