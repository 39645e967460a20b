from pyspark.sql import functions as F

from mailweave.operators import delivery_dedup as dd

SCHEMA = "delivery_id long, message_id string, source_file string, note string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, m, "f", "x") for i, m in ids], SCHEMA)


def test_lowest_delivery_stays(spark):
    df = rows(spark, (3, "<A@x>"), (1, " a@x "), (2, "a@X"), (4, "b@x"), (5, None), (6, "  "), (7, "<>"), (8, None))
    assert {r[0] for r in dd.surplus_deliveries(df).collect()} == {2, 3}
    assert {r[0] for r in dd.exactly_once(df).select("delivery_id").collect()} == {1, 4, 5, 6, 7, 8}


def test_empty_table_and_null_order(spark):
    assert dd.surplus_deliveries(rows(spark)).count() == 0
    df = rows(spark, (None, "a"), (1, "a"), (2, "a"))
    assert [r[0] for r in dd.surplus_deliveries(df).collect()] == [2]


def test_key_determines_identifier(spark):
    ids = ["a", "ab", "a\0", "abcdefgh", "abcdefgh1", "abcdefgi1", "x" * 16, "x" * 17, "é" * 9, "abcdefghijklmnopqrstuvwxyz" * 40]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    q, r = dd.quotient_key(F.col("i"))
    assert df.select(q.alias("q"), r.alias("r")).distinct().count() == len(ids)


def test_repeated_rows_and_extra_columns(spark):
    df = rows(spark, (1, "a"), (1, "a"), (2, "a"), (2, "a")).withColumn("_mw_id", F.lit(1)).withColumn("first", F.lit(2))
    assert sorted(r[0] for r in dd.surplus_deliveries(df).collect()) == [2]


def test_hot_identifier(spark):
    df = spark.range(20000).select(F.col("id").alias("delivery_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("message_id"))
    assert dd.surplus_deliveries(df).count() == 6667 - 1
