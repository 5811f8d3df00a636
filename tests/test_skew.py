from pyspark.sql import functions as F

from chronotext import session, skew


def test_salted_join_is_a_join(spark, rows):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k bigint, y string")
    assert skew.hot_keys(left, ["k"], 100).count() == 1
    for how in ("inner", "left", "left_anti", "left_semi"):
        plain = left.join(right, "k", how)
        assert rows(skew.salted_join(left, right, ["k"], F.col("x"), how, 100).select(*plain.columns)) == rows(plain)


def test_grid_join_is_a_join(spark, rows):
    left = spark.range(900).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(700).select(F.when(F.col("id") % 2 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    plain = left.join(right, "k")
    assert rows(skew.grid_join(left, right, ["k"], F.col("x"), F.col("y"), 100).select(*plain.columns)) == rows(plain)
    assert rows(skew.grid_join(left, right, ["k"], F.col("x"), F.col("y")).select(*plain.columns)) == rows(plain)


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 10).alias("a"), F.col("id").alias("b")).repartition(4)
    got = skew.row_numbers(df, ["a", "b"]).orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(1, 1001))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_materialized_tables_stay_until_released(spark):
    session.release(spark)
    kept = session.materialize(spark.range(5))
    assert kept.count() == 5 and session.release(spark) == 1 and session.release(spark) == 0
    again = session.materialize(spark.range(3).limit(0))
    assert again.schema.simpleString() == "struct<id:bigint>" and again.count() == 0
