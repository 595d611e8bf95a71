"""The salted join against a plain one: hot keys, null keys, empty tables."""

from pyspark.sql import functions as F

from feedloom.llm.common import salted_join


def test_salted_join_gives_the_rows_of_a_plain_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"))
    totals = rows.where("k is not null and (k = 0 or k % 2 = 0)").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        for hot in (3, 1000):
            got = salted_join(rows, totals, ["k"], "n", how, hot=hot, salts=8)
            plain = rows.join(totals, "k", how)
            assert got.columns == plain.columns
            assert sorted(got.collect(), key=repr) == sorted(plain.collect(), key=repr)
    none = totals.where("false")
    assert salted_join(rows, none, ["k"], "n").count() == 0
    assert salted_join(rows, none, ["k"], "n", "left").count() == 3000
