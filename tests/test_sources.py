"""Readers of tables and evaluation queries, from files and from a database."""

from pyspark.sql import functions as F

from loomwright.sources import tables as T

URL = "jdbc:derby:memory:sources;create=true"


def likes(spark, n=100):
    return spark.range(n).select(
        F.col("id").alias("article_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") + 1714521600).alias("create_time")
    )


def test_tables_from_files(spark, tmp_path):
    likes(spark).withColumn("other", F.lit(1)).write.parquet(str(tmp_path / "article_like"))
    got = T.read_tables(spark, f"{tmp_path}/", names=["article_like"])["article_like"]
    assert got.columns == ["article_id", "user_id", "create_time"]
    assert sorted(got.collect()) == sorted(likes(spark).collect())


def test_tables_from_a_database(spark):
    likes(spark).write.format("jdbc").options(url=URL, dbtable="article_like").save()
    whole = T.read_tables(spark, jdbc={"url": URL}, names=["article_like"])["article_like"]
    sliced = T.read_tables(spark, jdbc={"url": URL, "lower": 10, "upper": 90}, names=["article_like"], ranges=4)["article_like"]
    assert whole.rdd.getNumPartitions() == 1 and sliced.rdd.getNumPartitions() == 4
    assert sorted(whole.collect()) == sorted(sliced.collect()) == sorted(likes(spark).collect())


def test_evaluation_queries(spark, tmp_path):
    (tmp_path / "q.csv").write_text('query\nplain\n"with, comma"\n检索\n', encoding="utf-8")
    assert [r["query"] for r in T.read_eval_queries(spark, str(tmp_path / "q.csv")).collect()] == ["plain", "with, comma", "检索"]
