"""Chunks of large buckets all meet; the digest index is read by its buckets."""

from pyspark.sql import functions as F
from test_llm_operators import docs

from loomwright.llm import exact, simhash
from loomwright.session import Workspace


def test_rows_of_chunks_all_meet(spark):
    rows = spark.range(500).select(F.lit(7).cast("bigint").alias("key"), F.xxhash64("id").alias("fp"), F.col("id").alias("rep"))
    rows = rows.unionByName(spark.range(600, 610).select(F.lit(8).cast("bigint").alias("key"), F.col("id").alias("fp"), F.col("id").alias("rep")))
    got = simhash._chunked(rows, 40, Workspace(spark, "chunks")).cache()
    assert got.groupBy("key").count().agg(F.max("count")).first()[0] < 80 and got.where("key = 8").count() == 10
    met = got.alias("a").join(got.alias("b"), "key").where("a.rep < b.rep").select("a.rep", F.col("b.rep").alias("other")).distinct()
    assert met.count() == 500 * 499 // 2 + 45
    got.unpersist()


def test_index_is_not_shuffled(spark):
    index = exact.DigestIndex(spark)
    rows = [(i, f"text {i}") for i in range(30)]
    exact.exact_duplicates(docs(spark, rows), index).count()
    groups = exact.digests(docs(spark, rows)).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    version, buckets = index.layout()
    for partitions in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        with index._table(version, buckets) as name:
            for kind in ("left_anti", "inner"):
                plan = index.beside(groups.select("digest"), name, buckets, kind)._jdf.queryExecution().executedPlan().toString()
                side = plan[plan.index("Scan ExistingRDD") :]
                assert "Bucketed: true" in side and "Exchange" not in side
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    again = index.append_new(groups, 30, Workspace(spark, "again"))
    assert again.count() == 30 == index.entries().count()
