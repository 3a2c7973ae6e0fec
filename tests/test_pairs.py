"""All pairs of a user's vectors: values, how they are dealt, and the rounding."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomwright.operators import retrieval as R
from loomwright.plans import catalog

QUERY = "query_id long, user_id long, embedding array<float>"
MEMORY = "id long, user_id long, embedding array<float>"


def test_one_users_pairs_are_many_tasks(spark, tmp_path):
    rng, n = random.Random(3), 4500
    vectors = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(n)]
    ids = pa.array(range(n), pa.int64())
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([7] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": ids, "text": ["x"] * n}), tmp_path / "documents.parquet")
    found = catalog.queries()["cosine_similarity"](spark, str(tmp_path))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == n // 10 * n and len(tasks) > 1


def test_values(spark):
    """Vectors of several lengths, empty ones, nulls in place of and within vectors; small blocks; the longest that is written out."""
    rng = random.Random(5)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    odd = [None, [], [0.0] * 8, [None, *vector(7)], vector(3), vector(300)]
    for length in (8, R.LONGEST_WRITTEN, 300):
        queries = [(i, i % 3 or None, v) for i, v in enumerate([*(vector(length) for _ in range(30)), *odd])]
        memories = [(i, i % 3 or None, v) for i, v in enumerate([*(vector(length) for _ in range(50)), *odd, *odd])]
        q, m = spark.createDataFrame(queries, QUERY), spark.createDataFrame(memories, MEMORY)
        plain = q.select("query_id", "user_id", F.col("embedding").alias("a")).join(m.select(F.col("id").alias("memory_id"), "user_id", F.col("embedding").alias("b")), "user_id")
        plain = plain.select("query_id", "memory_id", F.round(R.cosine_similarity(F.col("a"), F.col("b")), 6).alias("score"))
        want = sorted(map(repr, plain.collect()))
        assert sorted(map(repr, R.all_scores(q, m, block=7).collect())) == want and len(want) > 400


def test_six_digits(spark):
    rng = random.Random(6)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0, -1e-7, 4.9999999e-7, 5e-7, -5e-7, 0.1234565, -0.1234565, 0.12345649999999999, 0.9999995, 1.0000005, 3.1234565, 1e300]
    some = [(rng.randrange(-(10**6), 10**6) + 0.5) / 1e6 + rng.choice([0, 1e-16, -1e-16, 1e-13, -1e-12, 3e-11]) for _ in range(20000)] + [rng.uniform(-1, 1) for _ in range(20000)]
    df = spark.createDataFrame([(x,) for x in odd + some], "x double")
    rows = df.select(R.six_digits(F.col("x")), F.round("x", 6)).collect()
    assert [repr(a) for a, _ in rows] == [repr(b) for _, b in rows]
