"""Recommendations of readers who have seen much, against a plain loop, and how few articles they meet."""

import random

from loomwright import session
from loomwright.operators import social as S


def test_readers_meet_few_articles_of_a_tag(spark, monkeypatch):
    rng = random.Random(5)
    metas = [(a, rng.randrange(50), rng.choice(["x, Y", "y", "x,z"])) for a in range(600)]
    views, tags = {a: v for a, v, _ in metas}, {a: {t.strip().lower() for t in s.split(",")} for a, _, s in metas}
    best = sorted(views, key=lambda a: (-views[a], -a))
    # A reader of the last 400, one of the first 300, one of every other of the first 100, one of all of them.
    seen = {1: best[200:], 2: best[:300], 3: best[:100:2], 4: best}
    likes = spark.createDataFrame([(u, a) for u, own in seen.items() for a in own if a % 2], "user_id bigint, article_id bigint")
    favorites = spark.createDataFrame([(u, a) for u, own in seen.items() for a in own if a % 3 == 0 or not a % 2], "user_id bigint, article_id bigint")
    meta = spark.createDataFrame(metas, "article_id bigint, view_count int, tags string")
    article = spark.createDataFrame([(a, 0, "2024-01-01") for a in views], "id bigint, is_deleted int, publish_time string")
    events = spark.createDataFrame([(a, "VIEW", "2024-01-10 01:00:00") for a in (5, 6, 7)], "article_id bigint, verb string, ts string").withColumn("ts", S.F.to_timestamp("ts"))
    offered, plain = [], S.exclude_seen
    monkeypatch.setattr(S, "exclude_seen", lambda candidates, own: offered.append(candidates) or plain(candidates, own))
    got = {}
    for r in S.recommend(likes, favorites, meta, article, events, "2024-01-10", 10).collect():
        got.setdefault(r["user_id"], []).append((r["place"], r["article_id"]))
    want = {u: [a for a in best if a not in set(own)][:10] for u, own in seen.items() if u != 4}
    assert all(set.intersection(tags[a], {"x", "y", "z"}) for a in views)
    assert {u: [a for _, a in sorted(own)] for u, own in got.items()} == want
    met = {r["user_id"]: r["count"] for r in offered[0].groupBy("user_id").count().collect()}
    assert met[1] <= 30 and met[3] <= 3 * 60 and met[2] <= 3 * 310  # 600 for the first before


def test_partitions_of_pairs_grow_with_the_input(spark, tmp_path, monkeypatch):
    pairs = spark.range(4000).selectExpr("id % 900 AS user_id", "id % 70 AS article_id")
    pairs.repartition(2).write.parquet(str(tmp_path / "pairs"))
    read = spark.read.parquet(str(tmp_path / "pairs"))
    plain = session.parts_for(read)
    assert plain == int(spark.conf.get("spark.sql.shuffle.partitions")) == session.parts_for(pairs)
    monkeypatch.setattr(session, "PART_BYTES", 500)
    assert session.parts_for(read) > plain
    seen = S.interacted(read, read)
    assert seen.rdd.getNumPartitions() == session.parts_for(read, read)
    assert sorted(tuple(r) for r in seen.collect()) == sorted({(i % 900, i % 70) for i in range(4000)})
