"""Pages of follow lists and articles: whole, stable and of bounded size."""

from pyspark.sql import functions as F

from loomwright.operators import content as C
from loomwright.operators import social as S


def test_a_hub_comes_in_pages(spark):
    """A hub of 10,000 followers, each edge given twice, beside small lists."""
    hub = spark.range(10_000).select((F.col("id") + 10).alias("follower_id"), F.lit(1).cast("bigint").alias("followee_id"))
    small = spark.createDataFrame([(1, 2), (2, 3)], "follower_id long, followee_id long")
    follows = hub.unionAll(hub).unionAll(small)
    pages = S.follow_pages(follows, 64).where("user_id = 1").orderBy("side", "page").collect()
    followers = [r for r in pages if r["side"] == "followers"]
    assert [r["page"] for r in followers] == list(range(1, 158)) and all(len(r["ids"]) == 64 for r in followers[:-1])
    assert [i for r in followers for i in r["ids"]] == list(range(10, 10_010))
    assert all(r["cursor"] == r["ids"][-1] for r in pages)
    assert [(r["page"], r["ids"]) for r in pages if r["side"] == "following"] == [(1, [2])]


def test_a_cursor_is_stable(spark):
    follows = spark.createDataFrame([(i, 1) for i in range(2, 42)], "follower_id long, followee_id long")
    ask = lambda cursor: spark.createDataFrame([(1, "followers", cursor), (9, "followers", cursor)], "user_id long, side string, cursor long")
    first = [r["other_id"] for r in S.follow_page_after(follows, ask(None), 7).orderBy("place").collect() if r["user_id"] == 1]
    assert first == list(range(2, 9))
    changed = follows.where("follower_id NOT IN (3, 5)").unionAll(spark.createDataFrame([(0, 1)], follows.schema))
    after = [(r["place"], r["other_id"]) for r in S.follow_page_after(changed, ask(8), 7).where("user_id = 1").orderBy("place").collect()]
    assert after == [(i + 1, 9 + i) for i in range(7)]
    assert S.follow_page_after(changed, ask(41), 7).where("user_id = 1").count() == 0
    assert S.follow_pages(follows.limit(0)).count() == 0


def test_article_pages_join_up(spark):
    rows = [(i, f"1997-01-{1 + i % 3:02d} 00:00:00", int(i % 7 == 0)) for i in range(60)]
    article = spark.createDataFrame(rows, "id long, publish_time string, is_deleted int").withColumn("publish_time", F.to_timestamp("publish_time"))
    want = [r["id"] for r in article.where("is_deleted = 0").orderBy(F.desc("publish_time"), F.desc("id")).collect()]
    got, at = [], (None, None)
    while page := C.article_page_after(article, *at, 8).collect():
        got += [r["id"] for r in page]
        at = (str(page[-1]["publish_time"]), page[-1]["id"])
    assert got == want
