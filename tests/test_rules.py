"""Rules that differ from what one would expect, on tables small enough to read."""

from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.functions import metrics as M
from loomwright.operators import content as C
from loomwright.functions.windows import ranked
from loomwright.operators import ingest as I
from loomwright.operators import retrieval as R
from loomwright.operators import social as S
from loomwright.operators import tasks as T
from loomwright.streaming import greedy as G

NOW = "2024-05-01 00:00:00"
AT = datetime(2024, 5, 1)
MEMORY = (
    "id long, user_id long, type string, content string, content_hash string, importance double, access_count int, "
    "last_accessed_at timestamp, create_time timestamp, is_deleted int, vector_status string, retry_count int, embedding array<float>"
)


def memories(spark, *rows):
    """(id, content, vector, importance, last access, profile age in days)"""
    full = [(i, 1, "fact", c, c, imp, 0, last, AT - timedelta(days=age), 0, "SYNCED", 0, v) for i, c, v, imp, last, age in rows]
    return spark.createDataFrame(full, MEMORY)


def query(spark, text="ab cd", vector=(1.0, 0.0)):
    return spark.createDataFrame([(1, 1, text, list(vector))], "query_id long, user_id long, text string, embedding array<float>")


def fuse(spark, mem, semantic, keyword=(), profile=(), vector=(1.0, 0.0)):
    rows = lambda xs: spark.createDataFrame([(1, i, float(s)) for i, s in xs], "query_id long, memory_id long, score double")
    own = spark.createDataFrame([(1, i) for i in profile], "user_id long, memory_id long")
    out = R.fuse_scores(query(spark, vector=vector), rows(semantic), rows(keyword), own, mem, NOW)
    return {r["memory_id"]: (r["source"], round(r["score"], 6)) for r in out.collect()}


def test_fusion(spark):
    mem = memories(
        spark, (1, "a", None, 0.9, AT, 0), (2, "b", None, 0.3, AT - timedelta(days=60), 0), (3, None, None, 0.5, None, 0), (4, "d", None, None, None, 0)
    )
    got = fuse(spark, mem, [(1, 0.5), (2, 0.5), (3, 0.9), (4, 0.05)], [(4, 3.0)], [])
    assert set(got) == {1, 2} and got[1][1] > got[2][1]  # no content: dropped; 4 is claimed by its weak vector hit
    assert fuse(spark, mem, [(1, 0.99)], [], [1])[1] == ("profile", 0.85)
    assert fuse(spark, mem, [], [(2, 3.0)], [], vector=())[2] == ("keyword", 0.71095)
    assert fuse(spark, mem, [], [(1, 3.0), (2, 0.5)], [], vector=()).keys() == {1}


def test_blank_query_and_rerank(spark):
    mem = memories(spark, *[(i, f"ab {i}", [1.0, i / 10], 0.5, None, i) for i in range(8)])
    assert R.hybrid_search(query(spark, "  "), mem, NOW).count() == 0
    assert R.hybrid_search(query(spark), mem, NOW, k=10).count() == 5
    few = R.hybrid_search(query(spark), mem.where("id < 3"), NOW, k=10)
    assert few.count() == 3
    odd = memories(spark, (1, "a", [1.0], 0.5, None, 0))
    assert [r["score"] for r in R.vector_topk(query(spark), odd, 3).collect()] == [0.0]


def test_parse(spark):
    reply = lambda s: spark.createDataFrame([(1, 1, "s", s)], "message_id long, user_id long, session_id string, response string")
    got = I.parse_memory_candidates(reply('```json\n{"memory":[{"text":" a ","type":"fact"},{"text":"b","type":"wrong_type"},{"text":"' + "x" * 501 + '","type":"fact"}]}\n```'))
    assert [(r["text"], r["type"]) for r in got.collect()] == [("a", "fact")]
    assert I.parse_memory_candidates(reply("malformed {")).count() == 0


def test_update_above_only(spark):
    mem = memories(spark, (42, "a", [1.0, 0.0], 0.5, None, 0))
    cand = spark.createDataFrame([(1, 1, "n", [1.0, 0.1]), (2, 1, "m", [0.0, 1.0])], "candidate_id long, user_id long, content string, embedding array<float>")
    assert {r["candidate_id"]: r["target_id"] for r in I.update_target(cand, mem).collect()} == {1: 42, 2: None}


def test_reactions(spark):
    rows = [(1, 1, 7, "LIKE"), (2, 1, 7, "LIKE"), (3, 2, 7, "UNLIKE"), (4, 3, 7, "LIKE"), (5, 3, 7, "UNLIKE"), (6, 4, 7, "FAVORITE")]
    events = spark.createDataFrame([(i, u, a, v, AT) for i, u, a, v in rows], "event_id long, user_id long, article_id long, verb string, ts timestamp")
    assert [tuple(r) for r in S.apply_reactions(events).collect()] == [(7, 1, 1)]
    art = spark.createDataFrame([(7, "t", "s", 1)], "id long, title string, summary string, is_deleted int")
    assert S.leaderboard(events, art).count() == 0


def test_threads_page_limit(spark):
    rows = [(1, 5, 1, None, "p", 0, AT)] + [(10 + i, 5, 1, 1, f"r{i}", 0, AT + timedelta(minutes=i)) for i in range(11)]
    comments = spark.createDataFrame(rows, "id long, article_id long, user_id long, parent_id long, content string, is_deleted int, create_time timestamp")
    likes = spark.createDataFrame([(1, 9)], "comment_id long, user_id long")
    users = spark.createDataFrame([(1, "u")], "id long, username string")
    row = S.comment_threads(comments, likes, users, viewer=9).first()
    assert len(row["replies"]) == 10 and row["liked"] and row["replies"][0]["content"] == "r0"


def test_fanout(spark):
    comments = spark.createDataFrame([(1, 5, 1), (2, 5, 3)], "id long, article_id long, user_id long")
    article = spark.createDataFrame([(5, 1, "")], "id long, author_id long, title string")
    users = spark.createDataFrame([(1, "u")], "id long, username string")
    none = spark.createDataFrame([], "comment_id long, user_id long")
    follows = spark.createDataFrame([(1, 1), (1, 3)], "follower_id long, followee_id long")
    got = {(r["user_id"], r["content"]) for r in S.notification_fanout(comments, none, follows, article, users).collect()}
    assert got == {(1, "用户#3 评论了你的文章"), (3, "u 关注了你")}


def test_backoff_and_stale(spark):
    df = spark.range(0, 8).select(T.backoff_seconds(F.col("id")).alias("s"))
    assert [r["s"] for r in df.collect()] == [10, 20, 40, 80, 160, 320, 600, 600]
    rows = [(1, 0, AT - timedelta(minutes=5), 0), (2, 0, AT - timedelta(minutes=5, seconds=1), 0), (3, 1, AT - timedelta(hours=1), 0)]
    tasks = spark.createDataFrame(rows, "id long, status int, heartbeat_at timestamp, is_deleted int")
    assert [r["id"] for r in T.stale_tasks(tasks, NOW).collect()] == [2]


def test_gate_and_numbers(spark):
    rows = [(1, 1, "t", "b"), (2, 2, "t", "b"), (3, 0, " ", "b"), (4, 0, "t", ""), (5, 0, "t", "b")]
    draft = spark.createDataFrame([(i, s, t, b) for i, s, t, b in rows], "id long, status int, title string, content_md string")
    assert [r["reason"] for r in C.publish_gate(draft).orderBy("id").collect()] == ["already published", "not editing", "blank title", "blank body", None]


def test_ranks_by_ranges(spark):
    """Numbers are right, and neither a hot group nor an outlying key fills a partition."""
    ids = spark.range(5, 50_000, 7).unionByName(spark.createDataFrame([(10**15,)], "id long"))
    got = ranked(ids, [], [F.asc("id")], "number", 16)
    rows = got.orderBy("id").collect()
    assert [r["number"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["id"] == 10**15
    hot = spark.range(20_000).select(F.when(F.col("id") % 10 < 3, "hot").when(F.col("id") % 10 == 4, None).otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("tag"), (F.col("id") % 97).alias("views"), "id")
    got = ranked(hot, ["tag"], [F.desc("views"), F.desc("id")], "rank", 16)
    want = hot.withColumn("rank", F.row_number().over(W.partitionBy("tag").orderBy(F.desc("views"), F.desc("id"))).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 20_000
    dealt = hot.repartitionByRange(16, F.asc("tag"), F.desc("views"), F.desc("id")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < 4 * 20_000 / 16
    text = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.split("\n") if "row_number()" in line and "windowspecdefinition" in line]
    assert windows and all("__part" in line for line in windows)


def test_greedy(spark):
    def events(*rows):
        return spark.createDataFrame([(i, 1, AT + timedelta(seconds=s), t) for i, (s, t) in enumerate(rows)], "event_id long, user_id long, ts timestamp, text string")

    def run(df, kernel):
        return [r["admitted"] for r in G.admit(df, ["user_id"], kernel, text="text").orderBy("event_id").collect()]

    assert run(events((0, "A"), (30, "A"), (61, "A"), (62, "A"), (63, "B"), (64, "A")), G.same_comment()) == [True, False, True, False, True, True]
    assert run(events(*[(s, "") for s in (0, 1, 2, 3, 4, 5, 60)]), G.at_most()) == [True] * 5 + [False, True]
    assert run(events((0, ""), (4, ""), (5, ""), (9, ""), (11, "")), G.spaced()) == [False, False, True, False, True]


def test_metrics_without_hits(spark):
    ranked = spark.createDataFrame([], "query_id long, memory_id long, place long")
    judged = spark.createDataFrame([(1, "g", [1, 2])], "query_id long, grp string, relevant_ids array<long>")
    assert [(r["recall"], r["mrr"], r["hit1"]) for r in M.retrieval_metrics(ranked, judged).collect()] == [(0.0, 0.0, 0.0)] * 2


def test_comments_of_equal_time_and_id(spark):
    """Such comments stand in the order of their authors, however the rows come."""
    from loomwright.operators import social as S

    rows = [(10, 1, user, None, f"by {user}", 0, AT) for user in range(8)] + [(11, 1, user, 10, "reply", 0, AT) for user in range(3)]
    users = spark.createDataFrame([(u, f"u{u}") for u in range(8)], "id long, username string")
    likes = spark.createDataFrame([], "comment_id long, user_id long")
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        comments = spark.createDataFrame(order, "id long, article_id long, user_id long, parent_id long, content string, is_deleted int, create_time timestamp").repartition(3)
        shown = S.comment_threads(comments, likes, users, viewer=7, size=3, replies=2).collect()
        assert sorted((r["place"], r["username"]) for r in shown) == [(1, "u0"), (2, "u1"), (3, "u2")]
        assert {tuple(x["user_id"] for x in r["replies"]) for r in shown} == {(0, 1)}
