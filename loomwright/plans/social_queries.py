"""Queries over edges, counters, heat, comments and notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import social as S
from loomwright.plans.registry import query
from loomwright.sources import tables as T

EDGES = "SELECT user_id, article_id FROM article_like UNION SELECT user_id, article_id FROM article_favorite"
HEAT = """SELECT CAST(ts AS DATE) AS day, article_id, CAST(sum(CASE verb WHEN 'VIEW' THEN 1 WHEN 'LIKE' THEN 3 END) AS BIGINT) AS heat
    FROM interaction WHERE verb IN ('VIEW', 'LIKE') GROUP BY 1, 2"""
COUNTS = """SELECT article_id, CAST(sum(l) AS BIGINT) AS likes, CAST(sum(f) AS BIGINT) AS favorites
    FROM (SELECT article_id, 1 AS l, 0 AS f FROM article_like UNION ALL SELECT article_id, 0, 1 FROM article_favorite) GROUP BY article_id"""
LAST = """SELECT article_id, user_id, kind, arg_max(verb, (ts, event_id)) AS verb FROM (
        SELECT *, CASE WHEN verb IN ('LIKE', 'UNLIKE') THEN 'like' WHEN verb IN ('FAVORITE', 'UNFAVORITE') THEN 'favorite' END AS kind FROM interaction)
    WHERE kind IS NOT NULL GROUP BY article_id, user_id, kind"""
TAGS = "SELECT article_id, view_count, unnest(list_distinct(list_transform(string_split(tags, ','), lambda x: lower(trim(x))))) AS tag FROM article_meta"
TOP_TAGS = f"""SELECT user_id, tag, uses, place FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, tag) AS place FROM (
            SELECT user_id, tag, count(*) AS uses FROM ({EDGES}) e JOIN ({TAGS}) t USING (article_id) GROUP BY 1, 2)) WHERE place <= 5"""
DAY = "2024-01-10"

query("leaderboard", "interaction article", f"""
    SELECT day, place, article_id, heat, title, summary FROM (
        SELECT *, row_number() OVER (PARTITION BY day ORDER BY heat DESC, article_id DESC) AS place FROM ({HEAT})) h
    JOIN article a ON a.id = h.article_id WHERE place <= 10 AND is_deleted = 0""")(S.leaderboard)


@query("follow_lists", "user_follow", """
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(following, '') AS following, coalesce(followers, '') AS followers
    FROM (SELECT follower_id AS user_id, string_agg(DISTINCT followee_id, ',' ORDER BY followee_id) AS following FROM user_follow GROUP BY 1) a
    FULL JOIN (SELECT followee_id AS user_id, string_agg(DISTINCT follower_id, ',' ORDER BY follower_id) AS followers FROM user_follow GROUP BY 1) b
    ON a.user_id = b.user_id""")
def _lists(follows):
    both = S.follow_lists(follows)
    return both.select("user_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("following", "followers")])


BOTH_ENDS = """SELECT follower_id AS user_id, 'following' AS side, followee_id AS other_id FROM user_follow
    UNION SELECT followee_id, 'followers', follower_id FROM user_follow"""
query("follow_pages", "user_follow", f"""
    SELECT user_id, side, (place - 1) // 5 + 1 AS page, string_agg(other_id, ',' ORDER BY other_id) AS ids, max(other_id) AS cursor
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY other_id) AS place FROM ({BOTH_ENDS})) GROUP BY 1, 2, 3""")(
    lambda follows: S.follow_pages(follows, 5).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
)


@query("follow_page_after", "user_follow", f"""
    SELECT user_id, side, cursor, other_id, place FROM (
        SELECT e.*, e.user_id % 50 AS cursor, row_number() OVER (PARTITION BY user_id, side ORDER BY other_id) AS place
        FROM ({BOTH_ENDS}) e WHERE other_id > user_id % 50) WHERE place <= 5""")
def _after(follows):
    asked = S.follow_edges(follows).select("user_id", "side", (F.col("user_id") % 50).alias("cursor")).distinct()
    return S.follow_page_after(follows, asked, 5)


query("follow_counts", "user_follow", """
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(followers, 0) AS followers, coalesce(following, 0) AS following
    FROM (SELECT followee_id AS user_id, count(*) AS followers FROM user_follow GROUP BY 1) a
    FULL JOIN (SELECT follower_id AS user_id, count(*) AS following FROM user_follow GROUP BY 1) b ON a.user_id = b.user_id""")(S.follow_counts)


@query("exclude_seen", "interaction article_like article_favorite", f"""
    SELECT DISTINCT user_id, article_id FROM interaction EXCEPT ({EDGES})""")
def _unseen(events, likes, favorites):
    return S.exclude_seen(events.select("user_id", "article_id").distinct(), S.interacted(likes, favorites))


query("interacted", "article_like article_favorite", EDGES)(S.interacted)
query("edge_counts", "article_like article_favorite", COUNTS)(S.edge_counts)
query("comment_like_counts", "comment_like", "SELECT comment_id, count(*) AS likes FROM comment_like GROUP BY comment_id")(
    lambda likes: likes.groupBy("comment_id").agg(F.count(F.lit(1)).alias("likes"))
)
query("backfill_meta_counts", "article_meta article_like article_favorite", f"""
    SELECT m.article_id, m.word_count, m.view_count, m.tags, coalesce(c.likes, 0) AS like_count, coalesce(c.favorites, 0) AS favorite_count
    FROM article_meta m LEFT JOIN ({COUNTS}) c ON c.article_id = m.article_id""")(S.backfill_meta_counts)
query("apply_reactions", "interaction", f"""
    SELECT article_id, count(*) FILTER (kind = 'like') AS like_count, count(*) FILTER (kind = 'favorite') AS favorite_count
    FROM ({LAST}) WHERE verb IN ('LIKE', 'FAVORITE') GROUP BY article_id""")(S.apply_reactions)


@query("apply_views", "article_meta interaction", """
    SELECT m.article_id, CAST(m.view_count + coalesce(n, 0) AS BIGINT) AS view_count FROM article_meta m
    LEFT JOIN (SELECT article_id, count(*) AS n FROM interaction WHERE verb = 'VIEW' GROUP BY 1) v ON v.article_id = m.article_id""")
def _views(meta, events):
    return S.apply_views(meta, events).select("article_id", "view_count")


query("comment_counts", "article_comment", """
    SELECT article_id, count(*) AS comments FROM article_comment WHERE parent_id IS NULL AND is_deleted = 0 GROUP BY article_id""")(S.comment_counts)
query("author_overview", "article article_meta article_like article_favorite article_comment", f"""
    SELECT a.author_id, count(*) AS articles, CAST(sum(coalesce(m.view_count, 0)) AS BIGINT) AS views,
           CAST(sum(coalesce(c.likes, 0)) AS BIGINT) AS likes, CAST(sum(coalesce(c.favorites, 0)) AS BIGINT) AS favorites, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS comments
    FROM article a LEFT JOIN article_meta m ON m.article_id = a.id LEFT JOIN ({COUNTS}) c ON c.article_id = a.id
    LEFT JOIN (SELECT article_id, count(*) AS n FROM article_comment WHERE parent_id IS NULL AND is_deleted = 0 GROUP BY 1) k ON k.article_id = a.id
    WHERE a.is_deleted = 0 GROUP BY a.author_id""")(S.author_overview)


@query("author_daily_trend", "article article_like article_favorite article_comment", """
    WITH edges AS (SELECT article_id, CAST(create_time AS DATE) AS day, 'l' AS kind FROM article_like
                   UNION ALL SELECT article_id, CAST(create_time AS DATE), 'f' FROM article_favorite
                   UNION ALL SELECT article_id, CAST(create_time AS DATE), 'c' FROM article_comment),
         counts AS (SELECT author_id, day, count(*) FILTER (kind = 'l') AS likes, count(*) FILTER (kind = 'f') AS favorites,
                           count(*) FILTER (kind = 'c') AS comments
                    FROM edges JOIN article ON id = article_id WHERE is_deleted = 0 GROUP BY 1, 2),
         spine AS (SELECT author_id, CAST(DATE '1998-08-02' - CAST(d AS INT) AS DATE) AS day
                   FROM (SELECT DISTINCT author_id FROM article WHERE is_deleted = 0), range(7) t(d))
    SELECT s.author_id, s.day, coalesce(likes, 0) AS likes, coalesce(favorites, 0) AS favorites, coalesce(comments, 0) AS comments
    FROM spine s LEFT JOIN counts c ON c.author_id = s.author_id AND c.day = s.day""")
def _trend(article, likes, favorites, comments):
    return S.author_daily_trend(article, likes, favorites, comments, "1998-08-02", 7)


query("daily_article_stats", "interaction", """
    SELECT article_id, CAST(ts AS DATE) AS day, count(*) FILTER (verb = 'VIEW') AS views, count(*) FILTER (verb = 'LIKE') AS likes,
           count(*) FILTER (verb = 'FAVORITE') AS favorites FROM interaction GROUP BY 1, 2""")(S.daily_article_stats)


@query("upsert_daily_stats", "interaction", """
    SELECT article_id, CAST(ts AS DATE) AS date, count(*) FILTER (verb = 'VIEW') * (1 + (day(ts) % 2)) AS view_count
    FROM interaction GROUP BY article_id, CAST(ts AS DATE), day(ts)""")
def _upsert(events):
    base = events.groupBy("article_id", F.to_date("ts").alias("date")).agg(F.count_if(F.col("verb") == "VIEW").alias("view_count"))
    twice = base.where(F.dayofmonth("date") % 2 == 1).withColumn("view_count", F.col("view_count") * 2)
    return T.upsert_daily_stats(base, twice)


query("snapshot_views", "article_meta", "SELECT article_id, DATE '1998-08-02' AS snapshot_date, CAST(view_count AS BIGINT) AS view_count FROM article_meta")(
    lambda meta: T.snapshot_views(meta, "1998-08-02")
)
query("notification_unread", "notification", """
    SELECT user_id, count(*) AS total, count(*) FILTER (is_read = 0) AS unread FROM notification GROUP BY user_id""")(S.notification_unread)


@query("notification_page", "notification", """
    SELECT user_id, id, create_time, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC, id DESC) AS place
    FROM notification) WHERE place BETWEEN 6 AND 10""")
def _notes(notifications):
    return S.page_per_user(notifications, 2, 5).select("user_id", "id", "create_time", "place")


@query("mark_read", "notification", """
    SELECT id, user_id, CASE WHEN user_id % 9 = 0 OR id % 4 = 0 THEN 1 ELSE is_read END AS is_read FROM notification""")
def _read(notifications):
    one = notifications.where("id % 4 = 0").select("user_id", "id")
    foreign = notifications.where("id % 4 = 1").select(F.col("user_id") + 1000000, "id")
    every = notifications.where("user_id % 9 = 0").select("user_id", F.lit(None).cast("bigint")).distinct()
    return S.mark_read(notifications, one.unionAll(foreign).unionAll(every)).select("id", "user_id", "is_read")


query("notification_fanout", "article_comment comment_like user_follow article users", """
    SELECT r.user_id, r.type, r.sender_id, r.ref_id, coalesce(u.username, '用户#' || r.sender_id) || r.words AS content FROM (
        SELECT a.author_id AS user_id, 'NEW_COMMENT' AS type, c.user_id AS sender_id, c.article_id AS ref_id,
               ' 评论了你的文章' || CASE WHEN coalesce(a.title, '') = '' THEN '' ELSE '《' || a.title || '》' END AS words
        FROM article_comment c JOIN article a ON a.id = c.article_id
        UNION ALL SELECT c.user_id, 'NEW_COMMENT_LIKE', l.user_id, c.article_id, ' 赞了你的评论' FROM comment_like l JOIN article_comment c ON c.id = l.comment_id
        UNION ALL SELECT followee_id, 'NEW_FOLLOW', follower_id, NULL, ' 关注了你' FROM user_follow) r
    LEFT JOIN users u ON u.id = r.sender_id WHERE r.user_id <> r.sender_id""")(S.notification_fanout)
query("top_tags_per_user", "article_like article_favorite article_meta", TOP_TAGS)(S.top_tags_per_user)


@query("recommend", "article_like article_favorite article_meta article interaction", f"""
    WITH seen AS ({EDGES}), wanted AS (SELECT user_id, tag FROM ({TOP_TAGS})),
         pool AS (SELECT DISTINCT user_id, article_id, view_count FROM wanted JOIN ({TAGS}) USING (tag) WHERE (user_id, article_id) NOT IN (SELECT (user_id, article_id) FROM seen)),
         first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY view_count DESC, article_id DESC) AS place FROM pool) WHERE place <= 10),
         hot AS (SELECT article_id, heat FROM ({HEAT}) WHERE day = DATE '{DAY}' ORDER BY heat DESC, article_id DESC LIMIT 20),
         more AS (SELECT u.user_id, h.article_id, 10 + row_number() OVER (PARTITION BY u.user_id ORDER BY heat DESC, article_id DESC) AS place
                  FROM (SELECT DISTINCT user_id FROM wanted) u, hot h
                  WHERE (u.user_id, h.article_id) NOT IN (SELECT (user_id, article_id) FROM seen)
                    AND (u.user_id, h.article_id) NOT IN (SELECT (user_id, article_id) FROM first)),
         kept AS (SELECT * FROM (SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS place
                  FROM (SELECT user_id, article_id, place FROM first UNION ALL SELECT user_id, article_id, place FROM more)) WHERE place <= 10)
    SELECT k.user_id, k.article_id, k.place, a.publish_time FROM kept k JOIN article a ON a.id = k.article_id WHERE a.is_deleted = 0""")
def _recommend(likes, favorites, meta, article, events):
    return S.recommend(likes, favorites, meta, article, events, DAY, 10)


@query("comment_threads", "article_comment comment_like users", """
    WITH live AS (SELECT * FROM article_comment WHERE is_deleted = 0),
         parents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY create_time DESC, id DESC) AS place FROM live WHERE parent_id IS NULL) WHERE place <= 3),
         answers AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l.article_id ORDER BY l.create_time, l.id) AS place FROM live l JOIN parents p ON p.id = l.parent_id) WHERE place <= 2),
         liked AS (SELECT comment_id, count(*) AS likes, bool_or(user_id = 7) AS liked FROM comment_like GROUP BY 1)
    SELECT p.article_id, p.id, p.place, u.username, coalesce(l.likes, 0) AS likes, coalesce(l.liked, false) AS liked,
           coalesce((SELECT string_agg(a.id, ',' ORDER BY a.place) FROM answers a WHERE a.parent_id = p.id), '') AS replies
    FROM parents p LEFT JOIN liked l ON l.comment_id = p.id LEFT JOIN users u ON u.id = p.user_id""")
def _threads(comments, likes, users):
    nested = S.comment_threads(comments, likes, users, viewer=7, page=1, size=3, replies=2)
    ids = F.array_join(F.transform("replies", lambda r: r["id"].cast("string")), ",")
    return nested.select("article_id", "id", "place", "username", "likes", "liked", ids.alias("replies"))
