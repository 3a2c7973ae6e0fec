"""Edges, counters, heat, trends, recommendations, comments and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.functions.text import split_tags
from loomwright.functions.windows import numbered, ranked
from loomwright.session import Workspace, parts_for

#: What an interaction adds to an article's heat of the day; an unlike takes nothing away.
HEAT = {"VIEW": 1, "LIKE": 3}


def _count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _zero(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(0)) for n in names}


def edge_exists(asked: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` pairs with a flag whether the edge is there."""
    marked = edges.select(*keys).distinct().withColumn("__there", F.lit(True))
    return asked.join(marked, keys, "left").withColumn("present", F.coalesce("__there", F.lit(False))).drop("__there")


def follow_lists(follows: DataFrame) -> DataFrame:
    """(user_id, following, followers) as sorted arrays; use the edge table itself for hubs."""
    following = follows.groupBy(F.col("follower_id").alias("user_id")).agg(F.sort_array(F.collect_set("followee_id")).alias("following"))
    followers = follows.groupBy(F.col("followee_id").alias("user_id")).agg(F.sort_array(F.collect_set("follower_id")).alias("followers"))
    empty = F.array().cast("array<bigint>")
    return following.join(followers, "user_id", "full").select(
        "user_id", F.coalesce("following", empty).alias("following"), F.coalesce("followers", empty).alias("followers")
    )


def follow_edges(follows: DataFrame) -> DataFrame:
    """(user_id, side, other_id): each edge from both ends, as ``following`` and ``followers``; repeated ones once."""
    out = follows.select(F.col("follower_id").alias("user_id"), F.lit("following").alias("side"), F.col("followee_id").alias("other_id"))
    back = follows.select(F.col("followee_id").alias("user_id"), F.lit("followers").alias("side"), F.col("follower_id").alias("other_id"))
    return out.unionAll(back).distinct()


def follow_pages(follows: DataFrame, size: int = 100) -> DataFrame:
    """(user_id, side, page, ids, cursor): the lists of ``follow_lists`` in pages of at most ``size`` ascending ids.

    ``cursor`` is a page's last id, from which ``follow_page_after`` goes on. Places come by sampled ranges, so
    that neither a hub's list nor one array of it has to fit in a task.
    """
    placed = ranked(follow_edges(follows), ["user_id", "side"], [F.asc("other_id")], "__place")
    page = F.floor((F.col("__place") - 1) / size).cast("bigint") + 1
    paged = placed.groupBy("user_id", "side", page.alias("page")).agg(F.sort_array(F.collect_list("other_id")).alias("ids"))
    return paged.withColumn("cursor", F.element_at("ids", -1))


def follow_page_after(follows: DataFrame, asked: DataFrame, size: int = 100) -> DataFrame:
    """(user_id, side, cursor, other_id, place): the next ``size`` ids above each cursor of ``asked`` (user_id,
    side, cursor; null for the start). Edges that come or go below a cursor move nothing above it."""
    above = asked.select("user_id", "side", "cursor").distinct().join(follow_edges(follows), ["user_id", "side"])
    above = above.where(F.col("cursor").isNull() | (F.col("other_id") > F.col("cursor")))
    place = numbered(W.partitionBy("user_id", "side", "cursor").orderBy("other_id"))
    return above.withColumn("place", place).where(F.col("place") <= size)


def follow_counts(follows: DataFrame) -> DataFrame:
    a = _count(follows, "followee_id", "followers").withColumnRenamed("followee_id", "user_id")
    b = _count(follows, "follower_id", "following").withColumnRenamed("follower_id", "user_id")
    return a.join(b, "user_id", "full").withColumns(_zero("followers", "following"))


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen, ["user_id", "article_id"], "left_anti")


def interacted(likes: DataFrame, favorites: DataFrame) -> DataFrame:
    """Pairs of either table, each once. They are dealt by their own number of partitions: tasks that make the two tables
    don't hold the pairs as well, and a task's pairs don't grow with the input."""
    pair = ["user_id", "article_id"]
    return likes.select(*pair).union(favorites.select(*pair)).repartition(parts_for(likes, favorites), *pair).distinct()


def edge_counts(likes: DataFrame, favorites: DataFrame) -> DataFrame:
    """(article_id, likes, favorites), a row per article with either."""
    rows = likes.select("article_id", F.lit(1).alias("l"), F.lit(0).alias("f")).unionAll(
        favorites.select("article_id", F.lit(0).alias("l"), F.lit(1).alias("f"))
    )
    return rows.groupBy("article_id").agg(F.sum("l").alias("likes"), F.sum("f").alias("favorites"))


def backfill_meta_counts(meta: DataFrame, likes: DataFrame, favorites: DataFrame) -> DataFrame:
    """Every meta row with its like_count and favorite_count made anew, 0 where there are none."""
    joined = meta.drop("like_count", "favorite_count").join(edge_counts(likes, favorites), "article_id", "left")
    return joined.withColumns(_zero("likes", "favorites")).withColumnsRenamed({"likes": "like_count", "favorites": "favorite_count"})


def current_reactions(events: DataFrame) -> DataFrame:
    """(article_id, user_id, kind) that hold after all events: the last like or unlike of a pair
    decides, favorites likewise. Repeats and undoing what isn't there change nothing."""
    kind = F.when(F.col("verb").isin("LIKE", "UNLIKE"), "like").when(F.col("verb").isin("FAVORITE", "UNFAVORITE"), "favorite")
    last = (
        events.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .groupBy("article_id", "user_id", "kind")
        .agg(F.max_by("verb", F.struct("ts", "event_id")).alias("verb"))
    )
    return last.where(F.col("verb").isin("LIKE", "FAVORITE")).select("article_id", "user_id", "kind")


def apply_reactions(events: DataFrame) -> DataFrame:
    """(article_id, like_count, favorite_count) after all events."""
    return current_reactions(events).groupBy("article_id").agg(
        F.count_if(F.col("kind") == "like").alias("like_count"), F.count_if(F.col("kind") == "favorite").alias("favorite_count")
    )


def apply_views(meta: DataFrame, events: DataFrame) -> DataFrame:
    """Meta rows with the batch's views added; views of unknown articles are dropped."""
    views = _count(events.where("verb = 'VIEW'"), "article_id", "n")
    return meta.join(views, "article_id", "left").withColumn("view_count", F.col("view_count") + F.coalesce("n", F.lit(0))).drop("n")


def comment_counts(comments: DataFrame) -> DataFrame:
    return _count(comments.where("parent_id IS NULL AND is_deleted = 0"), "article_id", "comments")


def author_overview(article: DataFrame, meta: DataFrame, likes: DataFrame, favorites: DataFrame, comments: DataFrame) -> DataFrame:
    """Totals per author over all articles not deleted."""
    per = article.where("is_deleted = 0").select(F.col("id").alias("article_id"), "author_id")
    per = per.join(meta.select("article_id", "view_count"), "article_id", "left").join(edge_counts(likes, favorites), "article_id", "left")
    per = per.join(comment_counts(comments), "article_id", "left")
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(n) for c, n in (("view_count", "views"), ("likes", "likes"), ("favorites", "favorites"), ("comments", "comments"))]
    return per.groupBy("author_id").agg(F.count(F.lit(1)).alias("articles"), *sums)


def author_daily_trend(article: DataFrame, likes: DataFrame, favorites: DataFrame, comments: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per author and day, ``days`` days up to ``as_of``, zero-filled: likes, favorites and comments,
    the last ones with replies and deleted ones. The date filter stands before the join."""
    today = F.to_date(F.lit(as_of))
    first = F.date_sub(today, days - 1)
    rows = [d.select("article_id", F.to_date("create_time").alias("day"), F.lit(k).alias("kind")) for d, k in ((likes, "l"), (favorites, "f"), (comments, "c"))]
    edges = rows[0].unionAll(rows[1]).unionAll(rows[2]).where(F.col("day").between(first, today))
    owner = article.where("is_deleted = 0").select(F.col("id").alias("article_id"), "author_id")
    counts = edges.join(owner, "article_id").groupBy("author_id", "day").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("l", "likes"), ("f", "favorites"), ("c", "comments"))]
    )
    spine = owner.select("author_id").distinct().select("author_id", F.explode(F.sequence(first, today)).alias("day"))
    return spine.join(counts, ["author_id", "day"], "left").withColumns(_zero("likes", "favorites", "comments"))


def daily_article_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("article_id", F.to_date("ts").alias("day")).agg(
        *[F.count_if(F.col("verb") == v).alias(n) for v, n in (("VIEW", "views"), ("LIKE", "likes"), ("FAVORITE", "favorites"))]
    )


def heat(events: DataFrame) -> DataFrame:
    """(day, article_id, heat): weighted sum of the day's interactions."""
    weight = F.lit(0)
    for verb, value in HEAT.items():
        weight = F.when(F.col("verb") == verb, value).otherwise(weight)
    scored = events.withColumn("weight", weight).where("weight > 0")
    return scored.groupBy(F.to_date("ts").alias("day"), "article_id").agg(F.sum("weight").alias("heat"))


def leaderboard(events: DataFrame, article: DataFrame, n: int = 10) -> DataFrame:
    """Per day the ``n`` hottest articles (ties: larger id); those gone are left out after the cut."""
    place = numbered(W.partitionBy("day").orderBy(F.desc("heat"), F.desc("article_id")))
    top = heat(events).withColumn("place", place).where(F.col("place") <= n)
    there = article.where("is_deleted = 0").select(F.col("id").alias("article_id"), "title", "summary")
    return top.join(there, "article_id").select("day", "place", "article_id", "heat", "title", "summary")


def notification_unread(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_read") == 0).alias("unread"))


def page_per_user(rows: DataFrame, page: int, size: int, at: str = "create_time") -> DataFrame:
    """Per user page ``page`` of ``size``, newest first (ties: larger id)."""
    place = numbered(W.partitionBy("user_id").orderBy(F.desc(at), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place").between((page - 1) * size + 1, page * size))


def mark_read(notifications: DataFrame, asked: DataFrame) -> DataFrame:
    """is_read = 1 for asked (user_id, id); a null id asks for all of the user's, foreign ids for nothing."""
    one = asked.where("id IS NOT NULL").select("user_id", "id").distinct().withColumn("__one", F.lit(True))
    every = asked.where("id IS NULL").select("user_id").distinct().withColumn("__all", F.lit(True))
    joined = notifications.join(one, ["user_id", "id"], "left").join(every, "user_id", "left")
    return joined.withColumn("is_read", F.when(F.col("__one") | F.col("__all"), 1).otherwise(F.col("is_read"))).drop("__one", "__all")


def notification_fanout(comments: DataFrame, comment_likes: DataFrame, follows: DataFrame, article: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, type, sender_id, ref_id, content): comments to the article's author, likes of comments
    to their author, follows to the one followed; never to oneself."""
    name = users.select(F.col("id").alias("sender_id"), "username")
    of_article = article.select(F.col("id").alias("article_id"), F.col("author_id").alias("user_id"), "title")
    title = F.when(F.length(F.coalesce("title", F.lit(""))) > 0, F.concat(F.lit("《"), "title", F.lit("》"))).otherwise("")
    rows = (
        comments.select("article_id", F.col("user_id").alias("sender_id"))
        .join(of_article, "article_id")
        .select("user_id", F.lit("NEW_COMMENT").alias("type"), "sender_id", F.col("article_id").alias("ref_id"), F.concat(F.lit(" 评论了你的文章"), title).alias("words"))
    )
    author = comments.select(F.col("id").alias("comment_id"), "user_id", "article_id")
    rows = rows.unionByName(
        comment_likes.select("comment_id", F.col("user_id").alias("sender_id"))
        .join(author, "comment_id")
        .select("user_id", F.lit("NEW_COMMENT_LIKE").alias("type"), "sender_id", F.col("article_id").alias("ref_id"), F.lit(" 赞了你的评论").alias("words"))
    )
    rows = rows.unionByName(
        follows.select(
            F.col("followee_id").alias("user_id"), F.lit("NEW_FOLLOW").alias("type"), F.col("follower_id").alias("sender_id"),
            F.lit(None).cast("bigint").alias("ref_id"), F.lit(" 关注了你").alias("words"),
        )
    )
    sender = F.coalesce("username", F.concat(F.lit("用户#"), F.col("sender_id").cast("string")))
    told = rows.where("user_id <> sender_id").join(name, "sender_id", "left")
    return told.select("user_id", "type", "sender_id", "ref_id", F.concat(sender, "words").alias("content"))


def top_tags_per_user(likes: DataFrame, favorites: DataFrame, meta: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, tag, uses, place): the user's most frequent tags; ties by the tag."""
    return _top_tags(interacted(likes, favorites), meta, n)


def _top_tags(seen: DataFrame, meta: DataFrame, n: int = 5) -> DataFrame:
    tags = meta.select("article_id", F.explode(F.transform(split_tags(F.col("tags")), F.lower)).alias("tag"))
    counts = seen.join(tags, "article_id").groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("uses"))
    place = numbered(W.partitionBy("user_id").orderBy(F.desc("uses"), "tag"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def recommend(likes: DataFrame, favorites: DataFrame, meta: DataFrame, article: DataFrame, events: DataFrame, day: str, n: int = 10) -> DataFrame:
    """(user_id, article_id, publish_time): unseen articles with one of the user's top tags by views,
    filled up from the day's leaderboard.

    A user's best n unseen articles of a tag lie within the tag's first n plus as many as the user has
    seen among these: seen ranks count while fewer than n unseen ones stand before them. A tag's articles are
    ranked by ranges, so a hot tag is many tasks' work. Its list is cut at n plus the most that anybody has seen,
    and stands in blocks of ranks of doubling size: a user meets only the blocks up to its own reach. What users
    have seen is written once, and so is the list, so that Spark knows its size.
    """
    work = Workspace(likes.sparkSession, "recommend")
    seen = work.put(interacted(likes, favorites), "seen")
    own = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("own"))
    most_seen = own.agg(F.coalesce(F.max("own"), F.lit(0)).alias("most_seen"))
    tagged = meta.select("article_id", "view_count", F.explode(F.array_distinct(F.transform(split_tags(F.col("tags")), F.lower))).alias("tag"))
    in_tag = ranked(tagged, ["tag"], [F.desc("view_count"), F.desc("article_id")], "in_tag")
    best = in_tag.join(F.broadcast(most_seen)).where(F.col("in_tag") <= F.col("most_seen") + n)
    best = work.put(best.select("tag", "in_tag", "article_id", "view_count"), "best")
    wanted = work.put(_top_tags(seen, meta).select("user_id", "tag"), "wanted")
    met = seen.join(best.select("article_id", "tag", "in_tag"), "article_id").join(wanted, ["user_id", "tag"])
    before = F.col("in_tag") - numbered(W.partitionBy("user_id", "tag").orderBy("in_tag"))
    passed = met.withColumn("unseen_before", before).where(F.col("unseen_before") < n).groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("passed"))
    block = lambda rank: F.floor(F.log2(rank) + 1e-9).cast("int")
    reach = wanted.join(passed, ["user_id", "tag"], "left").withColumn("upto", F.coalesce("passed", F.lit(0)) + n)
    reach = reach.withColumn("block", F.explode(F.sequence(F.lit(0), block(F.col("upto")))))
    near = reach.join(best.withColumn("block", block(F.col("in_tag"))), ["tag", "block"]).where(F.col("in_tag") <= F.col("upto"))
    pool = exclude_seen(near.select("user_id", "article_id", "view_count").distinct(), seen)
    mine = W.partitionBy("user_id")
    first = pool.withColumn("place", numbered(mine.orderBy(F.desc("view_count"), F.desc("article_id")))).where(F.col("place") <= n)
    hot = heat(events).where(F.col("day") == F.to_date(F.lit(day))).orderBy(F.desc("heat"), F.desc("article_id")).limit(2 * n)
    hot = hot.select("article_id", "heat")
    # The hot list has 2n rows and every user is to be offered each of them.
    offered = wanted.select("user_id").distinct().join(F.broadcast(hot))
    more = exclude_seen(offered, seen).join(first.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
    more = more.withColumn("place", n + numbered(mine.orderBy(F.desc("heat"), F.desc("article_id"))))
    both = first.select("user_id", "article_id", "place").unionByName(more.select("user_id", "article_id", "place"))
    kept = both.withColumn("rank", numbered(mine.orderBy("place"))).where(F.col("rank") <= n)
    there = article.where("is_deleted = 0").select(F.col("id").alias("article_id"), "publish_time")
    return kept.join(there, "article_id").select("user_id", "article_id", F.col("rank").alias("place"), "publish_time")


def comment_threads(comments: DataFrame, comment_likes: DataFrame, users: DataFrame, viewer: int, page: int = 1, size: int = 10, replies: int = 10) -> DataFrame:
    """Per article a page of top-level comments (newest first) with their replies, oldest first.
    The page as a whole has at most ``replies`` replies. Authors, likes and the viewer's own likes
    are joined after both cuts."""
    live = comments.where("is_deleted = 0")
    # Comments that share time and id, which the given tables have, stand in the order of their authors and texts.
    newest = numbered(W.partitionBy("article_id").orderBy(F.desc("create_time"), F.desc("id"), "user_id", "content"))
    parents = live.where("parent_id IS NULL").withColumn("place", newest).where(F.col("place").between((page - 1) * size + 1, page * size))
    answers = live.where("parent_id IS NOT NULL").join(parents.select(F.col("id").alias("parent_id"), F.col("place").alias("parent_place")), "parent_id")
    oldest = numbered(W.partitionBy("article_id").orderBy("create_time", "id", "parent_place", "user_id", "content"))
    answers = answers.withColumn("place", oldest).where(F.col("place") <= replies)
    shown = parents.select("id", "article_id", "user_id", "content", "place", F.lit(None).cast("bigint").alias("parent_id"))
    shown = shown.unionByName(answers.select("id", "article_id", "user_id", "content", "place", "parent_id"))
    liked = comment_likes.groupBy(F.col("comment_id").alias("id")).agg(F.count(F.lit(1)).alias("likes"), F.max(F.col("user_id") == viewer).alias("liked"))
    shown = shown.join(liked, "id", "left").join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
    shown = shown.withColumns({"likes": F.coalesce("likes", F.lit(0)), "liked": F.coalesce("liked", F.lit(False))})
    fields = ["place", "id", "user_id", "username", "content", "likes", "liked"]
    nested = shown.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("replies"))
    top = shown.where("parent_id IS NULL").drop("parent_id")
    joined = top.join(nested, top.id == nested.parent_id, "left").drop("parent_id")
    return joined.withColumn("replies", F.coalesce("replies", F.array().cast(nested.schema["replies"].dataType)))
