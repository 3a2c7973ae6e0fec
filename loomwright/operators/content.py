"""Articles and drafts: search, pages, publishing, wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.functions.text import join_tags, java_trim, word_count
from loomwright.functions.windows import numbered, ranked

#: Codes of the status columns; fixed values.
DRAFT_STATUS = {0: "EDITING", 1: "PUBLISHED", 2: "DISCARDED"}
ARTICLE_STATUS = {0: "OFFLINE", 1: "PUBLISHED"}
TASK_STATUS = {0: "RUNNING", 1: "SUCCESS", 2: "FAILED", 3: "PENDING", 4: "RETRYING"}


def decode(code: Column, names: dict[int, str], default: str | None = None) -> Column:
    """Name of a status code, ``default`` for an unknown one."""
    out = F.lit(default).cast("string")
    for key, name in names.items():
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def decode_status(rows: DataFrame) -> DataFrame:
    """(kind article / draft / task, code) with a name: an unknown article is PUBLISHED, an unknown task null."""
    kinds = {"article": (ARTICLE_STATUS, "PUBLISHED"), "draft": (DRAFT_STATUS, None), "task": (TASK_STATUS, None)}
    name = F.lit(None).cast("string")
    for kind, (names, default) in kinds.items():
        name = F.when(F.col("kind") == kind, decode(F.col("code"), names, default)).otherwise(name)
    return rows.withColumn("name", name)


def article_filter(article: DataFrame, author_id: int | None = None, keyword: str | None = None) -> DataFrame:
    """Articles not deleted, of one author if given, whose title holds the keyword (LIKE or
    regular expression, whatever the case). A blank keyword filters nothing; offline articles count."""
    found = article.where("is_deleted = 0")
    if author_id is not None:
        found = found.where(F.col("author_id") == author_id)
    word = (keyword or "").strip()
    if word:
        found = found.where(F.lower("title").like(f"%{word.lower()}%") | F.col("title").rlike(f"(?i){word}"))
    return found


def article_search(article: DataFrame, users: DataFrame, author_id: int | None = None, keyword: str | None = None) -> DataFrame:
    names = users.select(F.col("id").alias("author_id"), F.col("username").alias("author_name"))
    return article_filter(article, author_id, keyword).join(names, "author_id", "left").select(
        "id", "author_id", "author_name", "title", "status", "publish_time"
    )


def article_count(article: DataFrame, author_id: int | None = None, keyword: str | None = None) -> DataFrame:
    return article_filter(article, author_id, keyword).agg(F.count(F.lit(1)).alias("n"))


def article_page(article: DataFrame, page: int, size: int) -> DataFrame:
    """Newest first, page ``page`` (from 1) of ``size``; ties by the larger id."""
    order = [F.desc("publish_time"), F.desc("id")]
    return article.where("is_deleted = 0").orderBy(*order).offset((page - 1) * size).limit(size)


def article_page_after(article: DataFrame, publish_time: str | None, last_id: int | None, size: int) -> DataFrame:
    """The page of ``article_page`` after the article with this time and id, the first one without: each task
    keeps ``size`` rows, however deep the page is, and new articles don't move it."""
    found = article.where("is_deleted = 0")
    if publish_time is not None:
        at = F.lit(publish_time).cast(article.schema["publish_time"].dataType)
        found = found.where((F.col("publish_time") < at) | ((F.col("publish_time") == at) & (F.col("id") < last_id)))
    return found.orderBy(F.desc("publish_time"), F.desc("id")).limit(size)


def article_page_cursor(article: DataFrame, cursor: int | None, size: int) -> DataFrame:
    """The next ``size`` articles below ``cursor`` by falling id."""
    found = article.where("is_deleted = 0")
    return (found if cursor is None else found.where(F.col("id") < cursor)).orderBy(F.desc("id")).limit(size)


def draft_list(draft: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """Per user a page of drafts not deleted and not published, newest first, with the user's total."""
    mine = W.partitionBy("user_id")
    place = numbered(mine.orderBy(F.desc("update_time"), F.desc("id")))
    rows = draft.where("is_deleted = 0 AND status <> 1").withColumns({"place": place, "total": F.count(F.lit(1)).over(mine)})
    return rows.where(F.col("place").between((page - 1) * size + 1, page * size)).select("user_id", "id", "title", "place", "total")


def publish_gate(draft: DataFrame) -> DataFrame:
    """Every draft with the first reason against publishing it, null if there is none."""
    blank = lambda c: F.length(java_trim(F.coalesce(F.col(c), F.lit("")))) == 0
    reason = (
        F.when(F.col("status") == 1, "already published")
        .when(F.col("status") != 0, "not editing")
        .when(blank("title"), "blank title")
        .when(blank("content_md"), "blank body")
    )
    return draft.withColumn("reason", reason)


def publish_articles(draft: DataFrame, article: DataFrame, as_of: str, tags: Column | None = None) -> DataFrame:
    """Article rows of the accepted drafts. A draft that has an article updates it and keeps its id;
    others get ids above the largest. word_count is the trimmed body's length."""
    tags = F.lit(None).cast("string") if tags is None else tags
    accepted = publish_gate(draft).where("reason IS NULL").drop("reason").withColumn("tags", join_tags(tags))
    existing = article.groupBy("draft_id").agg(F.max("id").alias("article_id"))
    top = article.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    joined = accepted.join(existing, accepted.id == existing.draft_id, "left").drop("draft_id")
    old = joined.where("article_id IS NOT NULL").withColumn("is_update", F.lit(True))
    fresh = joined.where("article_id IS NULL")
    # A running number over all new rows: ranges are counted first, so no task sees all of them.
    numbered = ranked(fresh, [], [F.asc("id")], "number").join(F.broadcast(top)).withColumn("article_id", F.col("top") + F.col("number"))
    new = numbered.drop("top", "number").withColumn("is_update", F.lit(False))
    return old.unionByName(new).select(
        F.col("article_id").alias("id"),
        F.col("id").alias("draft_id"),
        F.col("user_id").alias("author_id"),
        "title",
        "content_md",
        "summary",
        F.lit(1).alias("status"),
        F.lit(as_of).cast("timestamp").alias("publish_time"),
        word_count(F.col("content_md")).alias("word_count"),
        "tags",
        "is_update",
    )


def revert_to_draft(article: DataFrame, draft: DataFrame) -> DataFrame:
    """Published articles whose draft is published or in editing: new status of both."""
    drafts = draft.where("status IN (0, 1)").select(F.col("id").alias("draft_id"), F.col("status").alias("old_draft_status"))
    return article.where("status = 1 AND is_deleted = 0").join(drafts, "draft_id").select(
        "id", "draft_id", F.lit(0).alias("status"), F.lit(0).alias("draft_status"), "old_draft_status"
    )


def article_detail(article: DataFrame, users: DataFrame, meta: DataFrame, likes: DataFrame, favorites: DataFrame, comments: DataFrame) -> DataFrame:
    """Wide article rows. Counts are aggregated before the joins; deleted authors keep their names."""
    count = lambda df, name: df.groupBy("article_id").agg(F.count(F.lit(1)).alias(name))
    wide = article.where("is_deleted = 0").select("id", "author_id", "title", "status", "publish_time")
    wide = wide.join(users.select(F.col("id").alias("author_id"), F.col("username").alias("author_name"), "avatar_url"), "author_id", "left")
    wide = wide.join(meta.select(F.col("article_id").alias("id"), "word_count", "view_count", "tags"), "id", "left")
    for df, name in ((likes, "likes"), (favorites, "favorites"), (comments.where("is_deleted = 0 AND parent_id IS NULL"), "comments")):
        wide = wide.join(count(df, name).withColumnRenamed("article_id", "id"), "id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("view_count", "likes", "favorites", "comments")}
    return wide.withColumns(zero)


def user_library(edges: DataFrame, article: DataFrame) -> DataFrame:
    """Per user the liked or favorited articles that still exist, and when."""
    there = article.where("is_deleted = 0").select(F.col("id").alias("article_id"), "title", "author_id")
    return edges.join(there, "article_id").select("user_id", "article_id", "title", "author_id", "create_time")
