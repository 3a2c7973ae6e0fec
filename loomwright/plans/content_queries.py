"""Queries over articles and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import content as C
from loomwright.operators import social as S
from loomwright.plans.registry import query
from loomwright.sources.adapters import AS_OF

SEARCH = "a.is_deleted = 0 AND (lower(title) LIKE '%urgent%' OR regexp_matches(title, '(?i)urgent'))"


@query("article_search", "article users", f"""
    SELECT a.id, a.author_id, u.username AS author_name, a.title, a.status, a.publish_time
    FROM article a LEFT JOIN users u ON u.id = a.author_id WHERE {SEARCH}""")
def _search(article, users):
    return C.article_search(article, users, keyword=" Urgent ")


query("article_count", "article", f"SELECT count(*) AS n FROM article a WHERE {SEARCH}")(
    lambda article: C.article_count(article, keyword="urgent")
)


@query("draft_list", "draft", """
    SELECT user_id, id, title, place, total FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY update_time DESC, id DESC) AS place,
               count(*) OVER (PARTITION BY user_id) AS total
        FROM draft WHERE is_deleted = 0 AND status <> 1) WHERE place BETWEEN 3 AND 4""")
def _drafts(draft):
    return C.draft_list(draft, 2, 2)


@query("publish_gate", "draft", """
    SELECT id, CASE WHEN status = 1 THEN 'already published' WHEN status <> 0 THEN 'not editing'
                    WHEN trim(title) = '' THEN 'blank title' WHEN trim(content_md) = '' THEN 'blank body' END AS reason FROM draft""")
def _gate(draft):
    return C.publish_gate(draft).select("id", "reason")


@query("publish_articles", "draft article", f"""
    WITH ok AS (SELECT d.*, x.id AS article_id FROM draft d LEFT JOIN (
                    SELECT draft_id, max(id) AS id FROM article GROUP BY draft_id) x ON x.draft_id = d.id
                WHERE d.status = 0 AND trim(d.title) <> '' AND trim(d.content_md) <> '')
    SELECT coalesce(article_id, (SELECT max(id) FROM article)
                    + row_number() OVER (PARTITION BY article_id IS NULL ORDER BY id)) AS id,
           id AS draft_id, user_id AS author_id, title, content_md, summary, 1 AS status, TIMESTAMP '{AS_OF}' AS publish_time,
           CAST(length(trim(content_md)) AS INT) AS word_count, 'a,b,c' AS tags, article_id IS NOT NULL AS is_update FROM ok""")
def _publish(draft, article):
    return C.publish_articles(draft, article, AS_OF, F.lit("a， b、c"))


@query("revert_to_draft", "article draft", """
    SELECT a.id, a.draft_id, 0 AS status, 0 AS draft_status, d.status AS old_draft_status
    FROM article a JOIN draft d ON d.id = a.draft_id WHERE a.status = 1 AND a.is_deleted = 0 AND d.status IN (0, 1)""")
def _revert(article, draft):
    return C.revert_to_draft(article, draft)


@query("decode_status", "article draft ai_task", """
    SELECT kind, code, count(*) AS n, CASE WHEN kind = 'article' THEN CASE code WHEN 0 THEN 'OFFLINE' ELSE 'PUBLISHED' END
        WHEN kind = 'draft' THEN CASE code WHEN 0 THEN 'EDITING' WHEN 1 THEN 'PUBLISHED' WHEN 2 THEN 'DISCARDED' END
        ELSE CASE code WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'PENDING' WHEN 4 THEN 'RETRYING' END END AS name
    FROM (SELECT 'article' AS kind, CAST(id % 4 AS INT) AS code FROM article UNION ALL SELECT 'draft', status FROM draft
          UNION ALL SELECT 'task', CAST(id % 7 AS INT) FROM ai_task) GROUP BY kind, code""")
def _decode(article, draft, task):
    rows = article.select(F.lit("article").alias("kind"), (F.col("id") % 4).cast("int").alias("code"))
    rows = rows.unionAll(draft.select(F.lit("draft"), "status")).unionAll(task.select(F.lit("task"), (F.col("id") % 7).cast("int")))
    return C.decode_status(rows).groupBy("kind", "code", "name").agg(F.count(F.lit(1)).alias("n"))


PAGE = "SELECT id, title, publish_time FROM article WHERE is_deleted = 0"
query("article_page", "article", f"{PAGE} ORDER BY publish_time DESC, id DESC LIMIT 20 OFFSET 40")(
    lambda article: C.article_page(article, 3, 20).select("id", "title", "publish_time")
)
query("article_page_after", "article", f"""
    {PAGE} AND (publish_time < DATE '1997-06-01' OR publish_time = DATE '1997-06-01' AND id < 700) ORDER BY publish_time DESC, id DESC LIMIT 20""")(
    lambda article: C.article_page_after(article, "1997-06-01", 700, 20).select("id", "title", "publish_time")
)
query("article_page_cursor", "article", f"{PAGE} AND id < 1200 ORDER BY id DESC LIMIT 20")(
    lambda article: C.article_page_cursor(article, 1200, 20).select("id", "title", "publish_time")
)


@query("article_detail", "article users article_meta article_like article_favorite article_comment", """
    SELECT a.id, a.author_id, a.title, a.status, a.publish_time, u.username AS author_name, u.avatar_url, m.word_count,
           coalesce(m.view_count, 0) AS view_count, m.tags, coalesce(l.n, 0) AS likes, coalesce(f.n, 0) AS favorites, coalesce(c.n, 0) AS comments
    FROM article a LEFT JOIN users u ON u.id = a.author_id LEFT JOIN article_meta m ON m.article_id = a.id
    LEFT JOIN (SELECT article_id, count(*) AS n FROM article_like GROUP BY 1) l ON l.article_id = a.id
    LEFT JOIN (SELECT article_id, count(*) AS n FROM article_favorite GROUP BY 1) f ON f.article_id = a.id
    LEFT JOIN (SELECT article_id, count(*) AS n FROM article_comment WHERE is_deleted = 0 AND parent_id IS NULL GROUP BY 1) c ON c.article_id = a.id
    WHERE a.is_deleted = 0""")
def _detail(*tables):
    return C.article_detail(*tables)


query("user_library", "article_like article", """
    SELECT e.user_id, e.article_id, a.title, a.author_id, e.create_time FROM article_like e JOIN article a ON a.id = e.article_id
    WHERE a.is_deleted = 0""")(C.user_library)


@query("edge_exists", "article_like article_favorite", """
    SELECT f.article_id, f.user_id, EXISTS (SELECT 1 FROM article_like l WHERE l.article_id = f.article_id AND l.user_id = f.user_id) AS present
    FROM article_favorite f""")
def _edge(likes, favorites):
    return S.edge_exists(favorites.select("article_id", "user_id"), likes, ["article_id", "user_id"])
