"""Logical tables of the content platform, as views of the given star-schema tables.

Each view is one portable SELECT that Spark and DuckDB both run: braces hold the names of given
tables or of other views. Operators never read tables themselves; queries hand them these views.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from loomwright.session import table

AS_OF = "1998-08-02 00:00:00"

VIEWS: dict[str, str] = {
    "article": """
        SELECT o_orderkey AS id, o_orderkey + 1000000 + o_orderkey % 2 * 50000000 AS draft_id, o_custkey AS author_id,
               o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR(20)) AS title,
               o_orderpriority || ' body ' || o_orderstatus AS content_md,
               'about ' || o_orderpriority AS summary,
               CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS status,
               o_orderdate AS publish_time, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS is_deleted
        FROM {orders}""",
    "users": """
        SELECT c_custkey AS id, c_name AS username, 'nick ' || c_name AS nickname,
               c_mktsegment || '.png' AS avatar_url, CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS is_deleted
        FROM {customer}""",
    "article_meta": """
        SELECT o_orderkey AS article_id, CAST(o_orderkey % 900 AS INT) AS word_count,
               CAST(coalesce(n, 0) AS INT) AS view_count, 0 AS like_count, 0 AS favorite_count,
               o_orderpriority || ', ' || o_orderstatus AS tags
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) c
        ON l_orderkey = o_orderkey""",
    "draft": """
        SELECT o_orderkey + 1000000 AS id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 31 = 0 THEN '  ' ELSE o_orderpriority || ' draft' END AS title,
               CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE '  text of ' || CAST(o_orderkey AS VARCHAR(20)) || ' ' END AS content_md,
               'about ' || o_orderpriority AS summary, CAST(NULL AS VARCHAR(20)) AS cover_url,
               CAST(o_orderkey % 3 AS INT) AS status, o_orderdate AS update_time,
               CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS is_deleted
        FROM {orders}""",
    "article_like": """
        SELECT l_orderkey AS article_id, l_suppkey AS user_id, min(l_shipdate) AS create_time
        FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_suppkey""",
    "article_favorite": """
        SELECT l_orderkey AS article_id, l_suppkey AS user_id, min(l_shipdate) AS create_time
        FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_suppkey""",
    "article_comment": """
        SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey AS article_id, l.l_suppkey AS user_id,
               CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber > f.first_line
                    THEN l.l_orderkey * 10 + f.first_line END AS parent_id,
               'said ' || CAST(l.l_partkey % 7 AS VARCHAR(20)) AS content,
               CASE WHEN l.l_partkey % 11 = 0 THEN 1 ELSE 0 END AS is_deleted, l.l_shipdate AS create_time
        FROM {lineitem} l JOIN (SELECT l_orderkey, min(l_linenumber) AS first_line FROM {lineitem}
                                WHERE l_returnflag = 'N' GROUP BY l_orderkey) f ON l.l_orderkey = f.l_orderkey
        WHERE l.l_returnflag = 'N'""",
    "comment_like": """
        SELECT DISTINCT l_orderkey * 10 + l_linenumber AS comment_id, l_partkey % 100 + 1 AS user_id
        FROM {lineitem} WHERE l_returnflag = 'N' AND l_partkey % 3 = 0""",
    "user_follow": """
        SELECT c_custkey AS follower_id, c_custkey * 7 % 150 + 1 AS followee_id FROM {customer}
        UNION
        SELECT c_custkey AS follower_id, c_custkey * 3 % 40 + 1 AS followee_id FROM {customer}""",
    "notification": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS user_id, 'NEW_COMMENT' AS type,
               l_partkey AS sender_id, l_orderkey AS ref_id, CAST(l_linenumber % 2 AS INT) AS is_read, l_shipdate AS create_time
        FROM {lineitem}""",
    "interaction": """
        SELECT event_id, user_id, CAST(json_k AS BIGINT) AS article_id,
               CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'LIKE' WHEN 'error' THEN 'UNLIKE'
                    WHEN 'purchase' THEN 'FAVORITE' ELSE 'COMMENT' END AS verb, ts
        FROM (SELECT event_id, user_id, event_type, ts,
                     regexp_replace(regexp_replace(props, '^.*"k": *', ''), '[^0-9].*$', '') AS json_k FROM {events}) e""",
    "article_view_snapshot": """
        SELECT article_id, CAST(ts AS DATE) AS snapshot_date, count(*) AS view_count
        FROM {interaction} WHERE verb = 'VIEW' GROUP BY article_id, CAST(ts AS DATE)""",
    "memory_record": """
        SELECT vec_id AS id, CAST(label AS BIGINT) AS user_id,
               CASE vec_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'knowledge' ELSE 'event' END AS type,
               text AS content, md5(text) AS content_hash,
               CAST(vec_id % 10 AS DOUBLE) / 10 AS importance, CAST(vec_id % 13 AS INT) AS access_count,
               CASE WHEN vec_id % 3 > 0 THEN CAST('1998-08-02 00:00:00' AS TIMESTAMP) - INTERVAL 1 HOUR * (vec_id * 5 % 2000) END AS last_accessed_at,
               CAST('1998-01-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 HOUR * (vec_id * 7 % 5000) AS create_time,
               CASE WHEN vec_id % 19 = 0 THEN 1 ELSE 0 END AS is_deleted,
               CASE vec_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SYNCED' ELSE 'FAILED' END AS vector_status,
               CAST(vec_id % 5 AS INT) AS retry_count, embedding
        FROM {embeddings} JOIN {documents} ON vec_id = doc_id""",
    "memory_query": """
        SELECT vec_id AS query_id, CAST(label AS BIGINT) AS user_id, text, embedding,
               CASE WHEN vec_id % 20 = 0 THEN 5 ELSE 8 END AS k
        FROM {embeddings} JOIN {documents} ON vec_id = doc_id WHERE vec_id % 10 = 0""",
    "memory_candidate": """
        SELECT vec_id + 900000 AS candidate_id, CAST(label AS BIGINT) AS user_id,
               CASE WHEN vec_id % 5 = 0 THEN text ELSE text || ' more' END AS content,
               'fact' AS type, 1 AS session_id, CASE WHEN vec_id % 38 > 0 THEN embedding END AS embedding
        FROM {embeddings} JOIN {documents} ON vec_id = doc_id
        UNION ALL
        SELECT vec_id + 1900000 AS candidate_id, CAST(label AS BIGINT) AS user_id,
               CASE WHEN vec_id % 5 < 2 THEN text || ' more' ELSE text || ' again' END AS content,
               'fact' AS type, 0 AS session_id, embedding
        FROM {embeddings} JOIN {documents} ON vec_id = doc_id""",
    "chat_message": """
        SELECT conv_id * 100 + turn AS id, conv_id % 50 AS user_id, conv_id AS session_id, conv_id % 5 AS agent_id,
               role, text AS content,
               CAST('1998-08-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 MINUTE * (conv_id % 1000 + turn) AS create_time
        FROM {conversations}""",
    "ai_task": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey AS draft_id,
               CASE o_orderkey % 8 WHEN 0 THEN 'POLISH_TEXT' WHEN 1 THEN 'GENERATE_OUTLINE' WHEN 2 THEN 'SUMMARIZE' WHEN 3 THEN 'GENERATE_TITLE'
                    WHEN 4 THEN 'GENERATE_TAGS' WHEN 5 THEN 'QUALITY_CHECK' WHEN 6 THEN 'GENERATE_BODY' ELSE 'OTHER' END AS task_type,
               CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS status, o_orderdate AS started_at,
               CAST('1998-08-02 00:00:00' AS TIMESTAMP) - INTERVAL 1 SECOND * (o_orderkey % 600) AS heartbeat_at,
               CAST(o_orderkey % 7 AS INT) AS retry_count,
               CASE WHEN o_orderkey % 4 > 0 THEN CAST('1998-08-02 00:00:00' AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 5 - 2) END AS next_retry_at,
               o_orderdate AS create_time, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_deleted
        FROM {orders}""",
    "outbox_event": """
        SELECT o_orderkey AS event_id, 'TASK_CREATED' AS event_type, CAST(o_orderkey * 3 % 20000 AS VARCHAR(20)) AS aggregate_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'RETRYING' WHEN 2 THEN 'SENDING' WHEN 3 THEN 'PUBLISHED' ELSE 'FAILED' END AS status,
               CAST(o_orderkey % 7 AS INT) AS retry_count,
               CASE WHEN o_orderkey % 6 > 0 THEN CAST('1998-08-02 00:00:00' AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 9 - 4) END AS next_retry_at,
               o_orderdate AS create_time,
               CAST('1998-08-02 00:00:00' AS TIMESTAMP) - INTERVAL 1 SECOND * (o_orderkey % 900) AS update_time,
               CASE WHEN o_orderkey % 5 = 2 THEN 'p1' END AS publisher_id
        FROM {orders}""",
    "task_chunk": """
        SELECT conv_id AS task_id, turn AS seq, '1700000000000-' || CAST(turn + 5 AS VARCHAR(20)) AS stream_id,
               CASE WHEN turn < 2 THEN 'analyst' WHEN turn < 4 THEN 'generator' WHEN turn = 4 THEN 'reviewer' ELSE 'other' END AS author,
               CASE WHEN turn = 6 AND conv_id % 4 = 1 THEN 'result' WHEN turn = 6 AND conv_id % 4 = 2 THEN 'done'
                    WHEN turn = 5 AND conv_id % 4 = 3 THEN 'error' WHEN conv_id % 9 = 0 AND turn > 2 THEN 'tool' ELSE 'text' END AS type,
               CASE WHEN turn % 5 = 4 THEN '  ' ELSE text END AS content,
               CAST('1998-08-01 00:00:00' AS TIMESTAMP) + INTERVAL 1 MINUTE * (conv_id % 100) + INTERVAL 1 SECOND * turn AS ts
        FROM {conversations}""",
}

_NAME = re.compile(r"\{(\w+)\}")


@lru_cache(maxsize=None)
def sql(name: str) -> str:
    """The view's SELECT with all views inside it written out; given tables keep their names."""
    return _NAME.sub(lambda m: f"({sql(m[1])})" if m[1] in VIEWS else m[1], VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    wanted = set(_NAME.findall(VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in wanted})


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL: ``query`` over the named views."""
    views = "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names)
    own = query.strip()
    return f"{views}, {own[5:]}" if own.startswith("WITH ") else f"{views}\n{own}"
