"""Reading and writing of the platform's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.windows import numbered

#: Fixed schemas of the tables, as DDL.
SCHEMAS = {
    "user": "id bigint, username string, nickname string, avatar_url string, is_deleted int, create_time timestamp, update_time timestamp",
    "draft": "id bigint, user_id bigint, title string, content_md string, summary string, cover_url string, status int, create_time timestamp, update_time timestamp, is_deleted int",
    "article": "id bigint, draft_id bigint, author_id bigint, title string, content_md string, summary string, cover_url string, status int, publish_time timestamp, is_deleted int",
    "article_meta": "article_id bigint, word_count int, view_count int, like_count int, favorite_count int, tags string",
    "article_like": "article_id bigint, user_id bigint, create_time timestamp",
    "article_favorite": "article_id bigint, user_id bigint, create_time timestamp",
    "article_comment": "id bigint, article_id bigint, user_id bigint, parent_id bigint, content string, like_count int, is_deleted int, create_time timestamp",
    "comment_like": "comment_id bigint, user_id bigint, create_time timestamp",
    "user_follow": "follower_id bigint, followee_id bigint, create_time timestamp",
    "notification": "id bigint, user_id bigint, type string, sender_id bigint, ref_id bigint, content string, is_read int, create_time timestamp",
    "article_view_daily": "article_id bigint, date date, view_count int, like_count int, favorite_count int",
    "article_view_snapshot": "article_id bigint, snapshot_date date, view_count bigint",
    "memory_record": "id bigint, user_id bigint, type string, content string, content_hash string, importance double, access_count int, last_accessed_at timestamp, create_time timestamp, is_deleted int, vector_status string, retry_count int, embedding array<float>",
    "memory_history": "memory_id bigint, session_id string, old_content string, new_content string, event string, role string",
    "chat_message": "id bigint, user_id bigint, session_id string, agent_id string, role string, content string, create_time timestamp",
    "ai_task": "id bigint, user_id bigint, draft_id bigint, task_type string, status int, started_at timestamp, heartbeat_at timestamp, retry_count int, next_retry_at timestamp, worker_id string, create_time timestamp, is_deleted int",
    "outbox_event": "event_id bigint, event_type string, aggregate_id string, topic string, payload string, status string, retry_count int, next_retry_at timestamp, create_time timestamp, update_time timestamp, publisher_id string",
}
TASK_MESSAGE = "taskId bigint, eventId string, createdAt string"


def read_tables(spark: SparkSession, folder: str | None = None, jdbc: dict | None = None, names: list[str] | None = None, ranges: int = 16) -> dict[str, DataFrame]:
    """The tables by name, from a folder of Parquet or a database. A database is read in ``ranges``
    parallel slices of the id; ``jdbc`` has url and what the driver needs, and bounds as lower and upper."""
    found = {}
    for name in names or SCHEMAS:
        if folder is not None:
            found[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}")
        else:
            options = {k: v for k, v in (jdbc or {}).items() if k not in ("lower", "upper")}
            reader = spark.read.format("jdbc").options(dbtable=name, **options)
            first = T.StructType.fromDDL(SCHEMAS[name]).fields[0].name
            if jdbc and "upper" in jdbc:
                reader = reader.options(partitionColumn=first, lowerBound=str(jdbc.get("lower", 0)), upperBound=str(jdbc["upper"]), numPartitions=str(ranges))
            found[name] = reader.load()
    return found


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="query string")


def parse_task_messages(raw: DataFrame) -> DataFrame:
    """(task_id, event_id, created_at) from a column ``value`` of JSON messages; others are dropped."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), TASK_MESSAGE).alias("m")).where("m.taskId IS NOT NULL")
    return parsed.select(F.col("m.taskId").alias("task_id"), F.col("m.eventId").alias("event_id"), F.to_timestamp("m.createdAt").alias("created_at"))


def task_message_stream(spark: SparkSession, folder: str | None = None, kafka: dict | None = None) -> DataFrame:
    """The stream of task messages: a topic, or files with one message a line."""
    if kafka is not None:
        return parse_task_messages(spark.readStream.format("kafka").options(**kafka).load())
    return parse_task_messages(spark.readStream.schema("value string").text(folder))


def upsert_daily_stats(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``current`` with those of ``updates`` put in or over, by (article_id, date)."""
    both = current.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    place = numbered(W.partitionBy("article_id", "date").orderBy(F.desc("__new")))
    return both.withColumn("__n", place).where("__n = 1").drop("__n", "__new")


def write_daily_stats(rows: DataFrame, path: str) -> None:
    """Overwrites only the dates that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def snapshot_views(meta: DataFrame, day: str) -> DataFrame:
    return meta.select("article_id", F.to_date(F.lit(day)).alias("snapshot_date"), F.col("view_count").cast("bigint").alias("view_count"))


def append_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("snapshot_date").parquet(path)


def read_snapshot(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of the snapshots; only that day's folder is read."""
    return spark.read.schema(SCHEMAS["article_view_snapshot"]).parquet(path).where(F.col("snapshot_date") == F.to_date(F.lit(day)))
