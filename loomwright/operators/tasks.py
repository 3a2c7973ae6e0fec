"""Task and outbox decisions over whole backlogs, and latest-n views of tasks and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.functions.windows import numbered

RUNNING, SUCCESS, FAILED, PENDING, RETRYING = range(5)
WAITING = ("NEW", "RETRYING")
OPEN = ("NEW", "RETRYING", "SENDING")
STALE = "5 minutes"
TASK_RETRIES, SEND_RETRIES = 3, 5
ERROR_LENGTH = 1000


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _before(as_of: str, gap: str = STALE) -> Column:
    return _at(as_of) - F.expr(f"INTERVAL {gap}")


def claimable_tasks(tasks: DataFrame, as_of: str) -> DataFrame:
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= _at(as_of))
    return tasks.where(F.col("status").isin(PENDING, RETRYING) & due)


def stale_tasks(tasks: DataFrame, as_of: str, n: int | None = 50) -> DataFrame:
    """Running or retrying tasks without a heartbeat for five minutes, the ``n`` oldest (all if None)."""
    stale = tasks.where(F.col("status").isin(RUNNING, RETRYING) & (F.col("heartbeat_at") < _before(as_of)) & (F.col("is_deleted") == 0))
    return stale if n is None else stale.orderBy("heartbeat_at", "id").limit(n)


def outbox_backlog(events: DataFrame) -> DataFrame:
    """Per aggregate the events that wait and those still open; a row without aggregate has the totals."""
    waiting, still = F.col("status").isin(*WAITING), F.col("status").isin(*OPEN)
    return events.where(still).groupingSets([["aggregate_id"], []], "aggregate_id").agg(
        F.count_if(waiting).alias("waiting"), F.count(F.lit(1)).alias("open_events")
    )


def recover_tasks(tasks: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Every stale task with its action: FAIL after three tries, SKIP while an event of it is open, else
    RETRY with one more try, due at once, and the payload of a new event."""
    still = events.where(F.col("status").isin(*OPEN)).select(F.col("aggregate_id").cast("bigint").alias("id")).distinct().withColumn("open", F.lit(True))
    joined = stale_tasks(tasks, as_of, None).join(still, "id", "left")
    action = F.when(F.col("retry_count") >= TASK_RETRIES, "FAIL").when(F.col("open"), "SKIP").otherwise("RETRY")
    rows = joined.withColumn("action", action)
    retry = F.col("action") == "RETRY"
    payload = F.to_json(F.struct(F.col("id").alias("taskId"), F.concat(F.lit("r"), F.col("id"), F.lit("-"), F.col("retry_count") + 1).alias("eventId"), F.lit(as_of).alias("createdAt")))
    return rows.select(
        "id",
        "action",
        F.when(F.col("action") == "FAIL", FAILED).when(retry, RETRYING).otherwise(F.col("status")).alias("status"),
        F.when(retry, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(retry, _at(as_of)).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        F.when(retry, payload).alias("payload"),
    )


def claim_outbox(events: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    """The ``n`` oldest waiting events that are due, now SENDING; those without a due time are not."""
    due = events.where(F.col("status").isin(*WAITING) & (F.col("next_retry_at") <= _at(as_of)))
    return due.orderBy("create_time", "event_id").limit(n).withColumn("status", F.lit("SENDING"))


def backoff_seconds(retries: Column) -> Column:
    return F.least(10 * F.pow(F.lit(2.0), F.least(retries, F.lit(6))), F.lit(600.0)).cast("bigint")


def outbox_transition(claimed: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Claimed events with the outcome of sending (event_id, ok, error)."""
    rows = claimed.join(results, "event_id")
    spent = F.col("retry_count") >= SEND_RETRIES
    again = ~F.col("ok") & ~spent
    later = F.timestamp_seconds(F.unix_timestamp(_at(as_of)) + backoff_seconds(F.col("retry_count")))
    return rows.select(
        "event_id",
        F.when(F.col("ok"), "PUBLISHED").when(spent, "FAILED").otherwise("RETRYING").alias("status"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(again, later).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        F.when(~F.col("ok"), F.substring("error", 1, ERROR_LENGTH)).alias("error"),
    )


def recover_sending(events: DataFrame, as_of: str) -> DataFrame:
    """All events; those SENDING and untouched for five minutes are RETRYING again, with no publisher."""
    stuck = (F.col("status") == "SENDING") & (F.col("update_time") < _before(as_of))
    return events.withColumns(
        {"status": F.when(stuck, "RETRYING").otherwise(F.col("status")), "publisher_id": F.when(~stuck, F.col("publisher_id"))}
    )


def latest(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows per key in ``order``, with their place."""
    return rows.withColumn("place", numbered(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def latest_tasks_per_draft(tasks: DataFrame, n: int) -> DataFrame:
    return latest(tasks.where("is_deleted = 0"), ["draft_id"], [F.desc("create_time"), F.desc("id")], n)


def latest_event_per_task(events: DataFrame) -> DataFrame:
    """Per aggregate its newest event, and whether that one is to be published at once."""
    newest = latest(events, ["aggregate_id"], [F.desc("create_time"), F.desc("event_id")], 1)
    return newest.select(F.col("aggregate_id").cast("bigint").alias("task_id"), "event_id", "status", (F.col("status") == "NEW").alias("publish"))


def context_lines(messages: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per key its newest ``n`` messages, oldest first, as "[role]: content" lines."""
    newest = latest(messages, keys, [F.desc("create_time"), F.desc("id")], n)
    rows = F.sort_array(F.collect_list(F.struct("create_time", "id", "role", "content")))
    text = F.array_join(F.transform("rows", lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["content"])), "\n")
    return newest.groupBy(*keys).agg(rows.alias("rows")).select(*keys, text.alias("context"))


def last_messages(messages: DataFrame, n: int = 15) -> DataFrame:
    return context_lines(messages, ["session_id"], n)


def history_by_user_agent(messages: DataFrame, n: int = 20) -> DataFrame:
    return context_lines(messages, ["user_id", "agent_id"], n)


def oldest_by_user_agent(messages: DataFrame, n: int) -> DataFrame:
    return latest(messages, ["user_id", "agent_id"], ["create_time", "id"], n)


def history_by_session(messages: DataFrame, n: int = 50) -> DataFrame:
    return latest(messages, ["session_id"], ["create_time", "id"], n)
