"""Queries over tasks, the outbox, messages and task output, with batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import tasks as T
from loomwright.plans.registry import query
from loomwright.sources.adapters import AS_OF
from loomwright.sources.tables import parse_task_messages
from loomwright.streaming import greedy as G
from loomwright.streaming import jobs as J

NOW = f"TIMESTAMP '{AS_OF}'"
DUE = f"status IN (3, 4) AND (next_retry_at IS NULL OR next_retry_at <= {NOW})"
STALE = f"status IN (0, 4) AND heartbeat_at < {NOW} - INTERVAL 5 MINUTE AND is_deleted = 0"

query("claimable_tasks", "ai_task", f"SELECT id, status, next_retry_at FROM ai_task WHERE {DUE}")(lambda t: T.claimable_tasks(t, AS_OF).select("id", "status", "next_retry_at"))
query("stale_tasks", "ai_task", f"SELECT id, heartbeat_at FROM ai_task WHERE {STALE} ORDER BY heartbeat_at, id LIMIT 50")(
    lambda t: T.stale_tasks(t, AS_OF).select("id", "heartbeat_at")
)
query("outbox_backlog", "outbox_event", """
    SELECT aggregate_id, count(*) FILTER (status <> 'SENDING') AS waiting, count(*) AS open_events FROM outbox_event
    WHERE status IN ('NEW', 'RETRYING', 'SENDING') GROUP BY GROUPING SETS ((aggregate_id), ())""")(T.outbox_backlog)
query("recover_tasks", "ai_task outbox_event", f"""
    WITH s AS (SELECT t.*, CASE WHEN retry_count >= 3 THEN 'FAIL' WHEN EXISTS (SELECT 1 FROM outbox_event e WHERE CAST(e.aggregate_id AS BIGINT) = t.id
                    AND e.status IN ('NEW', 'RETRYING', 'SENDING')) THEN 'SKIP' ELSE 'RETRY' END AS action FROM ai_task t WHERE {STALE})
    SELECT id, action, CASE action WHEN 'FAIL' THEN 2 WHEN 'RETRY' THEN 4 ELSE status END AS status,
           CAST(CASE action WHEN 'RETRY' THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count,
           CASE action WHEN 'RETRY' THEN {NOW} ELSE next_retry_at END AS next_retry_at,
           CASE action WHEN 'RETRY' THEN '{{"taskId":' || id || ',"eventId":"r' || id || '-' || (retry_count + 1) || '","createdAt":"{AS_OF}"}}' END AS payload
    FROM s""")(lambda t, e: T.recover_tasks(t, e, AS_OF))
query("claim_outbox", "outbox_event", f"""
    SELECT event_id, 'SENDING' AS status FROM outbox_event WHERE status IN ('NEW', 'RETRYING') AND next_retry_at <= {NOW} ORDER BY create_time, event_id LIMIT 100""")(
    lambda e: T.claim_outbox(e, AS_OF).select("event_id", "status")
)


@query("outbox_transition", "outbox_event", f"""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'PUBLISHED' WHEN retry_count >= 5 THEN 'FAILED' ELSE 'RETRYING' END AS status,
           CAST(CASE WHEN event_id % 3 > 0 AND retry_count < 5 THEN retry_count + 1 ELSE retry_count END AS INT) AS retry_count,
           CASE WHEN event_id % 3 > 0 AND retry_count < 5 THEN {NOW} + INTERVAL 1 SECOND * CAST(least(10 * pow(2, least(retry_count, 6)), 600) AS BIGINT) ELSE next_retry_at END AS next_retry_at,
           CASE WHEN event_id % 3 > 0 THEN repeat('e', 1000) END AS error
    FROM outbox_event WHERE status = 'SENDING'""")
def _transition(events):
    claimed = events.where("status = 'SENDING'")
    results = claimed.select("event_id", (F.col("event_id") % 3 == 0).alias("ok"), F.repeat(F.lit("e"), 1200).alias("error"))
    return T.outbox_transition(claimed, results, AS_OF)


query("recover_sending", "outbox_event", f"""
    SELECT event_id, CASE WHEN stuck THEN 'RETRYING' ELSE status END AS status, CASE WHEN stuck THEN NULL ELSE publisher_id END AS publisher_id
    FROM (SELECT *, status = 'SENDING' AND update_time < {NOW} - INTERVAL 5 MINUTE AS stuck FROM outbox_event)""")(
    lambda e: T.recover_sending(e, AS_OF).select("event_id", "status", "publisher_id")
)


def _first(table: str, keys: str, order: str, n: int, where: str = "TRUE") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS place FROM {table} WHERE {where}) WHERE place <= {n}"


query("latest_tasks_per_draft", "ai_task", f"SELECT draft_id, id, create_time, place FROM ({_first('ai_task', 'draft_id', 'create_time DESC, id DESC', 3, 'is_deleted = 0')})")(
    lambda t: T.latest_tasks_per_draft(t, 3).select("draft_id", "id", "create_time", "place")
)
query("latest_event_per_task", "outbox_event", f"""
    SELECT CAST(aggregate_id AS BIGINT) AS task_id, event_id, status, status = 'NEW' AS publish
    FROM ({_first('outbox_event', 'aggregate_id', 'create_time DESC, event_id DESC', 1)})""")(T.latest_event_per_task)


def _context(keys: str, n: int) -> str:
    newest = _first("chat_message", keys, "create_time DESC, id DESC", n)
    return f"SELECT {keys}, string_agg('[' || role || ']: ' || content, chr(10) ORDER BY create_time, id) AS context FROM ({newest}) GROUP BY {keys}"


query("last_messages", "chat_message", _context("session_id", 3))(lambda m: T.last_messages(m, 3))
query("history_by_user_agent", "chat_message", _context("user_id, agent_id", 20))(T.history_by_user_agent)
query("oldest_by_user_agent", "chat_message", f"SELECT user_id, agent_id, id, place FROM ({_first('chat_message', 'user_id, agent_id', 'create_time, id', 4)})")(
    lambda m: T.oldest_by_user_agent(m, 4).select("user_id", "agent_id", "id", "place")
)
query("history_by_session", "chat_message", f"SELECT session_id, id, content, place FROM ({_first('chat_message', 'session_id', 'create_time, id', 50)})")(
    lambda m: T.history_by_session(m).select("session_id", "id", "content", "place")
)


def _walk(state: str, start: str, step: str, key: str = "user_id") -> str:
    """A recursive walk over each key's events in order; ``s`` is the state so far, ``e`` the event."""
    return f"""
    WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM interaction),
    walk AS (SELECT event_id, {key}, n, {start} FROM ev e WHERE n = 1
             UNION ALL SELECT e.event_id, e.{key}, e.n, {step} FROM walk s JOIN ev e ON e.{key} = s.{key} AND e.n = s.n + 1)
    SELECT event_id, {key}, admitted FROM walk"""


def _nested(sql: str) -> str:
    from loomwright.sources.adapters import sql as view_sql

    return sql.replace("FROM interaction", f"FROM ({view_sql('interaction')})")


def _greedy(name: str, kernel, key: str, text: str | None = None, **walk: str) -> None:
    @query(name, "interaction")
    def run(events):
        return G.admit(events, [key], kernel, text=text).select("event_id", key, "admitted")

    from loomwright.plans.registry import ORACLES

    if walk:
        ORACLES[name] = _nested(_walk("", walk["start"], walk["step"], key))


SAME = "(epoch(e.ts) - epoch(s.at) < 36000 AND e.verb = s.words)"
_greedy(
    "comment_dedup", G.same_comment(36000), "user_id", "verb",
    start="TRUE AS admitted, ts AS at, verb AS words",
    step=f"NOT {SAME}, CASE WHEN {SAME} THEN s.at ELSE e.ts END, CASE WHEN {SAME} THEN s.words ELSE e.verb END",
)
RECENT = "list_filter(s.times, lambda t: epoch(e.ts) - epoch(t) < 86400)"
_greedy(
    "rate_limit", G.at_most(2, 86400), "user_id",
    start="TRUE AS admitted, [ts] AS times",
    step=f"len({RECENT}) < 2, CASE WHEN len({RECENT}) < 2 THEN list_append({RECENT}, e.ts) ELSE {RECENT} END",
)
_greedy(
    "heartbeat_throttle", G.spaced(43200), "article_id",
    start="FALSE AS admitted, ts AS at",
    step="epoch(e.ts) - epoch(s.at) >= 43200, CASE WHEN epoch(e.ts) - epoch(s.at) >= 43200 THEN e.ts ELSE s.at END",
)


@query("idempotent_consume", "ai_task", f"""
    SELECT id AS task_id, 'e' || id AS event_id, {NOW} AS created_at FROM ai_task WHERE {DUE}""")
def _consume(tasks):
    message = F.to_json(F.struct(F.col("id").alias("taskId"), F.concat(F.lit("e"), "id").alias("eventId"), F.lit(AS_OF).alias("createdAt")))
    raw = tasks.select(message.alias("value"))
    broken = tasks.orderBy("id").limit(5).select(F.lit("not json").alias("value"))
    return J.idempotent_consume(parse_task_messages(raw.unionAll(raw).unionAll(broken)), T.claimable_tasks(tasks, AS_OF))


PHASE = "CASE author WHEN 'analyst' THEN 'analyzing' WHEN 'generator' THEN 'generating' WHEN 'reviewer' THEN 'reviewing' ELSE 'thinking' END"
#: A task's chunks up to and with the one that ends it, and its runs of text of one phase.
UP_TO_END = """c AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN type IN ('done', 'error') THEN 1 ELSE 0 END) OVER (
        PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM task_chunk) WHERE ended = 0)"""
RUNS = f"""{UP_TO_END},
    p AS (SELECT *, {PHASE} AS phase FROM c WHERE type = 'text' AND trim(content) <> ''),
    l AS (SELECT *, lag(phase) OVER (PARTITION BY task_id ORDER BY seq) AS before FROM p),
    r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM phase THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq) AS number FROM l)"""
query("task_phases", "task_chunk", f"WITH {RUNS} SELECT task_id, seq, phase FROM r WHERE before IS DISTINCT FROM phase")(J.task_phases)
query("phase_texts", "task_chunk", f"""WITH {RUNS}
    SELECT task_id, CAST(number AS BIGINT) AS number, min(phase) AS phase, min(seq) AS first_seq, string_agg(content, '' ORDER BY seq) AS text FROM r GROUP BY task_id, number""")(J.phase_texts)
query("assemble_task_stream", "task_chunk", f"""WITH {UP_TO_END}
    SELECT task_id, coalesce(arg_max(content, seq) FILTER (type = 'result' AND trim(content) <> ''),
                             string_agg(content, '' ORDER BY seq) FILTER (type = 'text' AND author <> 'analyst' AND trim(content) <> ''), '') AS text,
           CASE WHEN count(*) FILTER (type = 'error') > 0 THEN 'error' WHEN count(*) FILTER (type = 'done') > 0 THEN 'done' ELSE 'open' END AS state
    FROM c GROUP BY task_id""")(J.assemble_task_stream)
query("reassemble_lines", "task_chunk", f"""WITH {UP_TO_END}
    SELECT task_id, author, CAST(pos - 1 AS INT) AS pos, line, CAST(NULL AS VARCHAR) AS type FROM (
        SELECT task_id, author, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (
            SELECT task_id, author, string_agg(content, '' ORDER BY seq) AS text FROM c GROUP BY 1, 2)) WHERE trim(line) <> ''""")(J.reassemble_lines)
#: Every third task is asked from the start, by a last id that is no id; the ids go from -5 to -12.
query("resume_stream", "task_chunk", """
    WITH a AS (SELECT *, CAST(string_split(stream_id, '-')[2] AS BIGINT) AS n FROM task_chunk),
    f AS (SELECT * FROM a WHERE task_id % 3 = 0 OR n > 7),
    p AS (SELECT *, row_number() OVER w AS place, coalesce(sum(CASE WHEN type IN ('done', 'error') THEN 1 ELSE 0 END) OVER (
              PARTITION BY task_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM f WINDOW w AS (PARTITION BY task_id ORDER BY n))
    SELECT task_id, stream_id, type, place FROM p WHERE ended = 0 AND place <= 6""")(
    lambda c: J.resume_stream(
        c, c.select("task_id", F.when(F.col("task_id") % 3 == 0, F.lit("from the start")).otherwise("1700000000000-7").alias("last_id")).distinct(), 6
    ).select("task_id", "stream_id", "type", "place")
)
query("stale_sessions", "interaction", """
    SELECT article_id AS task_id, max(ts) AS last_beat, count(*) AS beats FROM (
        SELECT *, sum(new) OVER (PARTITION BY article_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY article_id ORDER BY ts) < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS new FROM interaction))
    GROUP BY article_id, run""")(lambda e: J.stale_sessions(e.select(F.col("article_id").alias("task_id"), "ts"), "5 hours"))
query("stream_leaderboard", "interaction", """
    SELECT CAST(ts AS DATE) AS day, article_id, CAST(sum(CASE verb WHEN 'VIEW' THEN 1 ELSE 3 END) AS BIGINT) AS heat
    FROM interaction WHERE verb IN ('VIEW', 'LIKE') GROUP BY 1, 2""")(J.stream_leaderboard)
query("top_of_day", "interaction", """
    SELECT day, article_id, heat, place FROM (
        SELECT *, row_number() OVER (PARTITION BY day ORDER BY heat DESC, article_id DESC) AS place FROM (
            SELECT CAST(ts AS DATE) AS day, article_id, CAST(sum(CASE verb WHEN 'VIEW' THEN 1 ELSE 3 END) AS BIGINT) AS heat
            FROM interaction WHERE verb IN ('VIEW', 'LIKE') GROUP BY 1, 2)) WHERE place <= 10""")(lambda e: J.top_of_day(J.stream_leaderboard(e), 10))
query("split_stream_id", "interaction", "SELECT event_id, epoch_us(ts) // 1000 AS ms, event_id AS n FROM interaction")(
    lambda e: e.select("event_id", J.split_stream_id(F.concat_ws("-", F.unix_millis(F.col("ts").cast("timestamp")), "event_id")).alias("s")).select("event_id", "s.*")
)
query("stream_reaction_counts", "interaction", """
    SELECT article_id, count(*) FILTER (kind = 'like') AS like_count, count(*) FILTER (kind = 'favorite') AS favorite_count FROM (
        SELECT article_id, user_id, kind, arg_max(verb, (ts, event_id)) AS verb FROM (
            SELECT *, CASE WHEN verb IN ('LIKE', 'UNLIKE') THEN 'like' WHEN verb = 'FAVORITE' THEN 'favorite' END AS kind FROM interaction)
        WHERE kind IS NOT NULL GROUP BY 1, 2, 3) WHERE verb IN ('LIKE', 'FAVORITE') GROUP BY article_id""")(lambda e: J.reaction_counts(e.unionAll(e.orderBy("event_id").limit(50))))
