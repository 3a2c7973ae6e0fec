"""Streaming jobs and their batch twins. Late data: each job has a watermark, and later events are dropped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.functions.windows import numbered
from loomwright.operators.social import HEAT, current_reactions

#: Phase by author; others are thinking. Fixed values.
PHASES = {"analyst": "analyzing", "generator": "generating", "reviewer": "reviewing"}
MOST_RESUMED = 500


def stream_leaderboard(events: DataFrame) -> DataFrame:
    """(day, article_id, heat) of a stream of interactions, by day; days stay open for two days."""
    weight = F.lit(0)
    for verb, value in HEAT.items():
        weight = F.when(F.col("verb") == verb, value).otherwise(weight)
    hot = events.withColumn("weight", weight).where("weight > 0").withWatermark("ts", "2 days")
    return hot.groupBy(F.window("ts", "1 day").alias("w"), "article_id").agg(F.sum("weight").alias("heat")).select(
        F.to_date("w.start").alias("day"), "article_id", "heat"
    )


def top_of_day(totals: DataFrame, n: int) -> DataFrame:
    place = numbered(W.partitionBy("day").orderBy(F.desc("heat"), F.desc("article_id")))
    return totals.withColumn("place", place).where(F.col("place") <= n)


def merge_reactions(path: str, compact_every: int = 50):
    """A ``foreachBatch`` function that keeps the last reaction per (article, user, kind) under ``path``.

    Each batch adds a folder with its own last reactions, whatever the batch's number, so a new
    checkpoint goes on with the state it finds and a batch delivered twice changes nothing: readers
    (``read_reactions``) take the last of all folders. After ``compact_every`` folders the next batch
    writes the whole state as one folder and deletes the others. One writer per path.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in store.listStatus(root)] if store.exists(root) else []
        versions = {int(p.getName()[1:]): p for p in found if p.getName()[0] == "v" and p.getName()[1:].isdigit()}
        events = batch.select("event_id", "user_id", "article_id", "verb", "ts")
        old = list(versions.values()) if len(versions) >= compact_every else []
        if old:
            events = events.unionByName(spark.read.schema(events.schema).parquet(*[p.toString() for p in old]))
        last_reactions(events).write.parquet(f"{path}/v{max(versions, default=-1) + 1}")
        for p in old:
            store.delete(p, True)

    return merge


def last_reactions(events: DataFrame) -> DataFrame:
    """The event that decides each (article, user, kind)."""
    kind = F.when(F.col("verb").isin("LIKE", "UNLIKE"), "like").when(F.col("verb").isin("FAVORITE", "UNFAVORITE"), "favorite")
    last = (
        events.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("article_id", "user_id", "kind")
        .agg(F.max_by(F.struct("event_id", "verb", "ts"), F.struct("ts", "event_id")).alias("e"))
    )
    return last.select("e.event_id", "user_id", "article_id", "e.verb", "e.ts")


def read_reactions(spark: SparkSession, path: str) -> DataFrame:
    """The state that ``merge_reactions`` keeps under ``path``."""
    schema = "event_id bigint, user_id bigint, article_id bigint, verb string, ts timestamp"
    return last_reactions(spark.read.schema(schema).parquet(f"{path}/v*"))


def reaction_counts(last: DataFrame) -> DataFrame:
    return current_reactions(last).groupBy("article_id").agg(
        F.count_if(F.col("kind") == "like").alias("like_count"), F.count_if(F.col("kind") == "favorite").alias("favorite_count")
    )


def idempotent_consume(messages: DataFrame, tasks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Messages (task_id, event_id, created_at) once each, of tasks that may be claimed."""
    keys = ["task_id", "event_id"]
    if messages.isStreaming:
        once = messages.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(keys)
    else:
        once = messages.groupBy(*keys).agg(F.min("created_at").alias("created_at"))
    return once.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi" if not messages.isStreaming else "inner")


def phase_of(author: Column) -> Column:
    out = F.lit("thinking")
    for name, phase in PHASES.items():
        out = F.when(author == name, phase).otherwise(out)
    return out


ENDS = ("done", "error")


def before_end(chunks: DataFrame) -> DataFrame:
    """A task's chunks up to and with the first that ends it (done or error)."""
    earlier = W.partitionBy("task_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.when(F.col("type").isin(*ENDS), 1).otherwise(0)).over(earlier), F.lit(0))
    return chunks.withColumn("__ended", ended).where("__ended = 0").drop("__ended")


def _said() -> Column:
    return F.length(F.trim(F.coalesce("content", F.lit("")))) > 0


def task_phases(chunks: DataFrame) -> DataFrame:
    """(task_id, seq, phase) where a task's phase changes; tool calls and blanks don't count."""
    return phase_texts(chunks).select("task_id", F.col("first_seq").alias("seq"), "phase")


def phase_texts(chunks: DataFrame) -> DataFrame:
    """(task_id, number, phase, first_seq, text): runs of text chunks of one phase, up to the task's end.
    Each begins with a change of phase, which is when a status is sent."""
    live = before_end(chunks).where((F.col("type") == "text") & _said()).withColumn("phase", phase_of(F.col("author")))
    order = W.partitionBy("task_id").orderBy("seq")
    change = F.when(F.col("phase").eqNullSafe(F.lag("phase").over(order)), 0).otherwise(1)
    runs = live.withColumn("change", change).withColumn("number", F.sum("change").over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda p: p["content"]), "")
    return runs.groupBy("task_id", "number").agg(F.min("phase").alias("phase"), F.min("seq").alias("first_seq"), text.alias("text"))


def assemble_task_stream(chunks: DataFrame) -> DataFrame:
    """(task_id, text, state): the chunks of a task in order up to its end, without blanks, tool calls and
    the analyst's; a final result (type ``result``) replaces them. State done, error or open."""
    part = F.when(_said() & (F.col("type") == "text") & (F.col("author") != "analyst"), F.struct("seq", "content"))
    final = F.when(_said() & (F.col("type") == "result"), F.struct("seq", "content"))
    rows = before_end(chunks).groupBy("task_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.max(final)["content"].alias("final"),
        F.max(F.when(F.col("type") == "error", 2).when(F.col("type") == "done", 1).otherwise(0)).alias("end"),
    )
    text = F.coalesce("final", F.array_join(F.transform("parts", lambda p: p["content"]), ""))
    return rows.select("task_id", text.alias("text"), F.element_at(F.array(F.lit("open"), F.lit("done"), F.lit("error")), F.col("end") + 1).alias("state"))


def _by_task(chunks: DataFrame, out: str, begin: Callable, take: Callable, flush: Callable, idle_ms: int, lateness: str) -> DataFrame:
    """Rows of ``out`` of a stream of chunks with event time ``ts``, by a state for each task.

    ``take(state, chunk)`` and, when the task ends, ``flush(state, end)`` give rows without their task_id;
    end is done, error, or open once the watermark is ``idle_ms`` past the last chunk. What comes
    after the end is left out as long as the task is remembered, for ``idle_ms``.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ended = (json.loads(state.get[0]), state.get[1]) if state.exists else (begin(), False)
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows += [] if ended else flush(held, "open")
            state.remove()
        else:
            batch = pd.concat(list(parts)).sort_values("seq")
            for chunk in batch.itertuples():
                if ended:
                    break
                rows += take(held, chunk)
                if chunk.type in ENDS:
                    rows += flush(held, chunk.type)
                    held, ended = begin(), True
            state.update((json.dumps(held), ended))
            state.setTimeoutTimestamp(max(int(batch["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    return chunks.withWatermark("ts", lateness).groupBy("task_id").applyInPandasWithState(run, out, "held string, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def _spoken(chunk) -> bool:
    return bool(chunk.content and chunk.content.strip(" "))


def assemble_stream(chunks: DataFrame, idle_ms: int = 1_800_000, lateness: str = "10 minutes") -> DataFrame:
    """``assemble_task_stream`` on a stream: a row when a task ends, or with state open when it falls silent."""

    def take(held: dict, chunk) -> list:
        if chunk.type == "text" and _spoken(chunk) and chunk.author is not None and chunk.author != "analyst":
            held["text"] += chunk.content
        elif chunk.type == "result" and _spoken(chunk):
            held["final"] = chunk.content
        return []

    def flush(held: dict, end: str) -> list:
        return [(held["text"] if held["final"] is None else held["final"], end)]

    return _by_task(chunks, "task_id bigint, text string, state string", lambda: {"text": "", "final": None}, take, flush, idle_ms, lateness)


def phase_texts_stream(chunks: DataFrame, idle_ms: int = 1_800_000, lateness: str = "10 minutes") -> DataFrame:
    """``phase_texts`` on a stream: a row when the next phase begins, the last one at the task's end or silence."""

    def flush(held: dict, end: str) -> list:
        return [(held["number"], held["phase"], held["first"], held["text"])] if held["number"] else []

    def take(held: dict, chunk) -> list:
        if chunk.type != "text" or not _spoken(chunk):
            return []
        phase = PHASES.get(chunk.author, "thinking")
        if held["number"] and phase == held["phase"]:
            held["text"] += chunk.content
            return []
        done = flush(held, "")
        held |= {"number": held["number"] + 1, "phase": phase, "first": int(chunk.seq), "text": chunk.content}
        return done

    begin = lambda: {"number": 0, "phase": None, "first": 0, "text": ""}
    return _by_task(chunks, "task_id bigint, number bigint, phase string, first_seq bigint, text string", begin, take, flush, idle_ms, lateness)


def _lines(rows: DataFrame) -> DataFrame:
    """Lines that are not blank, with the type of those that are JSON objects."""
    return rows.where(F.length(F.trim("line")) > 0).withColumn("type", F.get_json_object("line", "$.type"))


def reassemble_lines(chunks: DataFrame) -> DataFrame:
    """(task_id, author, pos, line, type): complete lines of each task's author up to the task's end; blank
    lines are dropped, and lines that are JSON objects have their type. ``content`` may be binary, and
    cut within characters then."""
    binary = dict(chunks.dtypes)["content"] == "binary"
    part = F.hex("content") if binary else F.col("content")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", part.alias("part")))), lambda p: p["part"]), "")
    whole = before_end(chunks).where("content IS NOT NULL").groupBy("task_id", "author").agg((F.decode(F.unhex(text), "UTF-8") if binary else text).alias("text"))
    return _lines(whole.select("task_id", "author", F.posexplode(F.split("text", "\n")).alias("pos", "line")))


def reassemble_lines_stream(chunks: DataFrame, idle_ms: int = 1_800_000, lateness: str = "10 minutes") -> DataFrame:
    """``reassemble_lines`` on a stream: a line comes with the batch that completes it; the open tail of each
    author stays in the task's state (as bytes) until the task ends or falls silent."""

    def take(held: list, chunk) -> list:
        if chunk.content is None:
            return []
        own = next((x for x in held if x[0] == chunk.author), None)
        if own is None:
            own = [chunk.author, 0, ""]
            held.append(own)
        data = chunk.content if isinstance(chunk.content, (bytes, bytearray)) else chunk.content.encode()
        *lines, tail = (own[2].encode("latin-1") + bytes(data)).split(b"\n")
        rows = [(own[0], own[1] + i, x.decode("utf-8", "replace")) for i, x in enumerate(lines)]
        own[1:] = [own[1] + len(lines), tail.decode("latin-1")]
        return rows

    def flush(held: list, end: str) -> list:
        return [(author, pos, tail.encode("latin-1").decode("utf-8", "replace")) for author, pos, tail in held]

    return _lines(_by_task(chunks, "task_id bigint, author string, pos int, line string", list, take, flush, idle_ms, lateness))


def resume_stream(chunks: DataFrame, cursors: DataFrame, n: int = MOST_RESUMED) -> DataFrame:
    """Events (stream_id "ms-n") of the asked tasks (task_id, last_id) after the last one seen, ``n`` at most and
    none beyond the first that ends the task. Ids are compared as two numbers; a last_id that isn't
    two numbers, null included, asks from the start."""
    seen = F.when(F.col("last_id").rlike(r"^[0-9]+-[0-9]+$"), split_stream_id(F.col("last_id")))
    at = split_stream_id(F.col("stream_id"))
    asked = cursors.select("task_id", seen.alias("__seen"))
    after = chunks.join(asked, "task_id").withColumn("__at", at).where(F.col("__seen.ms").isNull() | (F.col("__at") > F.col("__seen")))
    order = W.partitionBy("task_id").orderBy("__at")
    ended = F.sum(F.when(F.col("type").isin(*ENDS), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = after.withColumns({"place": numbered(order), "__ended": F.coalesce(ended, F.lit(0))})
    return placed.where((F.col("place") <= n) & (F.col("__ended") == 0)).drop("__at", "__seen", "__ended")


def split_stream_id(stream_id: Column) -> Column:
    """A two-part id "ms-n" as one comparable number pair: ms is null and n is 0 where they are no numbers."""
    parts = F.split(stream_id, "-")
    return F.struct(parts[0].try_cast("bigint").alias("ms"), F.coalesce(F.get(parts, F.lit(1)).try_cast("bigint"), F.lit(0)).alias("n"))


def stale_sessions(heartbeats: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """(task_id, last_beat): runs of heartbeats that ended with ``gap`` of silence. On a stream a row
    comes once the watermark has passed the silence; in batch every run but a still open one counts."""
    beats = heartbeats.withWatermark("ts", "0 seconds") if heartbeats.isStreaming else heartbeats
    runs = beats.groupBy(F.session_window("ts", gap).alias("w"), "task_id").agg(F.max("ts").alias("last_beat"), F.count(F.lit(1)).alias("beats"))
    return runs.select("task_id", "last_beat", "beats")
