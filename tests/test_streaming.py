"""Streaming jobs on files, one batch after the other, against their batch twins."""

from compare import DATA
from pyspark.sql import functions as F

from loomwright.operators import social as S
from loomwright.sources import tables as T
from loomwright.sources.adapters import view
from loomwright.streaming import greedy as G
from loomwright.streaming import jobs as J

SF = f"{DATA}/sf0.001"


def events_in_files(spark, folder, files=3):
    events = view(spark, SF, "interaction").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = events.stat.approxQuantile("event_id", [i / files for i in range(1, files)], 0)
    for i in range(files):
        low, high = ([-1, *bounds][i], [*bounds, 1 << 40][i])
        events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(str(folder))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, df, folder, mode="append", sink=None):
    writer = df.writeStream.option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).outputMode(mode)
    if sink is not None:
        writer.foreachBatch(sink).start().awaitTermination()
        return None
    name = f"out_{folder.name.replace('-', '_')}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_leaderboard(spark, tmp_path):
    events, stream = events_in_files(spark, tmp_path / "in")
    got = drain(spark, J.stream_leaderboard(stream), tmp_path, "complete")
    assert pairs(got, "day", "article_id", "heat") == pairs(S.heat(events), "day", "article_id", "heat")
    assert J.top_of_day(got, 3).count() > 0


def test_reactions(spark, tmp_path):
    events, stream = events_in_files(spark, tmp_path / "in")
    drain(spark, stream, tmp_path, sink=J.merge_reactions(str(tmp_path / "state")))
    cols = ["article_id", "like_count", "favorite_count"]
    assert pairs(J.reaction_counts(J.read_reactions(spark, str(tmp_path / "state"))), *cols) == pairs(S.apply_reactions(events), *cols)


def test_reactions_go_on_from_old_state(spark, tmp_path):
    events = view(spark, SF, "interaction").withColumn("ts", F.col("ts").cast("timestamp"))
    path, want = str(tmp_path / "state"), pairs(S.apply_reactions(events), "article_id", "like_count", "favorite_count")
    got = lambda: pairs(J.reaction_counts(J.read_reactions(spark, path)), "article_id", "like_count", "favorite_count")
    parts = [events.where(F.pmod("event_id", F.lit(4)) == i) for i in range(4)]
    for part in parts:  # every batch is the first of a new checkpoint
        J.merge_reactions(path, compact_every=3)(part, 0)
    assert got() == want
    assert [x.name for x in (tmp_path / "state").iterdir()] == ["v3"]
    J.merge_reactions(path, compact_every=3)(parts[1], 1)  # delivered again
    assert got() == want


def test_stream_ids(spark):
    ids = spark.createDataFrame([("12-3",), ("12-10",), ("9",), ("x-1",), (None,)], "id string")
    got = {r["id"]: tuple(r["s"]) for r in ids.select("id", J.split_stream_id(F.col("id")).alias("s")).collect()}
    assert got == {"12-3": (12, 3), "12-10": (12, 10), "9": (9, 0), "x-1": (None, 1), None: (None, 0)}


def test_greedy_twins(spark, tmp_path):
    # One file after the other must hold a key's events in order, as a queue does.
    events = view(spark, SF, "interaction").withColumn("ts", F.col("ts").cast("timestamp"))
    half = events.agg(F.percentile("event_id", F.lit(0.5))).first()[0]
    middle = events.where(F.col("event_id") <= half).agg(F.max("ts")).first()[0]
    for part in (events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kernel = G.at_most(2, 86400)
    got = drain(spark, G.admit_stream(stream, ["user_id"], kernel), tmp_path)
    want = G.admit(events, ["user_id"], kernel)
    assert pairs(got, "user_id", "event_id", "admitted") == pairs(want, "user_id", "event_id", "admitted")


def test_consume_once(spark, tmp_path):
    lines = ['{"taskId":1,"eventId":"a","createdAt":"2024-05-01 00:00:00"}', '{"taskId":1,"eventId":"a","createdAt":"2024-05-01 00:00:01"}', "junk"]
    (tmp_path / "in").mkdir()
    for i, line in enumerate(lines):
        (tmp_path / "in" / f"{i}.txt").write_text(line + "\n")
    tasks = spark.createDataFrame([(1,)], "id long")
    got = drain(spark, J.idempotent_consume(T.task_message_stream(spark, str(tmp_path / "in")), tasks), tmp_path)
    assert pairs(got, "task_id", "event_id") == [(1, "a")]


def test_assemble(spark, tmp_path):
    rows = [(1, 1, "analyst", "text", "no"), (1, 2, "generator", "text", "a"), (1, 3, "reviewer", "text", "b"), (1, 4, "x", "done", None), (2, 1, "g", "text", "c"), (2, 2, "g", "result", "R"), (2, 3, "g", "error", "")]
    chunks = spark.createDataFrame(rows, "task_id long, seq long, author string, type string, content string")
    chunks = chunks.withColumn("ts", F.timestamp_seconds(F.lit(1714521600) + F.col("seq")))
    chunks.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(spark, J.assemble_stream(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))), tmp_path)
    want = J.assemble_task_stream(chunks)
    assert pairs(got, "task_id", "text", "state") == pairs(want, "task_id", "text", "state") == [(1, "ab", "done"), (2, "R", "error")]


def made_chunks(spark, folder, cut=False):
    """Chunks of all types in three files, a task's in order; with ``cut`` as bytes, each chunk in two parts
    that end somewhere within a line or a character."""
    chunks = view(spark, SF, "task_chunk").withColumns({"ts": F.col("ts").cast("timestamp"), "content": F.concat(F.when(F.col("seq") % 2 == 1, '{"type":"é"}\n').otherwise("ñü "), "content", F.when(F.col("seq") % 3 == 0, "\n").otherwise(""))})
    if cut:
        data = F.encode("content", "UTF-8")
        at = F.lit(1) + F.pmod(F.xxhash64("task_id", "seq"), F.length(data)).cast("int")
        halves = F.array(F.struct(F.lit(0).alias("half"), F.substring(data, F.lit(1), at).alias("b")), F.struct(F.lit(1).alias("half"), F.substring(data, at + 1, F.lit(1 << 30)).alias("b")))
        chunks = chunks.withColumn("h", F.explode(halves)).withColumns({"content": F.col("h.b"), "seq": F.col("seq") * 2 + F.col("h.half")})
        chunks = chunks.withColumn("type", F.when((F.col("h.half") == 0) & F.col("type").isin("done", "error"), "text").otherwise(F.col("type"))).drop("h")
    for i in range(3):
        chunks.where((F.col("seq") * 3 / (16 if cut else 8)).cast("int") == i).coalesce(1).write.mode("append").parquet(str(folder))
    return chunks, spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def last_batch(spark, folder, chunks):
    """A late chunk of a task of its own: the watermark passes all others, and silent tasks time out."""
    far = chunks.limit(1).withColumns({"task_id": F.lit(-1).cast("bigint"), "ts": F.col("ts") + F.expr("INTERVAL 9 DAYS"), "author": F.lit("z"), "type": F.lit("tool")})
    far.coalesce(1).write.mode("append").parquet(str(folder))


def test_lines_with_open_tails(spark, tmp_path):
    chunks, stream = made_chunks(spark, tmp_path / "in", cut=True)
    last_batch(spark, tmp_path / "in", chunks)
    got = drain(spark, J.reassemble_lines_stream(stream, lateness="2 hours"), tmp_path).where("task_id >= 0")
    cols = ["task_id", "author", "pos", "line", "type"]
    want = pairs(J.reassemble_lines(chunks), *cols)
    assert pairs(got, *cols) == want and len(want) > 60 and any(r[4] == "é" for r in want) and not any("\ufffd" in r[3] for r in want)


def test_texts_of_phases(spark, tmp_path):
    chunks, stream = made_chunks(spark, tmp_path / "in")
    last_batch(spark, tmp_path / "in", chunks)
    got = drain(spark, J.phase_texts_stream(stream, lateness="2 hours"), tmp_path).where("task_id >= 0")
    cols = ["task_id", "number", "phase", "first_seq", "text"]
    want = pairs(J.phase_texts(chunks), *cols)
    assert pairs(got, *cols) == want and {r[2] for r in want} == {"analyzing", "generating", "reviewing", "thinking"}


def test_assembled_tasks_of_every_end(spark, tmp_path):
    chunks, stream = made_chunks(spark, tmp_path / "in")
    last_batch(spark, tmp_path / "in", chunks)
    got = drain(spark, J.assemble_stream(stream, lateness="2 hours"), tmp_path).where("task_id >= 0")
    want = pairs(J.assemble_task_stream(chunks), "task_id", "text", "state")
    assert pairs(got, "task_id", "text", "state") == want and {r[2] for r in want} == {"open", "done", "error"}


def test_resume_by_id(spark):
    rows = [(1, f"5-{i}", "text") for i in (8, 9, 10, 11)] + [(1, "6-0", "done"), (1, "6-1", "text"), (2, "5-1", "error"), (2, "5-2", "text"), (3, "70-1", "text"), (3, "9-1", "text")]
    chunks = spark.createDataFrame(rows, "task_id long, stream_id string, type string")
    ask = lambda *c: pairs(J.resume_stream(chunks, spark.createDataFrame(c, "task_id long, last_id string")), "task_id", "stream_id", "place")
    assert ask((1, "5-9")) == [(1, "5-10", 1), (1, "5-11", 2), (1, "6-0", 3)]
    assert ask((2, None), (3, "9")) == [(2, "5-1", 1), (3, "70-1", 2), (3, "9-1", 1)]
    assert ask((2, "5-1"), (3, "9-1")) == [(2, "5-2", 1), (3, "70-1", 1)] and ask((1, "7-0"), (9, None)) == []


def test_daily_files(spark, tmp_path):
    path = str(tmp_path / "daily")
    old = spark.sql("SELECT 1L AS article_id, DATE '2024-05-01' AS date, 3 AS view_count UNION ALL SELECT 1L, DATE '2024-05-02', 4")
    T.write_daily_stats(old, path)
    new = spark.sql("SELECT 1L AS article_id, DATE '2024-05-02' AS date, 9 AS view_count")
    T.write_daily_stats(new, path)
    assert pairs(spark.read.parquet(path), "date", "view_count")[1][1] == 9 and spark.read.parquet(path).count() == 2
    snap = str(tmp_path / "snap")
    T.append_snapshot(T.snapshot_views(spark.sql("SELECT 1L AS article_id, 5 AS view_count"), "2024-05-01"), snap)
    assert pairs(T.read_snapshot(spark, snap, "2024-05-01"), "article_id", "view_count") == [(1, 5)]
    assert T.read_snapshot(spark, snap, "2024-05-02").count() == 0
