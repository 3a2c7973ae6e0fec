"""Memory ingestion: parsing model output, duplicates by hash, update or insert, embedding runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.functions.windows import numbered
from loomwright.operators.retrieval import TINY, active, vector_topk_blocked
from loomwright.session import Workspace

MEMORY_TYPES = ("fact", "preference", "knowledge", "event")
LONGEST = 500
SAME_ABOVE = 0.9
MOST_TRIES = 3
NEW_IMPORTANCE = 0.5
#: Texts handed to the embedder at once.
BATCH = 50


def parse_memory_candidates(responses: DataFrame) -> DataFrame:
    """(message_id, user_id, session_id, pos, text, type, attributed_to) from model output.

    Code fences go, the outermost braces are read as JSON, and entries of ``memory`` with text of 1
    to 500 characters and a known type become rows. Malformed output gives none.
    """
    bare = F.regexp_replace("response", r"```(?:json)?", "")
    entry = "struct<text: string, type: string, attributed_to: string>"
    parsed = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), f"memory array<{entry}>")
    rows = responses.select("message_id", "user_id", "session_id", F.posexplode(parsed["memory"]).alias("pos", "m"))
    rows = rows.select("message_id", "user_id", "session_id", "pos", F.trim("m.text").alias("text"), F.lower(F.trim("m.type")).alias("type"), "m.attributed_to")
    return rows.where(F.length("text").between(1, LONGEST) & F.col("type").isin(*MEMORY_TYPES))


def hashed_bigrams(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in embedder for tests: unit vectors of hashed character pairs. It knows no meaning."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for row, text in enumerate(texts):
            for a, b in zip(text, text[1:]):
                out[row, zlib.crc32((a + b).encode()) % dims] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed_texts(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "content") -> DataFrame:
    """``rows`` with an embedding of their first 500 characters and what became of it: ``done``,
    ``blank`` (no text), or ``failed: ...`` with the error of the batch, whose vectors are empty then.
    Vectors stay with their rows. A wrong number of vectors is an error of the embedder as well."""

    @F.pandas_udf("embedding array<float>, outcome string")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [(t or "")[:LONGEST] for t in part]
            out: list[tuple[list[float], str]] = []
            for at in range(0, len(texts), BATCH):
                some = texts[at : at + BATCH]
                try:
                    made = embedder(some)
                    out += [(list(map(float, v)), "done") if t.strip() else ([], "blank") for t, v in zip(some, made, strict=True)]
                except Exception as error:  # noqa: BLE001  the caller's service may fail in any way
                    out += [([], f"failed: {type(error).__name__}: {error}")] * len(some)
            yield pd.DataFrame(out, columns=["embedding", "outcome"])

    made = rows.withColumn("__made", vectors(F.col(text)))
    return made.withColumns({"embedding": F.col("__made.embedding"), "outcome": F.col("__made.outcome")}).drop("__made")


def new_by_hash(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Candidates (candidate_id, user_id, content) whose user and content hash are neither in the store,
    deleted rows included, nor in an earlier candidate."""
    hashed = candidates.withColumn("content_hash", F.md5("content"))
    known = memories.select("user_id", "content_hash")
    fresh = hashed.join(known, ["user_id", "content_hash"], "left_anti")
    first = numbered(W.partitionBy("user_id", "content_hash").orderBy("candidate_id"))
    return fresh.withColumn("__n", first).where("__n = 1").drop("__n")


def update_target(candidates: DataFrame, memories: DataFrame, above: float = SAME_ABOVE) -> DataFrame:
    """(candidate_id, target_id): the user's nearest memory if its cosine is above 0.9, else null."""
    asked = candidates.select(F.col("candidate_id").alias("query_id"), "user_id", "embedding")
    near = vector_topk_blocked(asked, memories, 1, above=above)
    near = near.select(F.col("query_id").alias("candidate_id"), F.col("memory_id").alias("target_id"))
    return candidates.select("candidate_id").join(near, "candidate_id", "left")


PLANNED = "candidate_id bigint, target_id bigint"


def _in_order(above: float):
    """Decides a session's candidates one after the other: each goes to the nearest memory as the earlier
    ones have left it. ``near`` has the untouched memories above the limit, the best first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("candidate_id")
        # Memories that this session has changed: their places by id, and by vector length their ids and unit vectors.
        places: dict[int, tuple[int, int]] = {}
        changed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        used: Counter[int] = Counter()
        targets = []
        for vector, near in zip(rows["embedding"], rows["near"]):
            if vector is None or not len(vector):
                targets.append(None)
                continue
            unit = np.asarray(vector, np.float64)
            unit, width = unit / (np.sqrt((unit * unit).sum()) + TINY), len(unit)
            found = next(((x["score"], x["memory_id"]) for x in near if x["memory_id"] not in places), None) if near is not None else None
            best = [found] if found else []
            if n := used[width]:
                ids, units = changed[width]
                scores = np.round(units[:n] @ unit, 12)
                best.append((float(scores.max()), int(ids[:n][scores == scores.max()].min())))
            score, target = max(best, key=lambda x: (x[0], -x[1]), default=(0.0, None))
            targets.append(target if score > above else None)
            if targets[-1] is None:
                continue
            if target in places and places[target][0] != width:
                changed[places[target][0]][1][places[target][1]] = 0.0
                del places[target]
            if target not in places:
                ids, units = changed.get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
                if n == len(ids):  # twice the room
                    changed[width] = np.resize(ids, 2 * n + 8), np.concatenate([units, np.zeros((n + 8, width))])
                places[target], used[width] = (width, n), n + 1
            ids, units = changed[width]
            ids[places[target][1]], units[places[target][1]] = target, unit
        return pd.DataFrame({"candidate_id": rows["candidate_id"], "target_id": pd.array(targets, "Int64")})

    return run


def plan_session(candidates: DataFrame, memories: DataFrame, work: Workspace, most: int, above: float = SAME_ABOVE) -> DataFrame:
    """New candidates of one session of each user with ``target_id``, the memory they update (null: they are
    added), and ``old_content``: what the memory held before, be it from an earlier candidate.

    A session is one response of a model, so its candidates fit into one task; the memories do not
    come there: a candidate's near ones are found in blocks, and as many are kept as the longest session
    has candidates (``most``), since no more can have been changed before it.
    """
    fresh = work.put(new_by_hash(candidates, memories), f"fresh-{uuid4().hex}")  # small, and read four times
    asked = fresh.where(F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0)
    found = vector_topk_blocked(asked.select(F.col("candidate_id").alias("query_id"), "user_id", "embedding"), memories, most, above=above)
    best_first = F.array_sort(
        F.collect_list(F.struct("memory_id", "score")), lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).otherwise(F.when(a.memory_id < b.memory_id, -1).otherwise(1))
    )
    near = found.groupBy(F.col("query_id").alias("candidate_id")).agg(best_first.alias("near"))
    decided = fresh.join(near, "candidate_id", "left").select("user_id", "candidate_id", "embedding", "near").groupBy("user_id").applyInPandas(_in_order(above), PLANNED)
    chain = W.partitionBy("target_id").orderBy("candidate_id")
    before = memories.select(F.col("id").alias("target_id"), F.col("content").alias("__stored"))
    planned = fresh.join(decided, "candidate_id").join(before, "target_id", "left")
    last = F.lead("candidate_id").over(chain).isNull()
    return planned.withColumns({
        "old_content": F.when(F.col("target_id").isNotNull(), F.coalesce(F.lag("content").over(chain), "__stored")),
        "action": F.when(F.col("target_id").isNull(), "ADD").otherwise("UPDATE"),
        "applied": F.col("target_id").isNull() | last,
    }).drop("__stored")


def _applied(plan: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    """The memories that a plan changes or adds, as they are afterwards."""
    change = plan.where("action = 'UPDATE' AND applied").select(
        F.col("target_id").alias("id"), F.col("content").alias("__c"), F.col("content_hash").alias("__h"), F.col("embedding").alias("__e")
    )
    changed = memories.join(change, "id").withColumns({"content": F.col("__c"), "content_hash": F.col("__h"), "embedding": F.col("__e")})
    vector = F.coalesce("embedding", F.array().cast(memories.schema["embedding"].dataType))
    filled = {
        "id": F.col("candidate_id"), "importance": F.lit(NEW_IMPORTANCE), "access_count": F.lit(0), "last_accessed_at": F.lit(None).cast("timestamp"),
        "create_time": F.lit(as_of).cast("timestamp"), "is_deleted": F.lit(0), "embedding": vector,
        "vector_status": F.when(F.size(vector) > 0, "SYNCED").otherwise("PENDING"), "retry_count": F.lit(0),
    }
    added = plan.where("action = 'ADD'").withColumns(filled)
    return changed.select(*memories.columns).unionByName(added.select(*memories.columns))


def merge_memories(candidates: DataFrame, memories: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(store after the merge, history rows). New memories take their candidate's id.

    A user's sessions follow each other, in the order of their first candidates: each meets the store as
    the ones before it have left it. Round n takes the n-th session of every user that has so many, and
    reads these users' memories only. What has changed is kept apart until the end; the store is
    written never and joined once. Memories without a vector stay PENDING.
    """
    work = Workspace(memories.sparkSession, "merge")
    session = W.partitionBy("user_id", "session_id")
    ranked = candidates.withColumns({"first": F.min("candidate_id").over(session), "many": F.count(F.lit(1)).over(session)})
    ranked = work.put(ranked.withColumn("turn", F.dense_rank().over(W.partitionBy("user_id").orderBy("first"))), "candidates")
    rounds, most = ranked.agg(F.coalesce(F.max("turn"), F.lit(0)), F.max("many")).first()
    delta, history = None, []
    keep = lambda rows, other: rows.join(other.select("id"), "id", "left_anti").select(*memories.columns)
    for n in range(1, rounds + 1):
        some = ranked.where(F.col("turn") == n).drop("first", "many", "turn")
        users = some.select("user_id").distinct()
        of_users = lambda rows: rows.join(users, "user_id", "left_semi").select(*memories.columns)  # noqa: B023, E731
        mine = of_users(memories) if delta is None else keep(of_users(memories), delta).unionByName(of_users(delta))
        plan = work.put(plan_session(some, mine, work, most), f"plan-{n}")
        now = _applied(plan, mine, as_of)
        if n < rounds:
            now = work.put(now, f"changed-{n}")
            delta = now if delta is None else work.put(keep(delta, now).unionByName(now), f"delta-{n}")
        else:
            delta = now if delta is None else keep(delta, now).unionByName(now)
        history.append(plan.select(
            F.coalesce("target_id", "candidate_id").alias("memory_id"), "session_id", "old_content", F.col("content").alias("new_content"), F.col("action").alias("event")
        ))
    none = memories.sparkSession.createDataFrame([], f"memory_id bigint, session_id {dict(candidates.dtypes)['session_id']}, old_content string, new_content string, event string")
    return memories if delta is None else keep(memories, delta).unionByName(delta), reduce(DataFrame.unionByName, history, none)


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories with those named in ``ids`` (id) marked deleted and their vectors emptied."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    empty = F.array().cast(memories.schema["embedding"].dataType)
    joined = memories.join(gone, "id", "left")
    return joined.withColumns(
        {"is_deleted": F.when(F.col("__gone"), 1).otherwise(F.col("is_deleted")), "embedding": F.when(F.col("__gone"), empty).otherwise(F.col("embedding"))}
    ).drop("__gone")


def pending_vectors(memories: DataFrame) -> DataFrame:
    return active(memories).where("vector_status = 'PENDING'").orderBy("create_time", "id")


def sync_vectors(memories: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending memories with the outcome of their embedding (id, embedding, failed): SYNCED with a vector,
    still PENDING without, and on an error one more try, FAILED from the third on."""
    work = pending_vectors(memories).drop("embedding").join(outcomes.select("id", "embedding", "failed"), "id", "left")
    failed = F.coalesce("failed", F.lit(False))
    has = F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0
    tries = F.col("retry_count") + F.when(failed, 1).otherwise(0)
    status = F.when(failed & (tries >= MOST_TRIES), "FAILED").when(failed | ~has, "PENDING").otherwise("SYNCED")
    outcome = F.when(failed, "failed").when(has, "migrated").otherwise("skipped")
    return work.select("id", "user_id", tries.cast("int").alias("retry_count"), status.alias("vector_status"), outcome.alias("outcome"))


def sync_report(synced: DataFrame) -> DataFrame:
    return synced.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("migrated", "skipped", "failed")]
    )
