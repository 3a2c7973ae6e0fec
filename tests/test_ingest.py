"""Ingestion over several sessions against a store that is changed one candidate at a time."""

import hashlib
import random

import numpy as np

from loomwright.operators import ingest as I

MEMORY = (
    "id long, user_id long, type string, content string, content_hash string, importance double, access_count int, last_accessed_at timestamp, "
    "create_time timestamp, is_deleted int, vector_status string, retry_count int, embedding array<float>, session_id long"
)
CANDIDATE = "candidate_id long, user_id long, content string, type string, session_id long, embedding array<float>"
NOW = "2024-05-01 12:00:00"
md5 = lambda t: hashlib.md5(t.encode()).hexdigest()


def memory(i, user, content, vector, deleted=0):
    return (i, user, "fact", content, md5(content), 0.1, 0, None, None, deleted, "SYNCED", 0, vector, None)


def one_by_one(candidates, memories):
    """{id: (content, status)} and the history, by a plain loop."""
    store = {m[0]: {"user": m[1], "content": m[3], "hash": m[4], "deleted": m[9], "status": m[10], "vector": m[12]} for m in memories}
    history = []
    sessions = {}
    for c in sorted(candidates):
        sessions.setdefault((c[1], c[4]), []).append(c)
    for (user, session), rows in sorted(sessions.items(), key=lambda x: x[1][0][0]):
        hashes = {m["hash"] for m in store.values() if m["user"] == user}
        added = {}
        for i, _, content, _, _, vector in rows:
            if md5(content) in hashes:
                continue
            hashes.add(md5(content))
            best = (0.0, None)
            for k, m in sorted(store.items()):
                if m["user"] == user and not m["deleted"] and vector and m["vector"] and len(vector) == len(m["vector"]):
                    a, b = np.array(vector, np.float32).astype(float), np.array(m["vector"], np.float32).astype(float)
                    score = round(float(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-10), 9)
                    best = (score, k) if score > best[0] else best
            if best[0] > 0.9:
                m = store[best[1]]
                history.append((best[1], session, m["content"], content, "UPDATE"))
                m |= {"content": content, "hash": md5(content), "vector": vector}
            else:
                added[i] = {"user": user, "content": content, "hash": md5(content), "deleted": 0, "status": "SYNCED" if vector else "PENDING", "vector": vector}
                history.append((i, session, None, content, "ADD"))
        store |= added
    return {k: (m["content"], m["status"]) for k, m in store.items()}, history


def run(spark, candidates, memories):
    store, history = I.merge_memories(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(memories, MEMORY), NOW)
    got = {r["id"]: (r["content"], r["vector_status"]) for r in store.collect()}
    assert store.count() == len(got)
    return got, sorted((tuple(r) for r in history.collect()), key=repr)


def test_two_sessions_of_near_equal_vectors(spark):
    """The second session updates what the first has added; a second update's old text is the first one's."""
    memories = [memory(1, 5, "stored", [1.0, 0.0, 0.0]), memory(2, 6, "other user", [0.0, 0.0, 1.0])]
    candidates = [
        (10, 5, "new", "fact", 1, [0.0, 1.0, 0.0]), (11, 5, "newer", "fact", 2, [0.0, 1.0, 0.001]), (12, 5, "first change", "fact", 2, [1.0, 0.1, 0.0]),
        (13, 5, "second change", "fact", 2, [1.0, 0.15, 0.0]), (14, 5, "no vector", "fact", 2, []), (15, 5, "no vector either", "fact", 3, None), (16, 5, "stored", "fact", 3, [0.0, 0.0, 1.0]),
    ]
    got, history = run(spark, candidates, memories)
    assert got == {1: ("second change", "SYNCED"), 2: ("other user", "SYNCED"), 10: ("newer", "SYNCED"), 14: ("no vector", "PENDING"), 15: ("no vector either", "PENDING"), 16: ("stored", "SYNCED")}
    assert (1, 2, "first change", "second change", "UPDATE") in history and (10, 2, "new", "newer", "UPDATE") in history
    assert (got, history) == (lambda s, h: (s, sorted(h, key=repr)))(*one_by_one(candidates, memories))
    pending = I.pending_vectors(I.merge_memories(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(memories, MEMORY), NOW)[0])
    assert sorted(r["id"] for r in pending.collect()) == [14, 15]


def test_against_one_by_one(spark):
    rng = random.Random(11)
    near = lambda base, much: [b + rng.uniform(-much, much) for b in base]
    bases = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    memories = [memory(i, i % 3, f"m{i}", near(rng.choice(bases), 0.3), int(rng.random() < 0.1)) for i in range(30)]
    candidates = [
        (100 + i, rng.randrange(4), rng.choice([f"c{i}", f"c{i - 3}", f"m{i % 30}"]), "fact", rng.randrange(4), near(rng.choice(bases), 0.3) if rng.random() < 0.9 else [])
        for i in range(70)
    ]
    got, history = run(spark, candidates, memories)
    want, wanted = one_by_one(candidates, memories)
    assert got == want and history == sorted(wanted, key=repr) and sum(h[4] == "UPDATE" for h in history) > 10


def test_no_candidates(spark):
    memories = [memory(1, 5, "stored", [1.0, 0.0])]
    assert run(spark, [], memories) == ({1: ("stored", "SYNCED")}, [])
    assert run(spark, [(3, 5, "x", "fact", 1, [1.0, 0.0])], [])[0] == {3: ("x", "SYNCED")}


def test_blocks_keep_near_memories_only(spark):
    """As many memories are asked for as the longest session has candidates; those that aren't near leave no block."""
    from loomwright.operators import retrieval as R

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8))
    m = spark.createDataFrame([(i, 1, 0, v.tolist()) for i, v in enumerate(vectors)], "id long, user_id long, is_deleted int, embedding array<float>")
    q = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], "query_id long, user_id long, embedding array<float>")
    near = R.vector_topk_blocked(q, m, 400, block=100, above=0.9)
    every = R.vector_topk_blocked(q, m, 400, block=100).where("score > 0.9")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, every.collect()))
    assert 400 <= near.count() < 1000


def test_session_changes_memories_of_other_lengths():
    import pandas as pd

    near = [{"memory_id": 1, "score": 0.99}, {"memory_id": 2, "score": 0.95}]
    rows = [(1, [1.0, 0.0], near), (2, [1.0, 0.1], near), (3, [0.0, 0.0, 1.0], [{"memory_id": 5, "score": 1.0}]), (4, [0.0, 1.0], None), (5, None, None), (6, [0.0, 0.1, 1.0], None)]
    got = I._in_order(0.9)(pd.DataFrame(rows, columns=["candidate_id", "embedding", "near"]))
    assert [None if pd.isna(t) else int(t) for t in got["target_id"]] == [1, 1, 5, None, None, 5]
