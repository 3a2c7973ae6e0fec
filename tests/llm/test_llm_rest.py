"""Near-duplicates that links of a few spanning forests leave apart."""

import random

import numpy as np
import pyarrow as pa

from loomwright.llm import simhash
from test_llm_near import shingles
from test_llm_operators import docs


def test_no_variant_is_left_apart(spark):
    """Three hundred variants of one text close to 0.8: just those stay that no chain of similar pairs joins (16 more did with four forests alone)."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(60)}" for _ in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(150)] = f"w{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    sets, link = [shingles(t) for _, t in rows], list(range(300))
    root = lambda i: i if link[i] == i else root(link[i])
    for x in range(300):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) and root(x) != root(y):
                link[max(root(x), root(y))] = min(root(x), root(y))
    want = {i for i in range(300) if root(i) == i}
    for most in (20_000, 100):
        kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows), most=most).collect()}
        assert not want - kept and len(kept - want) <= 1, (len(want), len(kept))


def test_pairs_of_a_bucket_are_compared_as_pairs_of_sketches():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, 700, np.uint64).astype(np.uint32)
    sketches = []
    for n in [0, 0, *[80] * 20, *[700] * 20]:
        own = base[:n].copy()
        own[rng.random(n) < rng.choice([0.05, 0.1, 0.2])] = rng.integers(0, 1 << 32)
        own = np.unique(own + (rng.random(n) < 0.03).astype(np.uint32))[: simhash.SKETCH]
        sketches.append(own.tobytes())
    n = len(sketches)
    ids = pa.array(range(n), pa.int64())
    rows = pa.table({"rep": ids, "rep_key": ids, "fp": pa.array([-1] * n, pa.int64()), "label": ids, "sketch": pa.array(sketches, pa.binary())})
    got = simhash._compared(0.8)(rows).to_pylist()
    link = list(range(n))
    root = lambda i: i if link[i] == i else root(link[i])
    for r in got:
        assert simhash._verdict(sketches[r["a"]], sketches[r["b"]], 0.8) is r["similar"]
        if r["similar"]:
            link[root(r["a"])] = root(r["b"])
    doubts = {frozenset((r["a"], r["b"])) for r in got if r["similar"] is None}
    for x in range(n):
        for y in range(x):
            said = simhash._verdict(sketches[x], sketches[y], 0.8)
            assert said is False or root(x) == root(y) or (said is None and frozenset((x, y)) in doubts)
    assert any(r["similar"] for r in got) and len({root(i) for i in range(n)}) > 2
