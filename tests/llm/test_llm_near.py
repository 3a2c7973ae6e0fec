"""Large buckets of fingerprints, and near-duplicates of the pipeline against all pairs' similarity."""

import random
import time

import numpy as np

from loomwright.llm import simhash
from test_llm_operators import LOWER, WORD, docs, texts  # noqa: F401


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_fifty_thousand_in_one_bucket():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 42, 50_000, np.uint64) | np.uint64(5 << 50))
    near = np.unique(fps[:500] ^ np.uint64(0b1011 << 20))
    fps = np.unique(np.concatenate([fps, near]))
    began = time.time()
    links = simhash.trie_links(fps)
    assert time.time() - began < 60 and len(links) >= 480
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in links)


def test_split_buckets_give_the_same(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    whole, split = (
        sorted(tuple(r) for r in simhash.near_duplicates(docs(spark, rows), most=most).collect()) for most in (20_000, 3)
    )
    assert whole == split and len({r[2] for r in whole}) < 250
    kept = [{r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows), most=most).collect()} for most in (20_000, 3)]
    # Small chunks try nearly all pairs; a whole bucket's forests miss a few where links fail their check.
    assert kept[1] <= kept[0] and len(kept[0] - kept[1]) <= 10


def test_near_duplicates_by_similarity(spark, texts):  # noqa: F811
    rng = random.Random(3)
    make = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    rows = list(texts)
    for i in range(60):  # pairs on either side of the threshold, and texts longer than a sketch
        one = make(rng.choice([40, 120, 400, 1500]))
        two = list(one)
        for _ in range(max(1, int(len(one) * rng.choice([0.003, 0.01, 0.03, 0.08])))):
            two[rng.randrange(len(two))] = "changed"
        rows += [(1000 + 2 * i, " ".join(one)), (1001 + 2 * i, " ".join(two).upper())]
    rows += [(2000, "same words here"), (2001, "Same  words HERE"), (1000, " ".join(make(80)))]
    sets = [(i, shingles(t)) for i, t in rows]
    link, near = {i: i for i, _ in sets if i is not None}, 0
    root = lambda i: i if link[i] == i else root(link[i])
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None:
                s = len(a & b) / len(a | b) if a | b else 1.0
                near += abs(s - 0.8) < 0.03 and len(a | b) > 400
                if s >= 0.8 and root(i) != root(j):
                    link[max(root(i), root(j))] = min(root(i), root(j))
    got = simhash.drop_near_duplicates(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = {i for i in link if root(i) == i}
    assert len({i for i, _ in kept if i is not None} ^ want - {1000}) <= near
    assert (1000, rows[-1][1]) in kept and sum(i is None for i, _ in kept) == 2


def test_many_variants_of_one_text_in_one_bucket():
    """Twenty thousand near fingerprints, linked twice with different links, each within the budget."""
    rng = np.random.default_rng(4)
    fps = np.full(20_000, 0x5A5A1234F00DBEEF, np.uint64)
    for _ in range(7):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    fps = np.unique(fps)
    began = time.time()
    links = simhash.trie_links(fps, simhash.WIDE_BUDGETS)
    more = simhash.trie_links(fps, simhash.WIDE_BUDGETS, links)
    assert time.time() - began < 60 and len(links) == len(more) == len(fps) - 1
    pairs = [{(min(x), max(x)) for x in found} for found in (links, more)]
    assert not pairs[0] & pairs[1]
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 20 for i, j in links + more)


def test_long_texts_close_to_the_threshold_are_decided_on_their_words(spark):
    """Pairs of texts of 600 to 4,000 distinct shingles, the similarity a few shingles above or below 0.8."""
    rng = random.Random(6)
    rows, want = [], set()
    for n in range(40):
        words = [f"p{n}x{i}" for i in range(rng.choice([700, 1500, 4000]))]
        other, at, step = list(words), 2, rng.choice([43, 45, 47, 49])  # each changed word changes five shingles
        while at < len(other) - 4:
            other[at] = "new" + other[at]
            at += step
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        want |= {2 * n} | (set() if len(a & b) >= 0.8 * len(a | b) else {2 * n + 1})
    assert 45 < len(want) < 75
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert not want - kept and len(kept - want) <= 2  # a pair may share no bucket, or differ in more than 20 bits


def test_variants_near_the_threshold(spark):
    """Many texts of one bucket close to 0.8: links that fail their check have others beside them."""
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
    for most, missed in ((20_000, 18), (6, 1)):
        kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, rows), most=most).collect()}
        assert not want - kept and len(kept - want) <= missed
