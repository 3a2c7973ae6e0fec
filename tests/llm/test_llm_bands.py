"""Compression bands with many copies of one text."""

import collections
import random

import zstandard
from test_llm_operators import docs

from loomwright.llm import compression


def test_compression_copies_do_not_narrow_the_band(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    make = lambda n, of: " ".join(rng.choice(vocabulary[:of]) for _ in range(n))
    clean = [(i, make(rng.randint(210, 280), rng.choice((60, 100, 200, 400, 3000)))) for i in range(80)]
    copy = make(250, 3000)
    alone = {r["doc_id"]: r["kept"] for r in compression.judge(docs(spark, clean)).collect()}
    got = {r["doc_id"]: r["kept"] for r in compression.judge(docs(spark, clean + [(1000 + i, copy) for i in range(300)])).collect()}
    assert len(got) == 380 and sum(alone.values()) >= 78 and all(got[i] for i in alone if alone[i])


def test_compression_spread_of_neighbours(spark):
    rows = [("whole", 10, 400 + i % 100) for i in range(100)] + [("whole", 11, 450 + i % 2) for i in range(100)]
    rows += [("whole", 12, 400 + i % 100) for i in range(100)] + [("chunk", 0, 300 + i % 2) for i in range(50)]
    df = spark.createDataFrame([(*r, compression.VOTE) for r in rows], "kind string, size_class int, ratio int, votes long")
    got = {(r["kind"], r["size_class"]): r["high"] - r["low"] for r in compression.limits(df).collect()}
    assert got["whole", 11] > 0.3 and abs(got["chunk", 0] - 0.0825) < 1e-9


def brute_limits(ratios, least=compression.LEAST_TEXTS, least_spread=compression.LEAST_SPREAD_TEXTS):
    """(low, high) for each class of {class: [[ratio of each part] of each text]}."""

    def median(votes):
        votes, upto = sorted(votes), 0
        for x, n in votes:
            upto += n
            if 2 * upto >= sum(n for _, n in votes):
                return x

    def pool(of, c, least):
        own = []
        for d in range(64):
            if sum(n for _, n in own) < least * compression.VOTE:
                own += [x for k in {c - d, c + d} for x in of.get(k, [])]
        return own

    spread = lambda x: max(x / 1000 * 1.4826, 0.01)
    votes_of = {c: [(x, compression.VOTE // len(text)) for text in texts for x in text] for c, texts in ratios.items()}
    middle = {c: median(pool(votes_of, c, least)) for c in ratios}
    apart = {c: [(x - middle[c], n) for x, n in votes] for c, votes in votes_of.items()}
    pools = {c: pool(apart, c, least_spread) for c in ratios}
    away = {c: [(abs(x), n) for x, n in own] for c, own in pools.items()}
    up = {c: median([x for x in own if x[0] >= 0]) for c, own in pools.items()}
    out = {}
    for c in ratios:
        near = away.get(c - 1, []) + away.get(c + 1, [])
        below = spread(max(median(away[c]), median(near) if near else 0))
        above = spread(max(up[c], min((up[k] for k in (c - 1, c + 1) if k in up), default=0)))
        out[c] = (middle[c] / 1000 - 4.5 * below, middle[c] / 1000 + compression.WIDTH_ABOVE * above)
    return out


def test_verdicts_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    make = lambda n, of=3000: " ".join(rng.choice(vocabulary[:of]) for _ in range(n))
    rows = [(i, make(int(rng.choice([60, 200, 500, 1200, 3000, 9000]) * rng.uniform(0.8, 1.2)))) for i in range(320)]
    hexes = " ".join(f"{rng.getrandbits(64):x}" for _ in range(20_000))  # alone in its length class
    loop = [rng.choice(vocabulary) for _ in range(50)]
    drum = " ".join(w for k in range(400) for w in [*rng.sample(loop, 50)])  # few words over and over, in changing order
    tail = make(300) + " " + " ".join(f"{rng.getrandbits(64):x}" for _ in range(700))  # junk in most of its chunks
    rows += [(1000, hexes), (1001, drum), (1002, tail), (1003, rows[0][1]), (1004, None), (1005, "")]
    got = {r["doc_id"]: r for r in compression.judge(docs(spark, rows)).collect()}
    packer = zstandard.ZstdCompressor(level=compression.LEVEL)
    ratio = lambda x: len(packer.compress(x)) * 1000 // len(x)
    whole, chunks = collections.defaultdict(list), []
    cut = lambda x: [x[k : k + 4096] if k + 8192 <= len(x) else x[k:] for k in range(0, len(x) - 4095, 4096)] if len(x) >= 8192 else []
    for t in {t.encode() for _, t in rows if t}:
        whole[len(t).bit_length()].append([ratio(t)])
        chunks += [[*map(ratio, cut(t))]] if cut(t) else []
    limits, parts = brute_limits(whole), brute_limits({0: chunks})[0]
    for i, t in rows:
        data, want = (t or "").encode(), False
        if data and not got[i]["base_failed"]:
            low, high = limits[len(data).bit_length()]
            out = [not parts[0] * 1000 <= ratio(x) <= parts[1] * 1000 for x in cut(data)]
            want = low <= ratio(data) / 1000 <= high and 2 * sum(out) < max(1, len(out))
        assert got[i]["kept"] == want, i
    assert not got[1000]["base_failed"] and not got[1000]["kept"]
    assert not got[1001]["base_failed"] and not got[1001]["kept"] and not got[1002]["kept"]
    assert sum(got[i]["kept"] for i in range(320)) >= 310


def test_planted_junk_changes_no_other_verdict(spark):
    """Random and repetitive texts of all lengths go; every other text is judged as before."""
    import pyarrow.parquet as pq
    from compare import DATA

    table = pq.read_table(f"{DATA}/sf0.01/documents.parquet")
    clean = [(i, t) for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())]
    rng = random.Random(12)
    junk = [(10_000 + i, " ".join(f"{rng.getrandbits(32):x}" for _ in range(n))) for i, n in enumerate((300, 300, 3000, 200_000))]
    loop = "".join(rng.choice("etaoinshr ") for _ in range(200)).split()
    drums = [(20_000 + i, " ".join(rng.choice(loop) for _ in range(n))) for i, n in enumerate((300, 3000, 200_000))]
    run = lambda rows: {r["doc_id"]: (r["kept"], r["base_failed"]) for r in compression.judge(docs(spark, rows)).collect()}
    alone, got = run(clean), run(clean + junk + drums)
    assert {i: got[i] for i in alone} == alone
    assert not any(got[i][0] for i, _ in junk + drums) and not any(got[i][1] for i, _ in junk)
    assert sum(k for k, _ in alone.values()) >= sum(not b for _, b in alone.values()) - 15
