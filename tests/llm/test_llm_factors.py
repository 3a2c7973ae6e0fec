"""Factors of the relative Lempel-Ziv parse, and texts of a short period."""

import random

from loomwright.llm import substring
from test_llm_operators import brute_substring, by_id


def test_factors_are_copies(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    a, b = make(90), make(200)
    texts = {1: make(20) + a + make(30), 2: a[:70] + make(5) + b, 3: make(3) + b[50:130] + a[20:], 4: make(60), 5: make(2) + b + b, 6: make(34)}
    df = spark.createDataFrame([(i, " ".join(t), "x", 5, "y") for i, t in texts.items()] + [(7, None, "x", 0, None), (8, "", "x", 0, None)], "doc_id long, text string, uid string, place int, kept string")
    rows = substring.factors(df).collect()
    for r in rows:
        mine, other = texts[r["doc_id"]], texts[r["source_doc_id"]]
        assert r["length"] >= 35 and mine[r["start"] : r["start"] + r["length"]] == other[r["source_start"] : r["source_start"] + r["length"]]
    found = {(r["doc_id"], r["start"], r["length"]) for r in rows}
    assert {(2, 75, 200), (1, 20, 70), (1, 40, 70), (3, 83, 70)} <= found and {r["doc_id"] for r in rows} == {1, 2, 3, 5}


def test_short_periods(spark):
    rng = random.Random(12)
    rows = [(1, "a " * 5000), (2, "a " * 40), (3, "b a " * 700 + "c"), (4, "x y z " * 30 + " ".join(f"q{i}" for i in range(50))), (5, "x y z " * 11), (6, "a"), (7, "z x y " * 12 + "u")]
    rows += [(10 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(30, 400)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(substring.repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows)
    places = list(substring._index(iter([__import__("pyarrow").record_batch([[1], [b"a " * 5000]], names=["uid", "text"])])))[0]
    assert places.num_rows < 60


def test_shared_hot_anchor(spark):
    rng = random.Random(13)
    hot = " ".join(f"h{i}" for i in range(12))
    rows = []
    for i in range(200):  # one phrase within different surroundings, some of which occur twice
        k = i if i % 3 else i - i % 9
        around = random.Random(k)
        left, right = [" ".join(f"s{around.randrange(9)}" for _ in range(n)) for n in (rng.randrange(20, 40), 30)]
        rows.append((i, f"{left} {hot} {right}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(substring.repeated_passages(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows)
