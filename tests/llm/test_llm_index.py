"""The digest index opened again: other bucket counts, growth, many appends, a lock, no tables left."""

import pytest
from test_llm_operators import by_id, docs

from loomwright.llm import exact


def run(spark, index, rows):
    return sorted(by_id(exact.exact_duplicates(docs(spark, rows), index), "doc_id", "keep_id", "kept"))


def test_other_bucket_count(spark):
    known = [(i, f"text {i}") for i in range(50)]
    index = exact.DigestIndex(spark, buckets=4)
    run(spark, index, known)
    again = exact.DigestIndex(spark, index.path)
    assert run(spark, again, known) == sorted((i, i, True) for i, _ in known) and again.layout() == (1, 4)
    other = exact.DigestIndex(spark, index.path, buckets=8)
    got = run(spark, other, [(100 + i, f"TEXT {i}") for i in range(60)])
    assert other.layout() == (2, 8)
    assert got == sorted([(100 + i, i, False) for i in range(50)] + [(100 + i, 100 + i, True) for i in range(50, 60)])
    assert other.entries().count() == 60 == other.entries().select("digest").distinct().count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_growth_and_many_appends(spark, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_ROWS", 10)
    monkeypatch.setattr(exact, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(exact, "MOST_FILES", 3)
    index = exact.DigestIndex(spark)
    run(spark, index, [(i, f"a{i}") for i in range(15)])
    assert index.layout() == (1, 2)
    run(spark, index, [(i, f"b{i}") for i in range(90)])
    assert index.layout() == (2, 16)
    for k in range(6):
        run(spark, index, [(k, f"c{k}")])
    assert index.layout()[0] == 2 or index.entries().count() == 111
    assert index.entries().count() == 111 == index.entries().select("digest").distinct().count()


def test_lock(spark):
    index = exact.DigestIndex(spark)
    with index._locked(), pytest.raises(RuntimeError):
        run(spark, index, [(1, "a")])
    assert run(spark, index, [(1, "a")]) == [(1, 1, True)] == run(spark, index, [(1, "a")])
    assert run(spark, index, []) == []
