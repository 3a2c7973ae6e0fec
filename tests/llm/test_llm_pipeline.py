"""The registered queries and the pipeline on the smallest tables."""

import sys

from compare import DATA, check, connect

SF = f"{DATA}/sf0.001"


def test_pipeline_stages(spark):
    import corpus_pipeline
    from loomwright.session import Workspace, table

    docs = table(spark, SF, "documents")
    work, columns, sizes = Workspace(spark, "test"), docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.put(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert last.select("doc_id").distinct().count() == sizes[-1] and whole.count() == last.count()


def test_queries(spark):
    from loomwright.llm import queries

    duck = connect(SF)
    for name, query in queries.QUERIES.items():
        df = query(spark, SF)
        if name in queries.ORACLES:
            assert check(df, duck, queries.ORACLES[name])
        else:
            assert df.count() > 0


def test_rest_works_without(spark):
    import importlib

    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("loomwright.llm") or k in ("corpus_pipeline", "__spark_entry__")}
    sys.modules["loomwright.llm"] = None
    sys.modules["corpus_pipeline"] = None
    try:
        entry = importlib.import_module("__spark_entry__")
        assert not any(k.startswith("op") and k[2].isdigit() for k in entry.queries()) and "hybrid_search" in entry.queries()
        assert entry.entry(spark).count() > 0
    finally:
        for k in ("loomwright.llm", "corpus_pipeline", "__spark_entry__"):
            sys.modules.pop(k, None)
        sys.modules.update(held)
