"""The pipeline's rows against a plain version of its stages."""

import collections
import zlib

import duckdb
import numpy as np
from compare import DATA
from test_llm_near import shingles
from test_llm_operators import LOWER, WORD

SF = f"{DATA}/sf0.001"


def brute(spark):
    from loomwright.llm import toxicity
    from loomwright.session import table

    scores = toxicity.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    toxic = {r["doc_id"] for r in scores if r["predicted"]}
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    docs = {i: t for i, t in rows.items() if i not in toxic}
    last = {t.translate(LOWER): i for i, t in sorted(docs.items())}
    docs = {i: docs[i] for i in sorted(last.values())}
    sets = {i: shingles(t) for i, t in docs.items()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    alike = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and near(a, b)}
    root = {i: i for i in docs}
    moved = True
    while moved:
        moved = False
        for a, b in alike:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    docs = {i: t for i, t in docs.items() if root[i] == i}
    words = {i: WORD.findall(t) for i, t in docs.items()}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        if any(gone):
            docs[i] = " ".join(x for x, g in zip(w, gone) if not g)
    return docs


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = brute(spark)
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append(r)
    assert got.keys() == want.keys()
    for i, text in want.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(got[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids) == pieces[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
