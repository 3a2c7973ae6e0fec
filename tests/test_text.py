"""Golden strings of text repair and block rendering."""

from pyspark.sql import functions as F

from loomwright.functions import blocks as B
from loomwright.functions import text as X


def one(spark, function, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(function(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


POLICY_CASES = [
    ("PLAIN_TEXT", "## 摘要\n\n本文介绍 RocketMQ 的可靠投递机制。", "本文介绍 RocketMQ 的可靠投递机制。"),
    ("PLAIN_LINES", "1. # 多 Agent 写作系统实践\n2. 从同步生成到异步任务", "多 Agent 写作系统实践\n从同步生成到异步任务"),
    ("TAGS", "#Java、Spring Boot，RocketMQ\nRedis, Java", "Java, Spring Boot, RocketMQ, Redis"),
    ("ARTICLE_LIGHT", "## 2.1 任务可靠投递", "## 2.1 任务可靠投递"),
    ("NONE", "  \\*x ", "  \\*x "),
    *[(p, raw, raw) for p in ("PLAIN_TEXT", "TAGS", "ARTICLE_LIGHT", None) for raw in (None, "", "   ")],
]
#: What a text must hold after strict repair, and what it must not.
STRICT_CASES = [
    ("###标题\n正文", "### 标题", None),
    ("上一段##新标题", "\n## 新标题", None),
    ("这是 \\*\\*重点\\*\\* 内容", "**重点**", "\\"),
    ("```markdown\n# 标题\n正文\n```", "# 标题", "```"),
    ("\\| a \\| b \\|", "| a | b |", "\\|"),
    ("### 2.\n\n1作用与原理", "2.1", None),
    ("\\*x\n```\n\\*y\n```\n\\*z", "\\*y", "\\*z"),
    ("```javapublic void execute() {}\n```", "```java\npublic", None),
    ("##一、引言###1.1背景", "## 一、引言", "## \n"),
    ("## 2.1 小节\n正文", "### 2.1 小节", None),
]
BLOCK_CASES = [
    ('{"type":"md_heading","level":2,"text":"标题"}', "## 标题"),
    ('{"type":"md_heading","level":9,"text":"超深"}', "###### 超深"),
    ('{"type":"md_paragraph","text":" x "}', "x"),
    ('{"type":"md_list","items":["a","b"]}', "- a\n- b"),
    ('{"type":"md_list","ordered":true,"items":["x","y"]}', "1. x\n2. y"),
    ('{"type":"md_table","headers":["a","b"],"rows":[["1","2|3"]]}', "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"),
    ('{"type":"md_table","headers":["a","b","c"],"rows":[["1"]]}', "| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |"),
    ('{"type":"md_code","lang":"java","text":"int x;\\n"}', "```java\nint x;\n```"),
    ('{"type":"md_quote","text":"核心\\n结论"}', "> 核心\n> 结论"),
    ('{"type":"md_divider"}', "---"),
    ('{"type":"md_done"}', ""),
    ('{"type":"other"}', None),
    ("plain", None),
    (None, None),
]


def each(spark, function, rows):
    """The function's value for each row of strings, in order, by one job."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    out = df.select("i", function(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def test_policies(spark):
    got = each(spark, lambda raw, policy: X.normalize_by_policy(raw, policy), [(raw, policy) for policy, raw, _ in POLICY_CASES])
    assert got == [want for _, _, want in POLICY_CASES]


def test_strict(spark):
    for got, (_, inside, outside) in zip(each(spark, X.normalize_article_strict, [(c[0],) for c in STRICT_CASES]), STRICT_CASES):
        assert inside in got and (outside is None or outside not in got)


def test_blocks(spark):
    assert each(spark, B.render_block, [(line,) for line, _ in BLOCK_CASES]) == [want for _, want in BLOCK_CASES]


def test_document(spark):
    raw = 'x{"type":"md_heading","level":3,"text":"1.\n1微服务架构背景"}\n{"type":"md_paragraph","text":"a {b} \\" c"}{"open'
    assert one(spark, B.render_blocks_document, raw) == '### 1.1微服务架构背景\n\na {b} " c'
    assert one(spark, B.render_blocks_document, "  no block ") == "no block"


def test_strings(spark):
    assert one(spark, X.word_count, " \t ab \n") == 2 and one(spark, X.word_count, None) == 0
    assert one(spark, X.join_tags, " A， B、,C ") == "A,B,C"
    assert one(spark, X.split_tags, None) == [] and one(spark, X.split_tags, "A, ,B") == ["A", "B"]
    assert one(spark, lambda c: X.tag_match(c, ["java"]), "Go,Java") is True
    assert one(spark, X.policy_for_task, "POLISH_TEXT", "a【处理范围】选中文本") == "INLINE_LIGHT"


def test_long_lines_are_repaired_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from loomwright.functions import text as X

    long = "word " * 40_000 + "\n| a | b |\n|---|---|\n" + " " * 20_000 + "[粗体] x\n" + "line\n" * 20_000
    began = time.time()
    out = spark.createDataFrame([(long,)], "raw string").select(X.normalize_markdown_light(F.col("raw")).alias("t")).first()["t"]
    assert time.time() - began < 30 and "word \n\n| a | b |" in out and "[粗体]" not in out


def test_table_after_a_match_on_its_line(spark):
    """The linear forms of the two rules against the fixed patterns."""
    import random

    from pyspark.sql import functions as F

    from loomwright.functions import text as X

    rng = random.Random(7)
    rows = [("".join(rng.choice(["|", "a", " ", "\n", "|-|", "\n|a|\n|-|", "[粗体]", "\t"]) for _ in range(30)),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "raw string")
    for pattern, to in [r for r in X.MARKDOWN_REPAIRS if r and r[0] in X.LINEAR]:
        both = df.select(F.regexp_replace("raw", pattern, to).alias("a"), F.regexp_replace("raw", X.LINEAR[pattern], to).alias("b"), "raw")
        assert both.where("a <> b").count() == 0 and both.where("a <> raw").count() > 100


def test_embedding_outcomes(spark):
    from loomwright.operators import ingest

    def embedder(texts):
        if any("broken" in t for t in texts):
            raise TimeoutError("no answer")
        return ingest.hashed_bigrams(8)(texts)

    good = spark.createDataFrame([(1, "some text"), (2, " "), (3, None)], "id long, content string").coalesce(1)
    got = {r["id"]: (r["outcome"], len(r["embedding"])) for r in ingest.embed_texts(good, embedder).collect()}
    assert got == {1: ("done", 8), 2: ("blank", 0), 3: ("blank", 0)}
    want = ingest.hashed_bigrams(8)(["some text"])[0]
    assert ingest.embed_texts(good, embedder).where("id = 1").first()["embedding"] == [float(x) for x in want]
    bad = spark.createDataFrame([(4, "broken")], "id long, content string")
    assert ingest.embed_texts(bad, embedder).first()["outcome"] == "failed: TimeoutError: no answer"


def test_blocks_by_size(spark):
    import random

    from loomwright.operators import retrieval as R

    rng = random.Random(3)
    vector = lambda: [float(rng.randrange(5)) for _ in range(4)]
    memories = spark.createDataFrame([(i, 1 if i < 500 else i % 7, 0, vector()) for i in range(600)], "id long, user_id long, is_deleted int, embedding array<float>")
    queries = spark.createDataFrame([(i, i % 7 if i % 3 else 1, vector()) for i in range(40)], "query_id long, user_id long, embedding array<float>")
    rows = [sorted((r["query_id"], r["place"], r["memory_id"], round(r["score"], 9)) for r in R.vector_topk_blocked(queries, memories, 9, block=b).collect()) for b in (4096, 50, 7)]
    plain = sorted((r["query_id"], r["place"], r["memory_id"], round(r["score"], 9)) for r in R.top_per_query(R.vector_topk(queries, memories, 9).drop("place").selectExpr("query_id", "memory_id", "round(score, 12) AS score"), 9).collect())
    assert rows[0] == rows[1] == rows[2]
    assert [r[:2] + r[3:] for r in rows[0]] == [r[:2] + r[3:] for r in plain]


def test_keywords_by_size(spark):
    import math
    import random
    from collections import Counter

    from loomwright.operators import retrieval as R

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("aB é日𝒳\t\n ") for _ in range(rng.randrange(40))) if rng.random() < 0.95 else None
    memories = [(i, 1 if i < 150 else i % 7, int(i % 19 == 0), text()) for i in range(220)]
    queries = [(i, i % 7 if i % 3 else 1, text()) for i in range(40)] + [(99, None, "ab")]
    pairs = lambda t: [r[i : i + 2] for r in (t or "").lower().split() for i in range(len(r) - 1)]
    live = [(i, u, Counter(pairs(t))) for i, u, gone, t in memories if not gone]
    df = Counter(p for *_, tf in live for p in tf)
    want = []
    for q, user, t in queries:
        scored = [(round(sum(tf[p] * math.log10(len(live) / df[p]) ** 2 for p in set(pairs(t)) if p in tf), 9), i) for i, u, tf in live if u == user]
        want += [(q, n, i, s) for n, (s, i) in enumerate(sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1]))[:9], 1)]
    m = spark.createDataFrame(memories, "id long, user_id long, is_deleted int, content string")
    asked = spark.createDataFrame(queries, "query_id long, user_id long, text string")
    for block in (4096, 50, 7):
        got = sorted((r["query_id"], r["place"], r["memory_id"], r["score"]) for r in R.fulltext_topk(asked, m, 9, block=block).collect())
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
        assert all(abs(a[3] - b[3]) < 1e-8 for a, b in zip(got, sorted(want)))


def test_vectors_of_any_length(spark):
    from loomwright.operators import retrieval as R

    vectors = [[1.0, 0.0], [1.0], None, [], [3.0, 4.0], [2.0]]
    m = spark.createDataFrame([(i, 1, 0, v) for i, v in enumerate(vectors)], "id long, user_id long, is_deleted int, embedding array<float>")
    q = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors)], "query_id long, user_id long, embedding array<float>")
    for k, block in ((9, 4096), (9, 2), (9, 1)):
        got = {(r["query_id"], r["memory_id"]): round(r["score"], 6) for r in R.vector_topk_blocked(q, m, k, block=block).collect()}
        assert len(got) == 36 and {p: s for p, s in got.items() if s} == {(0, 0): 1, (0, 4): 0.6, (4, 0): 0.6, (4, 4): 1, (1, 1): 1, (1, 5): 1, (5, 1): 1, (5, 5): 1}
        best = {(r["query_id"], r["memory_id"]) for r in R.vector_topk_blocked(q, m, k, block=block, above=0.6).collect()}
        assert best == {(0, 0), (4, 4), (1, 1), (1, 5), (5, 1), (5, 5)}


def test_batches_are_mapped_in_slices():
    import pyarrow as pa

    from loomwright.functions.markdown import SLICE, in_slices

    texts = pa.array(["{a}", None, "", "x"] * 300)
    now = []

    class Watched:
        def __len__(self):
            return len(texts)

        def slice(self, at, n):
            now.append(min(n, len(texts) - at))
            return texts.slice(at, n)

    got = in_slices(Watched(), lambda t: None if t is None else [t, t], pa.list_(pa.string()))
    assert got.to_pylist() == [None if t is None else [t, t] for t in texts.to_pylist()]
    assert max(now) <= SLICE and sum(now) == len(texts)
    assert in_slices(pa.array([], pa.string()), str, pa.string()).to_pylist() == []
