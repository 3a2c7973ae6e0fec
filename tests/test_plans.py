"""What physical plans must and must not hold."""

from compare import DATA

from loomwright.operators import retrieval as R
from loomwright.operators import social as S
from loomwright.plans import catalog
from loomwright.sources.adapters import view

SF = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_built_in_queries(spark):
    blocked = {"vector_topk_blocked", "hybrid_search", "memory_context", "retrieval_metrics", "update_target", "merge_memories", "memory_history"}
    helpers = blocked | {"embed_texts", "embed_values", "extract_json_objects", "render_blocks_document", "comment_dedup", "rate_limit", "heartbeat_throttle"}
    helpers |= {"normalize_article_strict", "normalize_by_policy"}
    for name, query in catalog.queries().items():
        if name not in helpers:
            text = plan(query(spark, SF))
            assert "Python" not in text and "Arrow" not in text and "Pandas" not in text, name


def test_no_cartesian_product(spark):
    for name in ("leaderboard", "article_detail", "author_overview", "author_daily_trend", "vector_topk", "comment_threads", "notification_fanout"):
        assert "CartesianProduct" not in plan(catalog.queries()[name](spark, SF)), name


def test_filters_and_columns_reach_the_scan(spark):
    article = view(spark, SF, "article")
    text = plan(S.leaderboard(view(spark, SF, "interaction"), article))
    assert "o_totalprice" not in text and "PushedFilters" in text
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert "GreaterThan(o_orderkey,10)" in plan(orders.where("o_orderkey > 10").select("o_orderkey"))
    lean = plan(R.memory_counts(view(spark, SF, "memory_record")))
    assert "embedding" not in lean.split("ReadSchema")[1].split("\n")[0]


def test_norms_are_made_before_pairs(spark):
    pairs = plan(catalog.queries()["cosine_similarity"](spark, SF)).split("Join")[0]
    assert pairs.count("aggregate(") == 1
