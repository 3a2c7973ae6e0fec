"""Evaluation and load summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of task quality and personal accuracy by task type; fixed values.
QUALITY_WEIGHTS = {"personalized": (0.4, 0.6), "tech_writing": (0.6, 0.4), "generic_qa": (0.8, 0.2)}


def query_metrics(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, grp, recall, reciprocal_rank, hit1) from ranked (query_id, memory_id, place) and
    judged (query_id, grp, relevant_ids)."""
    wanted = judged.select("query_id", "grp", F.explode_outer(F.array_distinct("relevant_ids")).alias("memory_id"))
    hits = wanted.join(ranked.select("query_id", "memory_id", "place"), ["query_id", "memory_id"], "left")
    return hits.groupBy("query_id", "grp").agg(
        F.coalesce(F.count("place") / F.nullif(F.count("memory_id"), F.lit(0)), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.min("place"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.max(F.when(F.col("place") == 1, 1.0)), F.lit(0.0)).alias("hit1"),
    )


def retrieval_metrics(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """Means per group and overall (grp null): queries, recall, mrr, hit1."""
    return query_metrics(ranked, judged).groupingSets([["grp"], []], "grp").agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg("hit1"), 6).alias("hit1"),
    )


def answer_quality(scores: DataFrame) -> DataFrame:
    """(task_type or null for all, tasks, overall, share_good) from (task_type, tq, pa)."""
    overall = F.lit(None).cast("double")
    for kind, (tq, pa) in QUALITY_WEIGHTS.items():
        overall = F.when(F.col("task_type") == kind, tq * F.col("tq") + pa * F.col("pa")).otherwise(overall)
    rows = scores.withColumn("overall", F.round(overall, 9)).where("overall IS NOT NULL")
    return rows.rollup("task_type").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.round(F.avg("overall"), 6).alias("overall"),
        F.round(F.avg(F.when(F.col("overall") >= 4, 1.0).otherwise(0.0)), 6).alias("share_good"),
    )


def latency_summary(samples: DataFrame) -> DataFrame:
    """Per run from (run, started_ms, elapsed_ms, ok): counts, mean, extremes, percentiles at fixed
    ranks of the sorted samples, and requests per second from first start to last.

    Samples are counted by elapsed time first, so that what is sorted per run are distinct times.
    """
    counts = samples.groupBy("run", "elapsed_ms").agg(
        F.count(F.lit(1)).alias("k"), F.count_if(~F.col("ok")).alias("bad"), F.min("started_ms").alias("first"), F.max("started_ms").alias("last")
    )
    mine = W.partitionBy("run")
    upto = F.sum("k").over(mine.orderBy("elapsed_ms").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("k").over(mine)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("elapsed_ms")))
    seconds = (F.max("last") - F.min("first")) / 1000
    return ranked.groupBy("run").agg(
        F.sum("k").alias("samples"),
        F.sum("bad").alias("errors"),
        F.round(F.sum(F.col("elapsed_ms") * F.col("k")) / F.sum("k"), 6).alias("mean"),
        F.min("elapsed_ms").alias("min"),
        F.max("elapsed_ms").alias("max"),
        at(F.floor(F.col("n") / 2)).alias("p50"),
        at(F.floor(F.col("n") * 0.9)).alias("p90"),
        at(F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)).alias("p99"),
        F.round(F.sum("k") / F.nullif(seconds, F.lit(0.0)), 6).alias("tps"),
    )


def latency_median(rounds: DataFrame) -> DataFrame:
    """The median over the runs of ``latency_summary``; those of percentiles are cut to whole numbers."""
    cut = lambda c: F.floor(F.median(c)).cast("bigint").alias(c)
    return rounds.agg(F.count(F.lit(1)).alias("runs"), F.round(F.median("tps"), 6).alias("tps"), *[cut(c) for c in ("p50", "p90", "p99")])
