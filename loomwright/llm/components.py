"""Connected components of a link table, by alternating large-star and small-star steps.

(Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and
Beyond, 2014.) Each step is an aggregation with partial sums and one join that AQE may split,
so neither a hub nor a large component meets in one task. Each round is written to the shared
folder; only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import Workspace


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b). Large star: both directions of each link, larger neighbours move to the
    least one. Small star: smaller neighbours and the node itself move to the least one."""
    seen = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = seen.join(least, "a").select(F.col("a"), F.col("b"), F.col("m"))
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, work: Workspace, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node."""
    now = work.put(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{name}-0"
    )
    before = _sum(now)
    for step in range(1, most_rounds + 1):
        if not before[0]:
            break
        now = work.put(_star(_star(now, True), False), f"{name}-{step}")
        after = _sum(now)
        work.drop(f"{name}-{step - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
