"""Row numbers as 64-bit numbers; ranks whose groups no task needs to see whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.session import Workspace


def numbered(window: WindowSpec) -> Column:
    return F.row_number().over(window).cast("bigint")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their number from 1 (``name``) within each group of ``by`` in the given order, which no two rows share.

    Rows are dealt by sampled ranges of group and order, and written; sizes of a group's pieces are added
    up first (a row for each group and partition), and each piece is numbered on its own. So neither a
    hot group nor an outlying value brings more than a partition's rows to one task.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *[F.asc(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    dealt = Workspace(spark, "ranks").put(dealt, "dealt")
    key = [*by, "__part"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*key, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    own = numbered(W.partitionBy(*[f"d.{c}" for c in key]).orderBy(*order))
    joined = dealt.alias("d").join(before.alias("b"), reduce(Column.__and__, same))
    return joined.select(*[F.col(f"d.{c}") for c in rows.columns], (F.col("__before") + own).alias(name))
