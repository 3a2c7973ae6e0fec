"""Session settings and the shared work folder that every job uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the jobs assume; a cluster's own settings for sizes stay as they are.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "loomwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` (dots written as ``__``) overrides them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master (tests) gets a temporary folder; a cluster gets an error,
    as a machine-local folder would lose files there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-loomwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables of one job run, in a new folder below the shared folder.

    ``put`` writes a table and reads it back: lineage ends there, so a lost executor costs a
    reread and not a recomputation. ``drop`` deletes a table that nothing needs any more.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer: work on each row alone then
    uses them all. A large table has more partitions and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of input files for each partition of ``parts_for``.
PART_BYTES = 16 << 20


def parts_for(*dfs: DataFrame) -> int:
    """Shuffle partitions as the session has them, or more: one for each PART_BYTES in the folders of the tables' files,
    so that a task's rows don't grow with the input."""
    spark = dfs[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = {path.rpartition("/")[0] for df in dfs for path in df.inputFiles()}
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(folders)]
    size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{os.fspath(folder).rstrip('/')}/{name}.parquet")
