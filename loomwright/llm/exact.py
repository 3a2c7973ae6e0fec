"""Exact deduplication against a persistent digest index (DataFrame functions only).

The index is a table of one row per distinct normalised text (SHA-256 digest, id of the row
that stays), bucketed and sorted by digest. New data is first reduced to one row per digest,
with partial aggregation before the shuffle, so that a group of copies of any size becomes one
row. A sort-merge anti-join with the index leaves the unseen digests, which are appended; a second
join of that kind reads the verdicts of the new data's digests from it. The index side of both
is read by its buckets and never shuffled; Spark sorts each bucket again, as it has a sorted
file of every append.

The number of buckets is part of the index: an empty file beside the data names version and
buckets. An append that makes buckets too large, or their files too many, writes the index anew as
the next version. Only one append runs at a time, by a lock file. A repeated append finds its own
digests and keep_ids in the index and gives the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.texts import lower_az
from loomwright.session import Workspace, shared_folder

#: Rows of a bucket when the index is written (about 80 bytes each), and how often that it may hold.
BUCKET_ROWS = 1_000_000
GROWTH = 4
LEAST_BUCKETS = 16
#: Files of a bucket, one for each append, before the index is written anew.
MOST_FILES = 16
ROW = "digest STRING, keep_id BIGINT, group_size BIGINT"


class DigestIndex:
    """Digests seen so far, kept in ``path``; make one again with the same path to go on.

    ``buckets`` fixes their number; where it isn't given it goes by the rows. An index that was written
    with another number is written anew by the next append.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}"

    def _file(self, name: str = ""):
        """A path below the index, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def layout(self) -> tuple[int, int] | None:
        """Version and buckets of the index; None before the first append."""
        path, files = self._file()
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        found = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("layout-")]
        return max(found, default=None)

    def data(self, version: int) -> str:
        return f"{self.path}/data-{version}"

    @contextmanager
    def _locked(self) -> Iterator[None]:
        path, files = self._file("lock")
        if not files.createNewFile(path):
            raise RuntimeError(f"another append holds {path}; delete it if that one was killed")
        try:
            yield
        finally:
            files.delete(path, False)

    @contextmanager
    def _table(self, version: int, buckets: int) -> Iterator[str]:
        """The data as a table of the catalog, while it is needed."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({ROW}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.data(version)}'"
        )
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    def _write(self, rows: DataFrame, version: int, buckets: int, name: str) -> None:
        rows = rows.select("digest", "keep_id", "group_size").repartition(buckets, "digest")
        write = rows.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").mode("append")
        write.option("path", self.data(version)).saveAsTable(name)

    def _start(self, version: int, rows: int, entries: DataFrame | None = None) -> tuple[int, int]:
        """A new version with buckets for ``rows``, holding ``entries``; the one before the last goes."""
        buckets = self.buckets or LEAST_BUCKETS
        while not self.buckets and buckets * BUCKET_ROWS < rows:
            buckets *= 2
        path, files = self._file(f"data-{version}")
        files.delete(path, True)  # of an attempt that failed
        if entries is not None:
            with self._table(version, buckets) as name:
                self._write(entries, version, buckets, name)
        path, files = self._file(f"layout-{version}-{buckets}")
        files.createNewFile(path)
        for status in files.listStatus(path.getParent()):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in ("layout", "data") and int(number.split("-")[0]) < version - 1:
                files.delete(status.getPath(), True)
        return version, buckets

    def _fitting(self, rows: int) -> tuple[int, int]:
        """Version and buckets for ``rows`` more, written anew where they don't fit."""
        now = self.layout()
        if now is None:
            return self._start(1, rows)
        version, buckets = now
        path, files = self._file(f"data-{version}")
        count = len(files.listStatus(path)) if files.exists(path) else 0
        size = self.entries().count() + rows
        large = not self.buckets and size > GROWTH * BUCKET_ROWS * buckets
        if large or count > MOST_FILES * buckets or self.buckets not in (None, buckets):
            return self._start(version + 1, size, self.entries())
        return now

    def append_new(self, groups: DataFrame, rows: int, work: Workspace) -> DataFrame:
        """Adds the digests that the index lacks and gives the index's rows of all of ``groups``, which
        has one row per digest, ``rows`` at most."""
        with self._locked():
            version, buckets = self._fitting(rows)
            with self._table(version, buckets) as name:
                new = self.beside(groups, name, buckets, "left_anti")
                self._write(new, version, buckets, name)
                # Written, so that the caller's join may split a hot digest, which buckets forbid.
                return work.put(self.beside(groups.select("digest"), name, buckets, "inner"), "verdicts")

    def beside(self, groups: DataFrame, name: str, buckets: int, kind: str) -> DataFrame:
        """Sort-merge join of ``groups`` with the index. They are dealt by its buckets first: with more
        shuffle partitions than buckets Spark would shuffle the index instead."""
        seen = self.spark.table(name)
        seen = seen.select("digest") if kind == "left_anti" else seen
        return groups.repartition(buckets, "digest").hint("merge").join(seen.hint("merge"), "digest", kind)

    def entries(self) -> DataFrame:
        """All rows of the index."""
        return self.spark.read.schema(ROW).parquet(self.data(self.layout()[0]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of each row; null text counts as empty, only A-Z are lower-cased."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.sha2(lower_az(F.coalesce(F.col("text"), F.lit(""))), 256).alias("digest"),
    )


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of equal texts in one call the largest doc_id stays; a text that an earlier call put into
    the index has its keep_id and group_size from there, and the new rows are not kept. A null doc_id counts
    as the smallest (keep_id is null where all are). Repeated rows with one doc_id count in
    group_size and share the verdict. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    found = work.put(digests(docs), "digests")
    groups = found.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    index = index or DigestIndex(spark)
    verdicts = index.append_new(groups, found.count(), work)
    return (
        found.join(verdicts, "digest")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that ``exact_duplicates`` drops.

    Repeated rows of one doc_id with equal text count as one document: one of them stays.
    """
    least = F.lit(-(1 << 63))
    keys = ["__id", "__digest"]
    kept = exact_duplicates(docs).where("kept").select(F.coalesce("doc_id", least).alias("__id"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(lower_az(F.coalesce(F.col("text"), F.lit(""))), 256)
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("bigint"), least), "__digest": digest})
    # Both steps need the same keys, so that texts are shuffled once.
    return marked.join(kept.distinct(), keys, "left_semi").dropDuplicates(keys).drop(*keys)
