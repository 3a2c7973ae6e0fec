"""Ranked lexical search without a document index: an automaton of all items' terms reads the texts.

Items are dealt into blocks of bounded size. A block's distinct terms become one Aho-Corasick
automaton, each term guarded by a space on either side; texts are brought to the same form (every
byte outside terms is a space), so that only whole terms match. A scan gives a document's number of
terms and the counts of the terms it holds, from which document frequencies and lengths are summed
up. Scores go from terms to the items that hold them; a task keeps each item's best documents only.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.texts import LOWER_AZ, utf8
from loomwright.session import Workspace

#: Table for ``bytes.translate``: A-Z to a-z; digits, letters and every byte of a character beyond ASCII stay; the rest is a space.
FORM = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER_AZ)
TOP = 20
#: Term bytes of the items of one block, unless a single item has more: what is broadcast at once.
BLOCK_BYTES = 32 << 20
#: Cells (documents x items) that scores are summed up in at once.
CELLS = 1 << 20
#: Groups in which tasks' lists meet before an item's list is made.
GROUPS = 64
HITS = "doc_id bigint, n bigint, terms binary, counts binary"
SCORED = "item int, doc_id bigint, score bigint"


def form(text: bytes) -> bytes:
    """UTF-8 text whose terms are lower-cased (A-Z only) and whose bytes outside terms are spaces."""
    return text.translate(FORM)


def terms_of(text: str | None) -> list[bytes]:
    return form((text or "").encode("utf-8", "replace")).split()


@dataclass(frozen=True)
class Block:
    """Items of one scan: ``rows`` (item_id, text) and ``terms``, numbered from 0."""

    rows: list[tuple]
    terms: list[bytes]

    @staticmethod
    def of(rows: list[tuple]) -> Block:
        return Block(rows, sorted({t for _, x in rows for t in terms_of(x)}))

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each term its items and how often they hold it: first places (one more than terms), items, repeats."""
        number = {t: i for i, t in enumerate(self.terms)}
        found = [(number[t], i, n) for i, (_, x) in enumerate(self.rows) for t, n in Counter(terms_of(x)).items()]
        found.sort()
        terms, items, repeats = (np.array(c, np.int64) for c in (zip(*found) if found else ((), (), ())))
        return np.searchsorted(terms, np.arange(len(self.terms) + 1)), items, repeats


def blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The distinct rows of ``items`` (item_id, text) in blocks of at most ``most`` bytes each, or of one row.
    They are dealt by a hash until each share is small enough, so no more than a block comes to the driver."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 16

    def split(share: DataFrame, level: int) -> Iterator[Block]:
        n, total = share.agg(F.count(F.lit(1)), F.sum(size)).first()
        if n and (n == 1 or total <= most):
            yield Block.of(sorted(((r["item_id"], r["text"]) for r in share.collect()), key=repr))
        elif n:
            parts = int(-(-2 * total // most))
            deal = F.pmod(F.xxhash64("item_id", "text", F.lit(level)), F.lit(parts))
            for k in range(parts):
                yield from split(share.where(deal == k), level + 1)

    yield from split(rows, 0)


def automaton_of(terms: list[bytes]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        made.add_word(f" {term.decode('latin-1')} ", i)
    made.make_automaton()
    return made


_automata: dict[str, ahocorasick.Automaton] = {}


def _scan(terms: list[bytes], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata.clear()
            _automata[key] = automaton_of(terms)
        automaton = _automata[key]
        for batch in batches:
            numbers, found, counts = [], [], []
            for text in batch.column(1).to_pylist():
                data = b" " + form(text) + b" "
                inside = np.frombuffer(data, np.uint8) != 32
                numbers.append(int(np.count_nonzero(inside[1:] & ~inside[:-1])))
                hits = Counter(i for _, i in automaton.iter(data.decode("latin-1"))) if terms else {}
                order = sorted(hits)
                found.append(np.array(order, "<u4").tobytes())
                counts.append(np.array([hits[i] for i in order], "<u4").tobytes())
            cols = [batch.column(0), pa.array(numbers, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in HITS.split(", ")])

    return run


def scan(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """HITS: each row's number of terms, which of ``terms`` it holds (their numbers, rising) and how often."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(_scan(terms, uuid.uuid4().hex), HITS)


def document_frequencies(hits: DataFrame, terms: int) -> np.ndarray:
    """How many rows of ``hits`` hold each of the ``terms``; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in batches:
            for found in batch.column(0):
                seen[np.frombuffer(found.as_buffer(), "<u4")] += 1  # a row names a term once
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(seen[held], pa.int64())], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in hits.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)


class Best:
    """The highest-scoring documents of each item among those offered."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)
        self.lists: list[list[tuple]] = [[] for _ in range(items)]

    def offer(self, scores: np.ndarray, doc_ids: list) -> None:
        """``scores``: a row for each document, a column for each item. Equal to the least still counts: the id decides."""
        docs, items = np.nonzero((scores > 0) & (scores >= self.least))
        touched = set()
        for d, i in zip(docs.tolist(), items.tolist()):
            doc_id = doc_ids[d]
            self.lists[i].append((-int(scores[d, i]), doc_id is not None, doc_id or 0))
            touched.add(i)
        for i in touched:
            if len(self.lists[i]) > self.top:
                self.lists[i] = sorted(self.lists[i])[: self.top]
                self.least[i] = -self.lists[i][-1][0]

    def rows(self) -> Iterator[tuple]:
        for i, found in enumerate(self.lists):
            for score, known, doc_id in found:
                yield i, doc_id if known else None, -score


def _score(weight: np.ndarray, postings: tuple, items: int, documents: int, length: int, top: int):
    first, of, repeats = postings
    fan, step = np.diff(first), max(1, CELLS // max(1, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, top)
        for batch in batches:
            doc_ids, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            norm = 100 - 25 + (25 * numbers * documents) // length
            for at in range(0, len(doc_ids), step):
                some = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(2)[at : at + step]]
                rows = np.repeat(np.arange(len(some)), [len(x) for x in some])
                terms = np.concatenate(some).astype(np.int64) if some else np.zeros(0, np.int64)
                tf = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(3)[at : at + step]]).astype(np.int64)
                gain = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[at : at + step][rows]))
                # Each hit goes to all items that hold its term.
                wide = fan[terms]
                inner = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
                post = np.repeat(first[terms], wide) + inner
                scores = np.zeros(len(some) * items, np.int64)
                np.add.at(scores, np.repeat(rows, wide) * items + of[post], np.repeat(gain, wide) * repeats[post])
                best.offer(scores.reshape(len(some), items), doc_ids[at : at + step])
        item, doc_id, score = zip(*best.rows()) if any(best.lists) else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _search(hits: DataFrame, block: Block, documents: int, length: int, top: int) -> DataFrame:
    weight = weights(document_frequencies(hits, len(block.terms)), documents)
    rows = hits.where(F.octet_length("terms") > 0).mapInArrow(_score(weight, block.postings(), len(block.rows), documents, length, top), SCORED)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # Tasks' lists meet in groups first, so that an item's last list is made of few rows however many tasks there are.
    rows = rows.withColumn("group", F.spark_partition_id() % GROUPS)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = hits.sparkSession.createDataFrame([(i, x[0]) for i, x in enumerate(block.rows)], "item int, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents (doc_id, text) of each row of ``items`` (item_id, text).

    A null text has no terms: such a document counts for nothing, such an item gets no rows. Equal scores
    go by ascending doc_id, null first. Repeated documents are ranked each. Rows of ``items`` that are equal in
    both columns are one item; other rows with one item_id are answered each, with ranks of their own. If either table is empty, or no document has a term, there are no
    rows. Other columns are ignored. Every text is read once for each block of items.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lexical")
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for k, block in enumerate(blocks(items)):
        hits = work.put(scan(docs, block.terms), f"hits-{k}")
        documents, length = hits.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if documents and block.terms:
            out = out.unionByName(_search(hits, block, documents, length, top))
    return out
