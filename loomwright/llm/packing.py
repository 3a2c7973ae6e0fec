"""Packing of tokenised documents into sequences: first-fit decreasing, in random groups.

A document's ids and the closing id are cut into full sequences and one remainder. Full sequences
need no packing. Documents get a random group, dealt when their pieces are written: equal rows, too,
fall apart. Each group of a few thousand documents is packed on its own, and groups need nothing
of each other. In a group the remainders come by falling length, and
each goes to the first bin with room: a tournament tree over the bins' free room, whose nodes
hold the largest room below them, finds that bin in logarithmic time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.texts import utf8
from loomwright.session import Workspace

LENGTH = 1024
CLOSING = 0
GROUP = 8192
SEED = 17
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
WRITTEN = f"{PIECES}, number bigint, deal bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"
#: Runs of white space (Unicode's White_Space) that are too long for the library's pattern, which
#: keeps a state for each character of a run and fails at a million.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
SPECIAL = "<|endoftext|>"


def load_encoder(name: str = "byte_bpe_50k"):
    """text -> ids, as ``tokenizers`` gives them for ``name``.json without added special tokens.

    The ranks file holds the same vocabulary; its library needs a third of the time. A special
    token's string in a text becomes its id, as there. Long runs of white space are cut off as the
    pattern would: all but the last character before a word, all of it before the end.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    made = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: 50256})
    whole = tiktoken.Encoding(f"{name}_whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_RUN.finditer(text):
            ends = run.end() == len(text) or text.startswith(SPECIAL, run.end())
            stop = run.end() if ends else run.end() - 1
            ids += made.encode(text[at : run.start()], allowed_special="all") + whole.encode_ordinary(text[run.start() : stop])
            at = stop
        return ids + made.encode(text[at:], allowed_special="all")

    return encode


_encoders: dict = {}


def _pieces(name: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders[name] = load_encoder(name)
        encode = _encoders[name]
        # Numbers of pieces and deals of documents go by the partition and by the order in it.
        task, number, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows, of = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(data.decode("utf-8", "replace")), CLOSING], "<u4")
                deal = xxhash.xxh64_intdigest(f"{task} {row}", SEED) >> 2
                row += 1
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    rows.append((at, len(part), zlib.crc32(part.tobytes()), len(ids), task << 40 | number, deal))
                    number += 1
                    of.append(i)
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            ids = batch.column(0).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *cols], [x.split()[0] for x in WRITTEN.split(", ")])

    return run


def first_fit(lengths: list[int], room: int) -> list[int]:
    """Bin of each item, items taken in the order given; the first bin with room gets it."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [room] * (2 * leaves)
    bins = []
    for need in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins.append(node - leaves)
        free[node] -= need
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins


def _pack(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("number", "ascending")])
        sizes = rows.column("length").to_pylist()
        bins = first_fit(sizes, length)
        used: dict[int, int] = {}
        offsets = []
        for size, b in zip(sizes, bins):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + size
        base = key[0].as_py() << 33
        out = rows.select([x.split()[0] for x in PIECES.split(", ")])
        out = out.append_column("sequence_id", pa.array([base + 2 * b for b in bins], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """A row of PACKED for each piece of each row of ``docs`` (doc_id, text).

    Null text counts as empty: one piece with the closing id alone. Repeated rows are packed
    as documents of their own. An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "packing")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    pieces = work.put(narrow.mapInArrow(_pieces(tokenizer, length), WRITTEN), "pieces")
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group))
    packed = rests.withColumn("group", F.pmod("deal", F.lit(groups))).groupBy("group").applyInArrow(_pack(length), PACKED)
    # Sequences of groups have even numbers, those that one piece fills have odd ones.
    full = pieces.where(F.col("length") == length).select(
        *[x.split()[0] for x in PIECES.split(", ")], (2 * F.col("number") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.unionByName(full)
