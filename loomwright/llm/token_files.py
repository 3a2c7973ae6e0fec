"""Token files: documents as ids in byte-aligned variable-length coding, written in doc_id order.

Ids are replaced by their rank of frequency, so that the most frequent 256 take one byte. A document's
ranks are coded four at a time: a control byte holds four sizes of two bits, and the bytes of the
ranks, one to four each, stand in a stream of their own. A reader looks a block's control bytes up in
a table of sizes, whose running sum gives the place of every rank at once.

A file is MAGIC and blocks. A block has a HEAD (entries, ids, control bytes, data bytes, crc32 of what
follows), then its entries' doc_ids (i8), states (u1: NO_ID, CONTINUED) and numbers of ids (u4), its
control bytes and its data. An entry's control bytes begin anew; a document that is too long for a
block goes on in the next. ``ranks`` (rank, id, n) belongs to the files as their alphabet.

Texts are encoded by the ``tokenizers`` library word by word: nothing in the tokenizer's rules
reaches over ASCII white space.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.texts import utf8
from loomwright.session import Workspace

TOKENIZER = "word_bpe_49k.json"
CLOSING = 2
MAGIC = b"RVB1"
HEAD = struct.Struct("<5I")
NO_ID, CONTINUED = 1, 2
#: Ids of a block, bytes of a file before the next begins, coded bytes of a shard that are aimed at.
BLOCK_IDS = 1 << 16
FILE_BYTES = 1 << 30
SHARD_BYTES = 256 << 20
#: Shards of a run; their first places are summed up in one task.
MOST_SHARDS = 8192
#: Ids that are coded at once, whole documents apart.
CODED_AT_ONCE = 1 << 19
#: Bytes of texts that are split at once; units that a task remembers (it forgets all when there are
#: more), and their longest; units that the library is asked at once.
PIECE = 8 << 20
REMEMBERED, LONGEST = 800_000, 64
ASKED = 4096
#: Bytes of ids after which a reader hands a batch on.
BATCH_BYTES = 8 << 20
SPACE = re.compile(rb"[\x20\t-\r]")
END = "</w>"
#: What stands apart from letters in lower-cased Latin-1 words, whose letters and numbers are few enough
#: to list: endings with an apostrophe, runs of signs, single digits. A pattern of Arrow's library.
APART = "('s|'t|'re|'ve|'m|'ll|'d|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+|[0-9²³¹¼-¾])"
#: Sizes of the four ranks of each control byte.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1

ENCODED = "doc_id bigint, number bigint, tokens bigint, tie bigint, ids binary"
CODED = "doc_id bigint, number bigint, tokens bigint, tie bigint, coded binary"
MANIFEST = "shard bigint, piece bigint, path string, documents bigint, tokens bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of UTF-8 texts as the library gives them without added special tokens, as bytes of ``kind``.

    A batch's distinct words (between ASCII white space) fall into the tokenizer's own units: runs of
    letters, single digits, runs of signs. The library is asked for each new unit, many at a time with a
    space between: each makes just one token that ends a word, which tells where the next begins.
    Units are remembered. Words beyond Latin-1, or with a special token, are asked whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.vocabulary = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith(END)
        special = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.odd = "|".join([r"[^\x00-\x{ff}]|[\x{85}\x{a0}]", *special])
        self.units: dict[str, bytes] = {"": b""}

    def ask(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def ask_units(self, units: list[str]) -> list[bytes]:
        ids = np.array(self.model.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, self.kind)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
        if len(cuts) != len(units):
            return self.ask(units)
        data, cuts = ids.tobytes(), [0, *cuts.tolist()]
        return [data[x:y] for x, y in pairwise(cuts)]

    def _of_units(self, units: list[str]) -> list[bytes]:
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > REMEMBERED:
            self.units = {"": b""}
            new = [u for u in units if u]
        for at in range(0, len(new), ASKED):
            self.units.update(zip(new[at : at + ASKED], self.ask_units(new[at : at + ASKED])))
        found = list(map(self.units.__getitem__, units))
        for u in new:
            if len(u) > LONGEST:
                del self.units[u]
        return found

    def _of_words(self, words: pa.StringArray) -> pa.BinaryArray:
        """The ids of distinct words."""
        odd = np.array(pc.match_substring_regex(words, self.odd))
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.take(pa.array(plain))), APART, r" \1 "))
        units = split.values.dictionary_encode()
        found = pa.concat_arrays([
            _joined(pa.array(self._of_units(units.dictionary.to_pylist()), pa.binary()).take(units.indices), split.offsets),
            pa.array(self.ask(words.take(pa.array(other)).to_pylist()), pa.binary()),
        ])
        place = np.empty(len(words), np.int64)
        place[np.concatenate([plain, other])] = np.arange(len(words))
        return found.take(pa.array(place))

    def _of_texts(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))
        words = split.values.dictionary_encode()
        found = _joined(self._of_words(words.dictionary).take(words.indices), split.offsets)
        return found.to_pylist()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Texts are taken together up to PIECE bytes, longer ones in parts."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._of_texts([part for _, part in held])):
                out[i].append(ids)
            held.clear()

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = SPACE.search(text, at + PIECE)
                end = cut.end() if cut else len(text)
                held.append((i, text[at:end]))
                size += end - at
                if size >= PIECE:
                    flush()
                    size = 0
                at = end
        if held:
            flush()
        return [b"".join(x) for x in out]


def _joined(parts: pa.BinaryArray, offsets: pa.Array) -> pa.BinaryArray:
    """Neighbouring parts as one value: value i has the parts from offsets[i] on, before offsets[i + 1]."""
    if not len(parts):
        return pa.array([b""] * (len(offsets) - 1), pa.binary())
    places = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(places[np.array(offsets)].tobytes()), parts.buffers()[2]])


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, closing: int) -> DataFrame:
    """ENCODED: a row's ids with the closing one; ``number`` is unique, ``tie`` goes by the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = _encoder(path), TaskContext.get().partitionId() << 40
        end = np.array([closing], model.kind).tobytes()
        for batch in batches:
            ids = [x + end for x in model.encode(batch.column(1).to_pylist())]
            n = len(ids)
            cols = [
                batch.column(0), pa.array(range(number, number + n), pa.int64()), pa.array([len(x) // model.kind.itemsize for x in ids], pa.int64()),
                pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(ids, pa.binary()),
            ]
            number += n
            yield pa.RecordBatch.from_arrays(cols, _names(ENCODED))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(run, ENCODED)


def _ids(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a binary column, one row after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return np.frombuffer(column.buffers()[2], np.uint8, last - first, first).view(kind) if last > first else np.zeros(0, kind)


def frequency_ranks(rows: DataFrame, kind: str, vocabulary: int) -> DataFrame:
    """(rank, id, n) of every id of the vocabulary in all ``rows`` (ids), the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for batch in batches:
            seen += np.bincount(_ids(batch.column(0), kind), minlength=vocabulary)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found], pa.int64())], ["id", "n"])

    counts = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    whole = rows.sparkSession.range(vocabulary).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    # One task, with a row for each id of the vocabulary.
    return whole.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("bigint").alias("rank"), "id", "n")


def code(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control bytes, data bytes) of each of the runs that ``ranks`` holds one after the other, by their ``counts``."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-counts // 4)
    control_at, data_at = np.concatenate([[0], np.cumsum(quads)]), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    first = np.concatenate([[0], np.cumsum(counts)])
    two = np.zeros(4 * int(control_at[-1]), np.uint8)
    two[np.arange(len(ranks)) + np.repeat(4 * control_at[:-1] - first[:-1], counts)] = size - 1
    two = two.reshape(-1, 4)
    control = (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).astype(np.uint8).tobytes()
    width = int(size.max()) if len(size) else 1
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) < size[:, None]].tobytes()
    at = data_at[first].tolist()
    return [(control[a:b], data[x:y]) for (a, b), (x, y) in zip(pairwise(control_at.tolist()), pairwise(at))]


def decode(counts: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks of a block, entry after entry: sizes by table, places by running sum."""
    slots = (counts + 3) // 4 * 4
    size = SIZES[control].ravel().astype(np.int64)
    real = np.ones(len(size), bool)
    ends = np.cumsum(slots)
    for k in (1, 2, 3):  # the last control byte of an entry may have up to three free places
        real[(ends - k)[slots - counts >= k]] = False
    size = size[real]
    place = np.cumsum(size) - size
    ranks = data[place].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        ranks[longer] |= data[place[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _coded(kind: str, rank_of: np.ndarray):
    """Each row's ids as coded runs of BLOCK_IDS at most, one after the other, each after its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.array(batch.column(2))
            upto = np.concatenate([[0], np.cumsum(tokens)])
            ids, out, row = _ids(batch.column(4), kind), [], 0
            while row < len(tokens):  # rows of some CODED_AT_ONCE ids together
                end = max(row + 1, int(np.searchsorted(upto, upto[row] + CODED_AT_ONCE, "right")) - 1)
                runs = -(-tokens[row:end] // BLOCK_IDS)
                counts = np.full(int(runs.sum()), BLOCK_IDS)
                counts[np.cumsum(runs) - 1] = tokens[row:end] - (runs - 1) * BLOCK_IDS
                made = iter(code(rank_of[ids[upto[row] : upto[end]]], counts))
                for n in runs.tolist():
                    out.append(b"".join(x for _ in range(n) for c, d in (next(made),) for x in ((len(c) + len(d)).to_bytes(4, "little"), c, d)))
                row = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], _names(CODED))

    return run


class Block:
    """Entries gathered for one block."""

    def __init__(self):
        self.ids, self.states, self.counts, self.control, self.data = [], [], [], [], []
        self.total = self.bytes = 0

    def add(self, doc_id: int | None, state: int, count: int, run: bytes) -> None:
        cut = -(-count // 4)
        self.ids.append(doc_id or 0)
        self.states.append(state | (NO_ID if doc_id is None else 0))
        self.counts.append(count)
        self.control.append(run[:cut])
        self.data.append(run[cut:])
        self.total += count
        self.bytes += 13 + len(run)

    def packed(self) -> bytes:
        control, data = b"".join(self.control), b"".join(self.data)
        body = np.array(self.ids, "<i8").tobytes() + np.array(self.states, np.uint8).tobytes() + np.array(self.counts, "<u4").tobytes() + control + data
        return HEAD.pack(len(self.ids), self.total, len(control), len(data), zlib.crc32(body)) + body


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        shard, piece = TaskContext.get().partitionId(), 0
        out, path, written, documents, tokens = None, "", 0, 0, 0
        block = Block()

        def manifest() -> pa.RecordBatch:
            values = zip((shard, piece, f"{folder}/{path}", documents, tokens), _names(MANIFEST))
            return pa.RecordBatch.from_pydict({k: [v] for v, k in values})

        for batch in batches:
            for doc_id, n, coded in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4)):
                if out is None:
                    path, written, documents, tokens = f"{uuid.uuid4().hex}.ids", len(MAGIC), 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                    out.write(MAGIC)
                runs, at, left = memoryview(coded.as_buffer()), 0, n
                while left:
                    size, count = int.from_bytes(runs[at : at + 4], "little"), min(left, BLOCK_IDS)
                    if block.total + count > BLOCK_IDS and block.total:
                        data, block = block.packed(), Block()
                        out.write(data)
                        written += len(data)
                    block.add(doc_id, 0 if left == n else CONTINUED, count, bytes(runs[at + 4 : at + 4 + size]))
                    at, left = at + 4 + size, left - count
                documents, tokens = documents + 1, tokens + n
                if written + block.bytes > file_bytes:  # a document ends here
                    out.write(block.packed())
                    out.close()
                    block, out = Block(), None
                    yield manifest()
                    piece += 1
        if out is not None:
            out.write(block.packed())
            out.close()
            yield manifest()

    return run


@dataclass(frozen=True)
class TokenFiles:
    """Files of one run: ``manifest`` (MANIFEST; shards and their pieces rise with doc_id) and ``ranks``."""

    manifest: DataFrame
    ranks: DataFrame


def write_token_files(docs: DataFrame, tokenizer: str | None = None, closing: int = CLOSING, file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Writes all rows of ``docs`` (doc_id, text) in ascending doc_id order, null ids first.

    Null text counts as empty: the closing id alone. Rows with one doc_id stand side by side, ordered
    by the crc32 of their ids; repeated rows are written each. An empty table gives no file; other
    columns are ignored. The order is made by range partitions over (doc_id, crc32, row number), so that
    not even a doc_id with a third of all rows is one task's.
    """
    path, work = tokenizer or tokenizer_path(), Workspace(docs.sparkSession, "token-files")
    model = _encoder(path)
    kind, vocabulary = model.kind.str, max(model.vocabulary, closing + 1)
    rows = work.put(encoded(docs, path, closing), "encoded")
    ranks = work.put(frequency_ranks(rows, kind, vocabulary), "ranks")
    rank_of = np.zeros(vocabulary, np.uint32)
    total = 0
    for r in ranks.collect():  # as many rows as the vocabulary has ids
        rank_of[r["id"]] = r["rank"]
        total += r["n"]
    work.put(docs.sparkSession.range(0), "files")  # makes the folder
    shards = min(MOST_SHARDS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-2 * total // SHARD_BYTES)))
    order = ["doc_id", "tie", "number"]
    placed = rows.mapInArrow(_coded(kind, rank_of), CODED).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = work.put(placed.mapInArrow(_write(f"{work.path}/files", file_bytes), MANIFEST), "manifest")
    work.drop("encoded")
    return TokenFiles(manifest, ranks)


def blocks_of(stream) -> Iterator[tuple]:
    """(doc_ids, states, counts, ranks) of each block of one file; an error where its crc32 doesn't match."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(HEAD.size):
        k, n, c, d, crc = HEAD.unpack(head)
        body = stream.read(13 * k + c + d)
        if len(body) != 13 * k + c + d or zlib.crc32(body) != crc:
            raise ValueError("a block does not match its checksum")
        ids, states = np.frombuffer(body, "<i8", k), np.frombuffer(body, np.uint8, k, 8 * k)
        counts = np.frombuffer(body, "<u4", k, 9 * k).astype(np.int64)
        ranks = decode(counts, np.frombuffer(body, np.uint8, c, 13 * k), np.frombuffer(body, np.uint8, d, 13 * k + c))
        if len(ranks) != n:
            raise ValueError("a block does not hold as many ids as it says")
        yield ids, states, counts, ranks


def _read(ids_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held = 0

        def batch_of(done: list[list]) -> pa.RecordBatch:
            doc_ids, starts, parts = zip(*done)
            data = [b"".join(p) for p in parts]
            cols = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, _names(READ))

        for batch in batches:
            for path, place in zip(*(c.to_pylist() for c in batch.columns)):
                store, local = fs.FileSystem.from_uri(path)
                with store.open_input_stream(local, compression=None) as stream:
                    for doc_ids, states, counts, ranks in blocks_of(stream):
                        data = memoryview(ids_of[ranks].tobytes())
                        at = 0
                        for doc_id, state, n in zip(doc_ids.tolist(), states.tolist(), counts.tolist()):
                            part = data[at : at + 4 * n]
                            at, held = at + 4 * n, held + 4 * n
                            if state & CONTINUED:
                                rows[-1][2].append(part)
                            else:
                                if held > BATCH_BYTES and rows:
                                    yield batch_of(rows)
                                    rows, held = [], 4 * n
                                rows.append([None if state & NO_ID else doc_id, place, [part]])
                            place += n
        if rows:
            yield batch_of(rows)

    return run


def read_token_files(files: TokenFiles) -> DataFrame:
    """READ: each document's id, ``start`` (ids before it in all files), number of ids and the ids
    themselves as little-endian unsigned 32-bit integers. Blocks are verified by their crc32."""
    ids_of = np.zeros(files.ranks.count(), "<u4")
    for r in files.ranks.select("rank", "id").collect():  # as many rows as the vocabulary has ids
        ids_of[r["rank"]] = r["id"]
    manifest = files.manifest
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One task, with a row for each of MOST_SHARDS shards at most; then each shard's pieces.
    shards = manifest.groupBy("shard").agg(F.sum("tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("tokens").over(before.partitionBy("shard").orderBy("piece")), F.lit(0))
    placed = manifest.withColumn("inside", inside).join(F.broadcast(shards), "shard").select("path", (F.col("first") + F.col("inside")).alias("place"))
    return placed.repartition(max(1, min(10_000, manifest.count())), "path").mapInArrow(_read(ids_of), READ)
