"""Repair of conversations at the least cost, as a stream over rows sorted by conversation and turn.

Rows are dealt by conversation and sorted by turn; a task reads them batch by batch and carries a
dynamic program over four states: nothing written yet, after the system turn, after a user's, after
an assistant's. Each row leaves one byte a state: where the cheapest way to that state came from, and
by which edits. When a conversation ends, its edits are read off backwards. Conversations of more
than a batch's rows write these bytes and their rows to a file in the shared folder, in chunks; the way
back keeps one state a chunk, the way forward reads each chunk once.

Ties go by the least string of edits. Of two cheapest ways to different states neither string begins
the other, as each ends with its last row's edit; so the order of states is carried along in place of
the strings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import Workspace

#: Rows of a conversation that are held in memory; longer ones go to a file in chunks of so many.
CHUNK = 1 << 14
#: Bytes of texts that are held for a conversation before a chunk is closed.
CHUNK_BYTES = 8 << 20
#: Output rows of a batch, and bytes of their texts.
BATCH, BATCH_BYTES = 4096, 8 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn whose role has that initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: State after one inserted turn (the role is the one that may follow).
INSERTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINAL = (START, ASSISTANT)
FAULTS = ["", "blank", "duplicate", "truncated"]

EDITS = "conv_id bigint, turn bigint, edit string, role string, text string, fault string, pair_illegal boolean, cost bigint, last boolean"


def damage(rows: DataFrame) -> DataFrame:
    """Damaged ``rows`` (conv_id, turn, role, text) by crc32 of ``conv_id:turn``, modulo 20 (nulls: one
    space): 0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 sets the role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % F.lit(20)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind"),
    )
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind != 0").withColumn("copy", F.explode(copies)).drop("kind", "copy")


def fault_of(text: Column) -> Column:
    """blank or truncated, as far as a text alone tells; else empty."""
    end = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(end == "", F.lit("blank")).when(~F.substring(end, -1, 1).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))


def _digest() -> Column:
    """128 bits of role and text, in hex; the length tells where the role ends."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256).substr(1, 32)


def ordered(rows: DataFrame, all_ids: DataFrame, work: Workspace) -> DataFrame:
    """The rows of each conversation side by side, by turn (nulls first), equal rows of a turn together, with
    faults. Ahead of a row may stand a mark (mark = 0) that its role and text were seen in an earlier turn;
    ahead of each conversation of ``all_ids`` (conv_id) stands a row with mark = -1.

    Whether role and text were seen in an earlier turn is found by a join of digests, so that no
    task needs a conversation's digests in memory; copies within a turn are neighbours.
    """
    rows = rows.withColumn("digest", _digest())
    # Null turns come before all others.
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    turns = rows.select("conv_id", "digest", at.alias("at"))
    firsts = turns.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.max("at").alias("end")).where("first < end").drop("end")
    firsts = work.put(firsts, "firsts")  # an exchange on both sides of the join lets Spark split a hot digest
    same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    again = turns.alias("a").join(firsts.alias("b"), same).where(F.col("a.at") > F.col("b.first")).select("a.conv_id", "a.digest", F.col("a.at.turn").alias("turn"))
    none = lambda kind: F.lit(None).cast(kind)
    marks = again.distinct().select("conv_id", "turn", "digest", F.lit(0).alias("mark"), none("string").alias("role"), none("string").alias("text"))
    empty = all_ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    empty = empty.select("conv_id", none("bigint").alias("turn"), F.lit("").alias("digest"), F.lit(-1).alias("mark"), none("string").alias("role"), none("string").alias("text"))
    whole = rows.select("conv_id", "turn", "digest", F.lit(1).alias("mark"), "role", "text").unionByName(marks).unionByName(empty)
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest", "mark").withColumn("fault", fault_of(F.col("text")))


#: Costs of the four states above the least one (None: can't be reached) and their order by strings of edits.
States = tuple[tuple[int | None, int], ...]
BEGIN: States = ((0, 0), (None, 0), (None, 0), (None, 0))


def _inserted(states: States) -> Iterator[tuple[int, int, int, int, int]]:
    """(cost, order, from, state, inserts): the states before the next row, with up to two inserted turns."""
    for source, (cost, order) in enumerate(states):
        if cost is not None:
            at = source
            for inserts in (0, 1, 2):
                yield cost + INSERT * inserts, order, source, at, inserts
                at = INSERTED[at]


@lru_cache(1 << 16)
def step(states: States, initial: str, fault: str) -> tuple[int, States, bytes]:
    """Takes a row in: what the least cost grows by, the new states, and a byte for each: from << 4 | inserts << 2 |
    0 K, 1 R, 2 D (255: can't be reached). Costs differ by little, so few arguments ever occur."""
    best: dict[int, tuple] = {}
    extra = TRUNCATED if fault == "truncated" else 0

    def offer(state: int, cost: int, order: int, source: int, inserts: int, kind: int) -> None:
        found = (cost, order, "I" * inserts + "KRD"[kind], source, inserts, kind)
        if state not in best or found < best[state]:
            best[state] = found

    for cost, order, source, at, inserts in _inserted(states):
        offer(at, cost + DELETE, order, source, inserts, 2)
        if fault not in ("blank", "duplicate"):
            if (at, initial) in NEXT:
                offer(NEXT[at, initial], cost + extra, order, source, inserts, 0)
            offer(INSERTED[at], cost + extra + REROLE, order, source, inserts, 1)
    rank = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    least = min(x[0] for x in best.values())
    back = bytes(best[s][3] << 4 | best[s][4] << 2 | best[s][5] if s in best else 255 for s in range(4))
    return least, tuple((best[s][0] - least, rank[s]) if s in best else (None, 0) for s in range(4)), back


def end(states: States) -> tuple[int, int, int]:
    """(cost, last row's state, turns inserted at the end) of the cheapest whole repair."""
    found = ((cost, order, "I" * inserts, source, inserts) for cost, order, source, at, inserts in _inserted(states) if at in FINAL)
    cost, _, _, source, inserts = min(found)
    return cost, source, inserts


class Kept:
    """Rows and bytes of one conversation in chunks: in memory while it is one chunk, else in a file."""

    def __init__(self, folder: str, chunk: int):
        self.folder, self.chunk, self.store, self.path, self.out = folder, chunk, None, "", None
        self.rows: list[tuple] = []
        self.back = bytearray()
        self.size = 0
        self.places: list[tuple[int, int, int]] = []

    def add(self, row: tuple, back: bytes) -> None:
        if len(self.rows) >= self.chunk or self.size > CHUNK_BYTES:
            self._spill()
        self.rows.append(row)
        self.back += back
        self.size += len(row[2]) + len(row[1])

    def _spill(self) -> None:
        if self.out is None:
            self.store, base = fs.FileSystem.from_uri(self.folder)
            self.path = f"{base}/{uuid.uuid4().hex}.rows"
            self.out = self.store.open_output_stream(self.path, compression=None)
        kinds = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*self.rows), kinds)], [n for n, _ in kinds])
        data = made.serialize().to_pybytes()
        self.schema = made.schema
        self.out.write(bytes(self.back))
        self.out.write(data)
        start = self.places[-1][0] + self.places[-1][1] + self.places[-1][2] if self.places else 0
        self.places.append((start, len(self.back), len(data)))
        self.rows, self.back, self.size = [], bytearray(), 0

    def chunks(self) -> int:
        """Closes the writer; the number of chunks."""
        if self.out is not None:
            self._spill()
            self.out.close()
        return max(1, len(self.places))

    def backs(self, k: int) -> bytes:
        if not self.places:
            return bytes(self.back)
        at, size, _ = self.places[k]
        with self.store.open_input_file(self.path) as file:
            return file.read_at(size, at)

    def rows_of(self, k: int) -> list[tuple]:
        if not self.places:
            return self.rows
        at, before, size = self.places[k]
        with self.store.open_input_file(self.path) as file:
            batch = pa.ipc.read_record_batch(pa.py_buffer(file.read_at(size, at + before)), self.schema)
        return list(zip(*(c.to_pylist() for c in batch.columns)))

    def drop(self) -> None:
        if self.out is not None:
            self.store.delete_file(self.path)


def _way(back: bytes, state: int) -> list[tuple[int, int, int]]:
    """(from, inserts, edit) of each row of a chunk that ends in ``state``."""
    out = []
    for row in range(len(back) // 4 - 1, -1, -1):
        found = back[4 * row + state]
        state = found >> 4
        out.append((state, found >> 2 & 3, found & 3))
    return out[::-1]


def _edits(conv_id: int | None, cost: int, states: States, kept: Kept) -> Iterator[tuple]:
    """Rows of EDITS of one conversation, in order; the last has last = true and the cost."""
    rest, last, closing = end(states)
    cost, state = cost + rest, last
    chunks = kept.chunks()
    ends = [0] * chunks
    for k in range(chunks - 1, -1, -1):
        ends[k] = state
        way = _way(kept.backs(k), state)
        state = way[0][0] if way else state
    before = None
    for k in range(chunks):
        way = _way(kept.backs(k), ends[k])
        for (at, inserts, kind), (turn, role, text, fault) in zip(way, kept.rows_of(k)):
            for _ in range(inserts):
                at = INSERTED[at]
                yield conv_id, None, "I", ROLE[at], "", "", False, None, False
            illegal = before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            made = (role, text) if kind == 0 else (ROLE[INSERTED[at]], text) if kind == 1 else (None, None)
            yield conv_id, turn, "KRD"[kind], *made, fault, illegal, None, False
    at = last
    for _ in range(closing):
        at = INSERTED[at]
        yield conv_id, None, "I", ROLE[at], "", "", False, None, False
    yield conv_id, None, "", None, None, "", False, cost, True
    kept.drop()


def _repair(folder: str, chunk: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in EDITS.split(", ")]

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, cost, states, kept, seen, marked = (), 0, BEGIN, None, (), ()
        for batch in batches:
            for conv_id, turn, digest, mark, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != (conv_id,):
                    if conv:
                        yield from _edits(conv[0], cost, states, kept)
                    conv, cost, states, kept, seen, marked = (conv_id,), 0, BEGIN, Kept(folder, chunk), (), ()
                if mark == 0:
                    marked = (turn, digest)
                elif mark == 1:
                    if fault != "blank" and (turn, digest) in (seen, marked):
                        fault = "duplicate"
                    seen = (turn, digest)
                    more, states, back = step(states, role[:1], fault)
                    cost += more
                    kept.add((turn, role, text, fault), back)
        if conv:
            yield from _edits(conv[0], cost, states, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in edits(batches):
            rows.append(row)
            size += len(row[4] or "")
            if len(rows) >= BATCH or size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def repair(rows: DataFrame, all_ids: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """EDITS of each conversation of ``rows`` (conv_id, turn, role, text), side by side and in order: a row for each
    row kept (K), given another role (R) or deleted (D), and for each turn inserted (I), with the role and
    text that it has afterwards; then one with last = true that has the cost.

    Null roles and texts are one space, and so are never kept. Null turns come first; rows of a turn go by a
    digest of role and text, so equal rows are neighbours. Null conv_ids are one conversation. ``all_ids`` may
    name conversations without rows: these have the closing row alone. An empty table gives no rows; other
    columns are ignored.

    A conversation is one task's, which holds a chunk of its rows and streams the rest through a file.
    """
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    work = Workspace(rows.sparkSession, "conversations")
    work.put(rows.sparkSession.range(0), "spilled")  # makes the folder
    return ordered(rows, rows if all_ids is None else all_ids, work).mapInArrow(_repair(f"{work.path}/spilled", chunk), EDITS)


SUMMARY = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def summaries(edits: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of ``repair``'s rows, which this reads in their order, without a shuffle."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            return dict.fromkeys(FAULTS, 0), hashlib.sha256(), []

        faults, digest, audit = fresh()
        illegal = turns = 0
        least = most = None
        begun = False
        for batch in batches:
            out = []
            for conv_id, turn, edit, role, text, fault, pair_illegal, cost, last in zip(*(c.to_pylist() for c in batch.columns)):
                if last:
                    gaps = 0 if least is None else most - least + 1 - turns
                    out.append((conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()))
                    faults, digest, audit = fresh()
                    illegal = turns = 0
                    least = most = None
                    begun = False
                    continue
                audit.append(edit)
                faults[fault] += 1
                illegal += pair_illegal
                if turn is not None and turn != most:  # turns rise
                    turns, most = turns + 1, turn
                    least = turn if least is None else least
                if role is not None:
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode("utf-8", "replace"))
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 7 + [pa.string()] * 2)], names)

    return edits.mapInArrow(run, SUMMARY)
