"""Removal of long repeated passages by relative Lempel-Ziv parsing against indexed blocks.

Every text is a reference for every other one and for itself. A text's anchors are the runs of
ANCHOR words whose hash is least within some window of WINDOW words; equal windows have equal
anchors, so one row per anchor (about 7 in 100 words) indexes everything. A block is an anchor with
all the words that windows around it can reach.

The index holds for each anchor its distinct blocks. The block met first is the anchor's reference;
a block that occurs again is a reference for its own repetitions. Each block is compared with its
reference word by word, outwards from the anchor, which gives the longest match there. Matches that
go on from block to block with the same reference at the same distance are joined; a text is then
parsed from left to right, each time taking the match that reaches furthest, into factors
(start, length, and the text and place they are a copy of). Factors of WINDOW words or more are
duplicate spans.

At factor boundaries, where a block stops matching its reference, it may still share a window with
another block of that anchor: the windows beyond the match are counted by 128-bit keys, one place
standing for all that share a block, and a window met twice is a match as well. Windows whose own
anchor is unique are unique. Nothing is sampled, no pairs of places are made, and rows grow with
the words of the corpus only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from loomwright.llm.texts import utf8
from loomwright.session import Workspace

WINDOW = 35
ANCHOR = 10
#: Anchors in a window, less one: how far a block reaches to either side of its anchor.
REACH = WINDOW - ANCHOR
#: Words of a block; shorter at a text's ends.
BLOCK = ANCHOR + 2 * REACH
#: Factors of the rolling hashes: fixed odd 64-bit numbers.
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
#: Texts of a partition have their numbers from partition << SHIFT on.
SHIFT = 40
MATCHES = "array<struct<low:int,high:int,source:bigint,place:int>>"
FACTORS = ["start", "length", "source"]


class Hashed:
    """Rolling hashes of any run of words of one text."""

    powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        self.sums = []
        for up, down in self._powers(self.n + WINDOW + 2 * REACH):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.own * down[: self.n], out=sums[1:])
            self.sums.append((sums, up))

    @classmethod
    def _powers(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not cls.powers or len(cls.powers[0][0]) < n:
            cls.powers = []
            size = max(4096, 2 * n)
            for base in BASES:
                both = []
                for factor in (base, pow(base, -1, 1 << 64)):
                    step = np.full(size, factor, np.uint64)
                    step[0] = 1
                    both.append(np.cumprod(step))
                cls.powers.append((both[0], both[1]))
        return cls.powers

    def runs(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums, up = self.sums[which]
        return _mixed((sums[end] - sums[begin]) * up[end])


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return value ^ (value >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def anchors(hashed: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, hashes of all runs of ANCHOR words, and the least of each window."""
    starts = np.arange(hashed.n - ANCHOR + 1)
    grams = hashed.runs(starts, starts + ANCHOR)
    least = _sliding(grams, REACH + 1, np.minimum)
    # A run is an anchor if it is the least of some window: then the greatest least around it is its own.
    around = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    return np.flatnonzero(_sliding(around, REACH + 1, np.maximum) == grams), grams, least


def blocks(hashed: Hashed, places: np.ndarray) -> np.ndarray:
    """Keys of the blocks at anchors: the words within REACH and how much of them there is."""
    low, high = np.maximum(places - REACH, 0), np.minimum(places + ANCHOR + REACH, hashed.n)
    return hashed.runs(low, high, 1) + ((places - low) * 1009 + (high - places)).astype(np.uint64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a number to each row: the bytes (and rows) of its partition before it. A text's words then
    have numbers of their own, that of the text plus their place, in the order of the texts."""
    base = TaskContext.get().partitionId() << SHIFT
    for batch in batches:
        sizes = np.array([len(x) + 1 if x is not None else 1 for x in batch.column("__bytes").to_pylist()], np.int64)
        ends = base + np.cumsum(sizes)
        base = int(ends[-1]) if len(ends) else base
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ends - sizes)], [*batch.schema.names[:-1], "__uid"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct block of a text: how often the text has it, and where first. Text of a
    short period has few distinct blocks, however many of its words are anchors."""
    for batch in batches:
        of, parts = [], []
        for i, data in enumerate(batch.column(1).to_pylist()):
            words = data.split()
            if len(words) >= WINDOW:
                hashed = Hashed(words)
                places, grams, _ = anchors(hashed)
                keys = blocks(hashed, places)
                _, first, times = np.unique(_mixed(grams[places]) + keys, return_index=True, return_counts=True)
                places, keys = places[first], keys[first]
                low, high = np.maximum(places - REACH, 0), np.minimum(places + ANCHOR + REACH, hashed.n)
                parts.append((grams[places].view(np.int64), keys.view(np.int64), times, *(x.astype(np.int32) for x in (places, low, high))))
                of.append(np.full(len(first), i))
        if of:
            cols = [pa.array(np.concatenate(c)) for c in zip(*parts)]
            uid = batch.column(0).take(pa.array(np.concatenate(of)))
            yield pa.RecordBatch.from_arrays([*cols, uid], ["anchor", "block", "n", "place", "low", "high", "uid"])


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words (as 64-bit hashes) of the blocks at given places, how many stand before and from the
    anchor on, and as bits the windows that are the anchor's own: those in which it is the least."""
    for batch in batches:
        rows: list[tuple] = []
        for uid, data, spots in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
            hashed = Hashed(data.split())
            _, grams, least = anchors(hashed)
            spots = spots.values
            places = spots.field("place").to_numpy().astype(np.int64)
            low, high = np.maximum(places - REACH, 0), np.minimum(places + ANCHOR + REACH, hashed.n)
            windows = places[:, None] - REACH + np.arange(REACH + 1)[None, :]
            inside = (windows >= 0) & (windows <= hashed.n - WINDOW)
            own = inside & (least[np.clip(windows, 0, len(least) - 1)] == grams[places][:, None])
            masks = (own.astype(np.int64) << np.arange(REACH + 1)).sum(axis=1)
            for spot, p, a, b, mask in zip(spots.to_pylist(), places.tolist(), low.tolist(), high.tolist(), masks.tolist()):
                rows.append((spot["anchor"], spot["block"], hashed.own[a:b].tobytes(), p - a, b - p, mask, uid, p))
        cols = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names = ["anchor", "block", "words", "before", "after", "own", "uid", "place"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _grid(words: pa.Array, before: np.ndarray) -> np.ndarray:
    """A row of BLOCK word hashes for each block, its anchor at REACH; 0 where the text has no word."""
    grid = np.zeros((len(words), BLOCK), np.uint64)
    for i, (data, at) in enumerate(zip(words.to_pylist(), (REACH - before).tolist())):
        row = np.frombuffer(data, np.uint64)
        grid[i, at : at + len(row)] = row
    return grid


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the words left of its anchor and from the anchor on that its reference has too,
    and the keys and offsets (from the anchor) of its own windows beyond that match."""
    powers = [(up[: BLOCK + 1], down[:BLOCK]) for up, down in Hashed._powers(BLOCK + 1)]
    for batch in batches:
        anchor, block, words, before, after, own, uid, place, ref, ref_before, ref_after = batch.columns
        before, after = before.to_numpy(), after.to_numpy()
        mine, other = _grid(words, before), _grid(ref, ref_before.to_numpy())
        unlike = mine != other
        left = np.minimum(np.where(unlike[:, :REACH].any(axis=1), unlike[:, :REACH][:, ::-1].argmax(axis=1), REACH), np.minimum(before, ref_before.to_numpy()))
        right = np.where(unlike[:, REACH:].any(axis=1), unlike[:, REACH:].argmax(axis=1), BLOCK - REACH)
        right = np.minimum(right, np.minimum(after, ref_after.to_numpy()))
        starts = np.arange(REACH + 1)
        matched = (starts[None, :] >= REACH - left[:, None]) & (starts[None, :] + WINDOW <= REACH + right[:, None])
        ask = ((own.to_numpy()[:, None] >> starts[None, :]) & 1 > 0) & ~matched
        keys = []
        for up, down in powers:
            sums = np.zeros((len(mine), BLOCK + 1), np.uint64)
            np.cumsum(mine * down[None, :], axis=1, out=sums[:, 1:])
            keys.append(_mixed((sums[:, starts + WINDOW] - sums[:, starts]) * up[starts + WINDOW][None, :]))
        ends = np.concatenate([[0], np.cumsum(ask.sum(axis=1))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(k[ask].view(np.int64))) for k in keys]
        at = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.nonzero(ask)[1] - REACH).astype(np.int32)))
        cols = [anchor, block, uid, place, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *lists, at]
        yield pa.RecordBatch.from_arrays(cols, ["anchor", "block", "uid", "place", "left", "right", "key_a", "key_b", "window"])


def _spread(words: list[bytes], found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``found``, with the matches of blocks that the text has several times at all of their places."""
    if all(place < 0 for *_, place in found):
        return found
    hashed = Hashed(words)
    places, grams, _ = anchors(hashed)
    keys = _mixed(grams[places]) + blocks(hashed, places)
    order = np.argsort(keys, kind="stable")
    out = []
    for low, high, source, place in found:
        if place < 0:
            out.append((low, high, source, place))
            continue
        key = keys[np.searchsorted(places, place)]
        same = order[np.searchsorted(keys, key, "left", order) : np.searchsorted(keys, key, "right", order)]
        out += [(at + low - place, at + high - place, source, -1) for at in places[same].tolist()]
    return out


def parse(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Factors (start, length, number of the word that they are a copy from) of one text, in order.

    Matches with one source at one distance that touch are joined. From the left, of the matches
    that begin no later than the last factor ends the one that reaches furthest is taken, whole, so
    that factors overlap where two sources share words; shorter ones than a window are left out.
    """
    joined: list[list[int]] = []
    for distance, low, high in sorted((source - low, low, high) for low, high, source, _ in matches):
        if joined and joined[-1][0] == distance and low <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], high)
        else:
            joined.append([distance, low, high])
    long = sorted((low, high, distance) for distance, low, high in joined if high - low >= WINDOW)
    found: list[tuple[int, int, int]] = []
    end, i = 0, 0
    while i < len(long):
        start, best = max(end, long[i][0]), long[i]
        while i < len(long) and long[i][0] <= start:
            best = max(best, long[i], key=lambda x: x[1])
            i += 1
        if best[1] > end:
            found.append((best[0], best[1] - best[0], best[0] + best[2]))
            end = best[1]
    return found


def _cut(texts: pa.Array, found: pa.Array) -> pa.Array:
    at, values = found.offsets.to_numpy(), found.values
    columns = [values.field(i).to_numpy() for i in range(4)]
    sizes, removed, rests, ends, made = [], [], [], [0], []
    for i, data in enumerate(texts.to_pylist()):
        words = data.split()
        matches = list(zip(*(c[at[i] : at[i + 1]].tolist() for c in columns)))
        factors = parse(_spread(words, matches)) if matches else []
        kept, done, gone = [], 0, 0
        for start, length, _ in factors:
            kept += words[done:start]
            gone += start + length - max(done, start)
            done = start + length
        sizes.append(len(words))
        removed.append(gone)
        rests.append(b" ".join(kept + words[done:] if factors else words))
        made += factors
        ends.append(len(made))
    parts = list(zip(*made)) if made else [()] * 3
    inner = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in parts], FACTORS)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
    arrays = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(rests, pa.binary()), lists]
    return pa.StructArray.from_arrays(arrays, ["n_words", "n_removed", "kept", "factors"])


_cut.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
CUT = "struct<n_words:bigint,n_removed:bigint,kept:binary,factors:array<struct<start:bigint,length:bigint,source:bigint>>>"


def _matches(texts: DataFrame, work: Workspace) -> DataFrame:
    """(uid, matches) for every row of ``texts`` (uid, text as bytes) that has one; the source of a
    match is the number of the word at which its copy begins.

    Tables that are joined back are written first: a join of two shuffles may split a hot key, one
    that takes over an aggregation's partitions may not.
    """
    at = F.col("uid") + F.col("place")
    columns = "anchor bigint, block bigint, n bigint, place int, low int, high int, uid bigint"
    places = work.put(texts.mapInArrow(_index, columns), "places")
    # Numbers rise from text to text, so that the least place is in the text with the least number.
    ends = [F.sum("n").alias("times"), F.min(at).alias("rep"), F.max(at).alias("last"), F.min("uid").alias("rep_uid")]
    seen = places.groupBy("anchor").agg(F.min("block").alias("b"), F.max("block").alias("c"), *ends)
    again = work.put(seen.where("times > 1").select("anchor", "rep", "last", "rep_uid", (F.col("b") != F.col("c")).alias("mixed")), "again")
    known = work.put(places.join(again, "anchor"), "known")
    work.drop("places")
    mixed = known.where("mixed").select("anchor", "block", "n", "place", "low", "high", "uid")
    groups = work.put(mixed.groupBy("anchor", "block").agg(*ends), "groups")
    spots = groups.select(F.col("rep_uid").alias("uid"), F.struct("anchor", "block", (F.col("rep") - F.col("rep_uid")).alias("place")).alias("spot"))
    spots = spots.groupBy("uid").agg(F.collect_list("spot").alias("spots"))
    spot_columns = "anchor bigint, block bigint, words binary, before int, after int, own int, uid bigint, place int"
    read = work.put(texts.join(spots, "uid").select("uid", "text", "spots").mapInArrow(_read_blocks, spot_columns), "read")
    # Each block beside the reference of its anchor, the block met first.
    lead = again.where("mixed").select("anchor", F.col("rep").alias("lead"), F.col("rep_uid").alias("lead_uid"))
    first = read.join(lead, "anchor").where("uid + place = lead").select(
        "anchor", F.col("words").alias("ref"), F.col("before").alias("ref_before"), F.col("after").alias("ref_after"), F.col("block").alias("ref_block")
    )
    first = work.put(first, "first")
    pairs = read.join(first, "anchor").where("block <> ref_block")
    compared = pairs.select(*read.columns, "ref", "ref_before", "ref_after").mapInArrow(
        _compare, "anchor bigint, block bigint, uid bigint, place int, left int, right int, key_a array<bigint>, key_b array<bigint>, window array<int>"
    )
    compared = work.put(compared, "compared")
    work.drop("read", "first")
    # What a block matches: its other occurrences if it has some, else its anchor's reference.
    lengths = compared.select("anchor", "block", "left", "right")
    judged = groups.join(lengths, ["anchor", "block"], "left").join(lead, "anchor")
    judged = work.put(judged.where(f"times > 1 or left + right >= {WINDOW}"), "judged")
    none = F.lit(None).cast("int")
    shared = ["uid", "place", "low", "high", "n", "rep", "last"]
    alike = known.where("not mixed").select(*shared, none.alias("left"), none.alias("right"))
    whole = F.col("times") > 1
    unlike = mixed.join(judged, ["anchor", "block"]).select(
        *shared[:5],
        *[F.when(whole, F.col(c)).otherwise(F.col("lead")).alias(c) for c in ("rep", "last")],
        *[F.when(~whole, F.col(c)).alias(c) for c in ("left", "right")],
    )
    low, high = F.coalesce(F.col("place") - F.col("left"), "low"), F.coalesce(F.col("place") + F.col("right"), "high")
    source = F.when(at == F.col("rep"), F.col("last")).otherwise(F.col("rep")) - F.col("place") + low
    match = F.struct(low.alias("low"), high.alias("high"), source.alias("source"), F.when(F.col("n") > 1, F.col("place")).otherwise(-1).alias("place"))
    copies = alike.unionByName(unlike).where(high - low >= WINDOW).select("uid", match.alias("m"))
    # A reference has what its anchor's other blocks match of it: as many of these differ as there are lengths.
    back = judged.where(f"left + right >= {WINDOW}").groupBy("lead", "lead_uid", "left", "right").agg(F.min("rep").alias("rep"))
    back = back.withColumn("low", (F.col("lead") - F.col("lead_uid")).cast("int") - F.col("left"))
    match = F.struct("low", (F.col("low") + F.col("left") + F.col("right")).alias("high"), (F.col("rep") - F.col("left")).alias("source"), F.lit(-1).alias("place"))
    back = back.select(F.col("lead_uid").alias("uid"), match.alias("m"))
    # Windows beyond the matches: a key met at two places is a match of each.
    asked = compared.select("uid", "place", F.explode(F.arrays_zip("key_a", "key_b", "window")).alias("k"))
    asked = work.put(asked.select("k.key_a", "k.key_b", "uid", (F.col("place") + F.col("k.window")).alias("low")), "asked")
    at = F.col("uid") + F.col("low")
    double = work.put(asked.groupBy("key_a", "key_b").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b"), "double")
    source = F.when(at == F.col("a"), F.col("b")).otherwise(F.col("a"))
    match = F.struct("low", (F.col("low") + WINDOW).alias("high"), source.alias("source"), F.lit(-1).alias("place"))
    windows = asked.join(double, ["key_a", "key_b"]).select("uid", match.alias("m"))
    found = copies.unionByName(back).unionByName(windows).groupBy("uid").agg(F.collect_list("m").cast(MATCHES).alias("matches"))
    found = work.put(found, "matches")
    work.drop("again", "known", "groups", "compared", "judged", "asked", "double")
    return found


def _parsed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__uid`` and ``__cut`` (n_words, n_removed, kept as bytes, factors)."""
    work = Workspace(docs.sparkSession, "substring")
    numbered = StructType([*docs.schema.fields]).add("__uid", LongType())
    rows = work.put(docs.withColumn("__bytes", F.col("text").cast("binary")).mapInArrow(_number, numbered), "texts")  # written, so that numbers stay
    found = _matches(rows.select(F.col("__uid").alias("uid"), utf8(F.col("text")).alias("text")), work)
    joined = rows.join(found.select(F.col("uid").alias("__of"), F.col("matches").alias("__matches")), F.col("__uid") == F.col("__of"), "left")
    return joined.withColumn("__cut", F.arrow_udf(_cut, CUT)(utf8(F.col("text")), F.col("__matches"))).drop("__of", "__matches")


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, source_doc_id, source_start: a row for each factor of WINDOW words or more.

    Texts without one, as null, empty and short ones, give no row. Of a passage that occurs several
    times every occurrence is a factor, the first one as a copy of the last one; a passage that is
    repeated within one text only names its first place there, itself included.
    """
    work = Workspace(docs.sparkSession, "factors")
    parsed = work.put(_parsed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "__uid", F.col("__cut.factors").alias("factors")), "parsed")
    each = parsed.select("doc_id", F.explode("factors").alias("f")).select("doc_id", "f.start", "f.length", "f.source")
    # The text that holds a word: that with the greatest number up to the word's, of the same partition.
    every = each.select("*", F.lit(None).cast("bigint").alias("of"), F.lit(None).cast("bigint").alias("id")).unionByName(
        parsed.select(F.col("__uid").alias("source"), F.col("__uid").alias("of"), F.col("doc_id").alias("id")), True
    )
    upto = W.partitionBy(F.shiftright("source", SHIFT)).orderBy("source", F.col("of").isNull()).rowsBetween(W.unboundedPreceding, 0)
    of = every.withColumns({"text": F.last(F.when(F.col("of").isNotNull(), F.struct("of", "id")), True).over(upto)}).where("length is not null")
    return of.select("doc_id", "start", "length", F.col("text.id").alias("source_doc_id"), (F.col("source") - F.col("text.of")).alias("source_start"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    A word goes if a factor covers it: a window of 35 words over it starts a second time anywhere,
    in its own text or another, judged on the texts as they came. Null text has no words; texts of
    fewer than 35 words lose nothing. A repeated row is a further text: both lose all words from
    35 on. An empty table gives no rows; other columns are ignored.
    """
    parsed = _parsed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return parsed.select("doc_id", "__cut.n_words", "__cut.n_removed", F.sha2("__cut.kept", 256).alias("kept_sha256"))


def cut_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns: where words went, text is the rest, joined by one space, and
    n_chars (if there is one) its length. Texts that lose nothing stay as they are, null and empty
    ones too; repeated rows lose what they share; an empty table gives no rows."""
    changed = F.col("__cut.n_removed") > 0
    kept = F.decode("__cut.kept", "utf-8")
    new = {"text": F.when(changed, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _parsed(docs).withColumns(new).select(*docs.columns)
