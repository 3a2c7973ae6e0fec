"""SimHash near-duplicates: fingerprints, then a binary-trie self-join within an error budget.

The 64 bits fall into six blocks. Four errors leave two blocks whole at least, so each distinct
fingerprint goes to the 15 pairs of blocks, and a bucket holds fingerprints equal in 20 to 22
bits: exact at any size. A bucket of more than SPLIT fingerprints is dealt once more in the same
way by halves of its other blocks, and one that is still larger by pairs of chunks. Within a bucket the distinct fingerprints form a
path-compressed binary trie. Pairs of nodes are walked together; the bits in which their known
prefixes differ add up, and a pair whose sum exceeds the budget is left with everything below it;
pairs of small nodes are compared at once. A pair of nodes that one component covers already adds
nothing and is left too: a bucket gives at most one link less than it has fingerprints, not all pairs.

``drop_near_duplicates`` goes by similarity of texts instead, where errors are too many for blocks of
bits: its buckets are pairs out of six minima of hashed shingles, large ones fall into pairs of chunks, the
trie join links within budgets that grow step by step, four times with different links, and each is checked on
the texts' shingles: by sketches, and where these are estimates close to the threshold on whole texts. Buckets with a
link whose ends are not joined after that are compared pair by pair, so no number of forests bounds what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import connected_components
from loomwright.llm.texts import LOWER_AZ, utf8
from loomwright.session import Workspace

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Near-duplicates of the pipeline: words of a shingle, least Jaccard similarity, and the bits in which
#: fingerprints of such texts may differ (a similarity of 0.8 gives 10 on average, with a spread of 3),
#: in the steps in which links are looked for.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WIDE_BUDGETS = (4, 8, 12, 16, 20)
MINIMA = 6
#: Least shingle hashes of a text that are kept to compare it: all of a text of up to so many.
SKETCH = 512
#: Estimates this close to the least similarity (three standard errors of SKETCH hashes) are decided on whole texts.
DOUBT = 0.055
#: Spanning forests of a bucket's near fingerprints, no two with a link in common; what they leave apart is compared whole.
FORESTS = 4
#: A bucket of more fingerprints is split; nodes of at most so many fingerprints are compared at once.
SPLIT = 20_000
LEAF = 128
#: (shift, width) of the blocks of a fingerprint.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Hashes that are unpacked to bits at once.
CHUNK = 16384


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words where there are fewer."""
    words = text.translate(LOWER_AZ).split()
    if len(words) < shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text (UTF-8); zero without words."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


def trie_links(fps: np.ndarray, budgets: tuple[int, ...] = (BUDGET,), without: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Links (i, j) among distinct fingerprints, sorted as uint64, that join the same ones as
    all pairs within the last of ``budgets`` bits do: one link less than members for each component.
    Links within smaller budgets are made first, so that those within larger ones join what is left.
    ``without`` are links that are not made again."""
    n = len(fps)
    barred = np.array(sorted(min(x) * n + max(x) for x in without), np.int64)
    label = np.arange(n)
    members: dict[int, np.ndarray] = {}
    links: list[tuple[int, int]] = []
    whole: set[tuple[int, int]] = set()

    def union(i: int, j: int) -> None:
        links.append((i, j))
        a, b = int(label[i]), int(label[j])
        own, other = (members.pop(x, np.array([x])) for x in (a, b))
        if len(own) < len(other):
            a, own, other = b, other, own
        label[other] = a
        members[a] = np.concatenate([own, other])

    def compare(a: int, b: int, c: int, d: int, budget: int) -> None:
        far = np.bitwise_count(fps[a:b, None] ^ fps[None, c:d])
        near = far <= budget
        if len(barred):  # the second forest meets whole nodes mostly
            near &= label[a:b, None] != label[None, c:d]
        i, j = np.nonzero(near)
        i, j, far = i + a, j + c, far[i, j]
        if len(barred) and len(i):
            pair = np.minimum(i, j) * n + np.maximum(i, j)
            free = barred[np.minimum(np.searchsorted(barred, pair), len(barred) - 1)] != pair
            i, j, far = i[free], j[free], far[free]
        while len(i := i[keep := label[i] != label[j]]):
            j, far = j[keep], far[keep]
            k = int(far.argmin())
            union(int(i[k]), int(j[k]))

    def is_whole(lo: int, hi: int) -> bool:
        if hi - lo == 1 or (lo, hi) in whole:
            return True
        if label[lo] == label[hi - 1] and (label[lo:hi] == label[lo]).all():
            whole.add((lo, hi))
            return True
        return False

    def split(lo: int, hi: int) -> int:
        """Where the trie node of fps[lo:hi] branches; its values differ first in the top bit
        of the first and last value's difference."""
        bit = 1 << ((int(fps[lo]) ^ int(fps[hi - 1])).bit_length() - 1)
        start = int(fps[hi - 1]) & ~(bit - 1)
        return int(np.searchsorted(fps[lo:hi], np.uint64(start))) + lo

    for budget in budgets:
        # A job is a node with itself, or a pair of nodes.
        jobs: list[tuple] = [(0, n)]
        while jobs:
            job = jobs.pop()
            if len(job) == 2:
                lo, hi = job
                if hi - lo <= LEAF:
                    if hi - lo > 1 and not is_whole(lo, hi):
                        compare(lo, hi, lo, hi, budget)
                elif not is_whole(lo, hi):
                    mid = split(lo, hi)
                    jobs += [(lo, mid, mid, hi), (mid, hi), (lo, mid)]
                continue
            a, b, c, d = job
            first, second = int(fps[a]), int(fps[c])
            left, right = (first ^ int(fps[b - 1])).bit_length(), (second ^ int(fps[d - 1])).bit_length()
            if ((first ^ second) >> max(left, right)).bit_count() > budget:
                continue
            if label[a] == label[c] and is_whole(a, b) and is_whole(c, d):
                continue
            if b - a <= LEAF and d - c <= LEAF:
                compare(a, b, c, d, budget)
            elif b - a >= d - c:
                mid = split(a, b)
                jobs += [(mid, b, c, d), (a, mid, c, d)]
            else:
                mid = split(c, d)
                jobs += [(a, b, mid, d), (a, b, c, mid)]
    return links


def _block_keys(fp: Column) -> Column:
    """The 15 bucket keys of a fingerprint: number of the pair of blocks, then their bits."""
    part = [F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1) for s, w in BLOCKS]
    pairs = enumerate(combinations(range(len(BLOCKS)), 2))
    return F.array(*[F.lit(k << 22).cast("bigint") + F.shiftleft(part[i], 11) + part[j] for k, (i, j) in pairs])


def _sub_keys(key: Column, fp: Column) -> Column:
    """The 15 keys of a fingerprint within its bucket. The other four blocks make eight halves, of
    which four errors leave two of the first six whole at least."""
    halves = [half for s, w in BLOCKS for half in ((s, w // 2), (s + w // 2, w - w // 2))]
    values = F.array(*[F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1) for s, w in halves])
    free = [[h + 1 for h in range(12) if h // 2 not in pair][:6] for pair in combinations(range(len(BLOCKS)), 2)]
    own = F.element_at(F.array(*[F.array(*map(F.lit, six)) for six in free]), (F.shiftright(key, 22) + 1).cast("int"))
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j")) for i, j in combinations(range(6), 2)])
    value = lambda k: F.element_at(values, F.element_at(own, k))
    return F.transform(pairs, lambda p: F.xxhash64(key, p["i"], p["j"], value(p["i"]), value(p["j"])))


def _large(buckets: DataFrame, most: int, work: Workspace, name: str) -> DataFrame | None:
    """(key, n) of the keys that more than ``most`` rows of ``buckets`` have; None without any."""
    found = work.put(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), name)
    return None if found.isEmpty() else found


def _dealt(buckets: DataFrame, sub_keys: Column, most: int, work: Workspace) -> DataFrame:
    """``buckets`` (key, fp, rep), large ones dealt by ``sub_keys``."""
    large = _large(buckets, most, work, "large")
    rows = buckets.select("key", "fp", "rep")
    if large is None:
        return rows
    dealt = buckets.join(large, "key").select(F.explode(sub_keys).alias("key"), "fp", "rep")
    return work.put(rows.join(large, "key", "left_anti").unionByName(dealt), "dealt")


def _chunked(buckets: DataFrame, most: int, work: Workspace) -> DataFrame:
    """``buckets`` (key, fp, rep, any more) without one of much more than ``most`` rows: larger ones fall into chunks,
    and two chunks make a bucket, so that any two rows still meet."""
    large = _large(buckets, most, work, "large_chunked")
    if large is None:
        return buckets
    rows = buckets.join(large.select("key", F.ceil(2 * F.col("n") / most).alias("chunks")), "key")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp", "rep"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).where("mine <> other")
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return buckets.join(large, "key", "left_anti").unionByName(rows.select(pair.alias("key"), *[c for c in buckets.columns if c != "key"]))


def _linked(buckets: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """(a, b): links of the reps in each bucket (key, fp, rep)."""
    rows = buckets.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_bucket_links(budgets), "a bigint, b bigint")


def _bucket_links(budgets: tuple[int, ...]):
    def links_of(fps: np.ndarray, reps: np.ndarray) -> list[tuple[int, int]]:
        order = np.argsort(fps, kind="stable")
        fps, reps = fps[order], reps[order]
        new = np.r_[True, fps[1:] != fps[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # equal fingerprints are linked to their first
        same = list(zip(reps[first[~new]].tolist(), reps[~new].tolist()))
        reps = reps[new].tolist()
        links = trie_links(fps[new], budgets)
        if len(budgets) > 1:  # links that are checked later may fail: further forests stand in for the first
            for _ in range(FORESTS - 1):
                more = trie_links(fps[new], budgets, links)
                if not more:
                    break
                links = links + more
        return same + [(reps[i], reps[j]) for i, j in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        rest: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(rows[0]):
                continue
            if rest and rest[-1][0][-1] == rows[0][-1]:
                rest.append(rows)
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from done([*rest, tuple(x[:cut] for x in rows)])
            rest = [tuple(x[cut:] for x in rows)]
        yield from done(rest)

    def done(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        keys, fps, reps = (np.concatenate(x) for x in zip(*parts))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(keys)]
        links: list[tuple[int, int]] = []
        fps = fps.view(np.uint64)
        for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            links += links_of(fps[lo:hi], reps[lo:hi])
        if links:
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, most: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``budget`` (0 to 4) differing bits
    reach. Null text counts as empty; texts without words have fingerprint zero and are linked
    like any other. Rows with a null doc_id get the component of their fingerprint, null if no
    other row has it. Repeated rows come out again; an empty table gives no rows. Buckets of more
    than ``most`` fingerprints are split, which changes no result.
    """
    if not 0 <= budget <= 4:
        raise ValueError("six blocks find all links of 0 to 4 differing bits only")
    work = Workspace(docs.sparkSession, "simhash")
    found = work.put(with_fingerprints(docs, shingle), "fingerprints")
    distinct = work.put(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    buckets = work.put(distinct.where("rep is not null").select(F.explode(_block_keys(F.col("fp"))).alias("key"), "fp", "rep"), "buckets")
    links = _linked(_chunked(_dealt(buckets, _sub_keys(F.col("key"), F.col("fp")), most, work), most, work), (budget,))
    joined = connected_components(links, work)
    members = distinct.join(joined, distinct.rep == joined.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return found.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def minima(hashes: np.ndarray, count: int = MINIMA) -> list[int]:
    """The least value of each of ``count`` mixings of the hashes, as signed numbers; zeros without hashes."""
    if not len(hashes):
        return [0] * count
    found = []
    for i in range(count):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        found.append(int((mixed ^ (mixed >> np.uint64(32))).min().view(np.int64)))
    return found


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sketches, least = [], [], []
            for data in batch.column(2).to_pylist():
                hashes = shingle_hashes(data, shingle)
                fps.append(majority(hashes))
                own = np.unique(hashes)
                least.append(minima(own))
                sketches.append((own[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            cols = [batch.column(0), batch.column(1), fp, *(pa.array(c, pa.int64()) for c in (zip(*least) if least else [()] * MINIMA))]
            names = ["doc_id", "text_key", "fp", *(f"m{i}" for i in range(MINIMA)), "sketch"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sketches, pa.binary())], names)

    return run


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sketches: exact where both hold all hashes, else by the SKETCH least
    of both together; texts without words are alike."""
    one, two = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.union1d(one, two)
    if max(len(one), len(two)) >= SKETCH:
        both = both[:SKETCH]
    if not len(both):
        return 1.0
    return float((np.isin(both, one) & np.isin(both, two)).sum() / len(both))


def _verdict(a: bytes, b: bytes, least: float) -> bool | None:
    """Whether two sketches are similar; None where only the texts can tell."""
    found = similarity(a, b)
    estimated = max(len(a), len(b)) >= 4 * SKETCH
    return None if estimated and abs(found - least) <= DOUBT else found >= least


def _checked(least: float):
    """Links with what sketches say: ``similar``, null where only the texts can tell; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array(map(_verdict, batch.column(4).to_pylist(), batch.column(5).to_pylist(), repeat(least)), pa.bool_())
            rows = batch.select(["a", "a_key", "b", "b_key"])
            yield pa.RecordBatch.from_arrays([*rows.columns, said], [*rows.schema.names, "similar"]).filter(said.fill_null(True))

    return run


def _checked_on_texts(shingle: int, least: float):
    """Links (a, a_key, b, b_key, a_text, b_text) whose texts have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(4), batch.column(5)):
                a, b = (np.unique(shingle_hashes(x.as_py(), shingle)) for x in (one, two))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= least * (len(a) + len(b) - shared))
            yield batch.select(["a", "a_key", "b", "b_key"]).filter(pa.array(keep, pa.bool_()))

    return run


SAID = "a bigint, a_key bigint, b bigint, b_key bigint, similar boolean"


def _compared(least: float):
    """All pairs of a bucket (rep, rep_key, fp, label, sketch) within the widest budget whose labels differ, as links with
    what sketches say. A sure link joins two labels, and pairs that are joined are not looked at any more."""

    def run(rows: pa.Table) -> pa.Table:
        reps, keys, fps = (rows.column(c).to_numpy() for c in ("rep", "rep_key", "fp"))
        fps, sketches = fps.view(np.uint64), rows.column("sketch").to_pylist()
        label = np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]
        size = np.array([len(x) // 4 for x in sketches])
        start = np.r_[0, np.cumsum(size)]
        code = np.unique(np.frombuffer(b"".join(sketches), np.uint32), return_inverse=True)[1]
        holders = np.repeat(np.arange(len(reps)), size)[np.argsort(code, kind="stable")]
        upto = np.r_[0, np.cumsum(np.bincount(code))] if len(code) else np.zeros(1, int)
        links: list[tuple[int, int]] = []
        doubts: list[tuple[int, int]] = []
        for i in range(len(reps) - 1):
            near = np.flatnonzero((label[i + 1 :] != label[i]) & (np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= WIDE_BUDGETS[-1])) + i + 1
            if not len(near):
                continue
            # Every holder of each of the hashes: how many the others share with this one.
            own = [holders[upto[c] : upto[c + 1]] for c in code[start[i] : start[i + 1]]]
            shared = np.bincount(np.concatenate(own), minlength=len(reps))[near] if own else np.zeros(len(near), int)
            both = size[i] + size[near] - shared
            estimated = np.maximum(size[i], size[near]) >= SKETCH
            # An estimate is at most all that is shared by SKETCH; sketches are looked at only where it may matter, with
            # room for hashes that are equal in 32 bits.
            likely = shared + 2 >= np.where(estimated, (least - DOUBT) * SKETCH, least * both)
            for j in near[likely].tolist():
                if label[i] == label[j]:
                    continue
                said = _verdict(sketches[i], sketches[j], least)
                if said:
                    links.append((i, j))
                    label[label == label[j]] = label[i]
                elif said is None:
                    doubts.append((i, j))
        doubts = [(i, j) for i, j in doubts if label[i] != label[j]]
        a, b = np.array(links + doubts, np.int64).reshape(-1, 2).T
        similar = pa.array([True] * len(links) + [None] * len(doubts), pa.bool_())
        return pa.table([pa.array(reps[a]), pa.array(keys[a]), pa.array(reps[b]), pa.array(keys[b]), similar], ["a", "a_key", "b", "b_key", "similar"])

    return run


def _decided(said: DataFrame, ids: DataFrame, work: Workspace, name: str, shingle: int, least: float) -> DataFrame:
    """Links of ``said`` that hold; those whose ``similar`` is null are decided on both texts, of which no others are moved."""
    links, open_links = said.where("similar").drop("similar"), said.where("similar IS NULL").drop("similar")
    ends = [open_links.select(F.col(c).alias("doc_id"), F.col(f"{c}_key").alias("text_key")) for c in "ab"]
    # Written first, so that Spark knows their size and broadcasts few ones: texts that none names aren't shuffled then.
    asked = work.put(ends[0].unionAll(ends[1]).distinct(), f"{name}_asked")
    whole = work.put(ids.join(asked, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]), f"{name}_texts")
    text = lambda c: whole.select(F.col("doc_id").alias(c), F.col("text_key").alias(f"{c}_key"), F.col("text").alias(f"{c}_text"))
    pairs = open_links.join(text("a"), ["a", "a_key"]).join(text("b"), ["b", "b_key"]).select("a", "a_key", "b", "b_key", "a_text", "b_text")
    links = work.put(links.unionAll(pairs.mapInArrow(_checked_on_texts(shingle, least), SAID.removesuffix(", similar boolean"))), name)
    work.drop(f"{name}_asked", f"{name}_texts")
    return links


def _rest(links: DataFrame, tried: DataFrame, found: DataFrame, keys: Column, work: Workspace, least: float, most: int) -> DataFrame | None:
    """What ``links``, those of the ``tried`` (a, b) that held, have left open, as links with what sketches say; None if nothing.

    Where all tried links of a bucket have joined ends, its texts are one component. Only in others can two similar
    texts be apart: all texts of these, not one a fingerprint, meet pair by pair in chunks of at most ``most``.
    """
    joined = connected_components(links.select("a", "b"), work, "joined")
    label = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    apart = tried.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    apart = work.put(apart.select("a", "b"), "apart")
    if apart.isEmpty():
        return None
    own = lambda c: found.select(F.col("doc_id").alias(c), keys.alias(f"{c}_keys"))
    met = apart.join(own("a"), "a").join(own("b"), "b")
    still = work.put(met.select(F.explode(F.array_intersect("a_keys", "b_keys")).alias("key")).distinct(), "still")
    rows = found.select(F.explode(keys).alias("key"), "fp", F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key")).join(still, "key", "left_semi")
    rows = rows.distinct().join(label("rep"), "rep", "left").withColumn("label", F.coalesce("rep_label", "rep")).drop("rep_label")
    rows = work.put(rows, "rest_rows")
    # Buckets of the same texts, as texts with equal minima make up to 15, are compared once.
    alike = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep", "rep_key")).alias("sum"), F.min("label").alias("low"), F.max("label").alias("high"))
    one = work.put(alike.where("low < high").groupBy("n", "sum").agg(F.min("key").alias("key")).select("key"), "rest_keys")
    rows = _chunked(rows.join(one, "key", "left_semi"), most, work)
    sketch = found.select(F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"), "sketch").dropDuplicates(["rep", "rep_key"])
    said = rows.join(sketch, ["rep", "rep_key"]).groupBy("key").applyInArrow(_compared(least), SAID)
    said = work.put(said.where("a <> b").distinct(), "rest_said")
    work.drop("apart", "still", "rest_rows", "rest_keys")
    return said


def similar_links(docs: DataFrame, work: Workspace, shingle: int = WIDE_SHINGLE, least: float = SIMILARITY, most: int = SPLIT) -> DataFrame:
    """(a, a_key, b, b_key): links of texts (id, hash) that join those of a similarity of ``least`` or more.

    Two texts meet in a bucket if two of their six minima agree: at a similarity of 0.8 with a
    probability of 0.998. A bucket of more than ``most`` fingerprints falls into pairs of chunks, each of
    which any two of its texts share. Links whose sketches give an estimate close to ``least`` are decided on
    both whole texts, of which only those that such a link names are moved. Where links of a bucket fail and leave it in
    parts, all of its pairs between parts are compared (quadratic in such a bucket).
    """
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), utf8(F.col("text")).alias("text"))
    m = [f"m{i}" for i in range(MINIMA)]
    columns = f"doc_id bigint, text_key bigint, fp bigint, {', '.join(f'{c} bigint' for c in m)}, sketch binary"
    found = work.put(ids.mapInArrow(_sketches(shingle), columns), "sketches")
    groups = work.put(found.groupBy("fp", *m).agg(F.min("doc_id").alias("rep")), "groups")
    pairs = enumerate(combinations(m, 2))
    keys = F.array(*[F.xxhash64(F.lit(k), i, j) for k, (i, j) in pairs])
    buckets = work.put(groups.select(F.explode(keys).alias("key"), "fp", "rep"), "buckets")
    between = _linked(_chunked(buckets, most, work), WIDE_BUDGETS)
    within = found.join(groups, ["fp", *m]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    tried = work.put(between.unionByName(within).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    sketch = lambda c: found.select(F.col("doc_id").alias(c), F.col("text_key").alias(f"{c}_key"), F.col("sketch").alias(f"{c}_sketch"))
    both = tried.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "a_key", "b", "b_key", "a_sketch", "b_sketch")
    said = work.put(both.mapInArrow(_checked(least), SAID), "said")
    links = _decided(said, ids, work, "similar", shingle, least)
    rest = _rest(links, tried, found, keys, work, least, max(2, most // 4))
    if rest is not None:
        links = links.unionAll(_decided(rest, ids, work, "rest", shingle, least))
    work.drop("sketches", "groups", "buckets", "candidates", "said")
    return links


def drop_near_duplicates(docs: DataFrame, shingle: int = WIDE_SHINGLE, least: float = SIMILARITY, most: int = SPLIT) -> DataFrame:
    """``docs`` with all its columns, one document of each component of near-duplicates: that with
    the smallest id.

    Near-duplicates have a Jaccard similarity of ``least`` or more of their ``shingle``-word shingles
    (A-Z lower-cased). Null text counts as empty; texts without words are alike. Rows with a null
    doc_id cannot be named by a component and stay. Of a repeated doc_id only the rows whose own
    text is a near-duplicate go; rows equal in all stay or go together. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "near")
    links = similar_links(docs, work, shingle, least, most)
    joined = connected_components(links.select("a", "b"), work)
    ends = links.select("a", "a_key").unionAll(links.select("b", "b_key")).distinct()
    gone = ends.join(joined, F.col("a") == F.col("node")).where("component < a").select(F.col("a").alias("__id"), F.col("a_key").alias("__key"))
    own = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key"))
    return docs.join(work.put(gone, "gone"), own, "left_anti")
