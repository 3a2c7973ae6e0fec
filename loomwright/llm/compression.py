"""Quality rules: word statistics, then compression bands learned per length.

Repetitive text compresses too well for its length, random text too badly. Each whole text and
each fixed chunk of a text of more than one is compressed with zstandard; what is left of a text
after its chunks belongs to the last one. A histogram of ratios over all distinct texts gives median
and spreads for every length class (power of two); classes of fewer than LEAST_TEXTS are judged with
the nearest ones, so that a lone text isn't its own measure. A text is rejected outside its class's
limits, or when half its chunks or more are outside theirs, in which every text has one vote. The
spread below is at least that of the neighbouring classes together, so that texts much alike can't
narrow the band of their class. The spread above is that of the ratios above the median alone, and at
least the smaller one of the neighbours': natural texts hardly vary there, and random ones lie close.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwright.llm.texts import utf8
from loomwright.session import Workspace

LEVEL = 3
CHUNK = 4096
#: Length classes are pooled, nearest first, until they hold so many texts: for a class's median, and for its spreads.
LEAST_TEXTS, LEAST_SPREAD_TEXTS = 25, 100
#: Ratios are kept in steps of 1/STEPS, so that limits come from counts and not from an order.
STEPS = 1000
#: Limits are the median and so many spreads (normalised median deviations) below and above.
WIDTH, WIDTH_ABOVE = 4.5, 3.75
#: A text's weight among the chunks, which its chunks share: each text has one vote, however long.
VOTE = 1 << 20
LEAST_SPREAD = 0.01
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
BASE = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def word_statistics(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (UTF-8)."""
    text, words = data.decode("utf-8", "replace"), data.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    counts = Counter(windows)
    if len(counts) < len(windows):
        end = 0  # words before it are counted
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    ratio = lambda x: len(packer.compress(x)) * STEPS // len(x)
    for batch in batches:
        rows, sizes, whole, chunks, digests = [], [], [], [], []
        for data in batch.column(1).to_pylist():
            rows.append(word_statistics(data))
            sizes.append(len(data).bit_length())
            digests.append(xxhash.xxh3_128_digest(data))
            whole.append(ratio(data) if data else None)
            # A text of less than two chunks is one chunk, and judged as a whole already.
            starts = range(0, len(data) - CHUNK + 1, CHUNK) if len(data) >= 2 * CHUNK else ()
            chunks.append([ratio(data[i : i + CHUNK] if i + 2 * CHUNK <= len(data) else data[i:]) for i in starts])
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
        more = [pa.array(sizes, pa.int32()), pa.array(whole, pa.int32()), pa.array(chunks, pa.list_(pa.int32())), pa.array(digests, pa.binary())]
        names = [x.split()[0] for x in BASE.split(", ")] + ["size_class", "ratio", "chunks", "digest"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *more], names)


def _median(counts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Lower median of ``value`` per ``by`` from a table of counts ``n``, one row per value."""
    upto = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    return ranked.where("2 * upto >= all").groupBy(*by).agg(F.min(value).alias(name))


def limits(ratios: DataFrame, width: float = WIDTH, above: float = WIDTH_ABOVE, least: int = LEAST_TEXTS, least_spread: int = LEAST_SPREAD_TEXTS) -> DataFrame:
    """(kind, size_class, low, high) from (kind, size_class, ratio, votes); a text's rows have VOTE votes together.

    The median is that of the class's pool: all classes nearer than the one with which it holds ``least``
    texts, and that one (classes equally near come together). Spreads are those of a pool of
    ``least_spread`` texts, each text's ratio taken from its own class's median. They are at least
    LEAST_SPREAD; below, at least that of the two neighbouring classes' pools together, and above, at
    least the smaller one of these two pools'.
    """
    key = ["kind", "size_class"]
    counts = ratios.groupBy(*key, "ratio").agg(F.sum("votes").alias("n"))
    sizes = counts.groupBy(*key).agg(F.sum("n").alias("n"))
    classes = F.array_sort(F.collect_list(F.struct("size_class", "n")))  # bits of lengths: 64 at most
    each = sizes.join(sizes.groupBy("kind").agg(classes.alias("others")), "kind").select(*key, F.explode("others").alias("o"))
    near = each.select(*key, F.col("o.size_class").alias("other"), F.abs(F.col("o.size_class") - F.col("size_class")).alias("distance"), F.col("o.n").alias("n"))
    nearer = W.partitionBy(*key).orderBy("distance").rangeBetween(W.unboundedPreceding, -1)
    pools = near.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).select(*key, "other", "before")

    def pooled(rows: DataFrame, least: int) -> DataFrame:
        return pools.where(F.col("before") < least * VOTE).join(rows.withColumnRenamed("size_class", "other"), ["kind", "other"]).drop("other", "before")

    middle = _median(pooled(counts, least).groupBy(*key, "ratio").agg(F.sum("n").alias("n")), key, "ratio", "middle")
    apart = counts.join(middle, key).select(*key, (F.col("ratio") - F.col("middle")).alias("apart"), "n")
    away = pooled(apart, least_spread).groupBy(*key, F.abs("apart").alias("away"), (F.col("apart") >= 0).alias("up")).agg(F.sum("n").alias("n"))
    both = away.groupBy(*key, "away").agg(F.sum("n").alias("n"))
    next_to = lambda rows: rows.withColumn("size_class", F.explode(F.array(F.col("size_class") - 1, F.col("size_class") + 1)))
    around = _median(next_to(both).groupBy(*key, "away").agg(F.sum("n").alias("n")), key, "away", "near_mad")
    up = _median(away.where("up"), key, "away", "up_mad")
    near_up = next_to(up).groupBy(*key).agg(F.min("up_mad").alias("near_up"))
    spread = middle.join(_median(both, key, "away", "mad"), key).join(around, key, "left").join(up, key, "left").join(near_up, key, "left")
    of = lambda *mads: F.greatest(F.greatest(*mads) / STEPS * 1.4826, F.lit(LEAST_SPREAD))
    return spread.select(
        *key, (F.col("middle") / STEPS - width * of("mad", "near_mad")).alias("low"), (F.col("middle") / STEPS + above * of("up_mad", "near_up")).alias("high")
    )


def judge(docs: DataFrame, width: float = WIDTH, above: float = WIDTH_ABOVE) -> DataFrame:
    """BASE columns, base_failed, kept and the ratio for every row of ``docs`` (doc_id, text).

    Null text has no words and fails the base rules, as does an empty one. Length classes are
    few (bits of the length), so the limits are a small table whatever the input. A text alone
    in its class is judged by the nearest classes. Copies of a text count once in the limits; all
    rows come out again. An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "bands")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    found = work.put(narrow.mapInArrow(_statistics, f"{BASE}, size_class int, ratio int, chunks array<int>, digest binary"), "measured")
    texts = work.put(found.where("ratio is not null").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("size_class", "ratio", "chunks")]), "texts")
    whole = texts.select(F.lit("whole").alias("kind"), "size_class", "ratio", F.lit(VOTE).cast("double").alias("votes"))
    share = VOTE / F.size("chunks")
    parts = texts.where(F.size("chunks") > 0).select(F.lit("chunk").alias("kind"), F.lit(0).alias("size_class"), F.explode("chunks").alias("ratio"), share.alias("votes"))
    table = work.put(limits(whole.unionAll(parts).withColumn("votes", F.floor("votes")), width, above), "limits")
    own = table.where("kind = 'whole'").select("size_class", "low", "high")
    chunk = table.where("kind = 'chunk'").agg(F.max("low").alias("chunk_low"), F.max("high").alias("chunk_high")).first()
    ratio = F.col("ratio") / STEPS
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = ratio.between(F.col("low"), F.col("high")) & _chunks_fit(chunk)
    # At most 32 length classes (bits of a text's length): the broadcast side has a fixed bound.
    return found.join(F.broadcast(own), "size_class", "left").select(
        *[x.split()[0] for x in BASE.split(", ")],
        failed.alias("base_failed"),
        (~failed & F.coalesce(fits, F.lit(False))).alias("kept"),
        ratio.alias("ratio"),
    )


def _chunks_fit(chunk) -> Column:
    if chunk["chunk_low"] is None:
        return F.lit(True)
    low, high = chunk["chunk_low"] * STEPS, chunk["chunk_high"] * STEPS
    outside = F.size(F.filter("chunks", lambda x: (x < low) | (x > high)))
    return (F.size("chunks") == 0) | (2 * outside < F.size("chunks"))
