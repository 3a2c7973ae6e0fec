"""Language identification with a bit-sliced Bloom filter over character n-grams.

The filter is one table of slots; bit l of a slot belongs to language l. An n-gram's slots are
read once and joined by AND: the bits left are all languages that may hold the n-gram. Counting
bits per language over a text, and taking off the share that each language's slice would give by
chance, leaves comparable shares; the largest decides. A text of letters that stand alone has no
n-gram; the languages' shares of its letters decide then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.texts import fold, utf8

GRAM = 4
HASHES = 3
#: Labelled documents used for fitting are sampled by a hash of their id to about so many per language.
FIT_ROWS = 4000
#: An n-gram counts as a language's if it makes at least this share of its n-grams (which bounds
#: their number by the reciprocal) and this share of what the language that uses it most has.
LEAST_SHARE = 2e-5
LEAST_OF_MOST = 0.2
UNKNOWN = "und"
#: Languages of one word of a slot.
WORD_BITS = 64
#: Characters of a text that are turned to n-grams at once.
BLOCK = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(data: bytes) -> np.ndarray:
    """The text's code points, letters in lower case and all else as spaces."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters()[points]


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of folded code points, in blocks; those with two spaces on end are left out. Nothing without a letter."""
    if not (points != 32).any():
        return
    points = np.concatenate([np.full(1, 32, np.uint32), points, np.full(GRAM, 32, np.uint32)]).astype(np.uint64)
    for at in range(0, len(points) - GRAM + 1, BLOCK):
        part = points[at : at + BLOCK + GRAM - 1]
        n = len(part) - GRAM + 1
        if n <= 0:
            return
        value = np.zeros(n, np.uint64)
        bad = np.zeros(n, bool)
        for i in range(GRAM):
            value = value << np.uint64(16) ^ part[i : i + n]
            if i:
                bad |= (part[i - 1 : i - 1 + n] == 32) & (part[i : i + n] == 32)
        value = value[~bad]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        yield value ^ (value >> np.uint64(29))


class LanguageFilter:
    """Bit-sliced Bloom filter: ``slots`` slots of one bit per language, in words of up to 64."""

    def __init__(self, languages: list[str], gram_sets: list[np.ndarray], letters: dict[int, np.ndarray] | None = None):
        most = max((len(x) for x in gram_sets), default=0)
        self.languages = languages
        #: For each letter (code point) its share of every language's letters.
        self.letters = letters or {}
        self.shift = 64 - max(10, int(most * 16).bit_length())  # 16 to 32 slots for each n-gram
        self.words: list[np.ndarray] = []
        fill = []
        for first in range(0, max(1, len(languages)), WORD_BITS):
            sets = gram_sets[first : first + WORD_BITS]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(sets))
            slots = np.zeros(1 << (64 - self.shift), kind)
            for bit, found in enumerate(sets):
                for at in self._places(found):
                    slots[at] |= kind(1 << bit)
            self.words.append(slots)
            fill += [float((slots >> kind(b) & kind(1)).mean()) for b in range(len(sets))]
        self.chance = np.array(fill) ** HASHES

    def _places(self, found: np.ndarray) -> Iterator[np.ndarray]:
        step = found * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
        for i in range(HASHES):
            yield (found + np.uint64(i) * step) >> np.uint64(self.shift)

    def masks(self, found: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the languages that may hold it, as bits, word by word."""
        masks: list[np.ndarray] = []
        for at in self._places(found):
            read = [slots[at] for slots in self.words]
            masks = [a & b for a, b in zip(masks, read)] if masks else read
        return masks

    def counts(self, found: np.ndarray) -> np.ndarray:
        """For each language how many of the n-grams it may hold."""
        counts: list[int] = []
        for masks in self.masks(found):
            size = min(WORD_BITS, len(self.languages) - len(counts))
            if masks.dtype.itemsize == 1:
                seen = np.bincount(masks, minlength=256)
                counts += [int(seen[(np.arange(256) >> b & 1) == 1].sum()) for b in range(size)]
            else:
                counts += [int((masks >> masks.dtype.type(b) & masks.dtype.type(1)).sum()) for b in range(size)]
        return np.array(counts, np.int64)

    def shares(self, data: bytes) -> np.ndarray | None:
        """Per language the share of the text's n-grams beyond chance, or where it has none the
        mean share of its letters; None without letters."""
        points = folded(data)
        counts, n = np.zeros(len(self.languages), np.int64), 0
        for found in grams(points):
            counts += self.counts(found)
            n += len(found)
        if not n:
            own, times = np.unique(points[points != 32], return_counts=True)
            if not len(own):
                return None
            none = np.zeros(len(self.languages))
            return sum(k * self.letters.get(c, none) for c, k in zip(own.tolist(), times.tolist())) / times.sum()
        return np.maximum(0, (counts / n - self.chance) / np.maximum(1e-9, 1 - self.chance))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageFilter:
    """A filter from ``docs`` (doc_id, text, lang): about ``rows`` documents for each language, chosen by hash."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    number = {k: i for i, k in enumerate(languages)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    spark = docs.sparkSession
    # A row for each language: as many as the filter has bits.
    rates = spark.createDataFrame([(k, int((1 << 30) * min(1.0, rows / n))) for k, n in sizes.items()], "lang string, below bigint")
    sample = known.join(F.broadcast(rates), "lang").where(draw < F.col("below")).select(utf8(F.col("text")).alias("text"), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[str, int], list[np.ndarray]] = {}
            for data, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = folded(data)
                by.setdefault((lang, GRAM), []).extend(grams(points))
                by.setdefault((lang, 1), []).append(points[points != 32])
            for (lang, size), parts in by.items():
                if not parts:
                    continue
                if size == 1:
                    n = np.bincount(np.concatenate(parts))
                    gram = np.flatnonzero(n)
                    n = n[gram]
                else:
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    gram = gram.view(np.int64)
                cols = {"size": np.full(len(gram), size, np.int32), "gram": gram, "lang": pa.array([lang] * len(gram), pa.string()), "n": n.astype(np.int64)}
                yield pa.RecordBatch.from_pydict(cols)

    both = sample.mapInArrow(run, "size int, gram bigint, lang string, n bigint").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    # Each language's number of n-grams, and its letters, which are as many as Unicode has at most.
    sums = both.groupBy("lang", F.when(F.col("size") == 1, F.col("gram")).alias("letter")).agg(F.sum("n").alias("n")).collect()
    totals = {r["lang"]: r["n"] for r in sums if r["letter"] is None}
    letters: dict[int, np.ndarray] = {}
    for r in sums:
        if r["letter"] is not None:
            letters.setdefault(r["letter"], np.zeros(len(languages)))[number[r["lang"]]] = r["n"]
    if letters:
        of = np.maximum(1, sum(letters.values()))
        letters = {c: n / of for c, n in letters.items()}
    counts = both.where(F.col("size") == GRAM).select("gram", "lang", "n")
    sums = spark.createDataFrame([(k, float(v)) for k, v in totals.items()], "lang string, total double")
    shares = counts.join(F.broadcast(sums), "lang").withColumn("share", F.col("n") / F.col("total")).drop("total")
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    own = shares.where(F.col("share") >= LEAST_SHARE).join(most, "gram").where(F.col("share") >= LEAST_OF_MOST * F.col("most"))
    found: dict[str, list[int]] = {k: [] for k in languages}
    for r in own.select("lang", "gram").toLocalIterator():  # at most 1 / LEAST_SHARE of a language
        found[r["lang"]].append(r["gram"])
    return LanguageFilter(languages, [np.array(sorted(found[k]), np.int64).view(np.uint64) for k in languages], letters)


def predict(docs: DataFrame, model: LanguageFilter, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text), as ``identify``."""
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 1 / LEAST_SHARE n-grams of 32 slots at most, however large the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, scores = [], []
            for data in batch.column(2).to_pylist():
                shares = model.shares(data) if model.languages else None
                if shares is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best = int(shares.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(shares[best] / shares.sum()) if shares.sum() else 0.0)
            cols = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"), utf8(F.col("text")).alias("text")
    )
    return narrow.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Fitted on rows with a language whose id's crc32 modulo ``folds`` is not 0; held_out marks the
    others. Null text and text without a letter give ``und`` with score 0, as does every text
    when nothing is learned. Ties go to the language first in order. Repeated rows come out again.
    Any number of languages is learned. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs.where(fold(F.col("doc_id"), folds) != 0).select("doc_id", "text", "lang"), rows)
    return predict(docs, model, folds)
