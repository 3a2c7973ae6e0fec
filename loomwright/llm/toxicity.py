"""Toxicity scores from a learned lexicon, matched with Levenshtein automata over its trie.

Fitting: on a bounded sample of labelled documents, words and word beginnings (stems) that occur
in toxic documents, in several different surroundings, and hardly in clean ones become terms with
a log-likelihood ratio as weight. Surroundings are counted and not only documents, so that copies
of one document don't make its rare words terms.

Matching: the trie's nodes paired with edit counts are the states of the intersection of the
lexicon with every token's Levenshtein automaton. Sets of such states are made into one
deterministic automaton while tokens are read, each transition once; a token leaves it at the
first letter beyond the allowed edits, mostly after a few letters.

Scoring: hits weigh less with each edit and within quotation marks. The weights of the distinct
terms in the heaviest window of tokens are added, with a part of those of a stem's further words and
of a wider window, so a term scattered over a long text or a quotation alone stays below abuse, while
words of one stem in close order don't; a logistic curve, fitted on sampled documents with hits that
did not make the lexicon, turns the sum into the score; where these are many, their own shares do. Texts without hits share one score.
"""

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.texts import fold, utf8
from loomwright.session import Workspace

#: Labelled documents used for fitting (sampled by a hash of their id), whatever the input. They bound
#: the terms, too: each occurs in MIN_SHARE of the sample's toxic documents at least, so there are no
#: more than 1 / MIN_SHARE times the distinct words and stems of a toxic document on average.
FIT_ROWS = 40_000
MIN_DOCS = 3
MIN_SHARE = 0.005
MIN_CONTEXTS = 3
MIN_PRECISION = 0.85
STEM_SIZES = (4, 8)
STEM_WORDS = 3
#: Allowed edits by length of a term: up to 4 letters none, up to 9 one, else two. Stems take none,
#: and a term fewer if words at that distance are no sign of toxicity in the sample.
EDITS = ((4, 0), (9, 1))
MOST_EDITS = 2
EDIT_FACTOR = 0.6
QUOTE_FACTOR = 0.5
#: Tokens in a window and in a wide one; what a stem's further words count in a window, and what the
#: wide window's sum counts beyond the window's: abuse is dense in words of one stem, chance is not.
WINDOW, WIDE_WINDOW = 50, 400
FURTHER, WIDE_FACTOR = 0.25, 0.35
THRESHOLD = 0.7
#: Texts on the logistic curve that are added to each pool of texts of like weight.
CURVE_TEXTS = 5
TOKEN = re.compile(r"\w+")
#: A quotation opens and closes on one line; one that doesn't close is none.
QUOTATIONS = ((re.compile('"[^"\n]*["\n]?'), '"'), (re.compile("[“„«][^”»\n]*[”»\n]?"), "”»"))
#: What a task remembers at most before it forgets all: tokens met, and (node, edits) pairs in the
#: automaton's states, about 100 bytes each.
MOST_TOKENS = 200_000
MOST_NODES = 500_000


def edits_for(term: str) -> int:
    return next((k for size, k in EDITS if len(term) <= size), MOST_EDITS)


@dataclass
class Lexicon:
    """Terms and stems with weights, as a trie whose automaton is built while it is used."""

    terms: list[tuple[str, bool, float, int]]  # text, is a stem, weight, allowed edits
    slope: float = 1.0
    shift: float = -5.0
    none: float = 0.01  # score of a text without hits
    points: tuple[tuple[float, float], ...] = ()  # rising (weight, score); between them scores lie on a line
    made: bool = field(default=False, repr=False)

    def prepare(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.allowed: list[int] = [0]
        for number, (text, stem, _, limit) in enumerate(self.terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], limit)
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    for column in (self.word_at, self.stem_at):
                        column.append(-1)
                    self.allowed.append(0)
                node = self.children[node][ch]
                self.allowed[node] = max(self.allowed[node], limit)
            (self.stem_at if stem else self.word_at)[node] = number
        # A word counts as the same term as the stem that it begins with.
        stems = {text: number for number, (text, stem, _, _) in enumerate(self.terms) if stem}
        self.same = [
            number if stem else next((stems[text[:n]] for n in range(1, len(text) + 1) if text[:n] in stems), number)
            for number, (text, stem, _, _) in enumerate(self.terms)
        ]
        self.known: dict[str, tuple[int, int] | None] = {}
        self._restart()
        self.made = True

    def _restart(self) -> None:
        self.sets: list[tuple[dict[int, int], tuple[int, int] | None]] = []
        self.numbers: dict = {}
        self.steps: list[dict[str, int]] = []
        self.size = 0
        self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], stem: tuple[int, int] | None) -> int:
        """Number of the state with these nodes (at their least edits) and the stem met so far."""
        todo = list(nodes.items())
        while todo:  # leaving out a letter of the term costs an edit and no letter of the token
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.allowed[child] and nodes.get(child, 9) > edits + 1:
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        for node, edits in nodes.items():
            if self.stem_at[node] >= 0 and edits == 0:
                stem = stem or (self.stem_at[node], 0)
        key = (frozenset(nodes.items()), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append((nodes, stem))
            self.steps.append({})
            self.size += 4 + len(nodes)
        return self.numbers[key]

    def _step(self, state: int, ch: str) -> int:
        nodes, stem = self.sets[state]
        after: dict[int, int] = {}
        for node, edits in nodes.items():
            for letter, child in self.children[node].items():
                cost = edits + (letter != ch)
                if cost <= self.allowed[child] and after.get(child, 9) > cost:
                    after[child] = cost
            if edits < self.allowed[node] and after.get(node, 9) > edits + 1:
                after[node] = edits + 1
        return self._state(after, stem) if after or stem else -1

    def match(self, token: str) -> tuple[int, int] | None:
        """(number of the term, edits) of the nearest term, or None."""
        if token in self.known:
            return self.known[token]
        if self.size > MOST_NODES:
            self._restart()
        if len(self.known) > MOST_TOKENS:
            self.known.clear()
        state, steps = 0, self.steps
        for ch in token:
            after = steps[state].get(ch)
            if after is None:
                after = steps[state][ch] = self._step(state, ch)
            state = after
            if state < 0:
                break
        found = None
        if state >= 0:
            nodes, found = self.sets[state]
            for node, edits in nodes.items():
                term = self.word_at[node]
                if term >= 0 and edits <= self.terms[term][3] and (found is None or (edits, term) < found[::-1]):
                    found = (term, edits)
        self.known[token] = found
        return found

    def weigh(self, text: str) -> float:
        """The heaviest window's sum, and a part of what the heaviest wide window has beyond it."""
        if not self.made:
            self.prepare()
        text = text.lower()
        tokens = TOKEN.findall(text)
        hit = {t for t in set(tokens) if self.match(t)}
        if not hit:
            return 0.0
        quotes = merged_spans(quotations(text))
        starts = [begin for begin, _ in quotes]
        hits = []
        for at, token in enumerate(TOKEN.finditer(text)):
            if token[0] in hit:
                term, edits = self.known.get(token[0]) or self.match(token[0])
                weight = self.terms[term][2] * EDIT_FACTOR**edits
                near = bisect_right(starts, token.start())
                same = self.same[term]
                # Misspellings of a word are the word; words that begin with a stem are words of their own.
                word = "" if not self.terms[same][1] else token[0] if self.terms[term][1] else self.terms[term][0]
                hits.append((at, same, word, weight * QUOTE_FACTOR if near and token.end() <= quotes[near - 1][1] else weight))
        short = heaviest(hits, WINDOW, FURTHER)
        return short + WIDE_FACTOR * (heaviest(hits, WIDE_WINDOW, 1.0) - short)

    def score(self, weight: float) -> float:
        if weight <= 0:
            return self.none
        at = bisect_right(self.points, (weight, 2.0))
        if 0 < at < len(self.points):
            (x, p), (y, q) = self.points[at - 1 : at + 1]
            found = p + (q - p) * (weight - x) / (y - x)
        else:  # beyond the points the curve goes on
            curve = 1 / (1 + math.exp(-max(-700.0, self.slope * weight + self.shift)))
            found = max(curve, self.points[-1][1]) if at else min(curve, self.points[0][1]) if self.points else curve
        return max(self.none, found)


def heaviest(hits: list[tuple[int, int, str, float]], size: int, further: float) -> float:
    """The largest sum in a window of ``size`` tokens over ``hits`` (place, term, word, weight): each term's
    heaviest word counts whole, its other words ``further`` times; of a word's hits the heaviest counts."""
    most = total = 0.0
    low = 0
    words: dict[tuple[int, str], list[float]] = {}
    terms: dict[int, dict[str, float]] = {}

    def of_term(term: int) -> float:
        own = terms.get(term)
        if not own:
            return 0.0
        best = max(own.values())
        return best + further * (sum(own.values()) - best)

    def change(term: int, word: str, weight: float, enters: bool) -> float:
        before = of_term(term)
        held = words.setdefault((term, word), [])
        held.append(weight) if enters else held.remove(weight)
        if held:
            terms.setdefault(term, {})[word] = max(held)
        else:
            del terms[term][word]
        return of_term(term) - before

    for at, term, word, weight in hits:
        while hits[low][0] <= at - size:
            total += change(*hits[low][1:], False)
            low += 1
        total += change(term, word, weight, True)
        most = max(most, total)
    return most


def quotations(text: str) -> list[tuple[int, int]]:
    """Beginnings and ends of the text's quotations, in order: straight marks by turns on each line, an
    opening mark up to the next closing one. Read once from left to right, however long they are."""
    found = []
    for pattern, closing in QUOTATIONS:
        found += [(m.start(), m.end()) for m in pattern.finditer(text) if m[0][-1] in closing and len(m[0]) > 1]
    return sorted(found)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, toxic, clean): a row without context for each document's distinct words
    (clean ones added up in the batch), and for toxic documents one for each surrounding of a word."""
    for batch in batches:
        clean: dict[str, int] = {}
        words, contexts, toxic, counts = [], [], [], []
        for data, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = TOKEN.findall(data.decode("utf-8", "replace").lower())
            if not label:
                for w in set(tokens):
                    clean[w] = clean.get(w, 0) + 1
                continue
            own = set(tokens)
            words += own
            contexts += [None] * len(own)
            toxic += [1] * len(own)
            around = {(w, zlib.crc32(f"{a} {b}".encode())) for a, w, b in zip(["", *tokens], tokens, [*tokens[1:], ""])}
            words += [w for w, _ in around]
            contexts += [c for _, c in around]
            toxic += [0] * len(around)
        counts = [0] * len(words) + list(clean.values())
        toxic += [0] * len(clean)
        contexts += [None] * len(clean)
        words += clean
        cols = [pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array(toxic, pa.int64()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["word", "context", "toxic", "clean"])


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows: int, work: Workspace) -> DataFrame:
    """(text, toxic, mine) of about ``rows`` labelled documents outside the held-out fold; three in
    four of them make the lexicon (mine), the others the curve."""
    of = lambda name: F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << 30))
    marked = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(fold(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rate = min(1.0, rows / max(1, marked.count()))
    drawn = of("toxicity") < int((1 << 30) * rate)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    texts = texts.where(fold(F.col("doc_id"), folds) != held).where(drawn)
    chosen = F.broadcast(marked.where(drawn))  # about ``rows`` ids, whatever the input; texts need no shuffle
    return work.put(texts.join(chosen, "doc_id").select("text", "toxic", (of("mine") % 4 != 0).alias("mine")), "sample")


def mine_terms(mine: DataFrame, work: Workspace) -> list[tuple[str, bool, float, int]]:
    """Terms and stems from (text, toxic), with as many edits as a term's length allows."""
    sizes = {r["toxic"]: r["n"] for r in mine.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    rows = mine.select("text", "toxic").mapInArrow(_evidence, "word string, context bigint, toxic bigint, clean bigint")
    by_context = rows.groupBy("word", "context").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = work.put(
        by_context.groupBy("word").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("context").alias("contexts"), F.lit(1).cast("bigint").alias("words")
        ),
        "words",
    )
    low, high = STEM_SIZES
    stems = (
        words.where(F.length("word") > low)
        .select(F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.length("word") - 1))).alias("n"), "*")
        .groupBy(F.expr("substring(word, 1, n)").alias("word"))
        .agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "contexts", "words")])
        .where(F.col("words") >= STEM_WORDS)
    )
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    both = words.withColumn("stem", F.lit(False)).unionByName(stems.withColumn("stem", F.lit(True)))
    good = both.where(
        (F.length("word") >= 3)
        & (F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * toxic))
        & (F.col("contexts") >= F.greatest(F.lit(MIN_CONTEXTS), 0.1 * F.col("toxic")))
        & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean")))
    )
    rows = good.select("word", "stem", weight.alias("weight"))
    found = rows.collect()  # bounded by MIN_SHARE, see FIT_ROWS
    stems_found = {r["word"] for r in found if r["stem"]}
    beginnings = lambda w: (w[:n] for n in range(STEM_SIZES[0], len(w)))
    # A word that begins with a stem stays for the sake of its misspellings; a stem within a stem adds nothing.
    own = [r for r in found if not (r["stem"] and any(b in stems_found for b in beginnings(r["word"])))]
    return sorted((r["word"], r["stem"], r["weight"], 0 if r["stem"] else edits_for(r["word"])) for r in own)


def checked_edits(mine: DataFrame, terms: list[tuple[str, bool, float, int]]) -> list[tuple[str, bool, float, int]]:
    """``terms`` with fewer edits where words so far from a term are common in clean documents."""
    sent = mine.sparkSession.sparkContext.broadcast(Lexicon(terms))  # terms are bounded by MIN_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        if not lexicon.made:
            lexicon.prepare()
        for batch in batches:
            counts: dict[tuple[int, int, int], int] = {}
            for data, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = {lexicon.match(t) for t in set(TOKEN.findall(data.decode("utf-8", "replace").lower()))}
                for term, edits in hits - {None}:
                    if edits:
                        counts[term, edits, label] = counts.get((term, edits, label), 0) + 1
            cols = [*zip(*counts)] if counts else [(), (), ()]
            arrays = [pa.array(c, pa.int64()) for c in (*cols, list(counts.values()))]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "edits", "toxic", "n"])

    rows = mine.select("text", "toxic").mapInArrow(run, "term bigint, edits bigint, toxic bigint, n bigint")
    sums = rows.groupBy("term", "edits").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n")
    )
    limit = {r["term"]: r["edits"] - 1 for r in sums.where(F.col("toxic") < MIN_PRECISION * F.col("n")).orderBy(F.desc("edits")).collect()}
    return [(text, stem, weight, min(edits, limit.get(i, edits))) for i, (text, stem, weight, edits) in enumerate(terms)]


def _weights(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        for batch in batches:
            found = [lexicon.weigh(data.decode("utf-8", "replace")) for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64())], ["toxic", "weight"])

    return run


def _curve(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (weight, label, count), kept from extremes by a small ridge."""
    slope, shift = 0.5, -5.0
    for _ in range(50):
        g = [-0.05 * (slope - 1.0), -0.02 * (shift + 5.0)]
        h = [[0.05, 0.0], [0.0, 0.02]]
        for x, y, n in counts:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + shift))))
            g[0] += n * (y - p) * x
            g[1] += n * (y - p)
            d = n * p * (1 - p)
            h[0][0] += d * x * x
            h[0][1] += d * x
            h[1][1] += d
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        step = ((h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det)
        step = tuple(max(-1.0, min(1.0, s)) for s in step)
        slope, shift = slope + step[0], shift + step[1]
        if max(map(abs, step)) < 1e-9:
            break
    return slope, shift


def _points(counts: list[tuple[float, int, int]], slope: float, shift: float) -> tuple[tuple[float, float], ...]:
    """Rising points (weight, share of toxic texts): neighbouring weights are pooled until shares rise, and each
    pool has CURVE_TEXTS more texts that lie on the curve, so that it speaks where texts are few."""
    by: dict[float, list[int]] = {}
    for x, y, n in counts:
        own = by.setdefault(x, [0, 0])
        own[0], own[1] = own[0] + n, own[1] + n * y
    pools: list[tuple[int, int, float, float]] = []  # texts, toxic ones, least and largest weight
    for x in sorted(by):
        pools.append((*by[x], x, x))
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            (n, toxic, low, _), (m, more, _, high) = pools[-2:]
            pools[-2:] = [(n + m, toxic + more, low, high)]
    out: list[tuple[float, float]] = []
    for n, toxic, low, high in pools:
        for x in dict.fromkeys((low, high)):
            curve = 1 / (1 + math.exp(-max(-700.0, min(700.0, slope * x + shift))))
            share = (toxic + CURVE_TEXTS * curve) / (n + CURVE_TEXTS)
            out.append((x, max(share, out[-1][1] if out else 0.0)))
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without the held-out fold."""
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    drawn = sample(docs, labels, folds, held, rows, work)
    mine = drawn.where("mine")
    lexicon = Lexicon(checked_edits(mine, mine_terms(mine, work)))
    sent = spark.sparkContext.broadcast(lexicon)  # terms are bounded by MIN_SHARE
    weights = drawn.where("not mine").select("text", "toxic").mapInArrow(_weights(sent), "toxic int, weight double")
    counts = weights.groupBy(F.round("weight", 1).alias("weight"), "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("weight", "toxic")
    # Toxic texts of which the lexicon knows nothing must not flatten the curve for those with hits.
    found = [(r["weight"], r["toxic"], r["n"]) for r in counts.collect()]
    hits = [x for x in found if x[0] > 0]
    lexicon.slope, lexicon.shift = _curve(hits)
    lexicon.points = _points(hits, lexicon.slope, lexicon.shift)
    unknown = [(toxic, n) for weight, toxic, n in found if weight <= 0]
    lexicon.none = min(0.5, (0.5 + sum(n for toxic, n in unknown if toxic)) / (50 + sum(n for _, n in unknown)))
    work.drop("sample", "words")
    return lexicon


def predict(docs: DataFrame, lexicon: Lexicon, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), as ``score_documents``."""
    sent = docs.sparkSession.sparkContext.broadcast(Lexicon(lexicon.terms, lexicon.slope, lexicon.shift, lexicon.none, lexicon.points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            scores = [round(lexicon.score(lexicon.weigh(data.decode("utf-8", "replace"))), 6) for data in texts]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out"), utf8(F.col("text")).alias("text")
    )
    return narrow.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts have no hits and get the curve's lowest score. Labels with a null in
    doc_id or toxic are not used; where labels of one document differ, toxic holds. Without
    labels nothing is learned and all scores are low. Repeated rows come out again. An empty
    table gives no rows; other columns are ignored.
    """
    return predict(docs, fit(docs, labels, folds, held, rows), folds, held)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows whose text is predicted to be toxic.

    Null and empty texts stay, as does everything without labels. Repeated rows share their fate;
    an empty table gives no rows.
    """
    lexicon = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(Lexicon(lexicon.terms, lexicon.slope, lexicon.shift, lexicon.none, lexicon.points))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        lexicon = sent.value
        return texts.map(lambda t: lexicon.score(lexicon.weigh(t or "")) < THRESHOLD)

    return docs.where(clean(F.coalesce(F.col("text"), F.lit(""))))
