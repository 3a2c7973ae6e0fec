"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list splits a word into the one sequence of tokens whose neighbours are all stable: two
tokens stand side by side only if merging their joined symbols gives back just these two. The
transducer reads a word symbol by symbol and keeps, for each position, the last token of the
split of all that came before it. The next token can begin no further back than the longest
token, so only the last ``lookahead`` positions can still be referred to. Once the splits of all
these share their first tokens, those are stable and are emitted. Memory is bounded by the
lookahead, however long the word; texts are read in pieces cut at white space.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.texts import utf8

END = "</w>"
#: Stands after the last byte of a word and of a token that ends words; no byte is above it.
STOP = "\u0100"
SYMBOL = re.compile(f".{STOP}?", re.DOTALL)
#: Unicode's white space, as a class's content.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of a text that are normalised and split at once (up to the next white space).
PIECE = 1 << 16
#: Words and pairs of tokens that a task remembers; it forgets all when one is full.
REMEMBERED = 400_000


def _byte_symbols() -> dict[str, int]:
    """Symbol -> byte of the byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@dataclass(frozen=True)
class Letters:
    """What the ``tokenizers`` library takes for letters and numbers (contents of classes), and where its
    lower case is not Python's: the Unicode versions of both differ."""

    letters: str
    numbers: str
    lower: dict[int, str]


def _class_of(points: list[int]) -> str:
    """The content of a class with these code points, in rising order."""
    parts, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        parts.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(parts)


@lru_cache(1)
def library_letters() -> Letters:
    """Asks the library about every code point; a few seconds, once for a session."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))

    def having(kind: str) -> list[int]:
        inside = bytearray(b"\1") * len(text)
        for _, (a, b) in pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed").pre_tokenize_str(text):
            inside[a:b] = bytes(b - a)
        return [c for c, x in zip(points, inside) if x]

    lower = normalizers.Lowercase().normalize_str
    return Letters(_class_of(having("L")), _class_of(having("N")), {c: x for c in points if (x := lower(chr(c))) != chr(c).lower()} | {0x3A3: lower("\u03a3")})


class Words(dict):
    """Tokens of the words met so far; forgets all when it holds REMEMBERED words."""

    def __init__(self, tokens_of):
        super().__init__()
        self.tokens_of = tokens_of

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.tokens_of(word.encode("utf-8", "replace")))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class WordBpe:
    """Encoder and decoder for a tokenizer file with lower-casing, word ends and no decoder."""

    def __init__(self, path: str, known: Letters | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        known = known or library_letters()
        model, to_byte = spec["model"], _byte_symbols()

        def key(symbols: str) -> str:
            """A token as Latin-1 text of its bytes; a token that ends a word has STOP after them."""
            ends = symbols.endswith(END) and len(symbols) > len(END)
            data = bytes(to_byte[c] for c in (symbols.removesuffix(END) if ends else symbols))
            return data.decode("latin-1") + (STOP if ends else "")

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {key(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.names = {i: s.encode() for s, i in [*model["vocab"].items(), *self.special.items()]}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = model["vocab"][a], model["vocab"][b]
            self.ranks[left, right] = (rank, model["vocab"][a + b])
        self.symbols = {i: tuple(self.ids[x] for x in SYMBOL.findall(k)) for k, i in self.ids.items()}
        #: Finds, at each position of a word, the tokens that end there.
        self.tokens = ahocorasick.Automaton()
        for k, i in self.ids.items():
            self.tokens.add_word(k, (i, len(k)))
        self.tokens.make_automaton()
        #: Symbols after which a token's beginning can no longer change.
        self.lookahead = max(map(len, self.symbols.values()))
        special = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split_special = re.compile(f"({special})") if special else None
        self.space = re.compile(f"[{SPACE}]")
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.pattern = re.compile(rf"[{known.letters}]+|[{known.numbers}]|{short}|[^{SPACE}{known.letters}{known.numbers}]+")
        # The same for lower-cased Latin-1 text, whose letters and numbers are few enough to list.
        letters, numbers = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
        self.latin = re.compile(rf"[{letters}]+|[{numbers}]|{short}|[^\t-\r \x85\xa0{letters}{numbers}]+")
        self.lower = known.lower
        self.odd = re.compile(f"[{''.join(map(re.escape, map(chr, known.lower)))}]")
        #: Code points that Python's tables lack; the library normalises texts that have some.
        self.new = re.compile(f"[{_class_of([c for c in range(0x110000) if unicodedata.category(chr(c)) == 'Cn'])}]")
        self.nfc = None
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.words = Words(self.word)

    def merged(self, tokens: list[int], log: list | None = None) -> list[int]:
        """The merge list applied to ``tokens``: lowest rank first, leftmost first. ``log`` gets each
        step's rank with the first and last token before it."""
        while len(tokens) > 1:
            best = min((self.ranks.get(p, (1 << 60, -1)) for p in pairwise(tokens)))
            if best[1] < 0:
                break
            if log is not None:
                log.append((best[0], tokens[0], tokens[-1]))
            out, i = [], 0
            while i < len(tokens):
                pair = tuple(tokens[i : i + 2])
                if len(pair) == 2 and self.ranks.get(pair) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def edge(self, token: int) -> tuple[list, list] | None:
        """The first and the last token over time while the token's symbols are merged: (token,
        rank of the merge that ends it), the token itself without end. None if they make another token."""
        if token not in self.edges:
            log: list[tuple[int, int, int]] = []
            made = self.merged([*self.symbols[token]], log) == [token]
            both: tuple[list, list] = ([], [])
            time = -1
            for (rank, *old), new in zip(log, [x[1:] for x in log[1:]] + [(token, token)]):
                time = max(time, rank)
                for side in (0, 1):
                    if old[side] != new[side]:
                        both[side].append((old[side], time))
            for side in both:
                side.append((token, 1 << 60))
            self.edges[token] = both if made else None
        return self.edges[token]

    def stable(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their joined symbols are merged: no last part of a and
        first part of b that exist at one time merge before either is merged into its own token."""
        left, right = self.edge(a), self.edge(b)
        known = left is not None and right is not None
        if known:
            i = j = 0
            left, right, ranks = left[1], right[0], self.ranks
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                found = ranks.get((x, y))
                if found is not None and found[0] < x_end and found[0] <= y_end:
                    known = False
                    break
                if x_end == y_end == 1 << 60:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    def word(self, data: bytes) -> Iterator[int]:
        """Tokens of one word, each emitted once it is stable."""
        pairs, stable, look = self.pairs, self.stable, self.lookahead
        n, most = len(data), 4 * look
        # last[p - base], start[p - base]: last token of the split of data[:p], and where it begins; -2
        # if no token ends there. What lies before base is emitted, before is its last token.
        base, before = 0, -1
        last, start = [-1], [-1]
        top = 0
        for at, (token, size) in self.tokens.iter(data.decode("latin-1") + STOP):
            end = at + 1
            if end >= n:
                if end == n:
                    continue  # the last symbol is one that ends a word
                end = n
            if end == top:
                if last[-1] != -2:
                    continue
            else:
                if top - base >= most:
                    ready, base = self._emit(last, start, base, look)
                    if ready:
                        before = ready[-1]
                        yield from ready
                last += [-2] * (end - top)
                start += [-1] * (end - top)
                top = end
            begin = at + 1 - size
            if begin < base:
                continue
            prior = last[begin - base] if begin > base else before
            if prior != -2:
                if prior != -1:
                    good = pairs.get(prior << 32 | token)
                    if not (stable(prior, token) if good is None else good):
                        continue
                last[-1], start[-1] = token, begin
        out = []
        at = n
        while at > base:
            out.append(last[at - base])
            at = start[at - base]
        yield from reversed(out)

    @staticmethod
    def _emit(last: list[int], start: list[int], base: int, look: int) -> tuple[list[int], int]:
        """Tokens that the splits of the last ``look`` positions share, and where they end. Positions
        before that are dropped from ``last`` and ``start``."""
        end = base + len(last) - 1
        live = {p for p in range(end - look + 1, end + 1) if last[p - base] != -2}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(start[top - base])
        cut = live.pop()
        ready, at = [], cut
        while at > base:
            ready.append(last[at - base])
            at = start[at - base]
        del last[: cut - base], start[: cut - base]
        return ready[::-1], cut

    def normal_pieces(self, text: str) -> Iterator[str]:
        """The text's normal form, cut at white space: NFC, then each character lower-cased on its own."""
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cut = self.space.search(text, end)
                end = cut.end() if cut else len(text)
            part = text[at:end]
            if not _latin(part):  # Latin-1 is composed already
                part = self.composed(part)
                if self.odd.search(part):  # a final sigma, too, has no form of its own
                    part = part.translate(self.lower)
            yield part.lower()
            at = end

    def composed(self, part: str) -> str:
        if not self.new.search(part):
            return unicodedata.normalize("NFC", part)
        if self.nfc is None:
            from tokenizers import normalizers

            self.nfc = normalizers.NFC()
        return self.nfc.normalize_str(part)

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in runs; special tokens' strings become their ids."""
        tokens = self.words.__getitem__
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            for piece in self.normal_pieces(part):
                yield [*chain.from_iterable(map(tokens, (self.latin if _latin(piece) else self.pattern).findall(piece)))]


class Decoder:
    """Ids to text, step by step: tokens' bytes with a space between, through an incremental
    UTF-8 reader that holds back the bytes of a character still incomplete."""

    def __init__(self, names: dict[int, bytes]):
        self.names, self.reader, self.first = names, codecs.getincrementaldecoder("utf-8")("replace"), True

    def push(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = b" ".join(map(self.names.__getitem__, ids))
        data, self.first = data if self.first else b" " + data, False
        return self.reader.decode(data)

    def end(self) -> str:
        return self.reader.decode(b"", True)


_models: dict[str, WordBpe] = {}


def _digests(path: str, letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _models:
            _models[path] = WordBpe(path, letters)
        model = _models[path]
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                back = Decoder(model.names)
                for ids in model.encode(data.decode("utf-8", "replace")):
                    n += len(ids)
                    ids_hash.update(array("I", ids).tobytes())
                    text_hash.update(back.push(ids).encode())
                text_hash.update(back.end().encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text).

    Null text counts as empty: no tokens, and the digests of nothing. Repeated rows come out
    again; an empty table gives no rows; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return narrow.mapInArrow(_digests(path or tokenizer_path(), library_letters()), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
