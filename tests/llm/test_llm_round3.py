"""Token files, lexical search and conversation repair against brute force."""

import heapq
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from compare import DATA
from test_llm_operators import docs

from loomwright.llm import conversations, lexical, queries, token_files

ODD = ["a\x1cb", "x\xa0y　z", "<|endoftext|> <|startoftext|>x", "Ünïcode É é Σίσυφος", "don't 12345 ... !!", "́ combining", "\x85  ", "日本語 テキスト", "A" * 5000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    points = [*range(32, 127), *range(0xA0, 0x250), 0x301, 0x3A3, 0x4E00, 0x1F600, 9, 10, 13, 0x1D, 0x2003]
    rows = [(i, "".join(map(chr, rng.choices(points, k=rng.randint(0, 300))))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (9, rows[9][1]), (9, rows[9][1]), (-5, " \n "), (500, "word " * 90_000)]
    return rows


def library(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, texts):
    encode = library(token_files.tokenizer_path())
    want, start = [], 0
    coded = [(i, [*encode(t), 2]) for i, t in texts]
    for doc_id, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(np.array(x[1], "<u2").tobytes()))):
        want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = token_files.write_token_files(docs(spark, texts).repartition(5))
    assert [tuple(r) for r in sorted(token_files.read_token_files(files).collect(), key=lambda r: r["start"])] == want
    # The most frequent id has the least rank.
    n = [r["n"] for r in files.ranks.orderBy("rank").collect()]
    assert n == sorted(n, reverse=True) and sum(n) == start
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []))).count() == 0


def test_files_in_pieces(spark):
    """Many files a shard: their first places follow from the manifest."""
    rows = [(i, "some words here " * (i % 7)) for i in range(300)]
    files = token_files.write_token_files(docs(spark, rows), file_bytes=20)
    assert files.manifest.count() > files.manifest.select("shard").distinct().count()
    got = token_files.read_token_files(files).orderBy("doc_id").collect()
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1]) and len(got) == 300


def test_words_as_the_library_has_them(monkeypatch):
    """Words of all kinds, alone and in texts, also when the encoder forgets."""
    import pyarrow.parquet as pq

    model, encode = token_files.WordEncoder(token_files.tokenizer_path()), library(token_files.tokenizer_path())
    rng = random.Random(6)
    points = [*range(33, 127), *range(0xA1, 0x100), *range(0x100, 0x180), 0x301, 0x4E00]
    texts = ["".join(map(chr, rng.choices(points[: rng.choice([94, 189, 400])], k=rng.randint(1, 12)))) for _ in range(3000)]
    texts += ["it's''S 'tis x'LL", "a<|endoftext|>b", "µªº ß ÀÖØ ÿŸ", "1²3¼", "x\x85y\xa0z", "\x1c\x1d a\x1fb", "<| |>", "'", "''s", "é" * 100 + "9" * 200, *ODD]
    texts += pq.read_table(f"{DATA}/sf0.001/documents.parquet").column("text").to_pylist()
    want = [np.array(encode(t), model.kind).tobytes() for t in texts]
    data = [t.encode() for t in texts]
    assert model.encode(data) == want
    monkeypatch.setattr(token_files, "PIECE", 100)
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    assert model.encode(data) == want and model.encode([]) == [] and model.encode([b""]) == [b""]
    assert model.ask_units(["a", "", "b"]) == [*model.ask(["a"]), b"", *model.ask(["b"])]  # not one token end each


def test_coding():
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 1 << rng.integers(1, 33), n, dtype=np.int64).astype(np.uint32) for n in (1, 2, 3, 4, 5, 77, 1000)]
    parts = token_files.code(np.concatenate(runs), np.array([len(r) for r in runs]))
    assert parts == [x for r in runs for x in token_files.code(r, np.array([len(r)]))]
    control, data = (np.frombuffer(b"".join(p[k] for p in parts), np.uint8) for k in (0, 1))
    assert (token_files.decode(np.array([len(r) for r in runs]), control, data) == np.concatenate(runs)).all()


def test_damaged_file(tmp_path):
    block = token_files.Block()
    block.add(5, 0, 3, b"".join(*token_files.code(np.array([1, 300, 70_000]), np.array([3]))))
    good = token_files.MAGIC + block.packed()
    for bad in (good[:-1], good[:-1] + bytes([good[-1] ^ 1]), b"????" + good[4:]):
        (tmp_path / "x").write_bytes(bad)
        with pytest.raises(ValueError), open(tmp_path / "x", "rb") as file:
            list(token_files.blocks_of(file))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_search(rows, items, top=20):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    n_docs, length = sum(1 for _, x in found if x), sum(len(x) for _, x in found)
    out = []
    for item, text in set(items):
        scored = []
        terms = TERM.findall((text or "").translate(LOWER))
        for doc_id, x in found:
            score = 0
            for t in terms:
                if (tf := x.count(t)) > 0:
                    df = sum(1 for _, y in found if t in y)
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1)))
                    m = 100 - 25 + 25 * len(x) * n_docs // length
                    score += w * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 250])
def test_search(spark, monkeypatch, most):
    rng = random.Random(8)
    words = ["a", "Ab", "abc", "ñandú", "É", "b1", "x", "the", "THE", "zz", "日本"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "_", "\n", "'", "\x7f", "  "]) for _ in range(n))
    rows = [(i, make(rng.randint(0, 30))) for i in range(80)] + [(None, "ab abc"), (5, None), (6, ""), (7, "the"), (7, "the"), (8, "the"), (9, "...")]
    rows.append((90, make(4000)))
    items = [(i, make(rng.randint(1, 8))) for i in range(12)] + [(20, None), (21, ""), (22, "the the the"), (22, "the the the"), (22, "zz"), (23, "unheard")]
    monkeypatch.setattr(lexical, "CELLS", 40)
    monkeypatch.setattr(lexical.blocks, "__defaults__", (most,))
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in lexical.search(docs(spark, rows).repartition(4), table).collect()), key=repr)
    assert got == brute_search(rows, items)
    assert len(list(lexical.blocks(table))) > 1 or most > 250
    assert lexical.search(docs(spark, []), table).count() == lexical.search(docs(spark, rows), table.limit(0)).count() == 0


INITIALS = re.compile("(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Cheapest edits by search over strings of edits, in order of (cost, string)."""
    found = faults(rows)
    queue = [(0, "", 0, "", "")]
    done = set()
    while queue:
        cost, audit, at, initials, text = heapq.heappop(queue)
        if (at, initials, audit) in done:
            continue
        done.add((at, initials, audit))
        if at == len(rows) and INITIALS.fullmatch(initials):
            return cost, audit, sha256("\n".join(text.split("\x00")[1:]).encode()).hexdigest()
        if len(initials) <= len(rows) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(queue, (cost + 5, audit + "I", at, initials + role[0], f"{text}\x00{role}:"))
        if at < len(rows):
            _, role, words = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, initials, text))
            if found[at] not in ("blank", "duplicate"):
                more = 5 * (found[at] == "truncated")
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, initials + (role[:1] or "?"), f"{text}\x00{role}:{words}"))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 1, audit + "R", at + 1, initials + other[0], f"{text}\x00{other}:{words}"))
    raise AssertionError


def brute_summary(conv_id, rows):
    turns = [t for t, _, _ in rows if t is not None]
    found = faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv_id, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), *brute_repair(rows))


def made_conversations(n, longest):
    rng = random.Random(n)
    said = ["Yes.", "No!", "Why?", "cut off", " ", "", "so it is. ", "\t\n", "Yes."]
    rows = []
    for conv in range(n):
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * (longest // 2)
        for turn in range(rng.randint(0, longest)):
            role = roles[turn] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "tool", "", "unknown"])
            rows.append((conv, turn + rng.choice([0, 0, 0, 1]), role, rng.choice(said) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


def test_repair(spark):
    rows = made_conversations(150, 6)
    # One order for rows of one turn, as the operator takes them.
    digest = lambda r: sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()[:32]
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    convs |= {900: [(900, None, "user", "first."), (900, 3, "assistant", "second."), (900, 9, "user", "first.")], 901: [(901, None, "user", "a"), (901, None, "user", "a")]}
    convs |= {902: [(902, 0, "system", "Only this.")], 903: [(903, 0, "user", "Half"), (903, 1, "user", "Half more"), (903, 2, "assistant", "Done.")]}
    flat = [r for x in convs.values() for r in x]
    ids = spark.createDataFrame([(r[0],) for r in flat] + [(950,), (None,)], "conv_id long")
    table = spark.createDataFrame([(*r, 1, "x") for r in flat], "conv_id long, turn long, role string, text string, digest long, mark string").repartition(6)
    got = sorted((tuple(r) for r in conversations.summaries(conversations.repair(table, ids)).collect()), key=repr)
    want = [brute_summary(c, [r[1:] for r in sorted(x, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))]) for c, x in convs.items()]
    nothing = (0,) * 6 + ("", sha256(b"").hexdigest())
    assert got == sorted([*want, (950, *nothing), (None, *nothing)], key=repr)
    empty = table.limit(0)
    assert conversations.summaries(conversations.repair(empty)).count() == 0


def test_long_conversations_spill(spark):
    rows = made_conversations(6, 400)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, conversations.summaries(conversations.repair(table)).collect()))
    parts = sorted(map(tuple, conversations.repair(table).select("conv_id", "edit", "role", "text").collect()), key=repr)
    cut = conversations.repair(table, chunk=7)
    assert sorted(map(tuple, conversations.summaries(cut).collect())) == whole
    assert sorted(map(tuple, cut.select("conv_id", "edit", "role", "text").collect()), key=repr) == parts


def test_chunks_in_a_file(tmp_path):
    """The same edits from chunks in a file as from memory."""
    rng = random.Random(2)
    rows = [(t, rng.choice(["user", "assistant", "tool"]), rng.choice(["x.", "y", ""]), rng.choice(conversations.FAULTS)) for t in range(53)]
    outs = []
    for chunk in (5, 1000):
        kept, states, cost = conversations.Kept(f"file://{tmp_path}", chunk), conversations.BEGIN, 0
        for r in rows:
            more, states, back = conversations.step(states, r[1][:1], r[3])
            cost += more
            kept.add(r, back)
        outs.append(list(conversations._edits(1, cost, states, kept)))
        assert len(kept.places) == (11 if chunk == 5 else 0)
    assert outs[0] == outs[1] and not list(tmp_path.iterdir())


def brute_damage(conv_id, turn, role, text):
    said = lambda x: " " if x is None else str(x)
    kind = zlib.crc32(f"{said(conv_id)}:{said(turn)}".encode()) % 20
    role, text = said(role), said(text)
    row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
    return [] if kind == 0 else [row, row] if kind == 3 else [row]


def test_queries(spark):
    """op11 to op13 on the smallest tables, whole."""
    import duckdb

    folder = f"{DATA}/sf0.001"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet' ORDER BY conv_id, turn").fetchall()
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).extend(brute_damage(*r))
    got = sorted(tuple(r) for r in queries.op13_conversation_repair(spark, folder).collect())
    assert got == sorted(brute_summary(c, x) for c, x in convs.items())
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    encode, start, want = library(token_files.tokenizer_path()), 0, []
    for doc_id, text in texts:
        ids = np.array([*encode(text), 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in queries.op11_token_files(spark, folder).orderBy("doc_id").collect()] == want
