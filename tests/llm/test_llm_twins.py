"""Brute-force twins: window scores with quotations, and the language filter with exact sets."""

import random
import re

import numpy as np
from test_llm_operators import docs

from loomwright.llm import langid, packing, toxicity


def in_quotation(text, begin, end):
    """By reading the token's line from its start: straight marks by turns, opening and closing ones."""
    low = text.rfind("\n", 0, begin) + 1
    high = text.find("\n", end)
    line, begin = text[low : high if high >= 0 else len(text)], begin - low
    straight = [i for i, c in enumerate(line) if c == '"']
    if any(a < begin < b for a, b in zip(straight[::2], straight[1::2])):
        return True
    opened = None
    for i, c in enumerate(line):
        if opened is None and c in "“„«":
            opened = i
        elif opened is not None and c in "”»":
            if opened < begin < i:
                return True
            opened = None
    return False


def brute_weigh(text, terms, stems=()):
    """Every window from every place; ``stems`` are terms, too, for all words that begin with them."""
    text = text.lower()
    hits = []
    for at, m in enumerate(re.finditer(r"\w+", text)):
        stem = next((x for x in stems if m[0].startswith(x)), None)
        if m[0] in terms or stem:
            hits.append((at, stem or m[0], m[0], terms[stem or m[0]] * (toxicity.QUOTE_FACTOR if in_quotation(text, *m.span()) else 1)))

    def heaviest(size, further):
        most = 0.0
        for k, *_ in hits:
            best = {}
            for at, term, word, w in hits:
                if k - size < at <= k:
                    own = best.setdefault(term, {})
                    own[word] = max(own.get(word, 0), w)
            most = max(most, sum(max(x.values()) + further * (sum(x.values()) - max(x.values())) for x in best.values()))
        return most

    short = heaviest(toxicity.WINDOW, toxicity.FURTHER)
    return short + toxicity.WIDE_FACTOR * (heaviest(toxicity.WIDE_WINDOW, 1.0) - short)


def test_window_scores():
    rng = random.Random(4)
    terms = {"zzrude": 2.0, "qqvile": 1.5, "xxmean": 1.0, "wwbad": 0.5}
    lexicon = toxicity.Lexicon([(t, False, w, 0) for t, w in terms.items()])
    parts = [*terms, "ok", "fine", "word"] + ['"', "“", "”", "„", "«", "»", "\n", "plain", "text", "x"] * 2
    for _ in range(600):
        text = " ".join(rng.choice(parts) if rng.random() < 0.6 else "filler" for _ in range(rng.randrange(200)))
        assert abs(lexicon.weigh(text) - brute_weigh(text, terms)) < 1e-9
    lexicon = toxicity.Lexicon([*((t, False, w, 0) for t, w in terms.items()), ("stemm", True, 1.2, 0)])
    parts += ["stemma", "stemmed", "stemming", "stemm"]
    for _ in range(200):
        text = " ".join(rng.choice(parts) if rng.random() < 0.3 else "filler" for _ in range(rng.randrange(900)))
        assert abs(lexicon.weigh(text) - brute_weigh(text, terms | {"stemm": 1.2}, ["stemm"])) < 1e-9
    inside = 'he wrote "' + "so many words " * 40 + "zzrude" + " and so on" * 40 + '" yesterday'
    after = '"' + "so many words " * 40 + '" he wrote, you zzrude one, "' + "and more " * 60 + '"'
    assert lexicon.weigh(inside) == 1.0 and lexicon.weigh(after) == 2.0
    assert lexicon.weigh('"' * 100_001 + " zzrude " + "“" * 100_000) == 2.0


def test_no_documents(spark):
    none, labels = docs(spark, []), spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(none, labels).count() == 0 and toxicity.drop_toxic(none, labels).count() == 0
    some = docs(spark, [(1, "a word"), (2, None), (2, None), (None, "")])
    assert toxicity.drop_toxic(some, labels.where("doc_id < 0")).count() == 4


def test_many_languages(spark):
    for n in (70, 2000):
        rng = random.Random(n)
        own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for _ in range(n)]
        rows = [(i, " ".join("".join(rng.choice(own[i % n]) for _ in range(2)) for _ in range(40)), f"l{i % n:03}", "x", 1.0) for i in range(n * (8 if n < 100 else 5))]
        got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")).collect()
        assert sum(r["lang_pred"] == f"l{r['doc_id'] % n:03}" for r in got) >= 0.99 * len(rows)


def test_filter_against_exact_sets():
    rng = np.random.default_rng(7)
    for n in (3, 8, 9, 64, 65, 130):
        sets = [np.unique(rng.integers(0, 1 << 63, 300, np.uint64)) for _ in range(n)]
        model = langid.LanguageFilter([str(i) for i in range(n)], sets)
        asked = np.concatenate([sets[0][:100], sets[-1][:50], rng.integers(0, 1 << 63, 2000, np.uint64)])
        exact = np.array([np.isin(asked, s).sum() for s in sets])
        counts = model.counts(asked)
        assert (counts >= exact).all() and (counts - exact <= 20 + 4 * 2150 * model.chance).all()
        assert len(model.chance) == n and (model.chance < 0.01).all()


def test_long_text_and_clashing_columns(spark):
    rows = [(i, ("the whing banana " if i % 2 else "elque ción osque ") * 20, "aa" if i % 2 else "bb", True, "zz", 3.0) for i in range(40)]
    rows += [(100, "the whing banana " * 100_000, None, True, "zz", 3.0)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean, lang_pred string, score double")).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got}[100] == "aa"


def test_equal_rows_fall_apart(spark):
    rows = docs(spark, [(None, "")] * 20_000 + [(1, "many words " * 3000)])
    got = packing.pack(rows, group=1000).collect()
    groups = {}
    for r in got:
        if r["length"] < 1024:
            groups.setdefault(r["sequence_id"] >> 33, []).append(r)
    assert len(groups) == 21 and max(map(len, groups.values())) < 1200
    ids = {}
    for r in got:
        ids.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in ids.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
