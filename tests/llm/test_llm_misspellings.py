"""Misspellings of words that a stem covers."""

import random

from loomwright.llm import toxicity
from loomwright.session import Workspace


def test_toxicity_misspelling_of_a_word_with_a_stem(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(800)]
    rude = ["blockhead", "blockish", "blockers"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(30)]
        if i % 3 == 0:
            words[5], words[20] = rng.sample(rude, 2)
        rows.append((" ".join(words).encode(), int(i % 3 == 0)))
    mine = spark.createDataFrame(rows, "text binary, toxic int")
    terms = toxicity.checked_edits(mine, toxicity.mine_terms(mine, Workspace(spark, "test")))
    lexicon = toxicity.Lexicon(terms)
    lexicon.prepare()
    stem, edits = lexicon.match("blockhead")
    assert terms[stem][1] and edits == 0 and lexicon.match("blocking") == (stem, 0)
    term, edits = lexicon.match("bl0ckhead")
    assert terms[term][0] == "blockhead" and edits == 1
    assert lexicon.weigh("blockhead bl0ckhead") == lexicon.weigh("blockhead")  # one term
