"""The encoder on random code points, and stable pairs against merging their symbols."""

import random

from loomwright.llm import bpe


def test_random_code_points():
    from tokenizers import Tokenizer

    library, model, rng = Tokenizer.from_file(bpe.tokenizer_path()), bpe.WordBpe(bpe.tokenizer_path()), random.Random(1)
    for i in range(3000):
        most = (0x110000, 0x3100, 0x20000)[i % 3]
        text = "".join(chr(c) for c in (rng.randrange(most) for _ in range(40)) if not 0xD800 <= c < 0xE000)
        assert [x for run in model.encode(text) for x in run] == library.encode(text, add_special_tokens=False).ids
    for i in range(2000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 6, 26])]) for _ in range(rng.choice([3, 8, 15, 40, 300, 3000 if i < 50 else 9])))
        assert [x for run in model.encode(text) for x in run] == library.encode(text, add_special_tokens=False).ids


def test_stable_pairs():
    model, rng = bpe.WordBpe(bpe.tokenizer_path()), random.Random(2)
    ids = list(model.symbols)
    made = [i for i in ids if model.edge(i) is not None]
    assert len(made) == len(ids)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(10_000)]
    merges = list(model.ranks)
    pairs += [rng.choice(merges) for _ in range(2000)]
    for a, b in pairs:
        assert model.stable(a, b) == (model.merged([*model.symbols[a], *model.symbols[b]]) == [a, b])
