import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import awkward, documents, odd_columns, prose
from trackline.llm import tokens
from trackline.llm.cutting import best_pattern, fill_patterns, patterns, relaxed
from trackline.llm.packing import pack
from trackline.llm.tokens import WordTokenizer, default_vocabulary


def ids_of(model, text):
    return [*model.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(default_vocabulary())


def strange():
    return [r[1] for r in awkward()] + [
        "don't DON'T we'Re 'S x's'll", "á é̂ ẞ ﬁ ΑΣ ΌΣΟΣ   \x85 a\x1cb \xa0c", "<|startoftext|><|endoftext|> x<|y",
        "\x00 \x7f 🏳️‍🌈 ‍ １２ Ⅷ ⅷ", "ÀÉÎõü ÿŸ ŉ ſ ǅ Ǆ ɏ", "12 3.4 ½ ² a1b2", "__--__ ,.;'\"", "﻿bom", "ʼn ȺȾ İi̇",
    ]


@pytest.mark.parametrize("memory", [400_000, 5])
def test_tokens_are_the_tokenizers(model, monkeypatch, memory):
    monkeypatch.setattr(tokens, "REMEMBERED", memory)
    own = WordTokenizer(default_vocabulary())
    for part in (strange(), strange()[::-1]):
        for text, data in zip(part, own.encode(part)):
            assert np.frombuffer(data, "<u4").tolist() == ids_of(model, text)[:-1], text


def check(found, rows, model, size=4096):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    want = defaultdict(list)
    for r in rows:
        ids = np.array(ids_of(model, r[1]), "<u4")
        for a in range(0, len(ids), size):
            part = ids[a : a + size]
            want[r[0], len(ids)].append((a, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


def test_awkward_rows(spark, model):
    rows = awkward()
    found = pack(odd_columns(documents(spark, rows))).collect()
    check(found, rows, model)
    assert pack(documents(spark, [])).count() == 0


def test_little_padding_and_ids(spark, model):
    rows = [(i, prose(i, 20 + (i * 37) % 900), "en", "a", 1) for i in range(400)]
    found = pack(documents(spark, rows), keep_ids=True).collect()
    used = check(found, rows, model)
    assert sum(r["length"] for r in found) > 0.98 * 4096 * used
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)


def test_patterns_hold_the_demand_in_few_bins():
    draw = np.random.default_rng(3)
    for _ in range(5):
        sizes = np.sort(draw.choice(np.arange(1, 65), 20, replace=False))
        demand = draw.integers(1, 400, 20)
        made = patterns(sizes, demand, 64)
        assert (sum(p * t for p, t in made) == demand).all()
        assert all((p * sizes).sum() <= 64 for p, _ in made)
        used = sum(t for _, t in made)
        # Near the relaxed optimum, and no worse than plain best fit of everything.
        assert relaxed(sizes, demand.astype(float), 64)[1].sum() - 1e-6 <= used <= len(fill_patterns(sizes, demand, 64)) + 1
        assert used <= relaxed(sizes, demand.astype(float), 64)[1].sum() + len(sizes)
    assert patterns(np.array([], int), np.array([], int), 64) == []


def test_knapsack_against_brute_force():
    draw = np.random.default_rng(4)
    for _ in range(20):
        sizes = np.sort(draw.choice(np.arange(1, 12), 3, replace=False))
        values = draw.random(3)
        best = max(
            i * values[0] + j * values[1] + k * values[2]
            for i in range(21) for j in range(21) for k in range(21)
            if i * sizes[0] + j * sizes[1] + k * sizes[2] <= 20
        )
        value, pattern = best_pattern(values, sizes, 20)
        assert abs(value - best) < 1e-9 and abs(pattern @ values - best) < 1e-9 and pattern @ sizes <= 20
