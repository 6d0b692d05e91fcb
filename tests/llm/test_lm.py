import math
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import awkward, documents, lowered, odd_columns, prose, words
from trackline.llm import lm
from trackline.llm.lm import SMOOTH, UNITS, WORD_UNITS, fit, length_unit, score, start, vocabulary, word_counts
from trackline.llm.queries import QUERIES


def tokens(text):
    return [lowered(w) for w in words(text)] + [""]


def base(rows, training):
    counts = Counter(t for r in training for t in tokens(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        found = tokens(r[1])
        logs = [math.log10((counts[t] + SMOOTH) / (total + SMOOTH * (distinct + 1))) for t in found]
        yield r[0], len(found), sum(counts[t] > 0 for t in found), total, sum(logs)


def rows():
    return awkward() + [(100 + i, prose(i % 40, 60 + i), "en", "a", 1) for i in range(60)]


@pytest.mark.parametrize("head", [1 << 18, 30])
def test_base_score_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    data = rows()
    training = data[::2]
    found = score(odd_columns(documents(spark, data)), documents(spark, training)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    want = sorted(base(data, training), key=key)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in got], [x[4] for x in want], rtol=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert "text" not in found[0].asDict() and found[0]["place"] == "own place"


def test_probabilities_sum_to_one(spark):
    training = documents(spark, rows()).select("text")
    counts = word_counts(training)
    vocab = vocabulary(counts)
    model = fit(training, vocab)
    table = 10.0 ** model.log10_probabilities().astype(float)
    assert table.shape == ((UNITS + 1) ** 2, UNITS) and np.allclose(table.sum(axis=1), 1, atol=1e-4)
    # Inside a shared unit the known words and one unseen share sum to one.
    held = Counter()
    for r in counts.collect():
        word = bytes(r["word"])
        number = vocab.numbers[word]
        if vocab.unit[number] >= WORD_UNITS:
            assert vocab.unit[number] == length_unit(word)
            held[vocab.unit[number]] += r["c"] + SMOOTH
    for unit, mass in held.items():
        assert math.isclose(mass + SMOOTH, vocab.unit_tokens[unit] + SMOOTH * (vocab.unit_words[unit] + 1))
    assert sum(vocab.unit_tokens) == vocab.tokens and sum(vocab.unit_words) == vocab.distinct


def test_training_helps(spark, sf_dir):
    found = QUERIES["op8_log_bilinear"](spark, sf_dir).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    vocab = vocabulary(word_counts(docs))
    trained, first = fit(docs, vocab).log10_probabilities(), start(vocab).log10_probabilities()
    texts = [r["text"] for r in docs.limit(50).collect()]
    gain = 0.0
    for text in texts:
        unit = lm.encoded(text, vocab)[0]
        one, two = lm.contexts(unit)
        gain += (trained - first)[one * (UNITS + 1) + two, unit].sum(dtype=float)
    assert gain > 0


def test_nothing_to_learn_and_no_rows(spark):
    none = documents(spark, [])
    assert score(none, none).count() == 0
    found = score(documents(spark), none).collect()
    assert len(found) == len(awkward())
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in found)
    assert score(none, documents(spark)).count() == 0


def two_tongues(texts):
    """Texts of words of one length, each text in one of two languages that share no word."""
    draw = np.random.default_rng(3)
    made = [bytes(97 + i // 26**k % 26 for k in (2, 1, 0)).decode() + "xyz" for i in range(900)]
    return [(i, " ".join(made[j] for j in draw.integers(0, 450, 150) + 450 * (i % 2)), "en", "a", 1) for i in range(texts)]


def test_words_of_one_unit_are_told_apart_by_their_contexts(spark):
    """Before, words that shared a unit had its probability by their counts alone, whatever stood before them."""
    rows = two_tongues(1200)
    training = documents(spark, rows[:1160]).coalesce(1)
    vocab = vocabulary(word_counts(training))
    units = fit(training, vocab).log10_probabilities()
    by_counts = 0.0
    for row in rows[1160:]:
        unit, number, rare = lm.encoded(row[1], vocab)
        assert not rare
        one, two = lm.contexts(unit)
        by_counts += units[one * (UNITS + 1) + two, unit].sum(dtype=float)
        shared = unit >= WORD_UNITS
        inside = (vocab.counts[number] + SMOOTH) / (vocab.unit_tokens + SMOOTH * (vocab.unit_words + 1))[unit]
        by_counts += np.log10(inside[shared]).sum()
    found = score(documents(spark, rows[1160:]), training).collect()
    # Two languages of equal size: one bit a word is all there is to gain.
    gain = (sum(r["score"] for r in found) - by_counts) / (40 * 150) / math.log10(2)
    assert 0.1 < gain <= 1.1


@pytest.mark.parametrize("head", [1 << 18, 30, 300])
def test_probabilities_inside_a_unit_sum_to_one(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    training = documents(spark, rows() + two_tongues(20)).select("text")
    vocab = vocabulary(word_counts(training))
    model = fit(training, vocab)
    # One context for all leaves of a unit.
    for unit in range(WORD_UNITS, UNITS):
        leaves = [i for i in range(vocab.leaves - 1) if np.searchsorted(vocab.rest_leaf[WORD_UNITS:], i) + WORD_UNITS == unit]
        n = len(leaves)
        before = tuple(np.full(n, x) for x in (3, UNITS, leaves[0], vocab.leaves - 1))
        logs = [
            model.log_probabilities(lm.Batch(np.full(n, unit), np.array(x), None, before, None, []), slice(0, n), vocab, lm.Room())
            for x in (leaves, [vocab.leaves - 1] * n)
        ]
        assert math.isclose(np.exp(logs[0] - logs[1]).sum(), 1, rel_tol=1e-4)
    assert not model.words[vocab.leaves - 1].any() and model.words[: vocab.leaves].any()


@pytest.mark.parametrize("head", [1 << 18, 30, 300])
def test_a_step_is_that_of_every_token_and_decision(spark, monkeypatch, head):
    """Upper decisions are found by products of matrices, lower ones by columns; a row is read and written once a step."""
    monkeypatch.setattr(lm, "HEAD", head)
    texts = [r[1] for r in rows() + two_tongues(20)]
    vocab = vocabulary(word_counts(documents(spark, rows() + two_tongues(20))))
    p, size = start(vocab), lm.SIZE
    p.words[vocab.leaves :, :size] = np.random.default_rng(5).normal(0, 0.1, (len(vocab.odds), size))
    batch = lm.read([lm.tokens(t) for t in texts], vocab)
    place, context, target, bias, words = (a.astype(float) for a in (p.place, p.context, p.target, p.bias, p.words))
    trainer = lm.Trainer(p, vocab, 3)
    noise = np.minimum(np.searchsorted(trainer.edges, np.random.default_rng(3).random(lm.NOISE)), UNITS - 1)
    change, met, contexts, targets = np.zeros(words.shape), np.zeros(len(words)), np.zeros(context.shape), np.zeros(target.shape)
    for unit, leaf, one, two, own_one, own_two in zip(batch.unit, batch.leaf, *batch.before):
        guess = (context[one] + words[own_one, :size]) * place[0] + (context[two] + words[own_two, :size]) * place[1]
        up = 1 / (1 + np.exp(guess @ target[unit] + bias[unit] - trainer.log_noise[unit]))
        down = -1 / (1 + np.exp(-(target[noise] @ guess + bias[noise] - trainer.log_noise[noise])))
        pull = up * target[unit] + down @ target[noise]
        targets[unit] += up * guess
        np.add.at(targets, noise, down[:, None] * guess)
        for step in vocab.steps[vocab.first[leaf] : vocab.first[leaf + 1]].tolist():
            row = vocab.leaves + step // 2
            miss = step % 2 - 1 / (1 + np.exp(-(words[row, :size] @ guess + words[row, size])))
            pull = pull + miss * words[row, :size]
            change[row] += miss * np.append(guess, 1)
            met[row] += 1
        for unit, own, share in ((one, own_one, place[0]), (two, own_two, place[1])):
            contexts[unit] += pull * share
            change[own, :size] += pull * share
            met[own] += 1
    change[vocab.leaves - 1] = 0
    squares = lm.CALM + (change**2).sum(axis=1) / (size + 1)
    trainer.learn(batch.unit, batch.leaf, *batch.before)
    assert np.allclose(trainer.rows[:, : size + 1], words + lm.RATE * change / np.sqrt(squares)[:, None], atol=1e-4)
    assert np.allclose(trainer.rows[:, lm.SQUARES], squares, rtol=1e-3)
    assert (trainer.rows[:, lm.MET] == met).all()
    for value, first, step in ((p.context, context, contexts), (p.target, target, targets)):
        assert np.allclose(value, first + lm.RATE * step / np.sqrt(1e-6 + step**2), atol=1e-3)


def test_tops_hold_the_first_decisions(spark):
    vocab = vocabulary(word_counts(documents(spark, rows() + two_tongues(20))))
    nodes, places, right = vocab.tops
    units = np.searchsorted(vocab.rest_leaf[WORD_UNITS:], np.arange(vocab.leaves))
    for leaf in range(vocab.leaves - 1):
        steps = vocab.steps[vocab.first[leaf] : vocab.first[leaf + 1]][: lm.TOP]
        found = nodes[units[leaf], places[leaf, : len(steps)]] - vocab.leaves
        assert (2 * found + right[leaf, : len(steps)] == steps).all()
        assert (nodes[units[leaf], places[leaf, len(steps) :]] == vocab.leaves - 1).all()
    assert max(np.diff(vocab.first)) > lm.TOP
