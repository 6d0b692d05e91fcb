"""Scoring of texts by a log-bilinear neural language model.

The model predicts every token from the two before. Each head word has a context vector of its own. First comes one
of ``UNITS`` units: the most frequent words are units of their own, all others share one unit per word length. Inside a
shared unit the word is found by decisions between two sides, down a tree whose leaves are the unit's head words
and one for its other words; each node has a vector of its own. Only the words of that last leaf are told apart by
smoothed counts.

It is trained in numpy, units with noise-contrastive estimation, decisions by their likelihood, one replica per
partition of the training texts; the replicas are averaged, vectors of words over the replicas that met them. A
softmax over all units and two sides at each node make the token probabilities sum to one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from trackline.session import checkpointed

END = b""  # the token that closes a text; no word is empty
SMOOTH = 0.1
HEAD = 1 << 18  # at most so many of the most frequent words, whose counts every task knows; the counts of others are joined
WORD_UNITS, LENGTHS = 224, 32
UNITS = WORD_UNITS + LENGTHS
START = UNITS  # context before the first token
SIZE = 16  # of the unit vectors
NOISE = 64  # noise units a batch shares
BATCH, RATE = 4096, 0.05
SLOTS = 64  # sums of replicas the driver averages
DISTINCT = 400_000  # words a counting task holds before it hands on its counts
CALM = 0.01  # squared steps that vectors of words and nodes start with
SPREAD = 0.1  # of what words' own context vectors start with
BLOCK = 8192  # rows of word and node vectors that are averaged together
ROWS = 512  # tokens whose units are scored at once
SCORED = 16384  # tokens whose texts are scored together
TOP = 4  # upper levels of a tree whose decisions are found together
SQUARES, MET, WIDTH = SIZE + 1, SIZE + 2, SIZE + 4  # columns of a replica's rows: sum of squared steps, times met; with the unused last 80 bytes


@dataclass
class Vocabulary:
    """Head words with their counts, the totals of the training tokens, and the tree inside each shared unit.

    ``steps`` holds twice the node, plus one for its right side, of every decision on the way to a leaf; those of
    leaf i stand from ``first[i]`` to ``first[i + 1]``. The last leaf is that of all words with units of their own.
    """

    numbers: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    unit: np.ndarray  # of each head word
    unit_tokens: np.ndarray
    unit_words: np.ndarray
    leaf: np.ndarray  # of each head word
    rest_leaf: np.ndarray  # of each unit, for its words outside the head
    rest_mass: np.ndarray  # of each unit: their smoothed counts and that of one unseen word
    first: np.ndarray
    steps: np.ndarray
    odds: np.ndarray  # of each node: logarithm of its right side's counts by the left side's

    @property
    def leaves(self) -> int:
        return len(self.first) - 1

    @cached_property
    def depth(self) -> np.ndarray:
        """How many decisions below the tops lead to each leaf."""
        return np.maximum(np.diff(self.first) - TOP, 0).astype(np.int16)

    @cached_property
    def tops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The upper ``TOP`` levels of every shared unit's tree, whose decisions are found by products of matrices.

        First (unit, place) the row of the node in ``words``, children of place i at 2i + 1 and 2i + 2, and the last leaf's row where
        there is none. Then (leaf, level) the place of each decision, the last one where there is none, and its side.
        """
        nodes = np.full((LENGTHS, 1 << TOP), self.leaves - 1)
        places = np.full((self.leaves, TOP), (1 << TOP) - 1, np.int16)
        right = np.zeros((self.leaves, TOP), bool)
        units = np.searchsorted(self.rest_leaf[WORD_UNITS:], np.arange(self.leaves))
        place = np.zeros(self.leaves, np.int64)
        for level in range(TOP):
            has = np.flatnonzero(np.diff(self.first) > level)
            step = self.steps[self.first[has] + level]
            places[has, level], right[has, level] = place[has], step & 1
            nodes[units[has], place[has]] = self.leaves + (step >> 1)
            place[has] = 2 * place[has] + 1 + (step & 1)
        return nodes, places, right

    @property
    def denominator(self) -> float:
        return self.tokens + SMOOTH * (self.distinct + 1)


class Room:
    """Arrays that are filled again and again: fresh memory costs more than the sums done in it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, columns: int = SIZE + 1) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < rows:
            self.held[name] = np.empty((rows + rows // 4, columns), np.float32)
        return self.held[name][:rows]

    def columns(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Rows that many numbers long, one after the other."""
        return self(name, rows * columns, 1).reshape(rows, columns)

    def rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rows of the table at these places."""
        return table.take(at, axis=0, out=self(name, len(at), table.shape[1]), mode="clip")


@dataclass
class Parameters:
    """Context vectors of units, their weights at the two places before, target vectors and biases of units.

    ``words`` has a row per leaf, what its words' context vector has beyond their unit's, then a row per node, its vector and bias.
    """

    context: np.ndarray
    place: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    words: np.ndarray
    table: np.ndarray | None = field(default=None, repr=False)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.context, self.place, self.target, self.bias)])

    @staticmethod
    def of(flat: np.ndarray, words: np.ndarray) -> "Parameters":
        shapes, parts, at = [(UNITS + 1, SIZE), (2, SIZE), (UNITS, SIZE), (UNITS,)], [], 0
        for shape in shapes:
            size = math.prod(shape)
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32).copy())
            at += size
        return Parameters(*parts, words)

    def guess(self, before: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the tokens one and two places before, and what they say of a token."""
        one, two, own_one, own_two = before
        first = self.context.take(one, axis=0) + self.words.take(own_one, axis=0)[:, :SIZE]
        second = self.context.take(two, axis=0) + self.words.take(own_two, axis=0)[:, :SIZE]
        return first, second, first * self.place[0] + second * self.place[1]

    def log_probabilities(self, batch: "Batch", cut: slice, vocab: Vocabulary, room: Room) -> np.ndarray:
        """Of each token's unit and of its leaf inside it; natural logarithms."""
        unit, guess = batch.unit[cut], self.guess(tuple(x[cut] for x in batch.before))[2]
        full = np.append(guess, np.ones((len(guess), 1), np.float32), axis=1)
        target = np.append(self.target, self.bias[:, None], axis=1).T
        found, every = np.empty(len(unit)), np.ones(UNITS, np.float32)
        square = np.einsum("ij,ij->i", full, full).max(initial=0) * (target * target).sum(axis=0).max()
        for at in range(0, len(unit), ROWS):
            part = full[at : at + ROWS]
            scores = np.matmul(part, target, out=room("scores", len(part), UNITS))
            if not square < 80 * 80:  # maybe beyond the range of exponentials
                scores -= scores.max(axis=1, keepdims=True)
            own = scores.ravel().take(np.arange(len(scores)) * UNITS + unit[at : at + ROWS])
            found[at : at + ROWS] = own - np.log(np.exp(scores, out=scores) @ every)
        order = by_leaf(batch.leaf[cut], vocab)
        tops, met = Tops(batch.leaf[cut], order, full, self.words, vocab, room), decisions(batch.leaf[cut], order, vocab)
        loss = -missed(tops.lean, tops.right)
        loss[tops.none] = 0
        found[tops.order] += loss.sum(axis=1, dtype=float)
        rows = turned(room.rows("rows", self.words, vocab.leaves + met.node), room)
        lean = met.lean(np.ascontiguousarray(full.take(met.order, axis=0).T), rows, room)
        found[met.order] -= np.bincount(met.who, missed(lean, met.right), len(met.order))
        return found

    def log10_probabilities(self) -> np.ndarray:
        """(context pair, unit): the normalised distribution behind every pair of units without vectors of words."""
        if self.table is None:
            first, second = self.context * self.place[0], self.context * self.place[1]
            rows = []
            for unit in range(UNITS + 1):
                scores = (first + second[unit]) @ self.target.T + self.bias
                scores -= scores.max(axis=1, keepdims=True)
                scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
                rows.append(scores)
            self.table = np.stack(rows, axis=1).reshape(-1, UNITS) / np.float32(math.log(10))
        return self.table


def missed(lean: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Less the logarithm of the probability that decisions go to this side."""
    wrong = np.clip(np.where(right, -lean, lean), -80, 80)
    return np.log(1 + np.exp(wrong))


def turned(rows: np.ndarray, room: Room) -> np.ndarray:
    """What ``words`` has in these rows, a column per row."""
    columns = room.columns("turned", SIZE + 1, len(rows))
    columns[:] = rows[:, : SIZE + 1].T
    return columns


def length_unit(word: bytes) -> int:
    """The shared unit of the words with as many code points, 32 or more together."""
    points = sum(b & 0xC0 != 0x80 for b in word) if not word.isascii() else len(word)
    return WORD_UNITS + min(points, LENGTHS) - 1


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.lower`` touches no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in the texts; every text has one end token."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                held.update(tokens(text))
                held[END] += 1
                if len(held) > DISTINCT:
                    yield pd.DataFrame({"word": list(held), "c": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "c": list(held.values())})

    return rows.select("text").mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What every task needs to know of the counts; at most ``HEAD`` words and the end token come to the driver.

    The head is every word from a count on. That count is read off a histogram of their logarithms.
    """
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 64)
    room, least = HEAD, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    often = F.lit(False) if least is None else level >= least
    head = counts.where(often | (F.col("word") == F.lit(bytearray(END)))).collect()
    head = sorted(head, key=lambda r: (-r["c"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in head]
    # The end token is a unit of its own, whatever its rank.
    own = [END, *[w for w in words[:WORD_UNITS] if w != END][: WORD_UNITS - 1]]
    units = {w: i for i, w in enumerate(own)}
    unit = np.array([units.get(w, -1) if w in units else length_unit(w) for w in words], np.int64)
    rest = counts.where(~F.col("word").isin(*[F.lit(bytearray(w)) for w in own]))
    points = F.least(F.length(F.decode("word", "UTF-8")), F.lit(LENGTHS))
    per_length = rest.groupBy(points.alias("points")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    unit_tokens, unit_words = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
    for word, row in zip(words, head):
        if word in units:
            unit_tokens[units[word]] = row["c"]
            unit_words[units[word]] = 1
    for row in per_length:
        unit_tokens[WORD_UNITS + row["points"] - 1] = row["c"]
        unit_words[WORD_UNITS + row["points"] - 1] = row["v"]
    numbers = {w: i for i, w in enumerate(words)}
    of_head = np.array([r["c"] for r in head], np.int64)
    # Words that begin alike are near each other in the tree; a unit's last leaf is for its words outside the head.
    shared = np.flatnonzero(unit >= WORD_UNITS)
    ordered = np.array(sorted(shared.tolist(), key=lambda i: (unit[i], words[i])), np.int64)
    units_of = unit[ordered]
    within = np.bincount(units_of, minlength=UNITS)
    rest_mass = unit_tokens - np.bincount(units_of, of_head[ordered], UNITS) + SMOOTH * (unit_words - within + 1)
    rest_leaf = np.maximum(np.cumsum(within + (np.arange(UNITS) >= WORD_UNITS)) - 1, 0)
    leaf = np.full(len(words), len(ordered) + LENGTHS, np.int64)
    leaf[ordered] = np.arange(len(ordered)) + units_of - WORD_UNITS
    rest_leaf[:WORD_UNITS] = len(ordered) + LENGTHS
    mass = np.zeros(len(ordered) + LENGTHS)
    mass[leaf[ordered]] = of_head[ordered] + SMOOTH
    mass[rest_leaf[WORD_UNITS:]] = rest_mass[WORD_UNITS:]
    first, steps, odds = halved(mass, rest_leaf[WORD_UNITS:] + 1)
    return Vocabulary(
        numbers, of_head, n, v, unit, unit_tokens, unit_words, leaf, rest_leaf, rest_mass, first, steps, odds
    )


def halved(mass: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary trees over runs of leaves, cut where both sides weigh most alike: the ``first``, ``steps`` and ``odds`` of a vocabulary.

    A node has the number of the first leaf on its right side, so that those near a leaf lie together in memory.
    """
    upto = np.concatenate(([0.0], np.cumsum(mass)))
    low, high = np.concatenate(([0], ends[:-1])), ends
    found, taken, odds = [], [], np.zeros(len(mass))
    while len(low):
        low, high = low[high - low > 1], high[high - low > 1]
        middle = (upto[low] + upto[high]) / 2
        cut = np.searchsorted(upto, middle)
        cut -= (middle - upto[cut - 1]) < (upto[cut] - middle)
        cut = np.clip(cut, low + 1, high - 1)
        odds[cut] = np.log((upto[high] - upto[cut]) / (upto[cut] - upto[low]))
        size = high - low
        node = np.repeat(cut, size)
        leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        found.append(leaf)
        taken.append(2 * node + (leaf >= node))
        low, high = np.concatenate((low, cut)), np.concatenate((cut, high))
    every = np.concatenate(found) if found else np.zeros(0, np.int64)
    steps = np.concatenate(taken)[np.argsort(every, kind="stable")] if found else every
    depth = np.bincount(every, minlength=len(mass) + 1)
    first = np.concatenate(([0], np.cumsum(depth)))
    return first, steps.astype(np.int32), odds


@dataclass
class Decisions:
    """The decisions below the tops on the way to the tokens' leaves, one level of the trees after the other.

    ``order`` holds the tokens that meet decisions, the deepest leaves first, so that those of a level are the first ``sizes[level]``
    of them. ``who`` is the token's place in that order.
    """

    order: np.ndarray
    sizes: list[int]
    who: np.ndarray
    node: np.ndarray
    right: np.ndarray

    def levels(self) -> Iterator[tuple[int, slice]]:
        """How many tokens meet each level, and where its decisions stand."""
        at = 0
        for size in self.sizes:
            yield size, slice(at, at + size)
            at += size

    def lean(self, shown: np.ndarray, rows: np.ndarray, room: Room) -> np.ndarray:
        """Each decision's product of what its token and its node have, both with a column each; ``shown`` is in the order of the tokens."""
        parts = room.columns("parts", len(rows), len(self.node))
        for size, at in self.levels():
            np.multiply(shown[:, :size], rows[:, at], out=parts[:, at])
        return parts.sum(axis=0)


class Tops:
    """The decisions in the upper levels of the trees: one product of matrices per unit tells them all."""

    def __init__(self, leaf: np.ndarray, order: np.ndarray, full: np.ndarray, words: np.ndarray, vocab: Vocabulary, room: Room):
        self.order, self.room = order, room
        ends = np.searchsorted(leaf.take(order), vocab.rest_leaf[WORD_UNITS:], side="right").tolist()
        self.parts = [(u, slice(a, b)) for u, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        nodes, places, right = vocab.tops
        self.shown = room.rows("top shown", full, self.order)
        self.vectors = words.take(nodes, axis=0)[:, :, : SIZE + 1]
        leaves, width, n = leaf.take(self.order), 1 << TOP, len(self.order)
        self.place, self.right = places.take(leaves, axis=0), right.take(leaves, axis=0)
        scores = room("top", n, width)
        for u, part in self.parts:
            np.matmul(self.shown[part], self.vectors[u].T, out=scores[part])
        self.at = self.place + (np.arange(n) * width)[:, None]
        self.lean, self.none = scores.ravel().take(self.at), self.place == width - 1

    def back(self, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How the decisions pull each guess, the step of each node, and how often each was met."""
        miss[self.none] = 0
        width = 1 << TOP
        spread = self.room("top", len(self.order), width)
        spread[:] = 0
        spread.ravel()[self.at] = miss
        more, step = np.empty((len(self.order), SIZE), np.float32), np.zeros((LENGTHS, width, SIZE + 1), np.float32)
        times = np.zeros((LENGTHS, width), np.int64)
        for u, part in self.parts:
            np.matmul(spread[part], self.vectors[u][:, :SIZE], out=more[part])
            np.matmul(spread[part].T, self.shown[part], out=step[u])
            times[u] = np.bincount(self.place[part].ravel(), minlength=width)
        return more, step, times


def by_leaf(leaf: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The tokens of shared units in the order of their leaves, so that units come in order and near leaves read near rows."""
    shared = np.flatnonzero(leaf < vocab.leaves - 1)
    return shared[np.argsort(leaf.take(shared).astype(np.int32))]


def decisions(leaf: np.ndarray, order: np.ndarray, vocab: Vocabulary) -> Decisions:
    """Of the tokens in ``order``."""
    depth = vocab.depth.take(leaf.take(order))
    sizes = (len(order) - np.cumsum(np.bincount(depth)))[:-1].tolist()
    order = order[np.argsort(-depth, kind="stable")[: np.count_nonzero(depth)]]
    first, places = vocab.first.take(leaf.take(order)) + TOP, np.arange(len(order))
    if not sizes:
        return Decisions(order, sizes, places, places, places.astype(bool))
    steps = vocab.steps.take(np.concatenate([first[:n] + level for level, n in enumerate(sizes)]))
    who = np.concatenate([places[:n] for n in sizes])
    return Decisions(order, sizes, who, (steps >> 1).astype(np.int64), (steps & 1).astype(bool))


@dataclass
class Batch:
    """Tokens of whole texts: unit, leaf and head number (-1: not in the head) of each, and where each text begins.

    ``before`` holds units one and two places before each token, then the leaves there; ``rare`` the words not in the head.
    """

    unit: np.ndarray
    leaf: np.ndarray
    number: np.ndarray
    before: tuple[np.ndarray, ...]
    starts: np.ndarray
    rare: list[bytes]


def read(texts: Sequence[list[bytes]], vocab: Vocabulary) -> Batch:
    """The batch of the texts' words."""
    words: list[bytes] = []
    starts = []
    for found in texts:
        starts.append(len(words))
        words += found
        words.append(END)
    number = np.fromiter(map(vocab.numbers.get, words, repeat(-1)), np.int64, len(words))
    unit = vocab.unit[number] if len(vocab.unit) else np.zeros(len(words), np.int64)
    tail = np.flatnonzero(number < 0)
    rare = [words[i] for i in tail.tolist()]
    sizes = np.fromiter(map(len, rare), np.int64, len(rare))
    unit[tail] = np.where(sizes > 0, WORD_UNITS + np.minimum(sizes, LENGTHS) - 1, 0)
    for i, word in enumerate(rare):
        if not word.isascii():
            unit[tail[i]] = length_unit(word)
    leaf = vocab.leaf[number] if len(vocab.unit) else np.zeros(len(words), np.int64)
    leaf[tail] = vocab.rest_leaf[unit[tail]]
    at = np.array(starts, np.int64)
    return Batch(unit, leaf, number, (*contexts(unit, START, at), *contexts(leaf, vocab.leaves - 1, at)), at, rare)


def encoded(text: str | None, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Unit of each token, the head numbers of the tokens (-1: not in the head), and the words not in the head."""
    batch = read([tokens(text)], vocab)
    return batch.unit, batch.number, batch.rare


def batches(texts: Iterable[str | None], vocab: Vocabulary, least: int = BATCH) -> Iterator[Batch]:
    """Batches of at least ``least`` tokens, but for the last."""
    held, size = [], 0
    for text in texts:
        held.append(tokens(text))
        size += len(held[-1]) + 1
        if size >= least:
            yield read(held, vocab)
            held, size = [], 0
    if held:
        yield read(held, vocab)


def contexts(unit: np.ndarray, none: int = START, starts: Sequence[int] | np.ndarray = (0,)) -> tuple[np.ndarray, np.ndarray]:
    """The units, or leaves, one and two places before each token; ``none`` before the begin of a text."""
    at = np.asarray(starts, np.int64)
    one, two = np.empty_like(unit), np.empty_like(unit)
    one[1:], two[2:] = unit[:-1], unit[:-2]
    one[at] = two[at] = none
    second = at + 1
    two[second[second < len(unit)]] = none
    return one, two


def start(vocab: Vocabulary) -> Parameters:
    """Small fixed random vectors, none of nodes yet, and biases that give the frequencies."""
    draw = np.random.default_rng(8)
    context, target = (draw.normal(0, 0.1, (n, SIZE)).astype(np.float32) for n in (UNITS + 1, UNITS))
    share = (vocab.unit_tokens + 1) / (vocab.unit_tokens + 1).sum()
    words = np.zeros((vocab.leaves + len(vocab.odds), SIZE + 1), np.float32)
    words[: vocab.leaves - 1, :SIZE] = SPREAD * draw.standard_normal((vocab.leaves - 1, SIZE), np.float32)
    words[vocab.leaves :, SIZE] = vocab.odds
    own = np.log(share).astype(np.float32)
    return Parameters(context, np.ones((2, SIZE), np.float32), target, own, words)


def column_sums(at: np.ndarray, columns: np.ndarray, rows: int) -> np.ndarray:
    """Rows of what goes to each of few places."""
    return np.stack([np.bincount(at, column, rows) for column in columns], axis=1).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation of units, likelihood of decisions, with AdaGrad; the noise is drawn from the unit frequencies.

    ``rows`` are those of ``words``, each followed by the sum of its squared steps and by how often it was met, so that a
    step reads and writes a row once.
    """

    def __init__(self, parameters: Parameters, vocab: Vocabulary, seed: int):
        self.p, self.vocab, self.draw, self.seen = parameters, vocab, np.random.default_rng(seed), 0
        self.rows = np.zeros((len(parameters.words), WIDTH), np.float32)
        self.rows[:, : SIZE + 1] = parameters.words
        self.rows[:, SQUARES] = CALM
        self.slot, self.room = np.zeros(len(parameters.words), np.int32), Room()
        share = (vocab.unit_tokens + 1) / (vocab.unit_tokens + 1).sum()
        self.edges, self.log_noise = np.cumsum(share), np.log(share * NOISE).astype(np.float32)
        self.squares = [np.full_like(a, 1e-6) for a in (parameters.context, parameters.place, parameters.target, parameters.bias)]

    def learn(self, unit: np.ndarray, leaf: np.ndarray, *before: np.ndarray) -> None:
        """One step on the tokens ``unit`` and ``leaf`` with units and leaves of the tokens one and two places before."""
        p, room, (one, two, own_one, own_two) = self.p, self.room, before
        n, order = len(unit), by_leaf(leaf, self.vocab)
        met = decisions(leaf, order, self.vocab)
        # Mostly, what is two places before a token is one place before the last; both pull it at once.
        same = np.flatnonzero((two[1:] == one[:-1]) & (own_two[1:] == own_one[:-1]))
        alone = np.ones(n, bool)
        alone[same + 1] = False
        alone = np.flatnonzero(alone)
        found, at = self.numbered(np.concatenate((own_one, own_two[alone], met.node + self.vocab.leaves)))
        units = n + len(alone)
        rows = room.rows("old", self.rows, found)
        own = room.rows("own", rows, at[:units])[:, :SIZE] + p.context.take(np.concatenate((one, two[alone])), axis=0)
        c1, c2 = own[:n], np.empty((n, SIZE), np.float32)
        c2[1:], c2[alone] = c1[:-1], own[n:]
        full = np.ones((n, SIZE + 1), np.float32)
        guess = c1 * p.place[0]
        guess += c2 * p.place[1]
        full[:, :SIZE] = guess
        noise = np.minimum(np.searchsorted(self.edges, self.draw.random(NOISE)), UNITS - 1)
        target, noisy = p.target.take(unit, axis=0), p.target[noise]
        true = np.einsum("ij,ij->i", guess, target) + (p.bias - self.log_noise).take(unit)
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        against = -np.append(noisy, (p.bias - self.log_noise)[noise, None], axis=1).T
        down, pull = room("down", n, NOISE), np.empty((n, SIZE), np.float32)
        for a in range(0, n, ROWS):
            part = np.matmul(full[a : a + ROWS], against, out=down[a : a + ROWS])
            np.exp(np.minimum(part, 30, out=part), out=part)
            part += 1
            np.divide(-1, part, out=part)
            np.matmul(part, noisy, out=pull[a : a + ROWS])
        pull += up[:, None] * target
        # Decisions pull the guesses to the side that their token took.
        tops = Tops(leaf, order, full, self.rows, self.vocab, room)
        more, top_step, top_times = tops.back(tops.right - 1 / (1 + np.exp(np.clip(-tops.lean, -30, 30))))
        pull[tops.order] += more
        nodes = room.columns("nodes", SIZE + 1, len(met.node))
        turned(rows, room).take(at[units:], axis=1, out=nodes, mode="clip")
        shown = np.ascontiguousarray(full.take(met.order, axis=0).T)
        miss = met.right - 1 / (1 + np.exp(np.minimum(-met.lean(shown, nodes, room), 30)))
        nodes *= miss
        more = np.zeros((SIZE, len(met.order)), np.float32)
        for size, level in met.levels():
            more[:, :size] += nodes[:SIZE, level]
        pull[met.order] += more.T
        # What each row gets, a column per row met: of contexts, then of nodes.
        changes = room.columns("changes", SIZE + 1, units + len(met.node))
        first, second = (np.multiply(pull.T, x[:, None], order="C") for x in p.place)
        changes[SIZE, :units], changes[:SIZE, :n], changes[:SIZE, n:units] = 0, first, second[:, alone]
        second[:, alone] = 0
        changes[:SIZE, : n - 1] += second[:, 1:]
        for size, level in met.levels():
            np.multiply(shown[:, :size], miss[level], out=changes[:, units + level.start : units + level.stop])
        step = np.stack([np.bincount(at, change, len(found)) for change in changes])
        times = np.bincount(at, minlength=len(found)) + np.bincount(at[same], minlength=len(found))
        self.move(found, rows, step, times)
        top = np.flatnonzero(top_times.ravel() * (self.vocab.tops[0].ravel() >= self.vocab.leaves))
        found = self.vocab.tops[0].ravel()[top]
        self.move(found, room.rows("old", self.rows, found), top_step.reshape(-1, SIZE + 1)[top].T, top_times.ravel()[top])
        context_step = column_sums(np.concatenate((one, two[alone])), changes[:SIZE, :units], UNITS + 1)
        drawn = np.zeros((UNITS, NOISE), np.float32)
        drawn[noise, np.arange(NOISE)] = 1
        target_step = column_sums(unit, np.multiply(guess.T, up, order="C"), UNITS) + drawn @ (down.T @ guess)
        bias_step = (np.bincount(unit, up, UNITS) + drawn @ down.sum(axis=0)).astype(np.float32)
        place_step = np.stack((np.einsum("ij,ij->j", pull, c1), np.einsum("ij,ij->j", pull, c2)))
        steps = (context_step, place_step, target_step, bias_step)
        for value, square, change in zip((p.context, p.place, p.target, p.bias), self.squares, steps):
            square += change * change
            value += RATE * change / np.sqrt(square)
        self.seen += n

    def numbered(self, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different rows among ``met``, and where each of ``met`` stands there; found without a sort."""
        places = np.arange(len(met), dtype=np.int32)
        self.slot[met] = places
        found = met[self.slot.take(met) == places]
        self.slot[found] = places[: len(found)]
        return found, self.slot.take(met).astype(np.int64)

    def move(self, found: np.ndarray, rows: np.ndarray, step: np.ndarray, times: np.ndarray) -> None:
        """A step of these rows, each with one rate; ``step`` has a column per row."""
        step[:, found == self.vocab.leaves - 1] = 0  # words with units of their own, and what is before a text
        squares = rows[:, SQUARES] + np.einsum("ij,ij->j", step, step) / (SIZE + 1)
        rows[:, SQUARES] = squares
        rows[:, MET] += times
        step *= RATE / np.sqrt(squares)
        rows[:, : SIZE + 1] += step.T
        whole = f"V{rows.itemsize * WIDTH}"
        np.put(self.rows.view(whole), found, rows.view(whole), mode="clip")


def fit(rows: DataFrame, vocab: Vocabulary, shared: Broadcast | None = None) -> Parameters:
    """The average of one replica per partition; every training token is learned from once.

    Replicas weigh by their tokens, in a row of ``words`` by how often they met it; rows that none met stay as at the start.
    What they learned in those is sent in half precision. ``shared`` is the vocabulary where it is broadcast already.
    """
    shared = shared or rows.sparkSession.sparkContext.broadcast(vocab)
    schema = "part int, seen long, met binary, replica binary"
    columns = [c.split()[0] for c in schema.split(", ")]

    def replica(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vocab = shared.value
        number = TaskContext.get().partitionId()
        trainer = Trainer(start(vocab), vocab, number)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches((text for frame in frames for text in frame["text"]), vocab):
            held.append((batch.unit, batch.leaf, *batch.before))
            size += len(batch.unit)
            if size >= BATCH:
                joined = [np.concatenate(x) for x in zip(*held)]
                for at in range(0, size - BATCH + 1, BATCH):
                    trainer.learn(*[x[at : at + BATCH] for x in joined])
                rest = size % BATCH
                held, size = [tuple(x[size - rest :] for x in joined)], rest
        if size:
            trainer.learn(*[np.concatenate(x) for x in zip(*held)])
        if trainer.seen:
            flat = trainer.p.flat().astype(np.float64) * trainer.seen
            yield pd.DataFrame([(number % SLOTS, trainer.seen, b"", flat.tobytes())], columns=columns)
            for at in range(0, len(trainer.rows), BLOCK):
                often = trainer.rows[at : at + BLOCK, MET].copy()
                met = np.flatnonzero(often)
                if len(met):
                    values = (trainer.rows[at + met, : SIZE + 1] - trainer.p.words[at + met]).astype(np.float16)
                    row = SLOTS + at // BLOCK, 0, often.tobytes(), values.tobytes()
                    yield pd.DataFrame([row], columns=columns)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = 0.0, 0
        blocks: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, n, met, data in frame.itertuples(index=False):
                if part < SLOTS:
                    total, seen = total + np.frombuffer(data), seen + n
                    continue
                often = np.frombuffer(met, np.float32).astype(np.float64)
                sums = blocks.setdefault(part, np.zeros((len(often), SIZE + 2)))
                sums[:, 0] += often
                rows = np.flatnonzero(often)
                sums[rows, 1:] += np.frombuffer(data, np.float16).reshape(-1, SIZE + 1) * often[rows, None]
        if seen:
            yield pd.DataFrame([(0, seen, b"", total.tobytes())], columns=columns)
        for part, sums in blocks.items():
            met = np.flatnonzero(sums[:, 0])
            means = (sums[met, 1:] / sums[met, :1]).astype(np.float32)
            yield pd.DataFrame([(part, 0, met.astype(np.int32).tobytes(), means.tobytes())], columns=columns)

    sums = rows.select("text").mapInPandas(replica, schema).repartition(SLOTS, "part").mapInPandas(add, schema).collect()
    first = start(vocab)
    seen = sum(r["seen"] for r in sums)
    if not seen:
        return first
    for r in sums:
        if r["part"] >= SLOTS:
            at = (r["part"] - SLOTS) * BLOCK + np.frombuffer(r["met"], np.int32)
            first.words[at] += np.frombuffer(r["replica"], np.float32).reshape(-1, SIZE + 1)
    # Sums in a fixed order, so that the same data give the same model.
    parts = sorted((np.frombuffer(r["replica"]) for r in sums if r["part"] < SLOTS), key=lambda x: x.tobytes())
    return Parameters.of(sum(parts) / seen, first.words)


def score(df: DataFrame, training: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` but the text, with n_tokens, n_known, train_tokens, base_score and score.

    Columns of these names are replaced. A null text is empty, so its one token is the end. Counts and model are of the ``text`` of all rows of
    ``training``. Repeated rows are scored alike. Without training rows every base probability is one and the units
    are equally likely. Words outside the head meet their counts in a join on the word; no task gathers a text's rows
    from elsewhere.
    """
    rows = training.select(F.col(text).alias("text"))
    counts = checkpointed(word_counts(rows))
    vocab = vocabulary(counts)
    context = df.sparkSession.sparkContext
    shared = context.broadcast(vocab)
    model = context.broadcast(fit(rows, vocab, shared))
    names = ["n_tokens", "n_known", "head_log", "model_log", "rare", "times"]
    schema = "n_tokens long, n_known long, head_log double, model_log double, rare array<binary>, times array<int>"

    @F.pandas_udf(schema)
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab, parameters = shared.value, model.value
        log_count = np.append(np.log10(vocab.counts + SMOOTH), 0.0)  # -1, a word outside the head, reads the last
        log_rest = np.log10(vocab.rest_mass)

        room = Room()
        for texts in parts:
            out = []
            for batch in batches(texts, vocab, SCORED):
                cuts = [slice(at, at + SCORED) for at in range(0, len(batch.unit), SCORED)]
                logs = np.concatenate([parameters.log_probabilities(batch, cut, vocab, room) for cut in cuts]) / math.log(10)
                tail = np.flatnonzero(batch.number < 0)
                # The joined counts of words outside the head are shares of their units' last leaves.
                logs[tail] -= log_rest[batch.unit[tail]]
                ends = np.searchsorted(tail, batch.starts).tolist() + [len(tail)]
                found = [Counter(batch.rare[a:b]) for a, b in zip(ends, ends[1:])]
                sizes = np.diff(batch.starts, append=len(batch.unit))
                known = sizes - np.diff(ends)
                sums = [np.add.reduceat(x, batch.starts).tolist() for x in (log_count[batch.number], logs)]
                rare = [list(c) for c in found], [list(c.values()) for c in found]
                out += zip(sizes.tolist(), known.tolist(), *sums, *rare)
            yield pd.DataFrame.from_records(out, columns=names)

    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    old = [c for c in df.columns if c.lower() not in (*new, text.lower())]
    got = scored(F.col(text))
    base = checkpointed(
        df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in old]).alias("row"), F.monotonically_increasing_id().alias("place"), got.alias("s"))
        .select("row", "place", "s.*")
    )
    tail = base.select("place", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "place", F.col("w.rare").alias("word"), F.col("w.times").alias("n")
    )
    met = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("place").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + SMOOTH)).alias("tail_log"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
    )
    every = base.drop("rare", "times").join(sums, "place", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    found = every.select(
        "row",
        F.struct(
            "n_tokens",
            (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(vocab.tokens).cast("long").alias("train_tokens"),
            (F.col("head_log") + tail_log - F.col("n_tokens") * math.log10(vocab.denominator)).alias("base_score"),
            (F.col("model_log") + tail_log).alias("score"),
        ).alias("found"),
    )
    return found.select(*[F.col(f"row.`{c}`") for c in old], *[F.col(f"found.{c}") for c in new])
