"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled texts per language in a fixed number of hash buckets. The matrix of log
probabilities goes to every task, which scores whole batches of texts in numpy, a text's own buckets only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import free_name

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
# Texts per language that training uses at most (in expectation), picked by a hash of the text.
TRAIN_TEXTS = 20_000
# Languages at most: bounds the matrix at MAX_LANGUAGES * BUCKETS * 4 bytes.
MAX_LANGUAGES = 400
UNKNOWN = "und"
SLICE_CHARS = 1 << 20
PAD = "\x00"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # (languages, BUCKETS)
    log_prior: np.ndarray


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``SLICE_CHARS`` characters each; a longer text is a run of its own."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if chars and chars + size > SLICE_CHARS:
            yield start, i
            start, chars = i, 0
        chars += size
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that starts at each character, per order, and the span starts and ends of the texts.

    Texts are lowered. A pad before a text and two behind it keep n-grams from reaching into another text.
    """
    padded = [PAD + (t or "").lower() + PAD + PAD for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(p) for p in padded])
    starts = np.concatenate(([0], ends[:-1]))
    edges = np.stack((starts, ends - 2), axis=1).ravel()
    buckets, mixed = [], np.zeros(len(points), np.uint64)
    for order in ORDERS:
        shifted = np.zeros_like(points)
        shifted[: len(points) - order + 1] = points[order - 1 :]
        mixed = (mixed + shifted + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        found = mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
        buckets.append(found.astype(np.int64) & (BUCKETS - 1))
    return buckets, edges


def train(df: DataFrame, text: str, lang: str) -> Model:
    """The model of the labelled rows of ``df``; rows without text or language teach nothing."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    texts = {r["lang"]: r["count"] for r in counts}
    if not texts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    languages = sorted(texts)
    shares = {x: min(1.0, TRAIN_TEXTS / texts[x]) for x in languages}
    numbers = {x: i for i, x in enumerate(languages)}
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(s)) for x, s in shares.items()])
    chosen = rows.where(draw < share)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for frame in frames:
            labels = frame["lang"].map(numbers).to_numpy()
            held = frame["text"].tolist()
            for a, b in slices(held):
                buckets, edges = grams(held[a:b])
                length = np.diff(edges, append=edges[-1] + 2)
                label = np.repeat(np.repeat(labels[a:b], 2), length)
                inside = np.repeat(np.tile([True, False], b - a), length)
                for found in buckets:
                    total += np.bincount((label * BUCKETS + found)[inside], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    cells = chosen.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas()  # at most languages * BUCKETS rows
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    np.add.at(table.reshape(-1), got["cell"].to_numpy(np.int64), got["n"].to_numpy(float))
    log_prob = np.log(table) - np.log(table.sum(axis=1, keepdims=True))
    known = np.array([texts[x] for x in languages], float)
    return Model(languages, log_prob.astype(np.float32), np.log(known / known.sum()))


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    best, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return best, sure
    for a, b in slices(texts):
        buckets, edges = grams(texts[a:b])
        total = np.tile(model.log_prior, (b - a, 1))
        for found in buckets:
            for i, weights in enumerate(model.log_prob):
                # A text's own buckets only, summed over its characters in double precision.
                total[:, i] += np.add.reduceat(weights[found], edges, dtype=np.float64)[::2]
        total -= total.max(axis=1, keepdims=True)
        odds = np.exp(total)
        odds /= odds.sum(axis=1, keepdims=True)
        for i, at in enumerate(odds.argmax(axis=1).tolist()):
            text = texts[a + i]
            if text and any(map(str.isalpha, text)):
                best[a + i], sure[a + i] = model.languages[at], odds[i, at]
    return best, sure


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (0 to 1); columns of these names are replaced.

    A null text and one without a letter give ``und`` and 0, as does every text if nothing was learned. Of equally
    likely languages the first by name wins. The whole text counts; rows do not influence each other.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in parts:
            best, sure = score(texts.tolist(), known)
            yield pd.DataFrame({"lang_pred": best, "score": sure})

    got = free_name(df, "predicted")
    rows = df.withColumn(got, predicted(F.col(text)))
    return rows.withColumns({"lang_pred": F.col(f"{got}.lang_pred"), "score": F.col(f"{got}.score")}).drop(got)


def fold(identity: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(identity.cast("string"), F.lit(""))) % folds
