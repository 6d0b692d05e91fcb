"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, the share of tokens that are
raw bytes, and the entropy of its tokens. Each language, or else each script, has a band for every measure, and a
text outside a band is rejected. ``judged`` derives the bands from all documents of a language; the fixed ones serve
languages with few documents. Two plain rules come first: too few words, too many repeated words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import free_name, split_words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
LINE_BLANKS = " \t\n\x0b\x0c\r"
# Words whose tokens a Python worker remembers; words beyond are encoded anew each time.
REMEMBERED_WORDS = 300_000


@dataclass(frozen=True)
class Band:
    """Limits a kept text lies within: characters per token, byte tokens per token, bits per token."""

    min_chars: float
    max_chars: float
    max_bytes: float
    min_entropy: float


# Bands derived from documents: spreads below the median that a kept text may lie, spreads to the other side, where
# rare good texts are and no junk, and the fewest different texts that make statistics.
BELOW, ABOVE, ENOUGH = 3.5, 6.0, 100
# Smallest spreads, so that a measure that is the same in nearly all texts rejects no good one.
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.02, "token_entropy": 0.1}
# By script of most letters. Scripts a vocabulary has few pieces for give short tokens and more byte tokens.
SCRIPT_BANDS = {
    "LATIN": Band(1.2, 7.0, 0.20, 3.5),
    "CYRILLIC": Band(0.9, 6.0, 0.30, 3.5),
    "GREEK": Band(0.6, 5.0, 0.50, 3.5),
    "CJK": Band(0.3, 3.0, 0.95, 3.5),
    "HIRAGANA": Band(0.3, 3.0, 0.95, 3.5),
    "HANGUL": Band(0.3, 3.0, 0.98, 3.5),
    "": Band(0.2, 7.0, 1.00, 3.0),
}
# First code points of the letter ranges that decide the script; None ends a range.
SCRIPT_RANGES = [
    (0x41, "LATIN"), (0x5B, None), (0x61, "LATIN"), (0x7B, None), (0xC0, "LATIN"), (0x250, None),
    (0x370, "GREEK"), (0x400, "CYRILLIC"), (0x530, None), (0x1E00, "LATIN"), (0x1F00, "GREEK"), (0x2000, None),
    (0x3041, "HIRAGANA"), (0x3100, None), (0x3400, "CJK"), (0xA000, None), (0xAC00, "HANGUL"), (0xD7A4, None),
]
SCRIPT_STARTS = np.array([start for start, _ in SCRIPT_RANGES], np.uint32)
SCRIPT_OF_START = [script for _, script in SCRIPT_RANGES]
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "script string, chars_per_token double, byte_share double, token_entropy double, kept boolean"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a window of three that occurs twice or more, its first occurrence included."""
    if len(ids) < 4:
        return 0
    kinds = int(ids.max()) + 1
    pair = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    _, window, found = np.unique(pair[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    again = found[window] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(LINE_BLANKS)]
    return len(lines) - len(set(lines))


def main_script(text: str) -> str:
    """Script of most letters of the whole text, of equally many the first by name; empty without any."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.searchsorted(SCRIPT_STARTS, points, "right"), minlength=len(SCRIPT_STARTS) + 1)
    found: dict[str, int] = {}
    for count, script in zip(counts[1:].tolist(), SCRIPT_OF_START):
        if script and count:
            found[script] = found.get(script, 0) + count
    return max(sorted(found), key=found.get) if found else ""


class Fertility:
    """Tokens of words by one vocabulary."""

    def __init__(self, vocabulary: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[bytes, bytes] = {}

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """Token ids of a text, each word encoded by itself."""
        known = self.known
        new = [w for w in set(words) if w not in known]
        ids = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else []
        fresh = {w: np.asarray(i, "<u2").tobytes() for w, i in zip(new, ids)}
        if len(known) + len(fresh) <= REMEMBERED_WORDS:
            known.update(fresh)
            found = known
        else:
            found = {**{w: known[w] for w in set(words) if w in known}, **fresh}
        return np.frombuffer(b"".join([found[w] for w in words]), "<u2")

    def measures(self, words: list[bytes], chars: int) -> tuple[float, float, float]:
        ids = self.tokens(words)
        if not len(ids):
            return 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        counts = counts[counts > 0] / len(ids)
        return chars / len(ids), float(self.is_byte[ids].mean()), float(-(counts * np.log2(counts)).sum())


@cache
def fertility_of(vocabulary: str) -> Fertility:
    """One per Python worker: what a task has learned serves the next one."""
    return Fertility(vocabulary)


def measure(text: str | None, fertility: Fertility, lang: str | None = None, lang_bands: dict[str, Band] = {}) -> tuple:
    """One row of ``RESULT``."""
    text = text or ""
    words = split_words(text)
    chars = len(text) - sum(map(text.count, LINE_BLANKS))
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    repeats = repeated_words(ids)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
    script = main_script(text)
    per_token, byte_share, entropy = fertility.measures(words, chars)
    band = lang_bands.get(lang) or SCRIPT_BANDS.get(script, SCRIPT_BANDS[""])
    inside = (
        band.min_chars <= per_token <= band.max_chars and byte_share <= band.max_bytes and entropy >= band.min_entropy
    )
    symbols = sum(map(text.count, SYMBOLS))
    lines = repeated_lines(text)
    return (
        len(words), chars, symbols, lines, repeats, failed, script, per_token, byte_share, entropy,
        not failed and inside,
    )


def quality(
    df: DataFrame,
    text: str = "text",
    lang: str | None = None,
    lang_bands: dict[str, Band] | None = None,
    vocabulary: str | None = None,
) -> DataFrame:
    """``df`` with the columns of ``RESULT``; a column of the same name is replaced.

    A null text counts as empty: no words, so it fails the base rules. Whole texts are read. ``lang`` names a column
    whose value picks a band of ``lang_bands``; a null or other value falls back to the script. Rows are
    independent of each other, so ties, repeated rows and an empty table need no rule.
    """
    path, bands = vocabulary or default_vocabulary(), lang_bands or {}

    @F.pandas_udf(RESULT)
    def measured(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fertility = fertility_of(path)
        names = [x.split()[0] for x in RESULT.split(", ")]
        for texts, langs in parts:
            rows = [measure(t, fertility, x, bands) for t, x in zip(texts, langs)]
            yield pd.DataFrame.from_records(rows, columns=names)

    got = free_name(df, "measured")
    tongue = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = df.withColumn(got, measured(F.col(text), tongue))
    return rows.withColumns({f.name: F.col(f"{got}.{f.name}") for f in rows.schema[got].dataType}).drop(got)


def derived_bands(measured: DataFrame, group: Column) -> DataFrame:
    """(band_group, min_chars, max_chars, max_bytes, min_entropy) of each group with ``ENOUGH`` different texts.

    Limits lie around the median by multiples of the median deviation, over texts that pass the base rules; texts
    alike in all measures count once, so copies do not narrow a band. Measures are taken to thousandths up to 100,
    which bounds what the exact medians hold.
    """
    names = list(LEAST_SPREAD)
    texts = measured.where("NOT base_failed").select(group.alias("band_group"), "n_words", "word_chars", *names).distinct()
    fine = texts.select("band_group", *[F.round(F.least(F.col(c), F.lit(100.0)), 3).alias(c) for c in names])
    middle = lambda c: F.percentile(c, F.lit(0.5))
    medians = fine.groupBy("band_group").agg(F.count("*").alias("n"), *[middle(F.col(c)).alias(f"{c}_mid") for c in names])
    medians = medians.where(F.col("n") >= ENOUGH)
    off = fine.join(F.broadcast(medians), "band_group")
    far = lambda c: middle(F.round(F.abs(F.col(c) - F.col(f"{c}_mid")), 3))
    spreads = off.groupBy("band_group", *[f"{c}_mid" for c in names]).agg(
        *[F.greatest(1.4826 * far(c), F.lit(least)).alias(f"{c}_spread") for c, least in LEAST_SPREAD.items()]
    )
    limit = lambda c, times: F.col(f"{c}_mid") + times * F.col(f"{c}_spread")
    return spreads.select(
        "band_group",
        limit("chars_per_token", -BELOW).alias("min_chars"),
        limit("chars_per_token", ABOVE).alias("max_chars"),
        limit("byte_share", BELOW).alias("max_bytes"),
        limit("token_entropy", -BELOW).alias("min_entropy"),
    )


def judged(measured: DataFrame, lang: str) -> DataFrame:
    """The rows of ``quality`` with ``kept`` decided by bands derived from all of them.

    Texts are grouped by ``lang``, those without one by script. A group too small for statistics keeps the verdict
    it has. ``measured`` is read three times, so it should be materialised.
    """
    tongue, at = F.col(lang).cast("string"), free_name(measured, "band_of")
    group = F.when(tongue.isNull(), F.concat(F.lit("script "), F.col("script"))).otherwise(F.concat(F.lit("lang "), tongue))
    bands = derived_bands(measured, group).select(F.col("band_group").alias(at), F.struct("*").alias(f"{at}_band"))
    rows = measured.withColumn(at, group).join(F.broadcast(bands), at, "left")
    limit = lambda name: F.col(f"{at}_band.{name}")
    inside = (
        F.col("chars_per_token").between(limit("min_chars"), limit("max_chars"))
        & (F.col("byte_share") <= limit("max_bytes"))
        & (F.col("token_entropy") >= limit("min_entropy"))
    )
    known = F.col(f"{at}_band").isNotNull()
    return rows.withColumn("kept", F.when(known, ~F.col("base_failed") & inside).otherwise(F.col("kept"))).drop(at, f"{at}_band")
