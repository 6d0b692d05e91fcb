import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, lowered, odd_columns, prose
from trackline.llm import collocations
from trackline.llm.collocations import Sequences, Summary, Vocabulary, best_of, merged, phrases, slices


def brute(rows, threshold, limit=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if a >= threshold}
        longer = Counter()
        for p, a in known.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s : s + m]] = max(longer[p[s : s + m]], a)
        rows = []
        for p, a in known.items():
            if len(p) > 1 and not 100 * longer[p] >= 80 * a:
                score, k = min((2_000_000 * a // (known[p[:k]] + known[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, phrases(df, **kw).collect()))


def crowd():
    rows = [(i, prose(i % 6, 150), ["en", "de", None][i % 3], "a", 1) for i in range(240)]
    rows += [(i, "New York,\tnew york city: new  york City hall! NEW YORK", "en", "a", 1) for i in range(60)]
    rows += [(i, "new york state of mind; state of the art", "en", "a", 1) for i in range(9)]
    return rows + [(i, "a\x00b ſs É . a\x00b ſs É", "und", "a", 1) for i in range(40)] + awkward()


def test_against_brute_force(spark):
    rows = crowd()
    found = got(odd_columns(documents(spark, rows)).repartition(5))
    assert found == brute(rows, 30) and {r[0] for r in found} == {"en", "de", "und"}
    assert any("new york" in r[2] for r in found)


@pytest.mark.parametrize("bound", [64, 1 << 12])
def test_a_crowded_filter_loses_and_adds_nothing(spark, monkeypatch, bound):
    monkeypatch.setattr(collocations, "FILTER_BITS", bound)
    rows = crowd()
    assert got(documents(spark, rows), threshold=12, limit=50) == brute(rows, 12, 50)


def test_empty_and_rare(spark):
    assert got(documents(spark, [])) == []
    assert got(documents(spark, [(1, None, None, None, None), (2, "one two three", "en", "a", 1)])) == []


def test_summaries_keep_every_frequent_key():
    """Merged in any pieces, a key as frequent as the threshold is a candidate, and no estimate is off by the threshold."""
    draw = np.random.default_rng(6)
    for threshold in (5, 30):
        keys = draw.zipf(1.3, 40_000).astype(np.uint32) % 5000
        parts = [np.unique(p, return_counts=True) for p in np.array_split(keys, 37)]
        found = merged([k for k, _ in parts], [c for _, c in parts], threshold)
        assert len(found.keys) <= found.capacity and found.error < threshold
        true = Counter(keys.tolist())
        assert {k for k, f in true.items() if f >= threshold} <= set(found.candidates(threshold).tolist())
        small = Summary(len(keys) // threshold + 1)
        for k, c in parts:
            small.merge(k, c)
        assert small.error < threshold and len(small.keys) <= small.capacity
        assert all(true[k] - small.error <= c <= true[k] for k, c in zip(small.keys.tolist(), small.counts.tolist()))
        assert {k for k, f in true.items() if f >= threshold} <= set(small.candidates(threshold).tolist())


def test_long_texts_are_cut_between_pieces():
    text = (b"one two three. " * 50 + b"four five " * 20) * 3
    parts = list(slices(text, 100))
    assert b"".join(parts) == text and len(parts) > 5 and all(p.endswith(b".") for p in parts[:-1])
    assert list(slices(b"no stop at all " * 30, 100)) == [b"no stop at all " * 30]


def test_sequences_stay_inside_pieces():
    found = Sequences([("en", b"a b . c d e"), ("de", b""), ("en", b"a b")], Vocabulary())
    at = {n: [tuple(found.tokens[i : i + n]) for i in places] for n, places, _ in found.hashes()}
    assert at[2] == [(b"a", b"b"), (b"c", b"d"), (b"d", b"e"), (b"a", b"b")] and at[3] == [(b"c", b"d", b"e")] and at[4] == []


def test_ranking_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CROWD", 100)
    df = spark.range(5000).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).alias("v"))
    found = best_of(df, "g", [F.desc("v"), F.asc("id")], "id", 20, "rank").orderBy("rank").collect()
    assert [r["id"] for r in found] == [7 * i + 6 for i in range(20)] and [r["rank"] for r in found] == list(range(1, 21))
