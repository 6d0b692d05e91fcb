import os
from collections import Counter

import pytest

from tests.llm.cases import awkward, documents, odd_columns, prose, words
from trackline.llm.queries import QUERIES
from trackline.llm.quality import Band, Fertility, default_vocabulary, judged, main_script, quality


def brute(text):
    text = text or ""
    found = words(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed


def test_awkward_rows_against_brute_force(spark):
    rows = awkward() + [(20, "# * $ a|b <c> %% && " * 9 + prose(8, 99), "en", "a", 1), (21, "x y z\nx y z\r\nx y z\n \n \n" + prose(3, 70), "en", "a", 1)]
    got = quality(odd_columns(documents(spark, rows))).collect()
    columns = ("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter((r[0], r[1], *brute(r[1])) for r in rows)
    assert all(not (r["kept"] and r["base_failed"]) for r in got) and got[0]["measured"] == "own measured"
    assert quality(documents(spark, [])).count() == 0


def test_bands_reject_by_language_and_script(spark):
    noise = " ".join(f"க்{chr(0x10000 + i)}" for i in range(80))
    rows = [(1, prose(2, 200), "en", "a", 1), (2, prose(2, 200), "xx", "a", 1), (3, " ".join(["ab cd"] * 3 + ["ef gh ij"] * 90), "en", "a", 1)]
    rows += [(4, noise + " " + " ".join(prose(7, 30).split()), "en", "a", 1)]
    bands = {"xx": Band(5.0, 9.0, 0.1, 3.0)}
    got = {r["doc_id"]: r for r in quality(documents(spark, rows), lang="lang", lang_bands=bands).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and not got[2]["base_failed"] and not got[3]["kept"]
    assert got[4]["byte_share"] > 0.2 and not got[4]["kept"]


def test_clean_documents_stay(spark, sf_dir):
    """What passes the base rules of the given documents is prose, which the bands must leave alone."""
    got = quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("NOT base_failed").collect()
    assert got and all(r["kept"] for r in got)


def test_derived_bands_reject_planted_junk(spark):
    """Symbol-spattered text of a language goes, its prose stays; copies and a small language change nothing."""
    spattered = lambda i: " ".join(w + "***$$$&&&"[i % 3 * 3 :][:3] for w in prose(i, 200).split())
    rows = [(i, prose(i, 200), "en", "a", 1) for i in range(300)]
    rows += [(1000 + i, spattered(1000 + i), "en", "a", 1) for i in range(15)]
    rows += [(2000 + i, prose(7, 200), "en", "a", 1) for i in range(900)]
    rows += [(3000 + i, spattered(3000 + i), "xx", "a", 1) for i in range(5)] + [(4000, None, None, "a", 1), (4001, "too short", "en", "a", 1)]
    fixed = quality(documents(spark, rows)).cache()
    assert fixed.where("doc_id BETWEEN 1000 AND 1999 AND kept").count() == 15
    kept = {r["doc_id"] for r in judged(fixed, "lang").where("kept").collect()}
    assert len(kept & set(range(300))) >= 297 and kept >= set(range(2000, 2900)) | set(range(3000, 3005))
    assert not kept & {*range(1000, 1015), 4000, 4001}
    assert judged(fixed, "lang").schema == fixed.schema


def test_the_query_tells_labelled_junk(spark, sf_dir):
    # The next larger tables beside the chosen ones: the smallest have too few labels.
    folder = os.environ.get("TEST_LABELS_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"))
    got = QUERIES["op7_fertility_rules"](spark, folder).where("NOT base_failed")
    found = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n.get((0, False), 0) > n.get((0, True), 0) and 50 * n.get((1, False), 0) < n[1, True]


@pytest.mark.parametrize("text, script", [("", ""), ("123 !?", ""), ("abc где", "CYRILLIC"), ("abcd где", "LATIN"), ("где", "CYRILLIC"), ("日本語 a", "CJK"), ("ñ²", "LATIN")])
def test_scripts(text, script):
    assert main_script(text) == script


def test_words_beyond_the_memory_get_the_same_tokens(monkeypatch):
    found = [w.encode() for w in words(prose(6, 300))]
    want = Fertility(default_vocabulary()).tokens(found)
    monkeypatch.setattr("trackline.llm.quality.REMEMBERED_WORDS", 10)
    small = Fertility(default_vocabulary())
    assert [small.tokens(found).tolist() for _ in range(2)] == [want.tolist()] * 2
