from collections import Counter

from tests.llm.cases import awkward, documents, odd_columns, prose, words
from trackline.llm import decontaminate
from trackline.llm.decontaminate import contaminated, drop_contaminated

ITEMS = "item_id long, text string"


def shingles(text, n=5):
    found = words((text or "").lower())
    return {" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def brute(rows, items, threshold=0.8):
    out = Counter()
    tests = {(i, t): shingles(t) for i, t in items}
    for row in rows:
        held = shingles(row[1])
        for (item, _), want in tests.items():
            if want and round(len(want & held) / len(want), 9) >= threshold:
                out[row[0], item, len(want & held), len(want)] += 1
    return out


def tables(seed=0):
    items = [(i, prose(900 + i, 12 + 9 * i)) for i in range(12)]
    items += [(50, None), (51, ""), (52, "two words"), (52, "two words"), (None, "one"), (53, items[3][1])]
    rows = awkward()
    for i, (_, text) in enumerate(items[:12]):
        rows.append((100 + i, prose(i, 300) + " " + text.upper() + " " + prose(i + 1, 2000), "en", "a", 1))
        found = text.split(" ")
        rows.append((200 + i, " ".join([*found[: len(found) * 17 // 20], *prose(i + 5, 40).split(" ")]), "en", "a", 1))
        rows.append((300 + i, " ".join(found[: len(found) // 2]), "en", "a", 1))
    return rows, items


def test_against_brute_force(spark, monkeypatch):
    rows, items = tables()
    df, tests = odd_columns(documents(spark, rows)), odd_columns(spark.createDataFrame(items, ITEMS))
    want = brute(rows, items)
    got = contaminated(df, tests).select("id", "item", "n_shared", "n_shingles")
    assert Counter(map(tuple, got.collect())) == want and len(want) > 20
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    got = contaminated(df, tests).select("id", "item", "n_shared", "n_shingles")
    assert Counter(map(tuple, got.collect())) == want


def test_clean_rows_stay(spark):
    rows, items = tables()
    bad = {(r[0], r[1]) for r in rows if any(s and len(s & shingles(r[1])) >= 0.8 * len(s) - 1e-9 for s in (shingles(t) for _, t in items))}
    left = drop_contaminated(documents(spark, rows), spark.createDataFrame(items, ITEMS))
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in rows if (r[0], r[1]) not in bad)


def test_empty_tables(spark):
    rows, items = tables()
    assert contaminated(documents(spark, []), spark.createDataFrame(items, ITEMS)).count() == 0
    assert drop_contaminated(documents(spark, rows), spark.createDataFrame([], ITEMS)).count() == len(rows)
