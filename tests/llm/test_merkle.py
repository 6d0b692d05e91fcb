import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, awkward, documents, odd_columns
from trackline.llm import merkle
from trackline.llm.merkle import address, addresses, audited, block_nodes, fold, nodes_of, packed, sibling_runs, splits, unpacked

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def record(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = record((doc_id, source, lang, n_chars, text))
        seen = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            seen = text.replace("\n", "")
        groups[source].append((doc_id is not None, doc_id or 0, leaf, record((doc_id, source, lang, n_chars, seen))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: levels_of([r[2] for r in sorted(groups[g])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for i, (has_id, doc_id, leaf, claim) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], i) + siblings(top, place)
            proof, reached = "", claim
            for before, behind in path:
                proof += "".join(before + behind)
                reached = h(*before, reached, *behind)
            root = top[-1][0]
            out.append((doc_id if has_id else None, leaf, trees[g][-1][0], root, h(proof), reached, reached == root))
    return sorted(map(str, out))


def tampered():
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def got(spark, df, folder, **kw):
    return sorted(str(tuple(r)) for r in audited(spark, df, folder, COLUMNS, claimed=tampered(), **kw).collect())


def test_awkward_rows(spark, folder):
    rows = awkward()
    assert got(spark, odd_columns(documents(spark, rows)), folder) == brute(rows)


def test_empty_table(spark, folder):
    assert got(spark, documents(spark, []), folder) == []


@pytest.mark.parametrize("small", [[1], [2, 3, 4], [9, 10, 27, 28]])
def test_groups_of_all_sizes(spark, folder, small):
    """A group over several levels of blocks, one hot id of many equal rows in it, and small ones beside it."""
    rows = [(i, f"text\n{i}", "en", "hot", i) for i in range(2000)] + [(55, "copy\nof it", "en", "hot", 1)] * 1500
    rows += [(i, f"x\n{i}", None, f"s{n}", None) for n in small for i in range(n)] + [(None, "none\n", None, None, 3)]
    assert got(spark, documents(spark, rows).repartition(7), folder) == brute(rows)


def test_many_groups_make_a_deep_top_tree(spark, folder):
    rows = [(i, f"t\n{i}", "en", f"host{i}é", i) for i in range(400)]
    assert got(spark, documents(spark, rows).repartition(5), folder) == brute(rows)


def test_text_ids_and_no_claims(spark, folder):
    df = spark.createDataFrame([("b", "x", "s"), ("a", "y", "s"), (None, "z", None)], "doc_id string, text string, source string")
    found = audited(spark, df, folder, ["doc_id", "text"]).collect()
    assert all(r["verified"] for r in found) and {r["id"] for r in found} == {"a", "b", None}


@pytest.mark.parametrize("height", range(7))
def test_layout_is_recursive(height):
    """Every node has a place of its own, and each part of each split lies in one stretch."""
    places = [p for level in addresses(height) for p in level]
    assert sorted(places) == list(range(nodes_of(height + 1)))

    def part(depth, index, levels):
        own = [address(height, depth + d, np.arange(index * 3**d, (index + 1) * 3**d)) for d in range(levels)]
        flat = np.sort(np.concatenate(own))
        assert flat[0] == own[0][0] and (np.diff(flat) == 1).all()
        if levels > 1:
            upper = levels // 2
            part(depth, index, upper)
            for i in range(index * 3**upper, (index + 1) * 3**upper):
                part(depth + upper, i, levels - upper)

    part(0, 0, height + 1)
    assert len(splits(height)) == height + 1


def test_block_proofs_fold_to_its_root():
    for n in (1, 2, 3, 4, 8, 9, 10, 80, 243):
        leaves = [h(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        height = merkle.least_height(n)
        nodes = block_nodes(leaves, height).hex()
        assert nodes[:64] == levels[-1][0]
        for i in (0, n // 2, n - 1):
            runs = sibling_runs(nodes, n, height, i)
            assert [b[:p] for p, b in runs] == [b for b, _ in siblings(levels, i)]
            assert fold(leaves[i], unpacked(packed(runs))) == levels[-1][0]


def test_schema(spark, folder):
    found = audited(spark, spark.createDataFrame(awkward(), DOCS), folder, COLUMNS)
    assert found.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
