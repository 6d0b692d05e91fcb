from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.cases import DOCS, awkward, documents, lowered, odd_columns, prose, words
from trackline.llm import simhash
from trackline.llm.common import connected_components
from trackline.llm.simhash import block_pairs, drop_near_duplicates, exact_scheme, near_duplicates, spanning_links


def brute_print(text, n=4):
    found = [lowered(w) for w in words(text)]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in nodes}


def test_awkward_rows_against_brute_force(spark):
    rows = awkward()
    got = near_duplicates(odd_columns(documents(spark, rows))).collect()
    prints = {i: brute_print(r[1]) for i, r in enumerate(rows)}
    ids = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    comp = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    members = defaultdict(list)
    for i, c in comp.items():
        members[c].append(i)
    want = sorted(
        (str(rows[i][0]), prints[i], str(min((rows[j] for j in members[c]), key=lambda r: (r[0] is None, r[0] or 0))[0]))
        for i, c in comp.items()
    )
    assert ids(0) == (False, 1)
    assert sorted((str(r["id"]), r["w0"] % (1 << 64), str(r["component"])) for r in got) == want


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert drop_near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [8, 4096])
def test_close_prints_by_the_bit_planes(spark, monkeypatch, chunk):
    """Every link of random and crowded fingerprints, in one group and dealt out as pairs of chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = np.random.default_rng(5)
    center = draw.integers(0, 1 << 63, 3, np.uint64)
    prints = set(draw.integers(0, 1 << 63, 200, np.uint64).tolist())
    for c in center.tolist():
        for _ in range(60):
            flips = draw.choice(64, draw.integers(0, 6), replace=False)
            prints.add(c ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, w0 long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, exact_scheme())).collect()}
    want = components(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: got.get(i, i) for i in want} == want


def test_kernel_masks_the_tail_and_itself():
    prints = np.array([[0], [1], [3], [0xFFFF]], np.uint64)
    a, b = spanning_links(np.arange(4), np.zeros(4, int), prints, 4)
    assert dict(zip(a.tolist(), b.tolist())) == {1: 0, 2: 0}
    left, right = block_pairs(np.repeat([0, 1, 2], [10, 150, 5]))
    assert {(0, 0), (0, 1), (0, 2), (1, 2), (2, 2)} <= set(zip(left.tolist(), right.tolist()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    got = connected_components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(60)}


def edited(text, every):
    found = text.split(" ")
    return " ".join("changed" if i % every == every // 2 else w for i, w in enumerate(found))


def test_stage_against_brute_force(spark):
    """Texts with 0 to 5 changed words: exactly those go that a chain of fingerprints within 4 bits ties to a smaller id."""
    rows = []
    for i in range(240):
        base, changed = prose(2000 + i, 900), i % 6
        rows += [(i, base, "en", "a", 1), (1000 + i, edited(base, 900 // changed) if changed else base.replace("a", "A"), "en", "a", 1)]
    rows += [(3000 + i, f"{prose(70, 200)} {prose(4000 + i, 40)}", "en", "a", 1) for i in range(40)]
    rows += [(4000, None, None, None, None), (4001, "", None, None, None), (4002, "", None, None, None), (4002, "", None, None, None)]
    prints = {r[0]: brute_print(r[1]) for r in rows}
    comp = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert 60 < sum(comp[1000 + i] == comp[i] for i in range(240)) < 235
    left = drop_near_duplicates(documents(spark, rows))
    assert left.schema == documents(spark, []).schema
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(comp.values()))


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a b c d e f g", "en", "a", 1)] * 3
    assert drop_near_duplicates(odd_columns(spark.createDataFrame(rows, DOCS))).count() == 1


def test_schemes():
    for parts in exact_scheme().keys:
        assert sum(width for _, _, width in parts) in (20, 21, 22)
    assert len(exact_scheme().keys) == 15 == len(set(exact_scheme().keys))
