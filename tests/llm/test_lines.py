import hashlib
import random
from collections import Counter

import pytest

from tests.llm.cases import awkward, documents, odd_columns, prose
from trackline.llm.lines import LINE_PRIME, LONG_LINE, ROLL_PRIME, WEIGHT, drop_repeated_lines


def chunks(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % LINE_PRIME for x in lines]
    r = [((h[i - 1] * WEIGHT if i else 0) + h[i]) % ROLL_PRIME for i in range(len(h))]
    long = [len(x) >= LONG_LINE for x in lines] + [False]
    out, start, last = [], 0, len(lines) - 1
    for i in range(len(lines)):
        low = 0 < i < last - 1 and r[i] < r[i - 1] and r[i] <= r[i + 1] and not long[i - 1] and not long[i + 2]
        if i == last or long[i] or long[i + 1] or low:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def compared(found, k):
    """What of chunk ``k`` has to occur again: its bytes, for a short line alone with those of the line beside it."""
    chunk = found[k]
    if len(chunk) == 1 and len(chunk[0]) < LONG_LINE:
        if len(found) == 1:
            return None
        chunk = [found[k - 1][-1], *chunk] if k else [*chunk, found[1][0]]
    return "\n".join(chunk)


def brute(rows):
    order = sorted(
        {(r[0] is not None, r[0] or 0, hashlib.md5(((str(r[0]) if r[0] is not None else "~") + "\x1f" + ("\x1e" if r[1] is None else r[1])).encode()).hexdigest(), r[0], r[1]) for r in rows},
        key=lambda x: x[:3],
    )
    seen, result = set(), {}
    for *_, key, identity, text in order:
        kept, removed, lines = [], 0, 0
        found = chunks(text)
        for k, chunk in enumerate(found):
            body = compared(found, k)
            if body in seen:
                removed, lines = removed + 1, lines + len(chunk)
            else:
                kept += chunk
                if body is not None:
                    seen.add(body)
        left = text if text is None or not removed else "\n".join(kept)
        result[identity, text] = (left, 0 if text is None else sum(map(len, found)), lines, removed)
    return Counter((r[0], *result[r[0], r[1]]) for r in rows)


def got(df):
    found = drop_repeated_lines(df)
    return Counter(map(tuple, found.select("doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks").collect()))


def test_awkward_rows_against_brute_force(spark):
    rows = awkward()
    assert got(odd_columns(documents(spark, rows))) == brute(rows)


def test_a_passage_of_many_lines_goes_wherever_it_stands(spark):
    passage = prose(9, 400)
    rows = [(i, prose(20 + i, 60) + "\n" + passage + "\n" + prose(40 + i, 60), "en", "a", 1) for i in range(8)]
    found = {r["doc_id"]: r for r in drop_repeated_lines(documents(spark, rows)).collect()}
    assert found[0]["n_removed_lines"] == 0
    for i in range(1, 8):
        assert found[i]["n_removed_lines"] >= 0.6 * passage.count("\n")
        assert prose(20 + i, 60).split("\n")[0] in found[i]["text"]


@pytest.mark.parametrize("n", range(1, 7))
def test_a_passage_of_few_lines_goes_from_other_texts(spark, n):
    """Passages of over 50 words in one to six lines, between lines of their texts' own."""
    words = prose(70 + n, 54).replace(".\n", " ").split()
    size = -(-len(words) // n)
    lines = [" ".join(words[k : k + size]) + "." * (k // size) for k in range(0, len(words), size)]
    own = lambda i: prose(100 * n + i, 70)
    rows = [(i, own(i) + "\n" + "\n".join(lines) + "\n" + own(50 + i), "en", "a", 1) for i in range(12)]
    found = {r["doc_id"]: r for r in drop_repeated_lines(documents(spark, rows)).collect()}
    assert found[0]["text"] == rows[0][1]
    gone = [sum(x not in found[i]["text"] for x in lines) for i in range(1, 12)]
    if min(map(len, lines)) >= LONG_LINE:
        assert gone == [len(lines)] * 11
    for i in range(1, 12):
        left = found[i]["text"].split("\n")
        assert [x for x in left if x not in lines] == [x for x in rows[i][1].split("\n") if x not in lines]


def test_mixed_lines_against_brute_force(spark):
    """Short and long lines in any order, many of them shared between texts."""
    draw = random.Random(5)
    pool = ["x" * draw.choice((0, 3, LONG_LINE - 1, LONG_LINE, 200)) + str(k) for k in range(12)] + ["é" * LONG_LINE, "", ""]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 14))), "en", "a", 1) for i in range(300)]
    assert got(documents(spark, rows)) == brute(rows)


def test_chunks_of_short_lines_have_two_unless_long_ones_enclose_them(spark):
    short = lambda c: len(c) == 1 and len(c[0]) < LONG_LINE
    found = chunks(prose(3, 5000))
    assert any(map(short, found)) and any(len(c) > 1 for c in found)
    for k, chunk in enumerate(found):
        if short(chunk):
            assert all(len(c[0]) >= LONG_LINE for c in (found[k - 1 : k] if k else []) + found[k + 1 : k + 2])


def test_copies_leave_nothing_behind(spark):
    rows = [(i, prose(3, 400), "en", "a", 1) for i in range(3)]
    assert sorted(r["text"] for r in drop_repeated_lines(documents(spark, rows)).collect()) == ["", "", rows[0][1]]
    assert drop_repeated_lines(documents(spark, [])).count() == 0
