import hashlib
import re
from collections import Counter

import pytest

from tests.llm.cases import awkward, documents, odd_columns, prose
from trackline.llm.secrets import BASE, MORE, candidates, find_secrets, holds, index
from trackline.llm.trigrams import clause, trigram_query

PLAIN = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
SECRETS = [
    "Password = hunter22", "passwd:short", 'api_key": "abcdefgh"', "APIKEY='x/y+z=='", "token=token:abcdef", "secret==abc",
    "AKIA" + "A1" * 8, "AKIAAKIA" + "B2" * 6, "akia" + "A1" * 8, "0123456789abcdef" * 2, "deadbeef" * 2, "DEADBEEF" * 4,
    "token = " + "0f" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc",
    "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "https://me:pass@host/x", "ſecret=abcdef", "pass word = abcdefg",
]


def rows():
    found = awkward() + [(500 + i, f"{prose(i, 20)} {s}{prose(i + 1, 9)} {s}", "en", "a", 1) for i, s in enumerate(SECRETS)]
    found += [(600, " ".join(SECRETS), "en", "a", 1), (601, "ß😀" + SECRETS[0] + "日" + SECRETS[9], None, None, None)]
    return found + [(700, (prose(5, 5000) + " " + SECRETS[12] + " ") * 4, "en", "a", 1), (601, SECRETS[6], "en", "a", 1)]


def base_spans(text):
    out = [(m.start(), n, kind, m.end()) for n, (kind, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_against_brute_force(spark):
    data = rows()
    got = find_secrets(odd_columns(documents(spark, data))).collect()
    want = Counter()
    for r in data:
        spans = base_spans(r[1])
        kinds = Counter(k for k, _, _ in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        extra = [(m.start(), len(BASE) + n, x.kind, m.end()) for n, x in enumerate(MORE) for m in re.finditer(x.pattern, r[1] or "")]
        order = {k: n for n, (k, _, _) in enumerate(PLAIN)}
        every = sorted([(a, order[k], k, b) for k, a, b in spans] + extra)
        want[r[0], kinds["assign"], kinds["access"], kinds["hex"], digest, ",".join(f"{k}:{a}:{b}" for a, _, k, b in every)] += 1
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert Counter(tuple(r[c] for c in columns) for r in got) == want
    assert {k.split(":")[0] for w in want for k in w[5].split(",")} == {"", *(r.kind for r in (*BASE, *MORE))}


@pytest.mark.parametrize("rule", [*BASE, *MORE], ids=lambda r: r.kind)
def test_queries_let_every_match_through(rule):
    query = trigram_query(rule.pattern)
    assert bool(query) == (rule.kind != "hex")
    for text in (r[1] or "" for r in rows()):
        if re.search(rule.pattern, text):
            assert all(any(all(t in text.lower() for t in grams) for grams in options) for options in query)


def test_queries_of_other_patterns():
    assert trigram_query("abcd?") == [[frozenset({"abc"})]]
    assert trigram_query("x*abcd") == [[frozenset({"abc", "bcd"})]]
    assert trigram_query("(ab|cd)ef") == [[frozenset({"abe", "bef"}), frozenset({"cde", "def"})]]
    assert trigram_query("(abc)+x?") == [[frozenset({"abc"})]]
    assert trigram_query("(abc)*") == trigram_query("ab|abcd") == trigram_query("a.c") == []
    assert clause({"abcd", "ab"}) == []


def test_index_holds_the_trigrams(spark):
    df = spark.createDataFrame([("k1", "Token here"), ("k2", "to ken"), ("k3", None)], "key string, text string")
    assert sorted(map(tuple, index(df, "text", ["tok", "ken"]).select("key", "trigram").collect())) == [("k1", "ken"), ("k1", "tok"), ("k2", "ken")]
    assert [tuple(r) for r in candidates(df, "text", BASE).collect()] == [("k1", ["assign"])]
    assert candidates(df, "text", BASE[2:]) is None and callable(holds)


def test_empty_table_and_rules_without_index(spark):
    assert find_secrets(documents(spark, [])).count() == 0
    assert find_secrets(documents(spark), base=BASE[2:], more=()).count() == len(awkward())
