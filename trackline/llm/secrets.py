"""Secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. Postings say which rows hold which of the trigrams
that some query mentions; intersecting and uniting them leaves candidates, which the expression itself verifies.
A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import fenced, free_name, reshuffled, row_key
from trackline.llm.trigrams import Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """A pattern that Java, RE2 and Python read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
# Runs are matched with their least length at once: a shorter run holds no longer one.
BASE = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]+://[^/@:\x00-\x20]+:[^/@:\x00-\x20]+@"),
)


def index(df: DataFrame, text: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key): which rows of ``df`` (key, text) hold which trigrams, case aside."""
    low = fenced(df.select("key", text), {"low": F.lower(text)})
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode_outer(held).alias("trigram")).where("trigram IS NOT NULL")


def holds(query: Query, present: Column) -> Column:
    every = lambda grams: reduce(Column.__and__, [F.array_contains(present, t) for t in sorted(grams)])
    clauses = [reduce(Column.__or__, map(every, options)) for options in query]
    return reduce(Column.__and__, clauses)


def candidates(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, kinds): the indexed rules that may match the rows of a key; None without an indexed rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not queries:
        return None
    trigrams = sorted({t for q in queries.values() for options in q for grams in options for t in grams})
    present = index(df, text, trigrams).groupBy("key").agg(F.collect_set("trigram").alias("present"))
    kinds = F.array_compact(F.array(*[F.when(holds(q, F.col("present")), F.lit(k)) for k, q in queries.items()]))
    return fenced(present, {"kinds": kinds}).where(F.size("kinds") > 0).select("key", "kinds")


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, number, end) of the leftmost matches that do not overlap, in code points.

    The text between the matches and the matches themselves give the places.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    pieces = F.zip_with(found, group, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("least")))
    pieces = F.zip_with(
        F.slice(F.transform(between, lambda b: F.length(b)), 1, F.size(found)),
        pieces,
        lambda gap, m: F.struct(gap.alias("gap"), m.size.alias("size"), m.least.alias("least")),
    )
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    spans = F.aggregate(
        pieces,
        start,
        lambda acc, p: F.struct(
            (acc.at + p.gap + p.size).alias("at"),
            F.when(
                p.least >= rule.least,
                F.concat(
                    acc.out,
                    F.array(
                        F.struct(
                            (acc.at + p.gap).alias("start"),
                            F.lit(number).alias("number"),
                            (acc.at + p.gap + p.size).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc.out)
            .alias("out"),
        ),
        lambda acc: acc.out,
    )
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def find_secrets(
    df: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    base: tuple[Rule, ...] = BASE,
    more: tuple[Rule, ...] = MORE,
) -> DataFrame:
    """``df`` with n_<kind> per base rule, base_sha256 and spans; columns of these names are replaced.

    ``spans`` lists kind:start:end by start, then in the order of the rules, comma-joined; start and end count
    code points, the end is exclusive. ``base_sha256`` hashes the same list of the base rules alone. A null text is
    empty and has no span. Every row is scanned as a whole and kept, rows equal in id and text alike; rules do not
    hide each other's spans, however they overlap. An empty table gives no rows.
    """
    rules = (*base, *more)
    key, kinds, got = (free_name(df, n) for n in ("row_key", "row_kinds", "row_spans"))
    own = df.select(row_key(F.col(identity), F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = df.withColumn(key, row_key(F.col(identity), F.col(text)))
    maybe = candidates(own, "text", rules)
    if maybe is None:
        rows = rows.withColumn(kinds, F.array().cast("array<string>"))
    else:
        maybe = maybe.select(F.col("key").alias(key), F.col("kinds").alias(kinds))
        rows = rows.join(reshuffled(maybe, key), key, "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")
    lists = []
    for number, rule in enumerate(rules):
        spans = rule_spans(whole, rule, number)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(empty)
        lists.append(spans)
    rows = fenced(rows, {got: F.array_sort(F.concat(*lists))})
    names = F.array(*[F.lit(r.kind) for r in rules])
    label = lambda s: F.concat_ws(":", F.get(names, s.number), s.start, s.end)
    basic = F.filter(got, lambda s: s.number < len(base))
    of = lambda n: F.size(F.filter(got, lambda s: s.number == n)).cast("long")
    counts = {f"n_{rule.kind}": of(n) for n, rule in enumerate(base)}
    return rows.withColumns(
        {
            **counts,
            "base_sha256": F.sha2(F.array_join(F.transform(basic, label), ",").cast("binary"), 256),
            "spans": F.array_join(F.transform(got, label), ","),
        }
    ).drop(key, kinds, got)


def sql() -> str:
    """The operator's rows over ``documents`` as DuckDB SQL."""

    def spans(number: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
  SELECT row, {number} AS number, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    'at': (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT,
    'size': length(m[i]), 'least': length(g[i])}}), lambda s: s.least >= {rule.least})) AS s
  FROM (SELECT row, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,
    string_split_regex(text, '{pattern}') AS p FROM docs)"""

    rules = (*BASE, *MORE)
    union = " UNION ALL ".join(spans(n, r) for n, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    listed = "string_agg(kind || ':' || s.at || ':' || (s.at + s.size), ',' ORDER BY s.at, number)"
    coalesced = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), spans AS ({union}
), found AS (
  SELECT row, {counts}, coalesce({listed} FILTER (number < {len(BASE)}), '') AS base, {listed} AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, {coalesced}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (row)
"""
