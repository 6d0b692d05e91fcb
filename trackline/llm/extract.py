"""Main text of web pages through wrappers inferred per host."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import free_name, reshuffled
from trackline.llm.pages import parse
from trackline.llm.wrappers import Member, article, merged, template, wrapper
from trackline.session import checkpointed

HOSTS_HELD = 2_000  # templates a task holds before it hands them on
SLOTS = 64  # partial templates of a host meet in so many tasks first
BROADCAST_HOSTS = 20_000  # wrappers up to which they are broadcast; beyond, pages are joined by host


def host(url: Column) -> Column:
    """Lower-case host of an address; empty for null or anything else."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(rows: DataFrame) -> DataFrame:
    """(host, wrapper) out of (host, html): each task aligns its own pages first, then partial templates meet."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Member] = {}

        def rows_of() -> pd.DataFrame:
            texts = [json.dumps(m.data()) for m in held.values()]
            return pd.DataFrame({"host": list(held), "template": texts}, dtype=object)

        for frame in frames:
            for name, html in zip(frame["host"], frame["html"]):
                own = template(parse(html))
                held[name] = merged((held[name], own)) if name in held else own
                if len(held) >= HOSTS_HELD:
                    yield rows_of()
                    held = {}
        yield rows_of()

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by host and template: one host is held at a time, and the order of merging is fixed.
        name, held = None, None
        for frame in frames:
            for h, data in zip(frame["host"], frame["template"]):
                one = Member.of(json.loads(data))
                if h == name:
                    held = merged((held, one))
                else:
                    if held is not None:
                        yield pd.DataFrame({"host": [name], "template": [json.dumps(held.data())]})
                    name, held = h, one
        if held is not None:
            yield pd.DataFrame({"host": [name], "template": [json.dumps(held.data())]})

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [wrapper(Member.of(json.loads(t))) for t in frame["template"]]
            yield pd.DataFrame({"host": frame["host"].tolist(), "wrapper": made})

    schema = "host string, template string"
    parts = rows.mapInPandas(partial, schema).withColumn("slot", F.pmod(F.xxhash64("template"), F.lit(SLOTS)))
    some = parts.repartition("host", "slot").sortWithinPartitions("host", "template").select("host", "template")
    whole = some.mapInPandas(meet, schema).repartition("host").sortWithinPartitions("host", "template")
    return whole.mapInPandas(meet, schema).mapInPandas(decide, "host string, wrapper string")


def extract(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``df`` with text and n_chars; columns of these names are replaced.

    The text is that of the article alone, blocks joined by line feeds; empty if there is none or the html is null or
    empty. A page without a host shares its wrapper with the others of that kind; a page that lacks the place its
    host's wrapper names is read by a wrapper of its own. Whole pages are read, and every row is kept, repeated
    ones too; an empty table gives no rows.
    """
    name, rules, got = (free_name(df, n) for n in ("page_host", "page_wrapper", "page_text"))
    wrappers = checkpointed(infer(df.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))))
    wrappers = wrappers.select(F.col("host").alias(name), F.col("wrapper").alias(rules))
    rows = df.withColumn(name, host(F.col(url)))
    if wrappers.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(wrappers), name, "left")
    else:
        rows = rows.join(reshuffled(wrappers, name), name, "left")

    @F.pandas_udf("string")
    def text_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, list] = {}
        for pages, made in parts:
            out = []
            for page, data in zip(pages, made):
                if data not in known:
                    if len(known) >= HOSTS_HELD:
                        known.clear()
                    known[data] = json.loads(data)
                parsed = parse(page)
                found = article(parsed, known[data])
                out.append(article(parsed, None) if found is None else found)
            yield pd.Series(out, dtype=object)

    rows = rows.withColumn(got, text_of(F.col(html), F.col(rules))).drop(name, rules)
    text = F.coalesce(F.col(got), F.lit(""))
    return rows.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).drop(got)
