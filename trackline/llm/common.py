"""Helpers the operators share: words, row keys, gapless ranks and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trackline.session import checkpointed

# Java and RE2 pattern of what separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; ``bytes.split`` parts at space and 0x09 to 0x0D only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def words(text: Column) -> Column:
    """The same words as a column of arrays; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def row_key(identity: Column, text: Column) -> Column:
    """A key of a row from its id and text. Only rows equal in both share one, null ids included."""
    return F.md5(
        F.concat(F.coalesce(identity.cast("string"), F.lit("~")), F.lit("\x1f"), F.coalesce(text, F.lit("\x1e")))
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added, computed once.

    A later filter on them would else be pushed below and repeat the expressions, in lambdas once per element.
    Catalyst pushes no filter on its output through a generator, and infers none for an outer one.
    """
    name = free_name(df, "fenced")
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    df = df.withColumn(name, F.explode_outer(F.array(row)))
    return df.withColumns({n: F.col(f"{name}.`{n}`") for n in columns}).drop(name)


def reshuffled(df: DataFrame, key: str) -> DataFrame:
    """``df`` for the unique side of a join on the long or string ``key``.

    A key that is computed anew hides the partitioning an aggregate left behind. Both join sides are then
    shuffled for the join itself, and only such joins let adaptive execution split the other side's hot keys.
    """
    text = dict(df.dtypes)[key] == "string"
    return df.withColumn(key, F.concat(key, F.lit("")) if text else F.col(key).bitwiseXOR(F.lit(0)))


def gapless_rank(df: DataFrame, group: str, order: list[Column], spread: Column, buckets: int, out: str) -> DataFrame:
    """``out``: each row's place in its group, from 0 without gaps.

    A group is ordered by (bucket of ``spread``, ``order``), so that no task sorts a whole group: rows are
    numbered inside a bucket, and the running total of the smaller buckets is added.
    """
    bucket, first = free_name(df, "bucket"), free_name(df, "bucket_first")
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(spread), F.lit(buckets)))
    counts = rows.groupBy(group, bucket).agg(F.count("*").alias(first))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    numbered = rows.withColumn(out, F.row_number().over(inside) - 1)
    return numbered.join(firsts, [group, bucket]).withColumn(out, F.col(out) + F.col(first)).drop(bucket, first)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component: its smallest node.

    Alternating large-star and small-star steps: each links the neighbours of a node to the smallest of them.
    A node's neighbours are never gathered in one place; a hot node's join is split by adaptive execution.
    The edge set is checkpointed after each round, and the rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    pairs = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(reshuffled(low, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(reshuffled(low, "u"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        pairs = checkpointed(small.where("u != v").distinct())
        # Both sums are exact, so equal ones mean an unchanged set but for a hash collision of 64 bits.
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    low = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        low.select("node", F.col("node").alias("component"))
    )
