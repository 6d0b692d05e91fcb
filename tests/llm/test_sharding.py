import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, odd_columns
from trackline.llm.sharding import MULTIPLIER, jump_shard, shard, write_shards


def jump(key, shards):
    key, at, ahead = key % (1 << 64), -1, 0
    while ahead < shards:
        at = ahead
        key = (key * MULTIPLIER + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_of_the_paper(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    for shards in (1, 2, 24, 25, 1000):
        for r in keys.select("k", jump_shard(F.col("k"), shards).alias("s")).collect():
            assert r["s"] == jump(r["k"], shards)


def test_awkward_rows(spark):
    rows = awkward()
    found = shard(odd_columns(documents(spark, rows)), shards=3).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        text = r["text"] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["grown_shard"] in (r["shard"], 3) and r["law"] == "key" and r["key"] == "own key"
        slots[r["shard"]].append(r["slot"])
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    assert len({r["shard"] for r in found if r["doc_id"] == 8}) == 1


def test_one_more_shard_takes_its_part(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = shard(docs).groupBy("shard", "grown_shard").count().collect()
    assert all(r["grown_shard"] in (r["shard"], 24) for r in found)
    assert abs(sum(r["count"] for r in found if r["grown_shard"] == 24) - 20_000 / 25) < 150


def test_empty_and_written(spark, folder):
    assert shard(documents(spark, [])).count() == 0
    write_shards(documents(spark), f"{folder}/shards", shards=3)
    back = spark.read.parquet(f"{folder}/shards")
    assert back.count() == len(awkward())
    want = {(r["doc_id"], r["shard"]) for r in shard(documents(spark), shards=3).select("doc_id", "shard").collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()} == want
