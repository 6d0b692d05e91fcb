from collections import Counter

import corpus_pipeline
from tests.llm.cases import documents, prose


def stage(spark, name, docs, folder, sf_dir):
    function = dict(corpus_pipeline.STAGES)[name]
    function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def test_stages_take_effect_one_by_one(spark, folder, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    passage = prose(77, 300)
    rows = [(i, prose(i, 200), "en", "a", 1) for i in range(20)]
    rows += [(100 + i, prose(i, 200), "en", "a", 1) for i in range(5)]  # exact copies
    rows += [(200 + i, prose(i, 200).replace("\n", " ").replace("a", "A"), "en", "a", 1) for i in range(5, 10)]
    rows += [(300 + i, f"{prose(600 + i, 100)} {items[i]} {prose(700 + i, 100)}", "en", "a", 1) for i in range(5)]
    rows += [(400 + i, prose(800 + i, 150) + "\n" + passage, "en", "a", 1) for i in range(4)]
    rows += [(500, "too short", "en", "a", 1), (501, None, "en", "a", 1), (502, "again and again " * 60, "en", "a", 1)]
    docs = documents(spark, rows)
    after = {}
    for name, _ in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, name, docs, folder, sf_dir)
        after[name] = docs
        if name != "packing":
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in before.schema]
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in after.items()}
    every = {r[0] for r in rows}
    assert ids["quality_rules"] == every - {500, 501, 502}
    assert ids["line_dedup"] == ids["quality_rules"] - {100, 101, 102, 103, 104}
    cut = {r["doc_id"]: r for r in after["line_dedup"].collect()}
    assert all(len(cut[400 + i]["text"]) == cut[400 + i]["n_chars"] < len(rows[-4][1] or "x" * 3000) for i in (1, 2, 3))
    assert all(cut[i]["text"] == rows[i][1] and cut[i]["n_chars"] == 1 for i in range(20))
    assert ids["near_dedup"] == ids["line_dedup"] - {205, 206, 207, 208, 209}
    assert ids["decontamination"] == ids["near_dedup"] - {300, 301, 302, 303, 304}
    assert ids["packing"] == ids["decontamination"]


def test_run_gives_the_stages_result(spark, folder, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        docs = stage(spark, name, docs, folder, sf_dir)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    want = Counter(map(tuple, docs.select(*columns).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*columns).collect())) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
