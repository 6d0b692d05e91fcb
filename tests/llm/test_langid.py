import zlib

from pyspark.sql import functions as F

from tests.llm.cases import awkward, documents, odd_columns
from trackline.llm.langid import UNKNOWN, fold, identify, score, train
from trackline.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_naive_bayes"](spark, sf_dir).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_awkward_rows(spark):
    df = odd_columns(documents(spark))
    model = train(df, "text", "lang")
    assert model.languages == sorted({r[2] for r in awkward() if r[2] and r[1] is not None})
    found = identify(df, model).collect()
    assert len(found) == len(awkward())
    for r in found:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == UNKNOWN and r["score"] == 0) if not letters else r["lang_pred"] in model.languages
    assert found[0]["predicted"] == "own predicted"
    long = next(r for r in found if r["doc_id"] == 7)
    assert long["lang_pred"] == "en"


def test_a_text_scores_alike_in_any_company(spark):
    model = train(documents(spark), "text", "lang")
    texts = [r[1] for r in awkward()]
    together = score(texts, model)
    for text, best, sure in zip(texts, *together):
        alone = score([text], model)
        assert alone[0][0] == best and abs(alone[1][0] - sure) < 1e-6


def test_nothing_to_learn(spark):
    model = train(documents(spark, []), "text", "lang")
    assert {r["lang_pred"] for r in identify(documents(spark), model).collect()} == {UNKNOWN}
    assert identify(documents(spark, []), model).count() == 0


def test_folds_of_ids(spark):
    ids = spark.createDataFrame([(1,), (25,), (None,)], "i long")
    got = [r["f"] for r in ids.select(fold(F.col("i"), 4).alias("f")).collect()]
    assert got == [zlib.crc32(b"1") % 4, zlib.crc32(b"25") % 4, zlib.crc32(b"") % 4]
