"""Passages against documents, with nothing kept from being compared."""

from textspan.operators import match
from textspan.plans import registry


def test_noise_before_a_passage_hides_no_document(spark):
    words = [f"word{i % 37}x{i}" for i in range(200)]
    noise = [f"noise{i}" for i in range(10)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:60])), (3, " ".join(noise))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(noise + words[10:55]))], "item_id long, text string")
    assert {(r["item_id"], r["doc_id"]) for r in match.passages(docs, items).collect()} == {(7, 1), (7, 2)}


def test_a_later_chunk_places_an_item(spark):
    words = [f"word{i % 37}x{i}" for i in range(200)]
    noise = [f"noise{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(noise + words[20:80])), (8, " ".join(noise + words[20:27]))], "item_id long, text string")
    assert [(r["item_id"], r["doc_id"], r["start"], r["end"]) for r in match.passages(docs, items).collect()] == [(7, 1, 20, 80)]


def test_an_item_without_a_place_is_an_error_row(spark, tmp_path):
    words = [f"word{i % 37}x{i}" for i in range(200)]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(words[20:80])), (8, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: r for r in registry.QUERIES["align_token"](spark, str(tmp_path)).collect()}
    assert got[7]["status"] == "ok" and got[8]["status"] == "error" and got[8]["doc_id"] is None
