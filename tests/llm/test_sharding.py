"""Quantising of text dimensions."""

from textspan.llm import sharding


def test_sources_with_a_long_common_prefix_take_steps_of_their_own(spark):
    rows = [(1, "same text", "en", f"https://example.org/source/{i % 8}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sharding.shard(docs).select("curve").distinct().count() == 8
    odd = spark.createDataFrame([(1, "t", None, None), (1, "t", None, ""), (2, "t", "en", "s")], docs.schema)
    assert sorted(r["place"] for r in sharding.shard(odd).collect()) == [0, 1, 2]
