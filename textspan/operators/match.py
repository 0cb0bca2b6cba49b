"""Matching of pasted passages against pages, a row for each request.

A request is a row; the page's surface and the passage stand beside it. Each matcher is one Arrow
function over rows, so requests are spread like any rows and a page is never gathered with others.
"""

from __future__ import annotations

import dataclasses

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspan.functions import align, text
from textspan.operators import segment
from textspan.sources.stored import stored

OUTCOME = "status string, error string, text string, start int, end int, start_score double, end_score double, confidence string, report array<string>"
#: What each matcher reads: the clean text or the page itself.
MATCHERS = {"fuzzy": align.fuzzy, "token": align.token, "dmp": align.diff, "hybrid": align.hybrid, "token_raw_html": align.raw_token, "dmp_raw_html": align.raw_diff}
RAW = ("token_raw_html", "dmp_raw_html")


def _rows(found: list[align.Outcome]) -> pd.DataFrame:
    out = pd.DataFrame([dataclasses.asdict(o) for o in found], columns=[f.name for f in dataclasses.fields(align.Outcome)])
    return out.astype({"start": "Int32", "end": "Int32", "start_score": "float64", "end_score": "float64"})


def matched(method: str, surface: Column, copied: Column, **settings) -> Column:
    """The outcome (OUTCOME) of a matcher; a null surface or passage is an error outcome."""
    matcher = MATCHERS[method]

    @F.pandas_udf(OUTCOME)
    def run(pages: pd.Series, passages: pd.Series) -> pd.DataFrame:
        null = align.Outcome("error", "failed: nothing to match")
        return _rows([null if p is None or c is None else matcher(p, c, **settings) for p, c in zip(pages, passages, strict=True)])

    return run(surface, copied)


def hybrid(clean: Column, copied: Column, references: str, entries: Column, captions: Column, **settings) -> Column:
    """The hybrid matcher with a page's reference entries (arrays of texts) and captions."""

    @F.pandas_udf(OUTCOME)
    def run(pages: pd.Series, passages: pd.Series, items: pd.Series, known: pd.Series) -> pd.DataFrame:
        null = align.Outcome("error", "failed: nothing to match")
        found = []
        for p, c, e, k in zip(pages, passages, items, known, strict=True):
            numbered = {str(i): x for i, x in enumerate([] if e is None else list(e), 1)}
            found.append(null if p is None or c is None else align.hybrid(p, c, references=references, entries=numbered, captions=[] if k is None else list(k), **settings))
        return _rows(found)

    return run(clean, copied, entries, captions)


# -- candidate windows, native -------------------------------------------------------------------

WINDOW, RARE, PLACES, CANDIDATES = 60, 28, 3, 240


def reaching(items: DataFrame, postings: DataFrame, least: float = 0.72) -> DataFrame:
    """(item_id, doc_id): all documents that an item can have the least score with. A document without
    any of some words has an overlap of at most the other words' share of the item's weight (of words
    that occur once), so an item's rarest words are taken until that is below what the score needs."""
    spread = postings.groupBy("value").agg(F.count("*").alias("df"))
    own = items.groupBy("item_id", "value").agg(F.count("*").alias("a")).join(spread, "value", "left")
    own = own.withColumn("w", F.col("a") * text.weight(F.col("value"), F.lit(1)))
    item = Window.partitionBy("item_id")
    w = item.orderBy(F.coalesce("df", F.lit(0)), "value").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("before", F.sum("w").over(w) - F.col("w")).withColumn("whole", F.sum("w").over(item))
    telling = own.where(F.col("before") <= (1 - (least - 0.35) / 0.65 + 1e-6) * F.col("whole")).select("item_id", "value")
    return postings.join(F.broadcast(telling), "value").select("item_id", "doc_id").distinct()


def meeting(items: DataFrame, counts: DataFrame, least: float = 0.72) -> DataFrame:
    """(item_id, doc_id, enough): the pairs of ``reaching`` whose document holds enough of the item at all. A window has
    no more of a word than its document, so the overlap with the whole document bounds that of all its
    windows. counts: (doc_id, value, n). Items are few beside documents: their words go to every executor,
    and a document's rows stay together from the join by doc_id on."""
    need = items.groupBy("item_id", "value").agg(F.count("*").alias("a")).withColumn("w", text.weight(F.col("value"), F.lit(1)))
    # words that the document does not have weigh as if they were there once
    whole = need.groupBy("item_id").agg(F.sum(F.col("a") * F.col("w")).alias("whole"))
    met = reaching(items, counts, least).join(counts, "doc_id").join(F.broadcast(need), ["item_id", "value"])
    own = F.col("w") / F.sqrt(F.col("n").cast("double"))
    got = met.groupBy("doc_id", "item_id").agg(F.sum(F.least("a", "n") * own).alias("shared"), F.sum(F.col("a") * (F.col("w") - own)).alias("lighter"))
    enough = ((least - 0.35) / 0.65 - 1e-6) * (F.col("whole") - F.col("lighter"))
    return got.join(F.broadcast(whole), "item_id").withColumn("enough", enough).where("shared >= enough").select("item_id", "doc_id", "enough")


def gathered(items: DataFrame, postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item_id, doc_id): the pairs of ``meeting`` with enough weight within the item's length somewhere. All that
    a window shares lies between its first shared word and an item's length behind that."""
    need = items.groupBy("item_id", "value").agg(F.count("*").alias("a")).select("item_id", "value", text.weight(F.col("value"), F.lit(1)).alias("w"))
    need = need.join(items.groupBy("item_id").agg(F.count("*").alias("long")), "item_id")
    met = pairs.join(postings, "doc_id").join(F.broadcast(need), ["item_id", "value"])
    at = met.select("item_id", "doc_id", "enough", (F.col("w") / F.sqrt(F.col("n").cast("double"))).alias("w"), "long", F.explode("positions").alias("p"))
    ahead = Window.partitionBy("item_id", "doc_id").orderBy(F.col("p") / F.col("long")).rangeBetween(0, 1)
    return at.withColumn("held", F.sum("w").over(ahead)).where("held >= enough").select("item_id", "doc_id").distinct()


def candidates(items: DataFrame, postings: DataFrame, sizes: DataFrame, pairs: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(item_id, doc_id, start, votes, order): windows that the rare words of an item vote for, at
    most ``most`` of a pair; ties go to the start voted for first. sizes: (doc_id, size) in tokens."""
    own = items.groupBy("item_id", "value").agg(F.slice(F.sort_array(F.collect_list("apos")), 1, PLACES).alias("places"))
    met = pairs.join(own, "item_id").join(postings, ["doc_id", "value"]).join(sizes, "doc_id")
    light = F.col("value").isin(sorted(text.fixed.STOP_WORDS)) | (F.length("value") <= 2)
    met = met.withColumn("telling", ~light & (F.col("n") <= F.greatest(F.lit(20), F.floor(F.col("size") / 35))))
    pair = Window.partitionBy("item_id", "doc_id")
    met = met.withColumn("any", F.max("telling").over(pair)).where("telling or not any")
    ranked = met.withColumn("r", F.row_number().over(pair.orderBy("n", F.desc(F.length("value")), "value"))).where(F.col("r") <= RARE)
    votes = ranked.select("item_id", "doc_id", "size", "r", F.explode("positions").alias("p"), "places").select("item_id", "doc_id", "size", "r", "p", F.posexplode("places").alias("k", "q"))
    votes = votes.withColumn("start", F.col("p") - F.col("q")).where("start >= 0 and start < size")
    counted = votes.groupBy("item_id", "doc_id", "start").agg(F.count("*").alias("votes"), F.min(F.struct("r", "p", "k")).alias("first"))
    order = F.row_number().over(pair.orderBy(F.desc("votes"), "first"))
    return counted.withColumn("order", order).where(F.col("order") <= most).select("item_id", "doc_id", "start", "votes", "order")


def _cut(body: Column) -> Column:
    """The ASCII words of a text outside citations as an array, in their own case."""
    return F.regexp_extract_all(segment._masked(body), F.lit("[A-Za-z0-9]+"), F.lit(0))


def _values(body: Column) -> Column:
    """The tokens of a text as an array."""
    return F.transform(_cut(body), lambda v: F.lower(v))


def scored(found: DataFrame, items: DataFrame, postings: DataFrame, docs: DataFrame, least: float = 0.72) -> DataFrame:
    """(item_id, doc_id, start, end, overlap, ordered, score) of windows with the least score. docs:
    (doc_id, text), of which those of such windows are tokenised. A word's places in a document tell how often it is in a window, so only
    windows whose overlap can still reach the least score are cut out and read in order."""
    anchor = items.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("apos", "value"))), lambda x: x["value"]).alias("anchor"))
    need = items.groupBy("item_id", "value").agg(F.count("*").alias("a"))
    pairs = found.select("item_id", "doc_id").distinct()
    words = pairs.join(need, "item_id").join(postings, ["doc_id", "value"], "left").withColumn("w", text.weight(F.col("value"), F.coalesce("n", F.lit(0))))
    part = F.when(F.col("n").isNotNull(), F.struct("value", "a", "w", "positions"))
    parts = words.groupBy("item_id", "doc_id").agg(F.sum(F.col("a") * F.col("w")).alias("whole"), F.sort_array(F.collect_list(part)).alias("parts"))
    both = found.join(parts, ["item_id", "doc_id"]).join(anchor, "item_id").withColumn("stop", F.col("start") + F.size("anchor"))
    inside = lambda p: F.size(F.filter(p["positions"], lambda x: (x >= F.col("start")) & (x < F.col("stop"))))
    shared = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.least(p["a"], inside(p)) * p["w"])
    near = stored(both.withColumn("overlap", shared / F.col("whole")).where(F.col("overlap") >= (least - 0.35) / 0.65 - 1e-9).drop("parts"), "windows")
    texts = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", _values(F.col("text")).alias("values"))
    cut = near.join(texts, "doc_id").withColumn("window", F.slice("values", F.col("start") + 1, F.size("anchor")))
    out = cut.withColumn("ordered", text.in_order(F.col("anchor"), F.col("window"))).withColumn("score", F.lit(0.65) * F.col("overlap") + F.lit(0.35) * F.col("ordered"))
    return out.where(F.col("score") >= least).select("item_id", "doc_id", "start", (F.col("start") + F.size("window")).alias("end"), "overlap", "ordered", "score")


def best(found: DataFrame) -> DataFrame:
    # sums differ in their last bits by the order of their rows, so scores are compared rounded
    w = Window.partitionBy("item_id", "doc_id").orderBy(F.desc(F.round("score", 9)), F.desc("ordered"), "start")
    return found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: float = 0.72) -> DataFrame:
    """Where each item (item_id, text) lies in the documents (doc_id, text): the best window, in each
    pair that passes, of the first of the item's chunks that passes there, from tokens to rank in
    native operators. Chunks hold ``window`` tokens; an odd one counts only with 8 or more."""
    spread = segment.tokens(items, "item_id").where("item_id is not null").withColumn("chunk", F.floor(F.col("pos") / window))
    sizes = Window.partitionBy("item_id", "chunk")
    spread = spread.withColumn("held", F.count("*").over(sizes)).where("chunk = 0 or held >= 8")
    mine = spread.select(F.struct("item_id", "chunk").alias("item_id"), (F.col("pos") % window).alias("apos"), "value")
    # words are counted first; places are kept only of documents that hold enough of some item
    wanted = mine.select("value").distinct()
    each = docs.select("doc_id", F.explode(_cut(F.col("text"))).alias("value")).select("doc_id", F.lower("value").alias("value"))
    counts = stored(each.join(F.broadcast(wanted), "value", "left_semi").groupBy("doc_id", "value").agg(F.count("*").alias("n")), "counts")
    met = stored(meeting(mine, counts, least), "pairs")
    near = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    each = near.select("doc_id", _cut(F.col("text")).alias("values")).select("doc_id", F.size("values").alias("size"), F.posexplode("values").alias("pos", "value"))
    found = each.withColumn("value", F.lower("value")).join(F.broadcast(wanted), "value", "left_semi").groupBy("doc_id", "value", "size").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))
    found = stored(found, "postings")
    sizes = found.select("doc_id", "size").distinct()
    some = stored(candidates(mine, found.drop("size"), sizes, gathered(mine, found, met)), "candidates")
    placed = best(scored(some, mine, found.drop("size"), docs, least)).withColumn("chunk", F.col("item_id.chunk")).withColumn("item_id", F.col("item_id.item_id"))
    first = Window.partitionBy("item_id", "doc_id").orderBy("chunk")
    return placed.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "chunk")
