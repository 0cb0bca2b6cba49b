"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code-point order, null last, weigh 1, 2, 3,
1, 2, 3, ...; they share the words of all documents, a target stops at ``most`` times its source's
size, and what is over is shared again by weight: each target is the lesser of its stop and one
common level times its weight. Whole repeats of a source come first. What is left of a target, less
than the source's size, is fitted from its histogram of exact lengths: an even share of each
length, and a bounded-knapsack program for the rest (``fit``). Which documents of a length are taken
follows a seeded hash.

Null text or one without words: size 0, never taken words of. Null source is a source. Rows with
the same doc_id and size are chosen one by one and may swap. No words at all: targets are 0. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textspan.llm.common import spread_rank, table, unambiguous, word_count

#: Words that the exact program may spend at first, and at most.
EXACT, MOST = 4096, 1 << 22


def targets(sources: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target): one row for each source.

    With stops c and weights w, sources whose c / w is least are stopped first; the level is that of
    the first source in this order that isn't stopped. Windows run over one row for each source."""
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    rows = sources.withColumn("at", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("w", w)
    rows = rows.withColumn("stop", F.col("source_size") * most).withColumn("r", F.col("stop") / F.col("w"))
    upto = Window.orderBy("r", "at").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("r", "at").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("r", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(upto), F.lit(0))) / F.sum("w").over(rest)
    # the first source that its level doesn't stop sets the level of all after it
    rows = rows.withColumn("level", level).withColumn("free", F.col("r") >= F.col("level"))
    common = F.min(F.when(F.col("free"), F.struct("r", "at", "level"))).over(whole)
    rows = rows.withColumn("common", common["level"])
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("stop").cast("double"), F.col("common") * F.col("w")), F.lit(0.0)).alias("target"))


def _fill(free: list[tuple[int, int]], left: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``left`` that (length, count) can make, and how: a bounded-knapsack
    program that keeps for each sum the length that first reached it and how many of them."""
    import numpy as np

    reached, length, times = np.zeros(left + 1, bool), np.zeros(left + 1, np.int64), np.zeros(left + 1, np.int64)
    reached[0] = True
    for n, count in free:
        if n > left or reached[left]:
            break
        rest, part = min(count, left // n), 1
        while rest > 0 and not reached[left]:
            step = min(part, rest)
            new = np.flatnonzero(reached[: left + 1 - step * n] & ~reached[step * n :]) + step * n
            reached[new], length[new], times[new] = True, n, step
            rest -= step
            part *= 2
    best = at = int(np.flatnonzero(reached)[-1])
    used: dict[int, int] = {}
    while at:
        n, k = int(length[at]), int(times[at])
        used[n] = used.get(n, 0) + k
        at -= n * k
    return best, used


def fit(lengths: list[tuple[int, int]], budget: int, exact: int = EXACT, most: int = MOST) -> dict[int, int]:
    """How many documents of each length, of (length, count) with positive lengths, make up the
    budget as nearly as possible without passing it.

    An even share of every length keeps the mix like its source; the program then spends the last
    ``exact`` words. Where that doesn't meet the budget to the word, documents are given back and the
    program has four times as many words to spend, until it meets the budget or has all of it to
    spend, and so has the best sum there is. Only past ``most`` words is the best found so far taken."""
    import math

    unit = math.gcd(*(n for n, _ in lengths)) if lengths else 1
    lengths, budget = sorted((n // unit, c) for n, c in lengths), budget // unit
    count, total = dict(lengths), sum(n * c for n, c in lengths)
    if budget >= total:
        return {n * unit: c for n, c in lengths}
    taken = {n: c * budget // total for n, c in lengths}
    best: tuple[int, dict[int, int]] = (-1, {})
    while True:
        left = budget - sum(n * t for n, t in taken.items())
        for n, _ in reversed(lengths):  # the longest that fit, while more is left than the program covers
            use = min(count[n] - taken[n], max(0, left - exact + n - 1) // n, left // n)
            taken[n] += use
            left -= use * n
        for n, _ in lengths:  # or give back as much as it covers
            use = min(taken[n], max(0, exact - left) // n)
            taken[n] -= use
            left += use * n
        some, how = _fill([(n, c - taken[n]) for n, c in lengths if c > taken[n]], left)
        got = budget - left + some
        if got > best[0]:
            best = got, {n: t + how.get(n, 0) for n, t in taken.items()}
        if best[0] == budget or not any(taken.values()) or exact >= most:
            return {n * unit: t for n, t in best[1].items()}
        exact *= 4


def plan(histogram: DataFrame) -> DataFrame:
    """(source, size, extra): of each length, how many documents are taken once more than the whole
    repeats. A source's histogram has at most the square root of twice its words in rows, which
    bounds the group a task holds."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        chosen = fit(list(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), int(rows["budget"].iloc[0]))
        out = rows[["source", "size", "at"]].copy()
        out["extra"] = [chosen.get(n, 0) for n in rows["size"].tolist()]
        return out[["source", "size", "extra"]]

    # null can't be told from other keys by pandas: a number stands for the source
    numbered = histogram.withColumn("at", F.xxhash64(F.col("source").isNull(), "source"))
    return numbered.groupBy("at", "source").applyInPandas(work, "source string, size long, extra long")


def mix(docs: DataFrame, seed: int = 42, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row, and the columns to carry."""
    few = unambiguous(docs, "doc_id", "text", "source", *carry)
    rows = table(few.select("doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("size"), *carry), "sizes")
    histogram = table(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sources, most, weights).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # no document over ``most`` times; rounding of the budget may not add a repeat
    goal = table(goal.withColumn("whole", F.least("whole", F.lit(most))).withColumn("budget", F.when(F.col("whole") < most, F.round(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0).cast("long")), "targets")
    named = goal.select(F.col("source").alias("__source"), "source_size", "target", "whole", "budget")
    same = lambda d: d["source"].eqNullSafe(F.col("__source"))
    budgets = histogram.where("size > 0").join(named, same(histogram)).where("budget > 0").select("source", "size", "n", "budget")
    extra = table(plan(budgets).where("extra > 0"), "extra").select(F.col("source").alias("__s"), F.col("size").alias("__n"), "extra")
    ranked = spread_rank(rows, ["source", "size"], F.xxhash64(F.lit(seed), "doc_id", *carry), ["doc_id", *carry])
    with_extra = ranked.join(extra, ranked["source"].eqNullSafe(extra["__s"]) & (ranked["size"] == extra["__n"]), "left").drop("__s", "__n")
    out = with_extra.join(named.drop("budget"), same(with_extra)).drop("__source")
    copies = F.col("whole") + (F.col("rank") < F.coalesce("extra", F.lit(0))).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs as the mix takes them: a row for each copy. Rows that the mix leaves out go. Every row is
    taken by itself, those that share a doc_id too: rows get a number of their own first. Columns are
    found by their exact names, else by the first that differs in case only; extra ones stay."""
    names = docs.columns
    rows = table(docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("row", F.monotonically_increasing_id()), "numbered")
    lower = [c.lower() for c in names]
    at = {n: f"c{names.index(n) if n in names else lower.index(n)}" for n in ("doc_id", "text", "source")}
    few = rows.select(*(F.col(c).alias(n) for n, c in at.items()), "row")
    taken = mix(few, seed, carry=("row",)).where("copies > 0").select("row", "copies")
    out = rows.join(taken.hint("merge"), "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.drop("row", "copies", "copy").toDF(*names)
