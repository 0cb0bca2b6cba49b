"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: principal axes of a bounded sample, turned by a rotation that is learned to bring the
projections close to their signs (iterative quantisation); with fewer dimensions than bits further
rotations of the same axes follow. A code is cut into substrings. The index is a table with a row
(substring, value) -> vector for each of them; a query's probes are all values within ``near`` bits
of its own in each substring, and an equality join brings candidates. If two codes differ by fewer than
substrings * (near + 1) bits, some substring differs by at most ``near``: every code within that
radius is retrieved, and farther ones as often as one of their substrings is close. Candidates are
ranked by exact Euclidean distance in double precision on the original vectors.

A query that retrieves fewer than ``least`` rows, too few to hold its neighbours for certain, goes on with
one bit more, up to ``widest``; what is left then, which takes a small table or a lonely query, is
compared with all rows.

Equal vectors are one entry, with the k + 1 smallest of their vec_ids, which is all that k neighbours
can need; equal queries are one search. Each vector moves once, to its block of rows; queries go to the blocks
where they have candidates; a task holds a block's rows and queries, reads its pairs batch by batch, and
returns at most k + 1 rows for a query of each batch.

Vectors that are null, zero, or hold null or non-finite components take no part, as queries or as
candidates; nor do rows with a null vec_id, or vectors of another length than most, from which no
distance is defined. Ties in distance go to the smaller vec_id. Rows that share a vec_id with the
query are the query's own. Repeated rows: one of each (vec_id, vector) takes part; a vec_id with
several vectors counts by its nearest. An empty table gives an empty result. Only the two columns
named are read, exact names first, so extra ones may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textspan.llm.common import by_arrow, release, table, unambiguous

_RESULT = "query_id long, rank int, vec_id long, score double"
#: Queries that are compared with all rows of a block at once.
TOGETHER = 64


@dataclass(frozen=True)
class Index:
    """width: bits of a substring, 16 at most."""

    substrings: int = 80
    width: int = 16
    near: int = 2
    widest: int = 3
    least: int = 2048
    #: Vectors that the axes and the rotation are learned from, at most.
    sample: int = 4096
    turns: int = 30
    row_block: int = 16384

    @property
    def bits(self) -> int:
        return self.substrings * self.width

    @property
    def radius(self) -> int:
        """Every code that differs by as many bits is retrieved."""
        return self.substrings * (self.near + 1) - 1


def learn(vectors: np.ndarray, index: Index = Index()) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection: dimensions x bits)."""
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=True)
    parts, have = [], 0
    while have < index.bits:
        width = min(index.bits - have, axes.shape[0])
        basis = axes[:width].T
        seen = centred @ basis
        rng = np.random.default_rng(7 + have)
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(index.turns):
            u, _, v = np.linalg.svd(np.where(seen @ turn > 0, 1.0, -1.0).T @ seen)
            turn = (u @ v).T
        parts.append(basis @ turn)
        have += width
    return mean, np.concatenate(parts, axis=1)


def encode(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray, index: Index = Index()) -> np.ndarray:
    """The values of each code's substrings."""
    bits = ((vectors - mean) @ projection > 0).reshape(len(vectors), index.substrings, index.width)
    return bits.astype(np.int64) @ (1 << np.arange(index.width))


def masks(width: int, near: int) -> np.ndarray:
    """What to change in a substring for every value within ``near`` bits of it."""
    return np.array([sum(1 << b for b in some) for n in range(min(near, width) + 1) for some in combinations(range(width), n)], np.int64)


def _keys(vectors: DataFrame, mean: np.ndarray, projection: np.ndarray, index: Index, near: int | None) -> DataFrame:
    """(key, id): a row for each substring of each (id, v), or for each of its probes."""
    change = masks(index.width, near or 0)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("id").to_numpy()
        values = encode(_matrix(batch.column("v")), mean, projection, index) | (np.arange(index.substrings) << index.width)[None]
        keys = values[:, :, None] ^ change[None, None]
        return pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, keys[0].size))], ["key", "id"])

    return by_arrow(vectors.select("id", "v"), work, "key long, id long", 64 if near else 512)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def entries(rows: DataFrame, name: str, vector: str, k: int) -> DataFrame:
    """(id, v, ids, asked): one row for each different vector that takes part."""
    few = unambiguous(rows, name, vector).toDF("vec_id", "v").select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    good = few.where(sound).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    top = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    alike = good.where(F.size("v") == (top["n"] if top else 0)).distinct()
    # the limit of a rank is applied before rows move, so a vector of many rows moves little
    first = alike.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return first.groupBy("v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), alike


def _best(block: dict[str, np.ndarray], k: int) -> Iterator[tuple[int, int, float]]:
    """(query, vec_id, distance): of each query the k + 1 nearest ids among its candidates in a block."""
    rows, queries = block["rows"], block["queries"]
    order = np.argsort(block["q"], kind="stable")
    q, r = block["q"][order], block["r"][order]
    cuts = np.flatnonzero(np.diff(q)) + 1
    for some in np.split(np.arange(len(q)), cuts) if len(q) else ():
        at, found = q[some[0]], r[some]
        far = np.sqrt(((rows[found] - queries[at]) ** 2).sum(axis=1))
        if len(far) > k + 1:
            near = np.flatnonzero(far <= np.partition(far, k)[k])
            found, far = found[near], far[near]
        ids = [(d, i) for d, x in zip(far.tolist(), found.tolist(), strict=True) for i in block["ids"][x]]
        for d, i in sorted(ids)[: k + 1]:
            yield int(block["names"][at]), i, d


def _ranked(pairs: DataFrame | None, rows: DataFrame, asked: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query, vec_id, score): pairs (query, id) by exact distance; without pairs, all rows."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    if pairs is None:
        spots = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        pairs = pairs.withColumn("block", block("id"))
        spots = pairs.select("block", F.col("query").alias("id")).distinct().join(asked, "id")
    nothing = F.array().cast("array<long>")
    sides = rows.select(block("id").alias("block"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("other"), "v", "ids")
    sides = sides.union(spots.select("block", F.lit(1), "id", F.lit(0).cast("long"), "v", nothing))
    if pairs is not None:
        sides = sides.union(pairs.select("block", F.lit(2), F.col("query"), F.col("id"), F.array().cast("array<double>"), nothing))

    whole = pairs is None

    def answer(held: tuple[dict, dict], names: np.ndarray | None, others: np.ndarray | None) -> pa.RecordBatch:
        rows, asked = held
        ids, called = rows["id"], asked["id"]
        if whole:
            q, r = np.divmod(np.arange(len(ids) * len(called)), len(ids))
        else:
            by_name, by_id = np.argsort(called), np.argsort(ids)
            q = by_name[np.searchsorted(called[by_name], names)]
            r = by_id[np.searchsorted(ids[by_id], others)]
        found = list(_best({"rows": rows["v"], "queries": asked["v"], "ids": rows["ids"], "names": called, "q": q, "r": r}, k))
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query", "vec_id", "score"])

    def side(parts: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(parts).combine_chunks()
        v = t.column("v").combine_chunks()
        return {"id": t.column("id").to_numpy(), "v": _matrix(v), "ids": t.column("ids").to_pylist()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, ([], []), None
        for batch in batches:
            kinds = np.stack([batch.column("block").to_numpy(), batch.column("side").to_numpy()])
            cuts = [0, *(np.flatnonzero((np.diff(kinds) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                block_of, kind = kinds[:, lo].tolist()
                if block_of != at:
                    at, parts, held = block_of, ([], []), None
                some = batch.slice(lo, hi - lo)
                if kind == 0 or not whole and kind == 1:
                    parts[kind].append(some)
                elif parts[0]:
                    if held is None:
                        held = side(parts[0]), None if whole else side(parts[1])
                    if not whole:
                        yield answer(held, some.column("id").to_numpy(), some.column("other").to_numpy())
                        continue
                    for i in range(0, some.num_rows, TOGETHER):
                        yield answer((held[0], side([some.slice(i, TOGETHER)])), None, None)

    # rows come before queries, and queries before pairs
    dealt = sides.repartition("block").sortWithinPartitions("block", "side", "id")
    return dealt.mapInArrow(work, "query long, vec_id long, score double")


def search(embeddings: DataFrame, every: int = 100, k: int = 10, index: Index = Index(), name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    spark = embeddings.sparkSession
    found, alike = entries(embeddings, name, vector, k)
    rows = table(found, "vectors")
    # bounded by ``sample``: the least hashes
    drawn = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(index.sample).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], _RESULT)
    mean, projection = learn(np.array([r["v"] for r in drawn], np.float64), index)
    asking = alike.where(F.pmod("vec_id", F.lit(every)) == 0)
    asking = table(asking.join(rows.select("v", "id"), "v").select(F.col("vec_id").alias("query_id"), "id"), "queries")
    asked = table(rows.join(asking.select("id").distinct(), "id", "left_semi").select("id", "v"), "asked")
    filed = table(_keys(rows, mean, projection, index, None), "index")
    n = rows.agg(F.count("*")).first()
    blocks, enough = max(1, -(-n[0] // index.row_block)), min(index.least, n[0])
    found, left = [], asked
    for near in range(index.near, index.widest + 1 if n[0] > index.least else index.near):
        probes = _keys(left, mean, projection, index, near).withColumnRenamed("id", "query")
        pairs = table(probes.join(filed.hint("merge"), "key").select("query", "id").distinct(), "candidates")
        some = table(pairs.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("query"), "settled")
        asking_now = left.join(some.withColumnRenamed("query", "id"), "id", "left_semi")
        found.append(table(_ranked(pairs.join(some, "query", "left_semi"), rows, asking_now, k, blocks), "nearest"))
        left = table(left.join(some.withColumnRenamed("query", "id"), "id", "left_anti"), "left")
        release(pairs)
        if not left.head(1):
            break
    else:
        found.append(_ranked(None, rows, left, k, blocks))
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    each = asking.join(best.withColumnRenamed("query", "id"), "id").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(embeddings: DataFrame) -> DataFrame:
    return search(embeddings)
