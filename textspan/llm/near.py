"""Near-duplicate groups of texts by the Jaccard similarity of their word shingles.

Candidates come from two indexes over different texts. One files SimHash fingerprints under their
one-wildcard segment variants (``simhash.variants``); it finds the closest texts cheaply. The other
is an exact prefix join: of two sets with similarity s, both hold a common shingle among their first
|x| - ceil(s |x|) + 1 in any one order, so it finds every pair (seldom shingles first, by a sample
that only moves work; it is a fixed share of the texts, so that the keys of the others stay small
however many texts there are). Every link is checked on the shingles of the two texts; none is an estimate.

1. Within a key each text meets the key's most typical text and its neighbour in order: a number of
   pairs in proportion to the rows. Pairs that pass join components.
2. Keys that still hold texts of different components are open. Those of up to ``together`` texts
   list their pairs across components. Texts of larger open keys form families (components of texts
   that share such a key); a family is cut into blocks of bounded size, and each pair of blocks is a
   task that counts all common shingles of its texts and returns a forest of links. A family of n
   texts sends each text's shingles n / block times, in rounds that bound what is on disk at once; no
   other step grows faster than its input.

So two texts at the similarity always end in one group, however large it is.

Equal word sequences (A-Z lower-cased) are one text from the start, texts without words too; these
link with nothing else. Null text counts as empty. Null doc_id: its text takes part, but names no
group. Repeated rows and rows that share a doc_id count as their texts do. An empty table gives an
empty result. Texts are named by 128-bit digests, shingles by 64-bit hashes, and
by 32 bits of these where two texts are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspan.llm import simhash
from textspan.llm.common import by_arrow, release, table, unambiguous

#: Texts of a key that are listed pair by pair.
TOGETHER = 64
#: Rows, and shingles, of a block of a family.
BLOCK, BLOCK_SHINGLES = 512, 150_000
#: Shingles that the families of a round send to their blocks, and how often a round sends those of all texts, at least.
ROUND_SHINGLES, ROUND_TIMES = 250_000_000, 4
#: One in so many texts is in the sample of shingles, at least.
SAMPLED = 4
_KEYED = "key long, node long, at int, size int, central int"


def _texts(docs: DataFrame) -> DataFrame:
    return unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def frequent(docs: DataFrame, near: simhash.Near, sample: int = 20_000, most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in rising order, and how often a sample of texts holds each: they come last in the order
    of the prefix join. Which ones are known moves work, not results. The sample is one text in
    SAMPLED, or as many more as come to ``sample``: in one of fixed size, the shingle that goes unseen
    would be the commoner the more texts there are, and the pairs of its key would grow with their square."""
    rows = _texts(docs).withColumn("h", _mark())
    step = max(1, min(SAMPLED, rows.count() // sample))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(simhash.hashes(t, near)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["hash"])

    some = rows.where(F.pmod("h", F.lit(step)) == 0).dropDuplicates(["h"]).select("text")
    counted = by_arrow(some, work, "hash long").groupBy("hash").count()
    top = counted.where(F.col("count") > 1).orderBy(F.desc("count"), "hash").limit(most).toArrow()
    hot, counts = top.column("hash").to_numpy().view(np.uint64), top.column("count").to_numpy()
    at = np.argsort(hot)
    return hot[at], counts[at]


def described(docs: DataFrame, near: simhash.Near) -> DataFrame:
    """(doc_id, mark, digest, fp, size, central, keys) of every row: a hash to find the text by, name of the
    word sequence, fingerprint, number of different shingles, how common they are, and the first of them
    in the order of the join."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, near))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        from hashlib import blake2b

        hot, counts = shared.value
        digests, fps, sizes, central, keys = [], [], [], [], []
        for t in batch.column("text").to_pylist():
            digests.append(blake2b(b" ".join(simhash.words(t)), digest_size=16).digest())
            h = simhash.hashes(t, near)
            fps.append(simhash.folded(h, near).tobytes())
            h = np.unique(h)
            seen = np.zeros(len(h), np.int64)
            if len(hot) and len(h):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                seen = np.where(hot[at] == h, counts[at], 0)
            sizes.append(len(h))
            central.append(int(seen.sum() // max(1, len(h))))
            first = len(h) - math.ceil(near.similarity * len(h) - 1e-9) + 1
            keys.append(h[np.argsort(seen, kind="stable")][:first].tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(central, pa.int32()), pa.array(keys, pa.binary())],
            ["doc_id", "mark", "digest", "fp", "size", "central", "keys"],
        )

    return by_arrow(_texts(docs).withColumn("mark", _mark()), work, "doc_id long, mark long, digest binary, fp binary, size int, central int, keys binary")


def _keyed(nodes: DataFrame) -> DataFrame:
    """A row for each shingle of a text's prefix."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
        n = [len(k) for k in keys]
        own = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in ("node", "size", "central")]
        at = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), own[0], pa.array(at), own[1], own[2]], ["key", "node", "at", "size", "central"])

    return by_arrow(nodes.select("node", "size", "central", "keys"), work, _KEYED)


def _possible(near: simhash.Near, a: tuple, b: tuple) -> np.ndarray:
    """Whether sizes, and places of a common key, allow the similarity. a, b: (size, at)."""
    least, part = near.similarity, near.similarity / (1 + near.similarity)
    rest = np.minimum(a[0] - a[1], b[0] - b[1])
    return (np.minimum(a[0], b[0]) >= least * np.maximum(a[0], b[0]) - 1e-9) & (rest >= part * (a[0] + b[0]) - 1e-9)


def _met(rows: DataFrame, near: simhash.Near) -> DataFrame:
    """Rows of keys that two or more texts hold, with the texts that each meets first: ``top``, the key's
    first row, and ``prev``, the row before; null where sizes and places rule the pair out. Rows come
    in order of key; what is carried from batch to batch is one row of each kind."""
    schema = "key long, node long, at int, size int, top long, prev long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "node", "at", "size")
        held: list[np.ndarray] | None = None  # the last row, which waits to know if its key goes on
        top: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held[:4], cols, strict=True)]
            key, node, at, size = (c.astype(np.int64) for c in cols)
            n, new = len(key), np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            tops = [node[first], size[first], at[first]]
            same = np.zeros(n, bool)  # goes on from the row before
            same[1:] = ~new[1:]
            prev = [np.concatenate([c[:1], c[:-1]]) for c in (node, size, at)]
            if held is not None:
                same[0] = held[4]
                for i, c in enumerate(prev):
                    c[0] = held[5 + i]
                if top is not None and top[0] == key[0]:
                    for c, v in zip(tops, top[1:], strict=True):
                        c[first == 0] = v
            goes = np.zeros(n, bool)
            goes[:-1] = ~new[1:]
            keep = (same | goes)[: n - 1]
            meets = same & (tops[0] != node) & _possible(near, (size, at), (tops[1], tops[2]))
            next_to = same & (prev[0] != tops[0]) & _possible(near, (size, at), (prev[1], prev[2]))
            # two texts alone that rule each other out: their key is of no more use
            alone = np.flatnonzero(~same[: n - 2] & goes[: n - 2] & same[1 : n - 1] & ~goes[1 : n - 1] & ~meets[1 : n - 1])
            keep[alone] = keep[alone + 1] = False
            out = lambda end, keep, key=key, node=node, at=at, size=size, tops=tops, prev=prev, meets=meets, next_to=next_to: pa.RecordBatch.from_arrays(
                [pa.array(key[:end][keep]), pa.array(node[:end][keep]), pa.array(at[:end][keep].astype(np.int32)), pa.array(size[:end][keep].astype(np.int32)),
                 pa.array(tops[0][:end][keep], mask=~meets[:end][keep]), pa.array(prev[0][:end][keep], mask=~next_to[:end][keep])],
                ["key", "node", "at", "size", "top", "prev"])
            yield out(n - 1, keep)
            held = [c[-1:] for c in cols] + [bool(same[-1]), prev[0][-1], prev[1][-1], prev[2][-1]]
            top = (key[-1], tops[0][-1], tops[1][-1], tops[2][-1])
            last = out(n, np.concatenate([np.zeros(n - 1, bool), [True]]))
        if held is not None and held[4]:
            yield last

    order = ["key", F.desc("central"), "size", "node"]
    return rows.repartition("key").sortWithinPartitions(*order).select("key", "node", "at", "size").mapInArrow(run, schema)


def _variants(nodes: DataFrame, near: simhash.Near) -> DataFrame:
    """(x, y): texts that share a one-wildcard segment variant with the key's first text or the one
    before, and differ by at most ``max_bits``."""

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column("fp").to_pylist()
        keys = simhash.variants(simhash.as_words(fps, near), near)
        at = pa.array(np.repeat(np.arange(len(fps)), keys.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("node").take(at), pa.array(fps, pa.binary()).take(at)], ["key", "node", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = top = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            fp = simhash.as_words(batch.column("fp").to_pylist(), near)
            if last is not None:
                key, node, fp = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node]), np.concatenate([last[2], fp])
            n, new = len(key), np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            tops, top_fp = node[first], fp[first]
            if top is not None and top[0] == key[0]:
                tops[first == 0], top_fp[first == 0] = top[1], top[2]
            i = np.flatnonzero(~new)
            both = [(tops[i], top_fp[i], i), (node[i - 1], fp[i - 1], i)]
            found = [np.stack([a, node[j]], axis=1)[np.bitwise_count(f ^ fp[j]).sum(axis=1) <= near.max_bits] for a, f, j in both]
            found = np.concatenate(found)
            found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], axis=1), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["x", "y"])
            last, top = (key[-1], node[-1], fp[-1:]), (key[-1], tops[-1], top_fp[-1])

    filed = by_arrow(nodes.select("node", "fp"), file, "key long, node long, fp binary")
    return filed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "x long, y long")


def _short(hashes: np.ndarray) -> np.ndarray:
    """Sorted 32-bit names of a text's different shingles. Equal names within a text are counted up, so
    that every shingle keeps one of its own."""
    found = np.sort((hashes >> np.uint64(32)).astype(np.uint32))
    while len(same := np.flatnonzero(found[1:] == found[:-1])):
        found[same + 1] += 1
        found.sort()
    return found


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, near: simhash.Near) -> DataFrame:
    """(node, hashes) of the texts wanted: each is read from a row that names it, by doc_id and a hash."""
    keys = ["mark", "__id", "__null"]
    keyed = lambda d, name: d.withColumn("__id", F.coalesce(name, F.lit(0))).withColumn("__null", F.col(name).isNull())
    named = keyed(nodes.join(wanted, "node", "left_semi"), "least").select("node", *keys)
    rows = keyed(_texts(docs).withColumn("mark", _mark()), "doc_id").select("text", *keys)
    texts = rows.join(named, keys).groupBy(*keys, "node").agg(F.first("text").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_short(np.unique(simhash.hashes(t, near))).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "hashes"])

    return table(by_arrow(texts.select("node", "text"), work, "node long, hashes binary"), "shingles")


def _alike(pairs: DataFrame, sets: DataFrame, near: simhash.Near) -> DataFrame:
    """The pairs whose texts are similar enough."""
    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("x", "s"), ("y", "t")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
            a, b = np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32)
            at = np.minimum(np.searchsorted(a, b), max(0, len(a) - 1))
            both = int((a[at] == b).sum()) if len(a) else 0
            keep.append(both >= near.similarity * (len(a) + len(b) - both) - 1e-9)
        return batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(one.hint("merge"), "x").join(two.hint("merge"), "y").select("x", "y", "s", "t")
    return by_arrow(joined, work, "x long, y long")


def _listed(rows: DataFrame, near: simhash.Near) -> DataFrame:
    """(x, y): all pairs of different roots within keys of up to TOGETHER texts."""

    def met(key: np.ndarray, node: np.ndarray, at: np.ndarray, size: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        i, found = np.arange(len(key)), []
        for d in range(1, TOGETHER):
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            j = i + d
            good = (root[i] != root[j]) & _possible(near, (size[i], at[i]), (size[j], at[j]))
            found.append(np.sort(np.stack([node[i[good]], node[j[good]]], axis=1), axis=1))
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "node", "at", "size", "root")])
            if sum(len(h[0]) for h in held) >= 100_000:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
                yield met(*(c[:cut] for c in rows))
                held = [[c[cut:] for c in rows]]
        if held:
            yield met(*(np.concatenate(c) for c in zip(*held, strict=True)))

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "size", "node")
    return sorted_rows.select("key", "node", "at", "size", "root").mapInArrow(run, "x long, y long").distinct()


def linked(ids: np.ndarray, roots: np.ndarray, side: np.ndarray, hashes: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest over the roots of two blocks' texts: links between different roots at the similarity.
    side: 0 or 1 for two blocks, of which only pairs across count, or all 2 for one block."""
    sizes = np.array([len(h) for h in hashes])
    every = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(ids)), sizes)
    names, at, n = np.unique(every, return_inverse=True, return_counts=True)
    common = n > 1
    column = np.cumsum(common) - 1
    chosen = common[at]
    owner, at = owner[chosen], column[at[chosen]]
    order = np.argsort(at, kind="stable")
    owner, at, both, step = owner[order], at[order], np.zeros((len(ids), len(ids)), np.float32), 4096
    for low in range(0, int(common.sum()), step):
        a, b = np.searchsorted(at, [low, low + step])
        held = np.zeros((len(ids), step), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        both += held @ held.T
    total = sizes[:, None] + sizes[None] - both
    good = (both >= similarity * total - 1e-6) & (roots[:, None] != roots[None])
    if side[0] != 2:
        good &= side[:, None] != side[None]
    i, j = np.nonzero(np.triu(good))
    edges = np.unique(np.sort(np.stack([roots[i], roots[j]], axis=1), axis=1), axis=0)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for a, b in edges.tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _families(hot: DataFrame, sets: DataFrame, near: simhash.Near) -> list[DataFrame]:
    """(a, b): links between roots of texts of larger keys, a table for each round. hot: (key, node, size, root)."""
    least = hot.groupBy("key").agg(F.min("node").alias("a"))
    edges = hot.join(least, "key").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    family = simhash.components(edges, "families").toDF("node", "family")
    members = table(hot.select("node", "size", "root").distinct().join(family, "node"), "members")
    parts = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts"), F.sum("size").alias("shingles")
    )
    sent, once = parts.agg(F.sum(F.col("shingles") * F.col("parts")), F.sum("shingles")).first()
    rounds = math.ceil((sent or 0) / max(ROUND_SHINGLES, ROUND_TIMES * (once or 0)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(parts, "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root",
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )

    def work(t: pa.Table) -> pa.Table:
        ids, roots, side = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "root", "side"))
        found = linked(ids, roots, side, [np.frombuffer(h, np.uint32) for h in t.column("hashes").to_pylist()], near.similarity)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = []
    for k in range(rounds):  # a table's end lets its round's shuffle files go
        some = dealt.where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(rounds)) == k) if rounds > 1 else dealt
        found.append(table(some.join(sets.hint("merge"), "node").groupBy("family", "i", "j").applyInArrow(work, "a long, b long"), "family-links"))
    return found


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.toDF("node", "__root"), "node", "left").withColumn("root", F.coalesce("__root", "node")).drop("__root")


def groups(docs: DataFrame, near: simhash.Near = simhash.SIMILAR) -> DataFrame:
    """(doc_id, digest, component_id): one row for each document. component_id is the smallest doc_id of
    the group, null where all its doc_ids are null."""
    told = table(described(docs, near), "described")
    rows = table(told.select("doc_id", "digest"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")
    one = told.groupBy("digest").agg(first, *(F.first(c).alias(c) for c in ("fp", "size", "central", "keys")))
    full = table(one.withColumn("node", F.monotonically_increasing_id()), "texts")
    release(told)
    nodes = table(full.select("node", "digest", F.col("first.doc_id").alias("least"), F.col("first.mark").alias("mark")), "names")
    some = full.where("size > 0")
    close = table(_variants(some, near).distinct(), "close")
    met = table(_met(_keyed(some), near), "met")
    release(full)
    pairs = met.where("top is not null").select(F.least("top", "node").alias("x"), F.greatest("top", "node").alias("y"))
    pairs = pairs.union(met.where("prev is not null").select(F.least("prev", "node"), F.greatest("prev", "node"))).union(close)
    pairs = table(pairs.distinct(), "pairs")
    wanted = table(_ends(pairs), "wanted")
    sets = _sets(docs, nodes, wanted, near)
    links = table(_alike(pairs, sets, near).toDF("a", "b"), "links")
    roots = table(simhash.components(links), "roots")
    keyed = _rooted(met.select("key", "node", "at", "size"), roots)
    count = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "n")
    opened = table(keyed.join(count.hint("merge"), "key"), "open-keys")
    release(close, met)
    hot = opened.where(F.col("n") > TOGETHER)
    listed = table(_listed(opened.where(F.col("n") <= TOGETHER), near).join(pairs.hint("merge"), ["x", "y"], "left_anti"), "listed")
    late = _ends(listed).union(hot.select("node")).distinct().join(wanted.hint("merge"), "node", "left_anti")
    others = _sets(docs, nodes, late, near)
    sets_of_all = sets.union(others)
    more = table(_alike(listed, sets_of_all, near).toDF("a", "b"), "more-links")
    new = [_rooted(_rooted(more.toDF("node", "b"), roots).select("root", F.col("b").alias("node")).withColumnRenamed("root", "a"), roots).select("a", F.col("root").alias("b"))]
    if hot.head(1):
        new += _families(hot.select("key", "node", "size", "root"), sets_of_all, near)
    between = reduce(DataFrame.union, new)
    between = table(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "between")
    final = table(_rooted(_rooted(nodes.select("node", "digest", "least"), roots).withColumnRenamed("node", "text").withColumnRenamed("root", "node"), simhash.components(between)), "rooted")
    release(sets, others, wanted, listed, pairs, links, opened, more, roots, *new[1:])
    names = final.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "digest").join(final.select("digest", "root").join(names, "root"), "digest").select("doc_id", "digest", "component_id")


def dedup(docs: DataFrame, near: simhash.Near = simhash.SIMILAR) -> DataFrame:
    """docs with one document left of each group: the one with the smallest doc_id. Rows with a null
    doc_id can't be told apart and stay. Of rows that share a doc_id all stay or go. Extra columns
    stay as they are, clashing names too."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key = f"c{names.index('doc_id') if 'doc_id' in names else [c.lower() for c in names].index('doc_id')}"
    kept = groups(docs, near).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    return plain.join(kept.hint("merge"), plain[key].eqNullSafe(kept["kept"]), "left_semi").toDF(*names)
