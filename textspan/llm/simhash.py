"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints within ``max_bits``, one
segment differs by at most one bit (2 * segments > max_bits). For each segment the fingerprint is
filed under every variant with one bit left out; two such segments then agree in some variant, so
an equality join on (segment, left-out bit, rest) finds the pair, and the whole distance is checked.

Equal fingerprints are one node before any of this. What a key gathers is joined inside a task
into a spanning forest of least distances, never listed as pairs; a key with more than ``together`` fingerprints is
cut into blocks, and each pair of blocks is a task of its own: nothing is dropped, memory is
bounded, and no task holds a hot key. Components are then found by rounds of minimum-label joins
over tables.

Null text counts as empty; a text without words has fingerprint zero and links like any other.
Null doc_id: keeps its row, its links count, and it is never a component's id unless all its
members are null. Repeated rows give repeated rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspan.llm.common import by_arrow, table, unambiguous

_BYTES = ((np.arange(256)[:, None] >> np.arange(8)[None]) & 1).astype(np.int64)


@dataclass(frozen=True)
class Near:
    """shingle: words in each; bits: of the fingerprint, 64 for each word; segments: pieces that
    are indexed, of bits // segments bits or one more; max_bits: differing bits that may link;
    similarity: Jaccard similarity that a link needs besides (see ``near``), if any."""

    shingle: int = 3
    bits: int = 64
    segments: int = 2
    max_bits: int = 2
    similarity: float = 0.0
    together: int = 4096

    @property
    def cuts(self) -> list[tuple[int, int]]:
        return [(self.bits * i // self.segments, self.bits * (i + 1) // self.segments) for i in range(self.segments)]

    @property
    def whole(self) -> bool:
        """Whether every pair within max_bits is found for certain."""
        return 2 * self.segments > self.max_bits


#: Links of 2 bits on 3-word shingles, all of them.
STRICT = Near()
#: 5-word shingles at a Jaccard similarity of 0.8: fingerprints bring the closest texts together,
#: ``near`` finds the rest and checks them all.
SIMILAR = Near(shingle=5, bits=96, segments=4, max_bits=28, similarity=0.8)

#: Fixed odd numbers that make further words of a fingerprint from a shingle's hash.
_ODD = np.random.default_rng(42).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _turned(h: np.ndarray, word: int) -> np.ndarray:
    """Hashes for this word of a fingerprint: the first word's are the shingles' own."""
    if not word:
        return h
    h = h * _ODD[word]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    """The words of a whole text; A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int) -> list[bytes]:
    """The shingles of a whole text, repeats included; A-Z are lower-cased."""
    parts = words(text)
    if not parts:
        return []
    line, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    k = min(k, len(parts))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [line[a:b] for a, b in zip(starts, ends[k - 1 :], strict=False)]


def hashes(text: str | None, near: Near) -> np.ndarray:
    """The hashes of a whole text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    pieces = shingles(text, near.shingle)
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))


def folded(hashes: np.ndarray, near: Near) -> np.ndarray:
    n_words = -(-near.bits // 64)
    out = np.zeros(n_words, np.uint64)
    if not len(hashes):
        return out
    for w in range(n_words):
        columns = _turned(hashes, w).view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BYTES for j in range(8)])
        out[w] = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    if near.bits % 64:
        out[-1] &= np.uint64((1 << near.bits % 64) - 1)
    return out


def fingerprint(text: str | None, near: Near = STRICT) -> np.ndarray:
    """The fingerprint of a whole text as bits // 64 (rounded up) unsigned words; bit i is 1 if set
    in over half of the shingles' hashes. A-Z are lower-cased; shingles count as often as they occur."""
    return folded(hashes(text, near), near)


def fingerprints(docs: DataFrame, near: Near = STRICT) -> DataFrame:
    """(doc_id, fp binary: little-endian unsigned words)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, near).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return by_arrow(unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, fp binary")


def as_words(names: list[bytes], near: Near) -> np.ndarray:
    """The fingerprints at the ends of names, a row of words each."""
    width = 8 * -(-near.bits // 64)
    return np.frombuffer(b"".join([x[-width:] for x in names]), np.uint64).reshape(len(names), -1)


def variants(fps: np.ndarray, near: Near) -> np.ndarray:
    """For each fingerprint a key for each variant with one bit of one segment left out."""
    bits, keys = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little"), []
    for s, (a, b) in enumerate(near.cuts):
        value = bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64))
        drop = np.arange(b - a, dtype=np.int64)
        keys.append(((value[:, None] & ~(1 << drop)[None]) << 16) | ((s << 8) | drop)[None])
    return np.concatenate(keys, axis=1)


def _filed(nodes: DataFrame, near: Near) -> DataFrame:
    """A row (key, fp) for each variant with one bit left out. fp is a name that ends in a fingerprint."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = variants(as_words(batch.column("fp").to_pylist(), near), near)
        at = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("fp").take(at)], ["key", "fp"])

    return by_arrow(nodes, work, "key long, fp binary")


def _forest(fps: np.ndarray, max_bits: int, halves: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Edges (i, j, differing bits) of a spanning forest of least distances of the graph of
    fingerprints within max_bits; with halves, only pairs across the two halves are looked at. It
    grows from a row by the closest row that is left: memory follows the group."""
    n, found, none = len(fps), [], 64 * fps.shape[1] + 1
    if n == 2:
        far = int(np.bitwise_count(fps[0] ^ fps[1]).sum())
        return [(0, 1, far)] if far <= max_bits and (halves is None or halves[0] != halves[1]) else []
    best, via, left, i = np.full(n, none, np.int16), np.zeros(n, np.int64), np.arange(1, n), 0
    while len(left):
        far = np.bitwise_count(fps[left, 0] ^ fps[i, 0]).astype(np.int16)
        for w in range(1, fps.shape[1]):
            far += np.bitwise_count(fps[left, w] ^ fps[i, w])
        closer = far < best[left]
        if halves is not None:
            closer &= halves[left] != halves[i]
        best[left[closer]], via[left[closer]] = far[closer], i
        at = int(np.argmin(best[left]))
        i = int(left[at])
        if best[i] <= max_bits:
            found.append((int(via[i]), i, int(best[i])))
        left = np.delete(left, at)
    return found


def _edges(filed: DataFrame, near: Near, blocks: bool) -> DataFrame:
    """Rows sorted by key become (a, b, far, key, big): links of forests, or, without blocks, the
    members of a key that holds too many (a is the fingerprint, big is set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[tuple[bytes, bytes]] = set()

        def group(key: int, names: list[bytes], sides: list[np.ndarray]) -> Iterator[tuple]:
            for i, j, far in _forest(as_words(names, near), near.max_bits, np.concatenate(sides) if blocks and (key & 1) else None):
                edge = tuple(sorted((names[i], names[j])))
                if edge not in said:
                    if len(said) > 200_000:
                        said.clear()
                    said.add(edge)
                    yield (*edge, far, 0, False)

        def rows() -> Iterator[tuple]:
            now, raw, sides, held, over = None, [], [], 0, False
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column("key").to_numpy(zero_copy_only=False)
                names = batch.column("fp").to_pylist()
                side = batch.column("side").to_numpy(zero_copy_only=False) if blocks else np.zeros(len(keys), np.int32)
                cuts = np.flatnonzero(np.diff(keys)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                    if keys[a] != now:
                        if held > 1 and not over:
                            yield from group(now, raw, sides)
                        now, raw, sides, held, over = keys[a], [], [], 0, False
                    raw += names[a:b]
                    sides.append(side[a:b])
                    held += b - a
                    if not blocks and held > near.together:
                        over = True
                    if over:
                        for name in raw:
                            yield name, None, 0, int(now), True
                        raw, sides = [], []
            if held > 1 and not over:
                yield from group(now, raw, sides)

        out: list[tuple] = []
        for row in rows():
            out.append(row)
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return filed.mapInArrow(run, "a binary, b binary, far int, key long, big boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, far, key, big = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(far, pa.int32()), pa.array(key, pa.int64()), pa.array(big, pa.bool_())],
        ["a", "b", "far", "key", "big"],
    )


def links(nodes: DataFrame, near: Near = STRICT) -> DataFrame:
    """(a, b, far): links between different fingerprints that give the same components as all links."""
    filed = _filed(nodes, near).repartition("key").sortWithinPartitions("key")
    found = table(_edges(filed, near, False), "links")
    big = found.where("big").select("key", F.col("a").alias("fp"))
    parts = big.groupBy("key").agg(F.ceil(2 * F.count("*") / near.together).cast("int").alias("parts"))
    blocks = table(
        big.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int")), "blocks"
    )
    # a member meets every block: (i, j) with i <= j; odd keys hold two halves, even ones a block by itself
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(-2))
        .bitwiseOR((F.col("own") != F.col("other")).cast("long")).alias("key"),
        "fp",
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    across = _edges(pairs.repartition("key").sortWithinPartitions("key", "side"), near, True)
    return found.where("not big").select("a", "b", "far").union(across.select("a", "b", "far")).distinct()


def components(edges: DataFrame, label: str = "components", rounds: int = 200) -> DataFrame:
    """(fp, root): the least name each name of the edges (a < b) reaches. Alternating large-star
    and small-star rounds; each round is written, and hot centres are aggregated before any join."""
    now = table(edges.select("a", "b").where("a <> b").distinct(), label)
    if not now.head(1):
        return now.select(F.col("b").alias("fp"), F.col("a").alias("root"))
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour of u points to the least name around u
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = table(large, label)
        # small star: u and its smaller neighbours point to the least of them
        lower = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(low, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        small = small.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        after = table(small, label)
        stars = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").head(1) or after.join(after.select(F.col("b").alias("a")), "a", "left_semi").head(1)
        now = after
        if not stars:
            return now.select(F.col("b").alias("fp"), F.col("a").alias("root")).union(now.select(F.col("a").alias("fp"), F.col("a").alias("root"))).distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(docs: DataFrame, near: Near = STRICT) -> DataFrame:
    """(doc_id, fp, component_id): one row for each document.

    A fingerprint's name begins with its smallest doc_id in an order-keeping form, so the least name
    of a component tells its id and nothing is gathered by component. With a similarity the second
    column is the digest of ``near.groups``."""
    if near.similarity:
        from textspan.llm import near as texts

        return texts.groups(docs, near)
    fps = table(fingerprints(docs, near), "fingerprints")
    sign = F.lit(-(1 << 63))
    number = F.unhex(F.lpad(F.hex(F.coalesce(F.col("least"), F.lit(0)).bitwiseXOR(sign)), 16, "0"))
    name = F.concat(F.when(F.col("least").isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number, F.col("fp"))
    nodes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("name", name), "nodes")
    found = table(components(links(nodes.select(F.col("name").alias("fp")), near)), "roots")
    roots = found.select(F.col("fp").alias("name"), "root")
    root = F.coalesce("root", "name")
    # 16 hex digits as an unsigned number, brought back to the signed one
    least = F.conv(F.hex(F.substring(root, 2, 8)), 16, -10).cast("long").bitwiseXOR(sign)
    named = nodes.join(roots, "name", "left").select("fp", F.when(F.hex(F.substring(root, 1, 1)) == "00", least).alias("component_id"))
    return fps.select("doc_id", "fp").join(named, "fp")


def hexed(fp: str, bits: int = 64):
    """Hex digits, the highest bit first: bytes of each word are turned round."""
    n = -(-bits // 64)
    parts = [F.substring(fp, 8 * w + 8 - b, 1) for w in reversed(range(n)) for b in range(8)]
    return F.lower(F.hex(reduce(lambda x, y: F.concat(x, y), parts)))


def op1(docs: DataFrame) -> DataFrame:
    return classes(docs, STRICT).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, near: Near = SIMILAR) -> DataFrame:
    """``near.dedup``: one document of each group of texts at the similarity."""
    from textspan.llm import near as texts

    return texts.dedup(docs, near)
