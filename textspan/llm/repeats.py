"""Removal of byte strings that documents of smaller doc_id hold too, by distributed prefix doubling.

Positions are ranked by their first bytes and the ranks of pairs at growing offsets are ranked
again; a position whose rank is its own can't repeat and drops out; past the threshold length, what
shares a rank repeats. To keep what Spark moves near the size of the input:

* Round 1 ranks the first ``sampled`` bytes at anchors only: the position of the least fingerprint
  among every length - sampled + 1 in a row. Equal strings have their anchor at the same place, so a
  string whose anchor occurs in one document only is unique and drops out. Names of anchors go to
  their partition in packed blocks; a bit or two for each comes back. A name shared by chance only
  keeps a position in the race.
* Round 2 sends each anchor that is left once, with the bytes that its strings can reach, to the
  partition of its name, where strings are ranked by 8-byte words, then pairs, then pairs of pairs
  up to ``length`` bytes: bytes are compared, not hashes. The first document of each rank keeps it.
* An anchor with more than ``hot`` places is split: its strings go by themselves, named by 128
  bits, once for each pack, to the partitions of their own names.

Documents travel in packs of whole texts (a text longer than a pack is one pack; it is worked on
in segments). Matches never cross documents. Null or short texts lose nothing; null text has 0
bytes. A null doc_id counts as larger than all others; rows with the same doc_id don't remove
from each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspan.llm.common import table, unambiguous

NO_ID = (1 << 63) - 1
_PLACE = 21
_LOW = np.uint64((1 << _PLACE) - 1)


@dataclass(frozen=True)
class Plan:
    length: int = 50
    sampled: int = 24
    hot: int = 2048
    pack: int = 4 << 20
    part: int = 8 << 20
    segment: int = 1 << 17
    together: int = 20_000

    @property
    def left(self) -> int:
        return self.length - self.sampled

    @property
    def reach(self) -> int:
        return self.left + self.length


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(32))) * _u(0xD6E8FEB86659FD93)
    return x ^ (x >> _u(29))


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    return np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw).data, strides=(1,))


_ODD = np.random.default_rng(50).integers(0, 1 << 63, 32, np.uint64) * np.uint64(2) + np.uint64(1)


def names_at(raw: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes (a multiple of 8) from each position on."""
    words, n = _words(raw), len(raw) - length + 1
    total = words[:n] * _ODD[0]
    for j in range(1, length // 8):
        total += words[8 * j : 8 * j + n] * _ODD[j]
    return _mix(total)


@dataclass
class Anchors:
    """One row for each run of strings with the same anchor: its place, its name, and the first
    string's start and their number."""

    place: np.ndarray
    name: np.ndarray
    first: np.ndarray
    count: np.ndarray


def anchors(raw: np.ndarray, ends: np.ndarray, plan: Plan) -> Anchors:
    """Of a pack, segment by segment. ends: where each document ends."""
    width, n, found = plan.length - plan.sampled + 1, len(raw), []
    whole = np.ones(n, bool)  # a string that starts here ends in its document
    for b in ends.tolist():
        whole[max(0, b - plan.length + 1) : b] = False
    for a in range(0, n - plan.length + 1, plan.segment):
        b = min(a + plan.segment, n - plan.length + 1)
        names = names_at(raw[a : b + plan.length - 1], plan.sampled)
        # another order than that of names, whose ranges are parts
        low = (names * _ODD[31] & ~_LOW) | np.arange(len(names), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        place = (low[: b - a] & _LOW).astype(np.int32)
        inside = whole[a:b]
        new = np.append(True, (place[1:] != place[:-1]) | ~inside[:-1]) & inside
        first = np.flatnonzero(new)
        if len(first):
            stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
            found.append((place[first] + np.int64(a), names[place[first]], first + a, stop - first))
    if not found:
        return Anchors(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64)))
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _part_of(name: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of names."""
    return ((name >> _u(40)) * _u(parts) >> _u(24)).astype(np.int64)


def _documents(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, doc_ids, ends) of a pack."""
    text = np.frombuffer(pa.decompress(row["text"], row["length"], "zstd", asbytes=True), np.uint8)
    return text, np.frombuffer(row["ids"], np.int64), np.cumsum(np.frombuffer(row["sizes"], np.int64))


def _owners(ids: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(ends, at, side="right")]


def _distinct(found: Anchors, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names in order, count with the highest bit for several documents) of a pack's anchors."""
    order = np.argsort(found.name)
    name, owner = found.name[order], np.searchsorted(ends, found.place, side="right")[order]
    begins = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
    count = np.minimum(np.diff(np.append(begins, len(name))), 0x7FFF).astype(np.uint16)
    several = np.minimum.reduceat(owner, begins) != np.maximum.reduceat(owner, begins)
    return name[begins], count | (several.astype(np.uint16) << np.uint16(15))


def _by_part(part: np.ndarray) -> list[tuple[int, slice]]:
    """The stretches of a column of parts in order."""
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True)]


def packs(docs: DataFrame, plan: Plan) -> DataFrame:
    """(pack, ids, named, sizes, length, text): whole texts one after the other, compressed. named: 0 where
    doc_id is null, whose id then stands after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, ids, named, texts, held = TaskContext.get().partitionId() << 32, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            text = b"".join(texts)
            small = pa.compress(text, "zstd", asbytes=True)
            return pa.RecordBatch.from_pydict({"pack": [base + seq], "ids": [np.array(ids, np.int64).tobytes()], "named": [bytes(named)], "sizes": [sizes.tobytes()], "length": [len(text)], "text": [small]})

        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(NO_ID if d is None else d)
                named.append(d is not None)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= plan.pack or len(ids) >= 1 << 16:
                    yield row()
                    seq, ids, named, texts, held = seq + 1, [], [], [], 0
        if ids:
            yield row()

    few = unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return few.mapInArrow(run, "pack long, ids binary, named binary, sizes binary, length long, text binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _round_one(packed: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """(pack, part, flags binary): for each of a pack's names in a part 0, 1 (elsewhere too) or 3 (hot too)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            raw, _, ends = _documents(row)
            found = anchors(raw, ends, plan)
            if len(found.name):
                name, count = _distinct(found, ends)
                short, got = name.view(np.uint8).reshape(-1, 8)[:, :6], _by_part(_part_of(name, parts))
                blocks = [short[s].tobytes() + count[s].tobytes() for _, s in got]
                yield pa.RecordBatch.from_pydict({"part": pa.array([g[0] for g in got], pa.int32()), "pack": pa.array([row["pack"]] * len(got), pa.int64()), "block": pa.array(blocks, pa.binary())})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, counts = [], [], []
        for row in _rows(batches):
            n = len(row["block"]) // 8
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(row["block"], np.uint8, 6 * n).reshape(n, 6)
            keys.append((row["pack"], row["part"]))
            names.append(wide.reshape(-1).view(np.uint64))
            counts.append(np.frombuffer(row["block"], np.uint16, n, 6 * n))
        if not keys:
            return
        sizes = [len(x) for x in names]
        name, count = np.concatenate(names), np.concatenate(counts)
        del names
        order = np.argsort(name, kind="stable")
        ranked, count = name[order], count[order]
        begins = np.flatnonzero(np.append(True, np.diff(ranked) != 0))
        many = np.diff(np.append(begins, len(ranked))) > 1
        many |= np.logical_or.reduceat(count >> 15 > 0, begins)
        hot = many & (np.add.reduceat((count & 0x7FFF).astype(np.int64), begins) > plan.hot)
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(ranked))))
        flags = np.empty(len(name), np.uint8)
        flags[order] = (many + 2 * hot.astype(np.uint8))[group]
        cuts = np.cumsum([0, *sizes])
        for at in range(0, len(keys), 256):
            some = range(at, min(at + 256, len(keys)))
            yield pa.RecordBatch.from_pydict(
                {"pack": pa.array([keys[i][0] for i in some], pa.int64()), "part": pa.array([keys[i][1] for i in some], pa.int32()), "flags": pa.array([flags[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())}
            )

    sent = packed.mapInArrow(send, "part int, pack long, block binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(rank, "pack long, part int, flags binary")


def _contexts(row: dict, flags: dict[int, np.ndarray], plan: Plan, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, block) of a pack: what round 2 needs of the anchors that are left."""
    raw, ids, ends = _documents(row)
    found = anchors(raw, ends, plan)
    # names and parts are in the same order, so the parts' flags in a row are those of all names
    known, _ = _distinct(found, ends)
    said = np.concatenate([flags[p] for p in sorted(flags)])
    flag = said[np.searchsorted(known, found.name)]
    out: dict[int, tuple[np.ndarray, ...]] = {}
    plain = np.flatnonzero(flag == 1)
    plain = plain[np.argsort(_part_of(found.name[plain], parts), kind="stable")]
    place = found.place[plain]
    fields = (place, found.first[plain] - place + plan.left, found.count[plain], _owners(ids, ends, place))
    reach = np.arange(-plan.left, plan.length)
    for p, s in _by_part(_part_of(found.name[plain], parts)) if len(plain) else []:
        text = raw[np.clip(place[s][:, None] + reach, 0, len(raw) - 1)]
        out[p] = (*(f[s] for f in fields), text)
    hot_name, hot_owner, hot_at = [], [], []
    hot = np.flatnonzero(flag == 3)
    for a in range(0, len(hot), 1 << 14):
        some = hot[a : a + (1 << 14)]
        n = found.count[some]
        at = np.repeat(found.first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = raw[at[:, None] + np.arange(plan.length)]
        hot_name.append(np.stack([_mix(_row_names(text, s)) for s in (1, 2)], axis=1))
        hot_owner.append(_owners(ids, ends, at))
        hot_at.append(at)
    split: dict[int, tuple[np.ndarray, ...]] = {}
    if hot_at:
        name, owner, at = np.concatenate(hot_name), np.concatenate(hot_owner), np.concatenate(hot_at)
        order = np.lexsort((at, owner, name[:, 1], name[:, 0]))
        name, owner, at = name[order], owner[order], at[order]
        begins = np.flatnonzero(np.append(True, (np.diff(name, axis=0) != 0).any(axis=1)))
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
        least = owner[begins][group]
        # the pack's first document asks; the others lose the string to it for certain
        ask, lose = owner == least, owner > least
        part = _part_of(name[:, 1], parts)
        for p in np.unique(part):
            here = part == p
            split[int(p)] = (name[here & ask], owner[here & ask], at[here & ask], at[here & lose])
    for p in sorted({*out, *split}):
        place, offset, count, owner, text = out.get(p) or (*(np.zeros(0, np.int64),) * 4, np.zeros((0, plan.reach), np.uint8))
        name, hot_ids, hot_places, lost = split.get(p, (np.zeros((0, 2), np.uint64), *(np.zeros(0, np.int64),) * 3))
        head = np.array([len(place), len(hot_places), len(lost)], np.int64)
        yield p, _pressed((
            head.tobytes(), place.astype(np.uint32).tobytes(), offset.astype(np.uint8).tobytes(), count.astype(np.uint8).tobytes(), owner.astype(np.int64).tobytes(),
            text.astype(np.uint8).tobytes(), name.astype(np.uint64).tobytes(), hot_ids.astype(np.int64).tobytes(), hot_places.astype(np.uint32).tobytes(), lost.astype(np.uint32).tobytes(),
        ))


def _row_names(text: np.ndarray, seed: int) -> np.ndarray:
    """One name for each row of bytes."""
    total = np.full(len(text), 0x9E3779B97F4A7C15 * seed & (1 << 64) - 1, np.uint64)
    for j in range(text.shape[1]):
        total = (total ^ text[:, j]) * _u(0x100000001B3 if seed == 1 else 0xD6E8FEB86659FD93)
        total ^= total >> _u(31)
    return total


def _pressed(fields: tuple[bytes, ...]) -> bytes:
    block = b"".join(fields)
    return len(block).to_bytes(8, "little") + pa.compress(block, "zstd", asbytes=True)


class _Block:
    def __init__(self, block: bytes, plan: Plan) -> None:
        block = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
        n, hot, lost = np.frombuffer(block, np.int64, 3)
        at = 24

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(block, kind, count, at)
            at += got.nbytes
            return got

        self.place, self.offset, self.count, self.owner = take(np.uint32, n), take(np.uint8, n), take(np.uint8, n), take(np.int64, n)
        self.text = take(np.uint8, n * plan.reach).reshape(n, plan.reach)
        self.name, self.hot_owner, self.hot_place, self.lost = take(np.uint64, 2 * hot).reshape(hot, 2), take(np.int64, hot), take(np.uint32, hot), take(np.uint32, lost)


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of numbers: equal ones share one."""
    order = np.argsort(values)
    ranked = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])) if len(values) else 0
    return out


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return _dense((first << 32) | second)


def _several(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=1)[rank] > 1


def _steps(length: int) -> list[int]:
    """Where the 8-byte words begin that cover ``length`` bytes."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def _classes(rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Ranks of whole rows of bytes beside a number, by pairs of words."""
    words, width = _words(np.append(rows.reshape(-1), np.zeros(8, np.uint8))), rows.shape[1]
    at = np.arange(len(rows)) * width
    ranks = [_dense(extra), *(_dense(words[at + s]) for s in _steps(width))]
    while len(ranks) > 1:
        ranks = [_pairs(*ranks[i : i + 2]) if i + 1 < len(ranks) else ranks[i] for i in range(0, len(ranks), 2)]
    return ranks[0]


def later(text: np.ndarray, row: np.ndarray, offset: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of ``length`` bytes at offset in text[row], those (numbers) that a string of
    a smaller owner equals: ranks of words, of pairs of words and so on, the unique dropped."""
    words = _words(np.append(text.reshape(-1), np.zeros(8, np.uint8)))
    at, left, steps = row * text.shape[1] + offset, np.arange(len(row)), _steps(length)
    # the first words' pairs for all, the rest for those that are left
    first = _pairs(_dense(words[at + steps[0]]), _dense(words[at + steps[1]]))
    keep = _several(first)
    at, left = at[keep], left[keep]
    ranks = [first[keep], *(_dense(words[at + s]) for s in steps[2:])]
    while len(ranks) > 1 and len(left):
        first = _pairs(ranks[0], ranks[1])
        keep = _several(first)
        rest = [_pairs(ranks[i][keep], ranks[i + 1][keep]) if i + 1 < len(ranks) else ranks[i][keep] for i in range(2, len(ranks), 2)]
        ranks, left = [first[keep], *rest], left[keep]
    if not len(left):
        return left
    dense = _dense(ranks[0])
    least = np.full(dense.max() + 1, NO_ID)
    np.minimum.at(least, dense, owner[left])
    return left[owner[left] > least[dense]]


def removed(anchor: np.ndarray, text: np.ndarray, offset: np.ndarray, count: np.ndarray, owner: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the strings to remove among rows that hold whole groups of an anchor.

    Rows that agree in all they hold are one class: in all but those of its smallest owner every
    string is removed. What is left of an anchor with one class repeats nowhere before."""
    ranks = _pairs(_dense(anchor), _classes(text, offset * 256 + count))
    least = np.full(ranks.max() + 1, NO_ID)
    np.minimum.at(least, ranks, owner)
    gone = owner > least[ranks]
    stand = np.flatnonzero(~gone)
    several = _dense(anchor[stand])
    # one row for a class is enough to compare; its owner's other rows share its lot
    pair = np.zeros(several.max() + 1, np.int64)
    kinds, one = np.unique(ranks[stand], return_index=True)
    np.add.at(pair, several[one], 1)
    open_rows = stand[pair[several] > 1]

    def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[rows]
        return np.repeat(rows, n), np.repeat(offset[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    row, off = spread(open_rows)
    lose = later(text, row, off, owner[row], plan.length) if len(row) else row
    all_row, all_off = spread(np.flatnonzero(gone))
    return np.append(all_row, row[lose]), np.append(all_off, off[lose])


def _round_two(packed: DataFrame, flags: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """(pack, starts binary, counts binary): runs of starts of strings to remove."""

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        flag = {p: np.frombuffer(f, np.uint8) for p, f in zip(right.column("part").to_pylist(), right.column("flags").to_pylist(), strict=True)}
        got = []
        if any(f.any() for f in flag.values()):
            got = [g for row in left.to_pylist() for g in _contexts(row, flag, plan, parts)]
        return pa.table({"part": pa.array([g[0] for g in got], pa.int32()), "pack": pa.array([key[0].as_py()] * len(got), pa.int64()), "block": pa.array([g[1] for g in got], pa.binary())})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blocks = [], []
        for row in _rows(batches):
            keys.append(row["pack"])
            blocks.append(_Block(row["block"], plan))
        if not keys:
            return
        packs_of = np.repeat(np.arange(len(keys)), [len(b.place) for b in blocks])
        place, offset, count, owner, text = (np.concatenate([getattr(b, f) for b in blocks]) for f in ("place", "offset", "count", "owner", "text"))
        found: list[tuple[np.ndarray, np.ndarray]] = [
            (np.full(len(b.lost), i), b.lost.astype(np.int64)) for i, b in enumerate(blocks)
        ]
        # whole groups of an anchor together, some groups at a time
        anchor = names_at(np.ascontiguousarray(text[:, plan.left : plan.left + plan.sampled]).reshape(-1), plan.sampled)[:: plan.sampled] if len(text) else np.zeros(0, np.uint64)
        order = np.argsort(anchor)
        begins = np.flatnonzero(np.append(True, np.diff(anchor[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        a = 0
        while a < len(order):
            more = begins[np.searchsorted(begins, a + plan.together) :]
            b = int(more[0]) if len(more) else len(order)
            some = order[a:b]
            a = b
            row, off = removed(anchor[some], text[some], offset[some].astype(np.int64), count[some].astype(np.int64), owner[some], plan)
            found.append((packs_of[some][row], place[some].astype(np.int64)[row] - plan.left + off))
        if any(len(b.hot_place) for b in blocks):
            name, hot_owner = np.concatenate([b.name for b in blocks]), np.concatenate([b.hot_owner for b in blocks])
            rank_of = _pairs(_dense(name[:, 0]), _dense(name[:, 1]))
            least = np.full(rank_of.max() + 1, NO_ID)
            np.minimum.at(least, rank_of, hot_owner)
            lose = hot_owner > least[rank_of]
            pack_of = np.repeat(np.arange(len(keys)), [len(b.hot_place) for b in blocks])
            found.append((pack_of[lose], np.concatenate([b.hot_place for b in blocks])[lose].astype(np.int64)))
        pack, start = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((start, pack))
        pack, start = pack[order], start[order]
        for i in np.unique(pack):
            mine = start[np.searchsorted(pack, i) : np.searchsorted(pack, i, side="right")]
            begin = np.flatnonzero(np.append(True, np.diff(mine) > 1))
            last = mine[np.append(begin[1:], len(mine)) - 1]
            yield pa.RecordBatch.from_pydict({"pack": pa.array([keys[i]], pa.int64()), "starts": [mine[begin].astype(np.uint32).tobytes()], "counts": [(last - mine[begin] + 1).astype(np.uint32).tobytes()]})

    sent = packed.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(send, "part int, pack long, block binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(rank, "pack long, starts binary, counts binary")


def remove(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>> of removed bytes, kept binary)."""
    if plan.sampled % 8 or plan.length <= plan.sampled or plan.reach > 255 + plan.length:
        raise ValueError("sampled must be a multiple of 8 below length")
    spark = docs.sparkSession
    packed = table(packs(docs, plan), "packs")
    total = packed.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // plan.part))
    flags = table(_round_one(packed, plan, parts), "flags")
    runs = table(_round_two(packed, flags, plan, parts), "runs")

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        raw, ids, ends = _documents(row)
        text = raw.tobytes()
        start = np.concatenate([np.frombuffer(x, np.uint32) for x in right.column("starts").to_pylist()] or [np.zeros(0, np.uint32)]).astype(np.int64)
        end = start + np.concatenate([np.frombuffer(x, np.uint32) for x in right.column("counts").to_pylist()] or [np.zeros(0, np.uint32)]) + plan.length - 1
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
        # maximal runs within documents: a start beyond all ends before, or in the next document
        doc = np.searchsorted(ends, start, side="right")
        begin = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (np.diff(doc) != 0))) if len(start) else np.zeros(0, np.int64)
        spans = [[] for _ in ids]
        for a, b, d in zip(start[begin], np.append(end[begin[1:] - 1], end[-1:]), doc[begin], strict=True):
            spans[d].append((int(a), int(b)))
        kept, cuts = [], []
        for i, (b, s) in enumerate(zip(ends, spans, strict=True)):
            a = int(ends[i - 1]) if i else 0
            at, parts_left = a, []
            for x, y in s:
                parts_left.append(text[at:x])
                at = y
            parts_left.append(text[at : int(b)])
            kept.append(b"".join(parts_left))
            cuts.append([{"start": x - a, "end": y - a} for x, y in s])
        return pa.table({
            "doc_id": pa.array([int(x) if known else None for x, known in zip(ids, row["named"], strict=True)], pa.int64()),
            "n_bytes": pa.array(np.diff(np.append(0, ends))),
            "spans": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
        })

    return packed.groupBy("pack").cogroup(runs.groupBy("pack")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def doubling(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, at): starts of the strings to remove, by prefix doubling of every position in Spark: rows
    (document, position, rank) are paired with the rank at an offset of 1, 2, 4, ..., pairs are sorted and
    ranked again, and what is unique drops out. The plain form of the method; it moves each position that
    is left twice in a round, which is many times the text (see the README), so op5 doesn't take it."""
    few = unambiguous(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    rows = table(few.where(F.length("raw") >= length).withColumn("row", F.monotonically_increasing_id()), "rows")
    byte = F.conv(F.hex(F.substring("raw", F.col("at") + 1, F.lit(1))), 16, 10).cast("long")
    now = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("raw") - 1))).select("doc_id", "row", "at", byte.alias("rank"))
    have, now = 1, table(now, "ranks")
    while have < length:
        step = min(have, length - have)
        after = now.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs = now.join(after, ["row", "at"])
        kinds = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
        parts = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranked = table(kinds.repartitionByRange(parts, "rank", "next").sortWithinPartitions("rank", "next").select("rank", "next", F.monotonically_increasing_id().alias("new")), "kinds")
        now = table(pairs.join(ranked, ["rank", "next"]).select("doc_id", "row", "at", F.col("new").alias("rank")), "ranks")
        have += step
    least = now.groupBy("rank").agg(F.min("doc_id").alias("least"))
    lost = now.join(least, "rank").where("doc_id > least")
    return lost.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "at")


def op5(docs: DataFrame) -> DataFrame:
    return remove(docs).select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
