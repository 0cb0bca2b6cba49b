"""Byte-level BPE by a monoid tree reduction.

A text is cut in halves down to leaves, short and long texts alike; a leaf becomes its pattern matches
(pieces) with their tokens. Two neighbours are joined by encoding a window around their seam again:

* Pieces: the window starts at the first piece of the left part that more text could change and grows
  to the right until it ends where the right part has a boundary. Both ends are provable, since a
  match depends only on what follows its start: a left piece is settled if the pattern's choice there
  looked at no character at or beyond the seam, and from a boundary shared with the right part on,
  the same text follows.
* Tokens, where the seam lies inside a piece (and for every piece longer than ``BYTES``, which is cut in
  halves in turn): some tokens on either side of the seam are merged again from bytes, more of them each
  time, until the outermost ones come out as they were. Tokens are a piece's encoding if and only if
  every two neighbours encode to themselves, so all tokens outside the window are settled then.

Pieces and tokens outside the windows stay. The operation is associative with the empty text as unit;
decoding concatenates bytes up the same tree.

Null text counts as empty: no tokens. Very long texts, and very long pieces, cost one task memory in
proportion to the text. Nothing but doc_id and text is read; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspan.llm.common import by_arrow, unambiguous

#: Characters of a leaf, bytes of a piece that is merged as a whole, tokens of a leaf in decoding.
LEAF, BYTES, DECODED = 512, 64, 1 << 14
#: Pieces whose tokens a worker keeps at most.
KEPT = 150_000
#: Above every rank.
_NONE = 1 << 62
#: A contraction looks at three characters from its start on.
LOOK = 3


def read_ranks(path: str) -> dict[bytes, int]:
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(a): int(b) for a, b in rows}


#: Pieces in order, and the tokens of each.
Node = tuple[list[str], list[list[int]]]


def _half(n: int) -> int:
    """Where to cut: a power of two, since tokens of long runs mostly have such lengths and so meet the cuts."""
    return 1 << (n - 1).bit_length() - 1


class Codec:
    """Pattern, ranks and the tree."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(ranks_path)
        self.all = regex.compile(pattern).findall
        self.match = regex.compile(pattern).match
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.known: dict[str, list[int]] = {}

    # tokens of one piece
    def merged(self, raw: bytes) -> list[int]:
        """Merges from single bytes, the pair of least rank first, the leftmost of equal ones."""
        n = len(raw)
        if n > BYTES:
            return self._merged_long(raw)
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(n)]
        pairs = [rank(raw[i : i + 2], _NONE) for i in range(n - 1)]
        while pairs and (least := min(pairs)) != _NONE:
            i = pairs.index(least)
            del pairs[i]
            parts[i] += parts.pop(i + 1)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, raw: bytes) -> list[int]:
        """The same with a heap over a linked list: parts are named by where they start."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(raw[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def weld(self, left: list[int], right: list[int]) -> list[int]:
        """The merges of both byte strings together, from the merges of each."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            some = self.merged(b"".join([self.bytes_of[t] for t in left[len(left) - a :] + right[:b]]))
            first = a == len(left) or some[0] == left[-a]
            last = b == len(right) or some[-1] == right[b - 1]
            if first and last:
                return left[: len(left) - a] + some + right[b:]
            a, b = (a if first else 2 * a), (b if last else 2 * b)

    def halved(self, raw: bytes) -> list[int]:
        if len(raw) <= BYTES:
            return self.merged(raw)
        half = _half(len(raw))
        return self.weld(self.halved(raw[:half]), self.halved(raw[half:]))

    def tokens(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)  # a piece in the vocabulary is its own token, whatever merges say
            found = [whole] if whole is not None else self.halved(raw)
            if len(piece) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _across(self, piece: str, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> list[int]:
        """Tokens of a piece that is one piece of either side."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        # a single token may be no merge of its bytes
        sides = [self.halved(p.encode("utf-8", "surrogatepass")) if len(t) == 1 else t for p, t in (left, right)]
        return self.weld(*sides)

    # the tree
    def join(self, left: Node, right: Node) -> Node:
        """The pieces and tokens of the text of both; left is used up."""
        pieces, toks = left
        if not pieces or not right[0]:
            return left if pieces else right
        # settled: ends before the seam with a character after it in sight, and LOOK fits as well
        window, beyond = [pieces.pop()], len(right[0])
        while pieces and len(window[-1]) + sum(map(len, window[:-1])) < LOOK:
            window.append(pieces.pop())
        # a blank run's last piece and what follows were chosen together: go back over blanks
        while pieces and pieces[-1].isspace():
            window.append(pieces.pop())
        if pieces:
            window.append(pieces.pop())
        last = (window[0], toks[-1])
        del toks[len(pieces) :]
        text, at, i = "".join(reversed(window)), 0, 0
        bound = len(text)
        seams, start = {bound}, bound - len(last[0])
        while True:
            # have some settled text beyond every match that is taken
            m = self.match(text, at) if at < len(text) else None
            ends = m.end() if m else at
            if m and (i == beyond or (ends < len(text) and at + LOOK <= len(text) and not self._open(text, ends))):
                piece = m.group()
                pieces.append(piece)
                if at == start and ends == bound + len(right[0][0]) and len(piece) > 64:
                    toks.append(self._across(piece, last, (right[0][0], right[1][0])))
                else:
                    toks.append(self.tokens(piece))
                at = ends
                if at >= bound and at in seams:
                    break
            elif i < beyond:
                text += right[0][i]
                i += 1
                seams.add(len(text))
            else:
                break
        # the pieces of right that begin at or after ``at`` are its own
        used, k = bound, 0
        while used < at:
            used += len(right[0][k])
            k += 1
        pieces.extend(right[0][k:])
        toks.extend(right[1][k:])
        return pieces, toks

    @staticmethod
    def _open(text: str, end: int) -> bool:
        """Whether a match that ends here might end elsewhere with more text: the blanks after
        it reach the end of what is in sight."""
        return text[end:].isspace()

    def node(self, text: str) -> Node:
        if len(text) <= LEAF:
            pieces = self.all(text)
            known, tokens = self.known.get, self.tokens
            return pieces, [known(p) or tokens(p) for p in pieces]
        half = _half(len(text))
        return self.join(self.node(text[:half]), self.node(text[half:]))

    def pieces(self, text: str) -> list[str]:
        return self.node(text)[0]

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(self.node(text)[1]))

    def decode(self, ids: array) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= DECODED:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: One for each vocabulary in a worker process, which serves many tasks.
_HELD: dict[tuple, Codec] = {}


def _codec(ranks_path: str | None, pattern: str | None) -> Codec:
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    key = (ranks_path, pattern)
    return _HELD.get(key) or _HELD.setdefault(key, Codec(*key))


def _here(ranks_path: str | None, pattern: str | None) -> Codec:
    """By the module that the worker imports, so that its codec stays."""
    from textspan.llm import bpe

    return bpe._codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit). The vocabulary is read where the
    work is, from a path every machine has."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _here(ranks_path, pattern)
        ids = [codec.encode(t or "").tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return by_arrow(unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, ids binary")


def decode(rows: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, raw binary)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _here(ranks_path, pattern)
        raw = [codec.decode(array("I", i)) for i in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    return by_arrow(rows.select("doc_id", "ids"), work, "doc_id long, ids binary, raw binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, raw): encode and decode by one worker, which holds one vocabulary."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _here(ranks_path, pattern)
        ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        raw = [codec.decode(i) for i in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])

    return by_arrow(unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, ids binary, raw binary")


def op7(docs: DataFrame) -> DataFrame:
    """Digests of ids and of the bytes decoded from them."""
    return round_trip(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


