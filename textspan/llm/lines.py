"""Line dedup by content-defined chunks of lines.

A text is cut at line feeds; a chunk ends after a line where the rolling hash over the hashes of
the last ``window`` lines has ``bits`` zero bits, so that lines put in before it don't move its
bounds. A chunk of ``least`` or more lines with a word, and ``letters`` or more characters, that
occurs before, in a document of smaller doc_id or earlier in the same one, is removed. Chunks are
grouped by their bytes themselves, pre-aggregated before the shuffle; a 128-bit name is carried on.

Null text stays null, with no lines. Empty text is one blank line and stays. Null doc_id is
ordered first. Rows that share a doc_id count as one document repeated: if their texts agree,
their chunks are equal in place and the first row's stay with all of them. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspan.llm.common import by_arrow, table, unambiguous


@dataclass(frozen=True)
class Cuts:
    window: int = 2
    bits: int = 1
    least: int = 2
    letters: int = 40


def chunks(text: str, cuts: Cuts = Cuts()) -> list[tuple[int, int]]:
    """(start, end) of the chunks among the text's lines, which they cover."""
    from xxhash import xxh64_intdigest

    lines = text.split("\n")
    hashes = [xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    mask, keep, rolling, out, start = (1 << cuts.bits) - 1, (1 << 64) - 1, 0, [], 0
    # each line's hash is turned by a place for each line since; the oldest leaves the window
    turn = lambda x, n: ((x << n) | (x >> 64 - n)) & keep if n else x
    for i, h in enumerate(hashes):
        rolling = turn(rolling, 1) ^ h
        if i >= cuts.window:
            rolling ^= turn(hashes[i - cuts.window], cuts.window % 64)
        if rolling & mask == 0 and i + 1 - start >= cuts.least:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def removable(lines: list[str], cuts: Cuts) -> bool:
    return sum(bool(x.strip(" \t\n\r\x0b\f")) for x in lines) >= cuts.least and sum(map(len, lines)) >= cuts.letters


def name_of(body: str) -> bytes:
    from hashlib import blake2b

    return blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _chunked(docs: DataFrame, cuts: Cuts) -> DataFrame:
    """(doc_id, at, name, body) of removable chunks; body as it stands in the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, ats, names, bodies = [], [], [], []
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if t is None:
                continue
            lines = t.split("\n")
            for a, b in chunks(t, cuts):
                if removable(lines[a:b], cuts):
                    body = "\n".join(lines[a:b])
                    ids.append(d)
                    ats.append(a)
                    bodies.append(body)
                    names.append(name_of(body))
        if not ids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(names, pa.binary()), pa.array(bodies, pa.string())], ["doc_id", "at", "name", "body"])

    return by_arrow(docs, work, "doc_id long, at int, name binary, body string")


def removals(docs: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(doc_id, gone array<struct<at, name>>): first lines and names of the chunks each document loses."""
    found = _chunked(unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), cuts)
    # grouped by the bytes: what is equal in name alone stays apart
    bodies = found.groupBy("name", "body").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    repeated = table(bodies.where("n > 1").select("name", "first"), "repeated-chunks")
    # as many as chunks repeat: not a size to broadcast
    again = found.select("doc_id", "at", "name").join(repeated.hint("merge"), "name")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    return again.where(later).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("at", "name"))).alias("gone"))


def cleaned(docs: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """docs, any columns, with the repeated chunks cut from text, and n_lines, n_removed (lines)."""
    names = docs.columns
    lower = [c.lower() for c in names]
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = (f"c{names.index(n) if n in names else lower.index(n)}" for n in ("doc_id", "text"))
    gone = table(removals(docs, cuts), "removals").withColumnRenamed("doc_id", "__id")
    columns = plain.columns
    joined = plain.join(gone.hint("merge"), plain[key].eqNullSafe(gone["__id"]), "left").drop("__id")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, removed = [], [], []
        for t, cut in zip(batch.column(text).to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = [] if t is None else t.split("\n")
            n = 0
            if lines and cut:
                ends, left, at = dict(chunks(t, cuts)), [], 0
                for a, name in ((x["at"], x["name"]) for x in cut):
                    # rows may share a doc_id: only the very chunk goes
                    if a in ends and name_of("\n".join(lines[a : ends[a]])) == name:
                        left += lines[at:a]
                        at = ends[a]
                        n += at - a
                t = "\n".join(left + lines[at:])
            kept.append(t)
            total.append(len(lines))
            removed.append(n)
        arrays = [pa.array(kept, pa.string()) if c == text else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*columns, "n_lines", "n_removed"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*plain.schema.fields]).add("n_lines", LongType()).add("n_removed", LongType())
    return by_arrow(joined, work, schema).toDF(*names, "n_lines", "n_removed")


def op6(docs: DataFrame) -> DataFrame:
    few = unambiguous(docs, "doc_id", "text")
    return cleaned(few).select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
