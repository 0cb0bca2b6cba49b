"""Token-ID files: flat unsigned 16-bit ids and 24-byte index records, made to be memory-mapped.

Layout below a folder, a pair of files for each shard (shards are contiguous ranges of the documents
in ascending doc_id order)::

    ids/N.u16    ids of all its documents, little-endian unsigned 16-bit
    index/N.idx  a record for each document: doc_id int64, first id's number uint64, 1 if the
                 doc_id is not null uint64

Every document ends with the end id, so a document runs to the next record's start or the end of
its shard's ids. Starts count through all shards: shard bases are prefix sums of shard totals.

Documents are dealt once, by ranges of doc_id, and tokenised behind that exchange: each task writes
its shard's ids as they come. A file gets its name when it is complete, and a task that runs again
writes the same bytes, so a lost executor leaves nothing half done. Files go through Arrow's file
systems (local or mounted folders, HDFS, S3, GCS).

Null text counts as empty (the end id alone). Null doc_ids come first. Rows with equal doc_id lie
next to each other, ordered by a hash of their texts; equal rows may be parted between shards, so
none of them makes a shard large. An empty table gives an empty result and no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspan.llm.common import SLICE_BYTES, scratch, table, unambiguous

END_ID = 1
#: Bytes of text, and 16 for each document, that a shard should hold.
SHARD_BYTES = 16 << 20
#: Texts whose words are made distinct together.
TOGETHER = 1024
#: Bare words whose ids a worker keeps, about.
KEPT = 320_000
RECORD = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("named", "<u8")])


class Words:
    """Ids of whole texts by way of their distinct words, as bytes.

    This vocabulary drops white space and no match of its pattern or normaliser reaches across it, so
    a text's ids are its blank-separated words' ids in a row. A word of Latin letters (one match)
    has the ids of its lower case, and one of ``.,;:!?`` behind it is a match of its own; every other
    word is given to the library as it stands. Words are split, made distinct and put back by Arrow;
    the library sees each bare word once, many in one text: the last id of a match ends a word.
    A vocabulary whose rules differ (``PROBE`` tells) is left to the library, text by text."""

    PROBE = ("A word, Another?  it's 12\tÉté naïve;\nx.y end", "don't <b> #tag STRASSE ß! 中文 a_b (c) d.", "The the THE thE.")

    LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
    MARKS = ".,;:!?"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.marks = pa.array([b"", *self._each(list(self.MARKS))], pa.binary())
        self.by_words = True
        try:
            self.by_words = self.encode(pa.array(self.PROBE)).to_pylist() == self._each(list(self.PROBE))
        except ValueError:
            self.by_words = False

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _bare(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one match each."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a vocabulary without word ends")
            raw, starts = ids.tobytes(), [0, *(2 * ends[:-1]).tolist()]
            self.known.update(zip(some, [raw[a:b] for a, b in zip(starts, (2 * ends).tolist(), strict=True)], strict=True))
        return [self.known[w] for w in words]

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        marked = pc.match_substring_regex(words, f"^{self.LETTER}+[{self.MARKS}]$")
        simple = pc.or_(marked, pc.match_substring_regex(words, f"^{self.LETTER}+$"))
        some = words.filter(simple)
        tail = pc.utf8_slice_codeunits(some, -1)
        mark = pc.fill_null(pc.index_in(tail, pa.array(list(self.MARKS))), -1)
        bare = pc.utf8_lower(pc.replace_substring_regex(some, f"[{self.MARKS}]$", "")).dictionary_encode()
        ids = pa.array(self._bare(bare.dictionary.to_pylist()), pa.binary()).take(bare.indices)
        ids = pc.binary_join_element_wise(ids, self.marks.take(pc.add(mark, 1)), b"")
        other = pa.array(self._each(words.filter(pc.invert(simple)).to_pylist()), pa.binary())
        place = np.empty(len(words), np.int64)
        chosen = simple.to_numpy(zero_copy_only=False)
        place[chosen], place[~chosen] = np.arange(len(ids)), len(ids) + np.arange(len(other))
        return pa.concat_arrays([ids, other]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text; none for null."""
        if not self.by_words:
            return pa.array(self._each([t or "" for t in texts.to_pylist()]), pa.binary())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        if not len(words):
            return pa.array([b""] * len(texts), pa.binary())
        ids = self._distinct(words.dictionary).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
        offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends[offsets].astype(np.int32)), ids.buffers()[2]])


#: One for each vocabulary in a worker process, which serves many tasks.
_HELD: dict[str, Words] = {}


def _vocabulary(path: str | None) -> Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return _HELD.get(path) or _HELD.setdefault(path, Words(path))


class _File:
    """Bytes that get their name when all are written."""

    def __init__(self, folder: str, name: str) -> None:
        import uuid

        from pyarrow import fs

        self.store, at = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.store.create_dir(at, recursive=True)
        self.name, self.draft = f"{at}/{name}", f"{at}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft)

    def write(self, raw: bytes | memoryview | pa.Buffer) -> None:
        self.out.write(raw)

    def done(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.name)


def _ranged(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(doc_id, text) in order, a partition for each shard."""
    rows = unambiguous(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16)).first()[0] or 0
    keys = ["doc_id", "h", "row"]
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    return keyed.repartitionByRange(max(1, -(-size // shard_bytes)), *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write(docs: DataFrame, folder: str, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> bool:
    """Write the files; False if there is nothing to write."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from textspan.llm import tokenfile

        shard, file, at = TaskContext.get().partitionId(), None, 0
        end = pa.scalar(np.uint16(END_ID).tobytes(), pa.binary())
        for whole in batches:
            step = max(1, min(TOGETHER, whole.num_rows * SLICE_BYTES // max(whole.nbytes, 1)))
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                words = tokenfile._vocabulary(path)
                ids = pc.binary_join_element_wise(words.encode(batch.column("text")), end, pa.scalar(b"", pa.binary()))
                file = file or tokenfile._File(f"{folder}/ids", f"{shard}.u16")
                ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
                file.write(ids.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])))
                n = np.asarray(pc.binary_length(ids)).astype(np.int64) // 2
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), batch.column("doc_id"), pa.array(starts), pa.array(n)], ["shard", "doc_id", "start", "n"])
                pa.default_memory_pool().release_unused()
        if file:
            file.done()

    rows = table(_ranged(docs, shard_bytes).mapInArrow(save, "shard int, doc_id long, start long, n long"), "token-index")
    totals = table(rows.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("shard") / 1024)), "shard-totals")
    if not totals.head(1):
        return False
    # prefix sums in two steps: of a thousand shards at a time, then of their sums
    upto = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", upto(Window.orderBy("block")).alias("below"))
    bases = totals.withColumn("before", upto(Window.partitionBy("block").orderBy("shard"))).join(blocks, "block")
    bases = bases.select("shard", (F.col("below") + F.col("before")).alias("base"))

    def index(t: pa.Table) -> pa.Table:
        from textspan.llm import tokenfile

        starts = t.column("start").to_numpy() + t.column("base").to_numpy()
        order = np.argsort(starts, kind="stable")
        records = np.zeros(len(starts), RECORD)
        ids = t.column("doc_id").combine_chunks()
        records["doc_id"] = np.asarray(pc.fill_null(ids, 0))[order]
        records["start"], records["named"] = starts[order], np.asarray(pc.is_valid(ids))[order]
        shard = t.column("shard")[0].as_py()
        file = tokenfile._File(f"{folder}/index", f"{shard}.idx")
        file.write(records.tobytes())
        file.done()
        return pa.table({"shard": pa.array([shard], pa.int32())})

    table(rows.join(bases, "shard").groupBy("shard").applyInArrow(index, "shard int"), "indexed")
    return True


def mapped_shards(folder: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Memory maps (ids, records) of each shard of a local folder, in order."""
    from pathlib import Path

    found = sorted(Path(folder, "index").glob("*.idx"), key=lambda p: int(p.stem))
    return [(np.memmap(Path(folder, "ids", f"{p.stem}.u16"), "<u2", "r"), np.memmap(p, RECORD, "r")) for p in found]


def read(spark: SparkSession, folder: str, local: bool | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): every document from the files; with digest the CRC of its
    ids as 32-bit integers, ids_crc32, in place of them.

    Spark lists the index files; tasks map them and the ids beside them where the folder is a plain
    file system, and read them through Arrow elsewhere."""
    local = folder.startswith(("file:", "/")) if local is None else local
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(f"{folder}/index").select("path")

    def opened(path: str, dtype) -> np.ndarray:
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        if local:
            return np.memmap(unquote(urlparse(path).path), dtype, "r")
        store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        with store.open_input_file(at) as f:
            return np.frombuffer(f.read(), dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                top, _, name = path.rpartition("/index/")
                records, raw = opened(path, RECORD), opened(f"{top}/ids/{name[:-4]}.u16", "<u2")
                starts = records["start"].astype(np.int64)
                local_starts = starts - starts[0]
                ends = np.append(local_starts[1:], len(raw))
                for at in range(0, len(records), 1024):
                    part = slice(at, at + 1024)
                    each = (raw[a:b] for a, b in zip(local_starts[part], ends[part], strict=True))
                    ids = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()) if digest else pa.array([x.tobytes() for x in each], pa.binary())
                    names = pa.array(records["doc_id"][part].astype(np.int64), mask=records["named"][part] == 0)
                    yield pa.RecordBatch.from_arrays([names, pa.array(starts[part]), pa.array(ends[part] - local_starts[part]), ids], ["doc_id", "start", "n_tokens", last.split()[0]])

    last = "ids_crc32 long" if digest else "ids binary"
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op8(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    if not write(docs, folder):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, digest=True)
