"""Hilbert-curve sharding by built-in expressions alone.

Metadata dimensions (source, language, size, doc_id) are quantised to equal-depth steps, a cell's
place on the Hilbert curve through them orders the rows, and the order is cut into runs whose
counts are at most one apart (law ``rows``). A shard then covers few cells, so that its min/max
statistics prune on each dimension. Only digests of a row are moved, never its text.

Null text: size 1, crc32 0. Null source, lang or doc_id takes the lowest step. Rows of one cell are
ordered by a hash of doc_id and crc32, then by doc_id, crc32 and size; equal rows may swap. Repeated
rows are placed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspan.llm.common import spread_rank, table, unambiguous

DIMS, BITS = 4, 3


def hilbert(coords: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell: a fold over the bits, highest first, whose state is
    (entry e, direction d, place h); Gray code of the rotated corner at each level."""
    n = len(coords)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    inverse = [gray.index(g) for g in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    turn = [0 if i == 0 else _ones(i if i % 2 else i - 1) % n for i in range(1 << n)]
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    corner = lambda i: sum(
        (F.call_function("shiftright", c.cast("int"), i).bitwiseAND(1) * (1 << k) for k, c in enumerate(coords)), F.lit(0)
    )
    levels = F.array(*(corner(F.lit(i)) for i in reversed(range(bits))))

    def rotl(x: Column, by: Column) -> Column:
        up = F.call_function("shiftleft", x, by)
        down = F.call_function("shiftright", x, F.lit(n) - by)
        return up.bitwiseOR(down).bitwiseAND(full)

    def step(state: Column, level: Column) -> Column:
        by = F.pmod(state["d"] + 1, F.lit(n))
        flipped = level.bitwiseXOR(state["e"])
        w = F.get(array(inverse), rotl(flipped, F.pmod(F.lit(n) - by, F.lit(n))))
        return F.struct(
            state["e"].bitwiseXOR(rotl(F.get(array(entry), w), by)).alias("e"),
            F.pmod(state["d"] + F.get(array(turn), w) + 1, F.lit(n)).alias("d"),
            (state["h"] * (1 << n) + w).alias("h"),
        )

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("int").alias("h"))
    return F.aggregate(levels, start, step)["h"]


def _ones(i: int) -> int:
    """Trailing one bits."""
    return (i ^ (i + 1)).bit_length() - 1


def _text_bounds(rows: DataFrame, name: str, steps: list[float], n: int) -> list[str | None]:
    """The values at these shares of the rows in code-point order, null first; counted by value, so that
    only values that differ are ordered."""
    order = Window.orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.groupBy(name).count().withColumn("upto", F.sum("count").over(order))
    least = [F.min(F.when(F.col("upto") >= step * n, F.struct(F.col(name).isNotNull().alias("some"), F.col(name).alias("value")))) for step in steps]
    return [x["value"] for x in upto.agg(*least).first() if x is not None]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32 and one value for each dimension): what is moved of a row."""
    rows = unambiguous(docs, "doc_id", "text", "lang", "source")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
        F.col("source").alias("q0"),
        F.col("lang").alias("q1"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("q2"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("q3"),
    )


def shard(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, place, shard, slot)."""
    rows = table(described(docs), "described")
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    # a few numbers: the bounds of each dimension's steps, and the row count
    found = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(f"q{d}", steps, 10_000).alias(f"b{d}") for d in (2, 3))).first()
    n = found["n"]
    bounds = [*(_text_bounds(rows, f"q{d}", steps, n) for d in (0, 1)), found["b2"] or [], found["b3"] or []]
    above = lambda c, b: c.isNotNull() if b is None else c > F.lit(b)
    coords = [
        sum((F.when(above(F.col(f"q{d}"), b), 1).otherwise(0) for b in set(bounds[d])), F.lit(0)) for d in range(DIMS)
    ]
    celled = rows.withColumn("cell", sum((c * (1 << bits * d) for d, c in enumerate(coords)), F.lit(0)).cast("int")).drop(*(f"q{d}" for d in range(DIMS)))
    # a row for each cell that occurs, 2 ** (DIMS * bits) at most
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"))
    parts = [F.call_function("shiftright", F.col("cell"), F.lit(bits * d)).bitwiseAND((1 << bits) - 1) for d in range(DIMS)]
    placed = cells.withColumn("curve", hilbert(parts, bits))
    before = F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = placed.select("cell", "curve", before.alias("first"))
    curved = celled.join(F.broadcast(placed), "cell")
    ranked = spread_rank(curved.select("doc_id", "size", "text_crc32", "curve", "first"), ["curve", "first"], F.xxhash64("doc_id", "text_crc32"), ["doc_id", "text_crc32", "size"])
    place = ranked.withColumn("place", F.col("first") + F.col("rank"))
    low, extra = divmod(n, shards)
    # the first ``extra`` shards hold low + 1 rows, the others low
    head = extra * (low + 1)
    number = F.when(F.col("place") < head, F.floor(F.col("place") / (low + 1))).otherwise(extra + F.floor((F.col("place") - head) / max(low, 1)))
    slot = F.when(F.col("place") < head, F.col("place") % (low + 1)).otherwise((F.col("place") - head) % max(low, 1))
    return place.select("doc_id", "size", "text_crc32", "curve", "place", number.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op2(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "place"
    )
