"""Each training-data operator against brute force, and on nulls, empty and long texts, ties, repeated
rows, empty tables and clashing columns."""

import hashlib
import re
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textspan.llm import bpe, hamming, langid, lines, mixing, quality, queries, repeats, sharding, simhash, tokenfile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in ("mor", "tel", "gra", "piu", "sen", "kol", "vad") for b in ("ing", "ta", "os", "elle", "ung", "er", "ido", "an")]


def _texts():
    base = [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(15, 120))) for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(RNG.choice(base).split(" "))
        for _ in range(RNG.choice([0, 0, 1, 3])):
            words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
        cut = RNG.randrange(len(words))
        rows.append((i, " ".join(words[:cut]) + "\n" + " ".join(words[cut:]), RNG.choice(["en", "fr"]), f"s{i % 3}", 0))
    return rows


ODD = [
    (1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \n\t ", None, "", 0), (None, "null id text here", "en", None, 1), (None, None, None, None, None),
    (1003, "long " * 30_000, "en", "s1", 5), (1004, "x" * 70_000, "fr", "s1", 5), (1005, "same row", "en", "s2", 8), (1005, "same row", "en", "s2", 8), (1006, "#$%& 12 34", "en", "s2", 1),
    (-7, "<|endoftext|> Ünï 中文 é don't 'll x", "fr", "s2", 9), (1007, "a b", "en", "s0", 1), (1008, "a  b", "en", "s0", 1),
]
ROWS = _texts() + ODD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Extra columns whose names differ in case or stand twice."""
    return df.select("*", F.lit("no").alias("TEXT"), F.lit(3).alias("Doc_ID"), F.lit(1).alias("extra"), F.lit(2).alias("extra"), F.lit("q").alias("Source"))


OPS = {"op1": simhash.op1, "op2": sharding.op2, "op4": mixing.op4, "op5": repeats.op5, "op6": lines.op6, "op7": bpe.op7, "op8": tokenfile.op8, "op9": langid.op9, "op10": quality.op10}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(empty, name):
    out = OPS[name](empty)
    assert out.collect() == [] and out.columns[0] == "doc_id"


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_clashing_columns_change_nothing(docs, name):
    some = docs.where("doc_id < 40 or doc_id >= 1005 or doc_id is null")
    assert rows_of(OPS[name](clash(some))) == rows_of(OPS[name](some))


def test_simhash_is_brute_force(docs):
    got = rows_of(simhash.op1(docs).select("doc_id", "fingerprint", "component_id"))
    fps = [int(simhash.fingerprint(r[1])[0]) for r in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(ROWS, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}
    assert got == sorted([(r[0], f"{f:016x}", least[g]) for r, f, g in zip(ROWS, fps, group, strict=True)], key=str)


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    words = "a b c d a b c".split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert int(simhash.fingerprint("A b\tC d\n a B c ")[0]) == want
    assert int(simhash.fingerprint("One  two")[0]) == xxh64_intdigest("one two", 42) and not simhash.fingerprint(" ")[0]


@pytest.mark.parametrize("near", [simhash.Near(together=4), simhash.Near(bits=128, segments=4, max_bits=7, together=8)])
def test_large_keys_are_cut_into_blocks(docs, near):
    whole = simhash.Near(near.shingle, near.bits, near.segments, near.max_bits)
    assert near.whole and rows_of(simhash.classes(docs, near)) == rows_of(simhash.classes(docs, whole))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    one = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(300)]
    near = list(one)
    near[150] = "changed"
    other = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame([(3, " ".join(one)), (1, " ".join(near)), (2, " ".join(one)), (9, " ".join(other)), (None, " ".join(other))], "doc_id long, text string")
    assert rows_of(simhash.dedup(df).select("doc_id")) == [(1,), (9,), (None,)]


def test_sharding_law(docs):
    rows = sharding.op2(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    key = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted([(r[0], *key(r[1])) for r in ROWS], key=str)
    order = [r["curve"] for r in sorted(rows, key=lambda r: r["place"])]
    assert order == sorted(order)


def test_hilbert_steps_are_neighbours(spark):
    cells = spark.range(512).select(*((F.call_function("shiftright", F.col("id").cast("int"), F.lit(3 * d)).bitwiseAND(7)).alias(f"c{d}") for d in range(3)))
    path = sorted((r["h"], r["c0"], r["c1"], r["c2"]) for r in cells.withColumn("h", sharding.hilbert([F.col(f"c{d}") for d in range(3)], 3)).collect())
    assert [p[0] for p in path] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def _search_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, None] + [0.0] * 22), (None, [1.0] * 24), (5004, [1.0] * 3), (5005, x[7].tolist()), (5006, x[7].tolist()), (7, x[7].tolist())]
    return x, [(i, [float(y) for y in v]) for i, v in enumerate(x)] + odd


def test_search_is_nearly_brute_force(spark):
    x, rows = _search_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming.search(clash(df.withColumn("doc_id", F.lit(1)).withColumn("EMBEDDING2", F.lit(0))), index=hamming.Index(row_block=400)).collect()
    ids = np.array([*range(1500), 5005, 5006])
    v = np.concatenate([x, x[[7, 7]]])
    hits = 0
    for q in range(0, 1500, 100):
        far = np.sqrt(((v - x[q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        want = [int(ids[i]) for i in np.lexsort((ids, far))[:10]]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [r["score"] for r in mine] == sorted(r["score"] for r in mine)
        assert all(abs(far[np.flatnonzero(ids == r["vec_id"])[0]] - r["score"]) < 1e-12 for r in mine)
        hits += len(set(want) & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * 150
    assert {r["query_id"] for r in got} == set(range(0, 1500, 100))


def _recall(got, v, ids, queries):
    hits = 0
    for q in queries:
        far = ((v - v[ids == q]) ** 2).sum(axis=1)
        far[ids == q] = np.inf
        hits += len({int(ids[i]) for i in np.argsort(far)[:10]} & got[q])
    return hits / (10 * len(queries))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_whole_tables(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows, got = df.toPandas(), defaultdict(set)
    for r in hamming.op3(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    v, ids = np.array(rows["embedding"].tolist(), np.float64), rows["vec_id"].to_numpy()
    assert _recall(got, v, ids, [int(i) for i in ids if i % 100 == 0]) >= 0.9


def test_probes_retrieve_the_near_and_few_others():
    """Recall of the ten nearest, and the share of rows that is ranked, of the first probes."""
    rng, index = np.random.default_rng(4), hamming.Index()
    v = rng.normal(size=(400, 48))[rng.integers(0, 400, 20_000)] + 0.35 * rng.normal(size=(20_000, 48))
    mean, projection = hamming.learn(v[:4096], index)
    values, change = hamming.encode(v, mean, projection, index), hamming.masks(index.width, index.near)
    hits, shares = [], []
    for q in range(0, 20_000, 1000):
        near = np.isin(values ^ values[q], change).any(axis=1)
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits.append(near[np.argsort(far)[:10]].mean())
        shares.append(near.mean())
    print(np.mean(hits), np.mean(shares))
    assert np.mean(hits) >= 0.9 and np.mean(shares) <= 0.15


def test_many_equal_vectors_and_far_ones(spark):
    """Rows that no probe of a query reaches are found all the same; copies come in order of vec_id."""
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(40)] + [(100 + i, [-1.0 - i, -0.5, 3.0 * i]) for i in range(6)] + [(200, [float(-i) for i in range(3)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(hamming.search(df, every=100).select("query_id", "rank", "vec_id"))
    want, v = [], {i: np.array(x) for i, x in rows}
    for q in (0, 100, 200):
        order = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in v if i != q)[:10]
        want += [(q, k, i) for k, (_, i) in enumerate(order, 1)]
    assert got == sorted(want, key=str)


def test_search_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [1.0, 1.5])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in hamming.op3(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert hamming.op3(few.limit(0)).collect() == []


def test_codes_within_the_radius_share_a_probe():
    rng = np.random.default_rng(2)
    index = hamming.Index(substrings=8, width=8, near=2)
    values, change = rng.integers(0, 256, (3000, 8)), hamming.masks(8, 2)
    far = np.bitwise_count(values ^ values[3]).sum(axis=1)
    hit = np.isin(values ^ values[3], change).any(axis=1)
    assert index.radius == 23 and hit[far <= index.radius].all() and (far <= index.radius).sum() > 20 and len(change) == 37


def test_mixing(docs):
    rows = mixing.op4(docs).collect()
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    target, free = dict.fromkeys(order, 0.0), set(order)
    while True:  # stop and share again until none is above
        left = total - sum(3 * sizes[s] for s in order if s not in free)
        for s in order:
            target[s] = left * weights[s] / sum(weights[t] for t in free) if s in free else 3.0 * sizes[s]
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        free -= over
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    assert rows_of(mixing.op4(docs.repartition(5))) == sorted(map(tuple, rows), key=str)


def test_budget_fitting_is_the_exact_subset_sum():
    rng = random.Random(3)
    for _ in range(1000):
        longest = rng.choice([40, 2000, 60_000])
        lengths = [(n, rng.randint(1, 9)) for n in rng.sample(range(1, longest), rng.randint(1, 9))]
        total = sum(n * c for n, c in lengths)
        budget = rng.randint(0, total + 5)
        sums = 1
        for n, c in lengths:
            for _ in range(c):
                sums |= sums << n
        best = (sums & ((1 << min(budget, total) + 1) - 1)).bit_length() - 1
        got = mixing.fit(lengths, budget)
        assert all(0 <= got.get(n, 0) <= c for n, c in lengths) and sum(n * got.get(n, 0) for n, _ in lengths) == best
    assert sum(n * c for n, c in mixing.fit([(4500, 9), (50_000, 2)], 22_000).items()) == 18_000


def test_each_row_is_mixed_by_itself(spark):
    """Rows that share a doc_id, null ids among them, get the copies that the mix grants to rows."""
    rows = [(None, "one two three " * (i % 3 + 1), "en", "a", i) for i in range(6)] + [(5, "w " * n, "en", "b", n) for n in (4, 4, 9)] + [(i, "x y z", None, None, 0) for i in range(20)] + [(99, None, None, "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    words = lambda t: len((t or "").split())
    granted = defaultdict(int)
    for r in mixing.op4(df).collect():
        granted[r["source"]] += r["taken"]
    emitted = defaultdict(int)
    out = mixing.mixed(clash(df)).collect()
    for r in out:
        emitted[r[3]] += words(r[1])
    assert {s: n for s, n in granted.items() if n} == dict(emitted) and len(out[0]) == 10
    copies = Counter(tuple(r[:5]) for r in out)
    assert max(copies.values()) <= 6


def _removed(rows, length=50):
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, k), k)
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not p for p, g in zip(b"\0" + bytes(gone), bytes(gone), strict=False))
        yield len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("plan", [repeats.Plan(), repeats.Plan(hot=3, pack=2000, segment=500, together=40)])
def test_repeats_are_brute_force(docs, plan):
    got = repeats.remove(docs, plan)
    got = rows_of(got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long"), F.size("spans").cast("long"), F.sha2("kept", 256)))
    keyed = [(repeats.NO_ID if r[0] is None else r[0], r[1]) for r in ROWS]
    assert got == sorted([(r[0], *x) for r, x in zip(ROWS, _removed(keyed), strict=True)], key=str)


def test_doubling_is_brute_force(spark):
    rows = [(3, "abcdefgh" * 4), (1, "xxabcdefghabcd" * 2), (None, "abcdefghabcdefghab"), (7, "short"), (8, None), (1, "abcdefghabcdefgh")]
    keyed = [(repeats.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for k, b in keyed:
        for i in range(len(b) - 11):
            first[b[i : i + 12]] = min(first.get(b[i : i + 12], k), k)
    want = [(None if k == repeats.NO_ID else k, i) for k, b in keyed for i in range(len(b) - 11) if first[b[i : i + 12]] < k]
    got = repeats.doubling(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_largest_doc_id_is_not_null(spark):
    df = spark.createDataFrame([(2**63 - 1, "a" * 60), (None, "b" * 60), (-(2**63), "c d")], "doc_id long, text string")
    assert {r["doc_id"] for r in repeats.op5(df).collect()} == {2**63 - 1, None, -(2**63)}
    assert {r["doc_id"] for r in tokenfile.op8(df).collect()} == {2**63 - 1, None, -(2**63)}


def _plain_chunks(text):
    """The rule of the operator's description, by itself: a cut after a line where the two last lines' hashes,
    the older one turned by one bit, agree in the lowest bit, if two lines or more are behind it."""
    from xxhash import xxh64_intdigest

    lines_, out, start = text.split("\n"), [], 0
    h = [xxh64_intdigest(x.encode()) for x in lines_]
    for i in range(len(lines_)):
        older = ((h[i - 1] << 1) | (h[i - 1] >> 63)) if i else 0
        if (older ^ h[i]) & 1 == 0 and i + 1 - start >= 2:
            out.append(lines_[start : i + 1])
            start = i + 1
    return out + [lines_[start:]] * (start < len(lines_))


def test_line_chunks_of_a_whole_table_are_the_plain_rule(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    seen, want = set(), []
    for d, t in rows:
        kept, n = [], 0
        for chunk in _plain_chunks(t):
            body = "\n".join(chunk)
            telling = sum(bool(x.strip()) for x in chunk) >= 2 and sum(map(len, chunk)) >= 40
            if body in seen and telling:
                n += len(chunk)
            else:
                kept += chunk
            seen.add(body)
        raw = "\n".join(kept).encode()
        want.append((d, t.count("\n") + 1, n, len(raw), hashlib.sha256(raw).hexdigest()))
    got = lines.op6(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert rows_of(got.select("doc_id", "n_lines", "n_removed", "kept_bytes", "kept_sha256")) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 50


def test_line_chunks(spark):
    cuts = lines.Cuts()
    part = [f"shared line number {i} of a passage that stands in many documents" for i in range(12)]
    bodies = ["\n".join([f"own opening {i} " * 3, *part, f"own ending {i} " * 3]) for i in range(6)]
    df = spark.createDataFrame([*enumerate(bodies), (50, None), (51, ""), (52, bodies[0]), (52, bodies[0]), (53, "short\nshort")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in lines.cleaned(df).collect()}
    seen, want = set(), set()
    for d, t in [*enumerate(bodies), (52, bodies[0])]:
        all_lines, kept, n = t.split("\n"), [], 0
        for a, b in lines.chunks(t, cuts):
            chunk = tuple(all_lines[a:b])
            if chunk in seen and lines.removable(list(chunk), cuts):
                n += b - a
            else:
                kept += chunk
            seen.add(chunk)
        want.add((d, "\n".join(kept), n))
    assert got == want | {(50, None, 0), (51, "", 0), (53, "short\nshort", 0)}
    assert sum(n for _, _, n in got) > 40


def test_chunk_bounds_resist_shifts():
    body = [f"line {i * i}" for i in range(60)]
    a = ["\n".join(body[x:y]) for x, y in lines.chunks("\n".join(body))]
    b = ["\n".join((["new", "lines", "here"] + body)[x:y]) for x, y in lines.chunks("\n".join(["new", "lines", "here"] + body))]
    assert len(set(a) & set(b)) >= len(a) - 4


def test_bpe_round_trip(docs):
    import public_tokenizers as P
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in ROWS:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert rows_of(bpe.op7(docs)) == sorted(want, key=str)
    assert rows_of(bpe.decode(bpe.encode(docs))) == rows_of(bpe.round_trip(docs))


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 16])
def test_joining_halves_changes_nothing(monkeypatch, leaf):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "LEAF", leaf)
    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(leaf)
    some = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "1", "22", "!", "?é", "中", "'ve", "   \n  ", " ", "\x1c"]
    for _ in range(1500):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))
        assert codec.pieces(t) == codec.all(t)


@pytest.mark.parametrize("leaf", [3, 40])
def test_tokens_are_joined_across_cuts(monkeypatch, leaf):
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "BYTES", 4)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(leaf)
    for _ in range(1500):
        some = rng.choice(["a", "ab", "the ", "aeinrst", "é中x", "-=", "0123", " \n"])
        t = "".join(rng.choice(some) for _ in range(rng.choice([3, 20, 90, 300])))
        assert list(codec.encode(t)) == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


@pytest.mark.parametrize("text", ["a" * 300_000, "".join(random.Random(9).choice("abcdefgh") for _ in range(1 << 20))])
def test_one_very_long_piece(text):
    import public_tokenizers as P
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert list(bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode(text)) == library.encode_ordinary(text)


def test_token_files(docs, spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ROWS]
    got = tokenfile.op8(docs).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted([(r[0], len(x), crc(x)) for r, x in zip(ROWS, ids, strict=True)], key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    tokenfile.write(docs.where("doc_id < 20"), f"file://{tmp_path}/t")
    raw, index = tokenfile.mapped_shards(f"{tmp_path}/t")[0]
    assert raw.dtype == np.uint16 and index["doc_id"][0] == -7 and list(index["start"]) == sorted(index["start"])
    other = tokenfile.read(spark, f"file://{tmp_path}/t", local=False)
    assert rows_of(other) == rows_of(tokenfile.read(spark, f"file://{tmp_path}/t"))


def test_words_by_library():
    import public_tokenizers as P
    import pyarrow as pa

    rng = random.Random(8)
    some = [*"aZ.,;'!?<|>#é̈́ß İΣÀÿ÷×\t\n 12s\x0b\x0c\r ", "<|endoftext|>", "<|STARTOFTEXT|>", "'ll", " ", "中"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    words = tokenfile.Words(P.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u2").tolist() for x in words.encode(pa.array(texts)).to_pylist()]
    assert got == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_languages_are_told_apart(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = documents.select("doc_id", "lang").join(langid.op9(documents), "doc_id").where("held_out")
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right >= 0.98 and n > 250 and 0 <= low <= high <= 1


def test_languages_of_odd_rows(docs):
    got = {r["doc_id"]: r for r in langid.op9(docs).collect() if r["doc_id"] is not None}
    for d in (1000, 1001, 1002, 1006):
        assert (got[d]["lang_pred"], got[d]["score"]) == (langid.UND, 0.0)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    model = langid.build([("en", "the", 9), ("fr", "les", 9)])
    assert model.predict("the the")[0] == "en" and model.predict("lesser")[0] == "fr"


def test_ledger_policies(docs):
    ledger = quality.ledger(docs).persist()
    table = {r["rule"]: r for r in quality.ablations(ledger, "v1").collect()}
    rows = ledger.collect()
    for i, rule in enumerate(quality.RULES):
        assert table[rule.name]["rejected"] == sum(r["failed"] >> i & 1 for r in rows)
        assert table[rule.name]["rescued"] == sum(r["failed"] == 1 << i for r in rows)
    assert ledger.where(quality.passes("base")).count() == sum(not r["failed"] & 3 for r in rows)


def test_repeated_words_by_hand(docs):
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.op10(docs).collect()}
    for d, t in ((r[0], r[1]) for r in ROWS if r[0] is not None):
        words = (t or "").split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = Counter(windows)
        assert got[d] == len({i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}), d


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_agree_with_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(str(tuple(r[n] for n in names)) for r in queries.QUERIES[name](spark, folder).collect()) == sorted(map(str, want.fetchall()))


def test_pairs_of_a_block_are_read_batch_by_batch(spark):
    """However many pairs a block has, a worker holds its vectors and one batch of them."""
    v = np.random.default_rng(8).normal(size=(300, 6))
    rows = spark.createDataFrame([(i, x, [i]) for i, x in enumerate(v.tolist())], "id long, v array<double>, ids array<long>")
    asked = rows.where("id % 3 = 0").select("id", "v")
    pairs = asked.select(F.col("id").alias("query")).crossJoin(rows.select("id"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        for some in (pairs, None):
            ranked = hamming._ranked(some, rows, asked, 4, 3)
            assert "FlatMapGroups" not in ranked._jdf.queryExecution().toString()
            got: dict[int, list] = {}
            for r in ranked.collect():
                got.setdefault(r["query"], []).append((r["score"], r["vec_id"]))
            for q in range(0, 300, 3):
                far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
                assert sorted(got[q])[:5] == sorted(zip(far.tolist(), range(300), strict=True))[:5]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_stay_known_over_slices():
    """Words of two slices, more than 80 000, are not encoded again when they come back."""
    import public_tokenizers

    held, letters = tokenfile.Words(public_tokenizers.path("word_bpe_49k.json")), "abcdefghij"
    word = lambda i: "".join(letters[int(d)] for d in str(i))
    slices = [pa.array([" ".join(word(i) for i in range(low, low + 50_000))]) for low in (100_000, 200_000)]
    first = [held.encode(s) for s in slices]
    known = dict(held.known)
    assert [held.encode(s) for s in slices] == first
    assert all(held.known[w] is ids for w, ids in known.items())
