"""The pipeline against a plain version over the same rows that takes none of its rules from the library."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"


def _languages(rows):
    """Of every text the language and its score: log frequencies of words, else of the longest n-grams
    that are known from each letter on. rows: (doc_id, text, lang), few enough to learn from all."""
    import regex

    words, grams = defaultdict(Counter), [defaultdict(Counter) for _ in range(6)]
    for d, t, lang in rows:
        if lang and t and zlib.crc32(str(d).encode()) % 3 != 1:
            for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower()):
                words[w][lang] += 1
                for k in range(1, 6):
                    for i in range(len(w) + 3 - k):
                        grams[k][f"<{w}>"[i : i + k]][lang] += 1
    langs = sorted({x for c in words.values() for x in c})
    grams = [{g: c for g, c in of.items() if k < 3 or sum(c.values()) > 1} for k, of in enumerate(grams)]

    def logs(table):
        total = {x: sum(c[x] for c in table.values()) for x in langs}
        return {w: np.array([math.log((c[x] + 0.5) / (total[x] + 0.5 * (len(table) + 1))) for x in langs]) for w, c in table.items()}

    known, by_length, seen = logs(words), [logs(g) for g in grams], {}

    def score(w):
        if w not in known and w not in seen:
            m, found = f"<{w}>", []
            for i in range(len(m) - 1):
                found.append(next((by_length[k][m[i : i + k]] for k in range(min(5, len(m) - i), 0, -1) if m[i : i + k] in by_length[k]), np.full(len(langs), math.log(1e-6))))
            seen[w] = sum(found) / len(found)
        return known[w] if w in known else seen[w]

    for _, t, _ in rows:
        found = regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
        if not found:
            yield "und", 0.0
            continue
        mean = sum(map(score, found)) / len(found)
        yield langs[int(np.argmax(mean))], float(1 / np.exp(mean - mean.max()).sum())


def _chunks(text):
    from xxhash import xxh64_intdigest

    lines, out, start = text.split("\n"), [], 0
    h = [xxh64_intdigest(x.encode()) for x in lines]
    for i in range(len(lines)):
        older = ((h[i - 1] << 1) | (h[i - 1] >> 63)) if i else 0
        if (older ^ h[i]) & 1 == 0 and i + 1 - start >= 2:
            out.append(lines[start : i + 1])
            start = i + 1
    return out + [lines[start:]] * (start < len(lines))


def _without_repeats(rows):
    seen = set()
    for d, t, s in rows:
        kept = []
        for chunk in _chunks(t):
            telling = sum(bool(x.strip(" \t\r\x0b\f")) for x in chunk) >= 2 and sum(map(len, chunk)) >= 40
            kept += [] if telling and tuple(chunk) in seen else chunk
            seen.add(tuple(chunk))
        yield d, "\n".join(kept), s


def _firsts(rows):
    """One row of each group of texts that all pairs at a Jaccard similarity of 0.8 join."""
    sets = []
    for _, t, _ in rows:
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def test_run_is_the_plain_version(spark):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect())
    told = list(_languages([(d, t, lang) for d, t, _, lang in rows]))
    known = [(d, t, s) for (d, t, s, _), (lang, score) in zip(rows, told, strict=True) if lang != "und" and score >= 0.5]
    kept = _firsts(list(_without_repeats(known)))
    assert 0 < len(kept) < len(rows)

    # the mix: what each source may take, from the definition of targets
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in kept}
    total, source = defaultdict(int), {d: s for d, _, s in kept}
    for d, n in size.items():
        total[source[d]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, free = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order)
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in order if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 3.0 * total[s] for s in order}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        free -= over

    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect())
    text = {d: t for d, t, _ in kept}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    taken, copies = defaultdict(int), Counter()
    for (d, n, ids_sha, raw_sha), times in got.items():
        ids = library.encode_ordinary(text[d])
        assert (n, ids_sha, raw_sha) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[d].encode()).hexdigest())
        taken[source[d]] += times * size[d]
        copies[d] += times
    for s in order:
        whole = min(3, int(target[s] // total[s])) if total[s] else 0
        sizes = [size[d] for d in text if source[d] == s and size[d]]
        assert all(whole <= copies[d] <= whole + 1 for d in text if source[d] == s and size[d])
        # the best sum of documents that the rest of the target holds
        budget, sums = round(target[s] - whole * total[s]) if whole < 3 else 0, 1
        for n in sizes:
            sums |= sums << n
        assert taken[s] == whole * total[s] + (sums & ((1 << budget + 1) - 1)).bit_length() - 1


ROWS = [
    (1, None, None, None, None), (2, "12 34", "en", "s", 5), (None, "words of a text", "en", None, 15), (4, "words of a text", "en", "s", 15), (4, "words of a text", "en", "s", 15),
    (5, "", "en", "s", 0), (6, "long words " * 30_000, "en", "s", 5), (7, "words of another kind", "en", "t", 5), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.limit(0).collect() == [], name
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
    kept = corpus_pipeline.STAGES[0][1](spark, docs, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["4", "4", "6", "7", "None"] and {r["lang"] for r in kept} == {"en"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_columns_change_nothing(spark, name):
    """Nulls, repeated rows, ties, empty and very long texts, beside columns whose names clash."""
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    more = docs.select("*", F.lit("no").alias("TEXT"), F.lit(3).alias("Doc_ID"), F.lit("x").alias("LANG"), F.lit(1).alias("extra"), F.lit(2).alias("extra"), F.lit("q").alias("Source"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(stage(spark, docs, FOLDER))
    assert rows(stage(spark, more, FOLDER)) == want and want


def test_near_dedup_of_odd_rows(spark):
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(ROWS, SCHEMA), FOLDER)
    # 1, 5 and the null row hold no word and are one text; so are the row without an id and both of 4
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "4", "6", "7", "None", "None"]
