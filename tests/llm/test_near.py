"""Near-duplicate groups against all pairs of texts by Jaccard similarity alone."""

import numpy as np

from textspan.llm import near, simhash

WORDS = [f"w{i}" for i in range(5000)]


def _variant(rng, base, n):
    words = list(base)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = WORDS[rng.integers(len(WORDS))]
    return words


def _groups(rows):
    near = simhash.SIMILAR
    sets = [set(simhash.shingles(t, near.shingle)) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= near.similarity * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return {rows[i][0]: rows[min(k for k, g in enumerate(group) if g == group[i])][0] for i in range(len(rows))}


def _found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.classes(docs, simhash.SIMILAR).collect()}


def test_a_member_whose_closest_fails_is_kept_by_another(spark):
    rng = np.random.default_rng(7)
    base = [WORDS[i] for i in rng.integers(0, 5000, 400)]
    rows = [(0, " ".join(base)), *((i, " ".join(_variant(rng, base, 8))) for i in range(1, 61))]
    want = _groups(rows)
    assert len(set(want.values())) < 10
    assert _found(spark, rows) == want


def test_every_pair_at_the_similarity_links(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        base = [WORDS[k] for k in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(_variant(rng, base, max(1, len(base) // 50))))]
    want = _groups(rows)
    assert 20 < len(set(want.values())) < 120
    assert _found(spark, rows) == want


def test_common_shingles_are_known_however_many_texts_there_are(spark):
    """A sample of fixed size would hold a passage of 24 texts in 3200 less than once; its shingles would
    come first, as if they were rare."""
    rng = np.random.default_rng(13)
    word = lambda n: [WORDS[i] for i in rng.integers(0, 5000, n)]
    passages = [word(12) for _ in range(10)]
    rows = [(i, " ".join(word(6) + (passages[i % 10] if i < 240 else []) + word(6))) for i in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot, counts = near.frequent(docs, simhash.SIMILAR, sample=100)
    assert len(hot) == len(counts) and (counts > 1).all() and (np.diff(hot) > 0).all()
    want = np.unique(np.concatenate([simhash.hashes(" ".join(p), simhash.SIMILAR) for p in passages]))
    assert np.isin(want, hot).mean() > 0.9


def test_families_in_rounds_link_what_one_round_links(spark, monkeypatch):
    rng = np.random.default_rng(17)
    bases = [rng.choice(2**32, 50, replace=False).astype(np.uint32) for _ in range(4)]
    sets = [np.unique(np.concatenate([bases[i % 4][: 50 - i % 7], rng.integers(0, 2**32, i % 7, dtype=np.uint32)])) for i in range(40)]
    hot = spark.createDataFrame([(1 + i % 2, i, len(sets[i]), i) for i in range(40)] + [(1, 1, len(sets[1]), 1)], "key long, node long, size int, root long")
    held = spark.createDataFrame([(i, h.tobytes()) for i, h in enumerate(sets)], "node long, hashes binary")
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "ROUND_SHINGLES", 100)
    monkeypatch.setattr(near, "ROUND_TIMES", 1)
    found = near._families(hot, held, simhash.SIMILAR)
    group = list(range(40))
    for a, b in (tuple(r) for t in found for r in t.collect()):
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= simhash.SIMILAR.similarity * (len(sets[i]) + len(sets[j]) - both):
                want = [min(want[i], want[j]) if g in (want[i], want[j]) else g for g in want]
    assert len(found) > 1
    assert group == want and len(set(want)) < 40
