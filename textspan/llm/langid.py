"""Language identification, word first with backoff to character n-grams.

A known word adds its log frequency in each language. A word the model has not seen is spelled
with marks around it and scored by its longest known n-grams: from n = 5 down, each position takes
the first length that is known, and a position unknown at every length adds a constant.

Fitting: counts are made by Spark over a sample with a documented bound: ``per_lang`` documents of
each language (the least hashes of doc_id), and ``most`` of all together, which are shared evenly if
there are more languages than most / per_lang. All words of the sample are learned, and every language
that has a document in it. What a document is called depends on its text alone.

Null text or a text without a letter: ``und``, score 0. No learnable row (empty table, all langs
null): every document is ``und``. Ties go to the language that sorts first. A null doc_id is never
learned from (its crc32 is null) and held_out is false for it. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textspan.llm.common import unambiguous

UND = "und"
#: Words are runs of letters; marks inside a word (combining characters) belong to it.
WORD = r"\p{L}[\p{L}\p{M}]*"
LONGEST = 5
#: New words whose score a worker keeps at most.
KEPT_SCORES = 150_000


class Model:
    """Rows of log frequencies, one column for each language: known words first, then words that
    texts brought, scored by backoff and kept up to a bound."""

    def __init__(self, langs: list[str], words: dict[str, int], table: np.ndarray, grams: dict[str, int], gram_table: np.ndarray, unseen: float) -> None:
        self.langs, self.grams, self.gram_table, self.unseen = langs, grams, gram_table, unseen
        self.words, self.fixed = words, len(table)
        self.table = np.concatenate([table, np.zeros((KEPT_SCORES, len(langs)))])
        self.row, self.used = dict(words), self.fixed

    @property
    def parts(self) -> tuple:
        return self.langs, self.words, self.table[: self.fixed], self.grams, self.gram_table, self.unseen

    def _new(self, word: str) -> int:
        """The row of a word seen for the first time; the caller sees to it that there is room."""
        marked, rows, blind = f"<{word}>", [], 0
        for i in range(len(marked) - 1):
            for n in range(min(LONGEST, len(marked) - i), 0, -1):
                found = self.grams.get(marked[i : i + n])
                if found is not None:
                    rows.append(found)
                    break
            else:
                blind += 1
        self.table[self.used] = (self.gram_table[rows].sum(axis=0) + blind * self.unseen) / (len(rows) + blind)
        self.row[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior over the mean evidence of a word."""
        import regex

        words = regex.findall(WORD, (text or "").lower())
        if not words or not self.langs:
            return UND, 0.0
        total, row = np.zeros(len(self.langs)), self.row
        for at in range(0, len(words), KEPT_SCORES):
            some = words[at : at + KEPT_SCORES]
            if self.used + len(some) > len(self.table):
                row = self.row = dict(self.words)
                self.used = self.fixed
            rows = [row[w] if w in row else self._new(w) for w in some]
            total += self.table[rows].sum(axis=0)
        means = total / len(words)
        best = int(np.argmax(means))
        return self.langs[best], float(1.0 / np.exp(means - means[best]).sum())


def build(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (lang, word, count); add-half smoothing over all languages' words."""
    langs = sorted({c[0] for c in counts})
    at = {x: i for i, x in enumerate(langs)}

    def logs(counted: dict[str, list[float]]) -> np.ndarray:
        found = np.array(list(counted.values()), float).reshape(len(counted), len(langs))
        return np.log((found + 0.5) / (found.sum(axis=0) + 0.5 * (len(counted) + 1)))

    words: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(langs))
    by_length: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(LONGEST + 1)]
    for lang, word, n in counts:
        words[word][at[lang]] += n
        marked = f"<{word}>"
        for k in range(1, LONGEST + 1):
            for i in range(len(marked) - k + 1):
                by_length[k][marked[i : i + k]][at[lang]] += n
    # long n-grams seen once say little and make most of the table
    kept = [{g: v for g, v in by_length[k].items() if k < 3 or sum(v) > 1} for k in range(1, LONGEST + 1)]
    names = [g for grams in kept for g in grams]
    return Model(langs, {w: i for i, w in enumerate(words)}, logs(words), {g: i for i, g in enumerate(names)}, np.concatenate([logs(g) for g in kept]), math.log(1e-6))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 1000, most: int = 100_000) -> Model:
    rows = unambiguous(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    ranked = rows.select("doc_id", F.col("lang").alias("__lang"), F.xxhash64("doc_id").alias("h"))
    langs = ranked.groupBy("__lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "__lang").limit(most)
    langs = docs.sparkSession.createDataFrame(langs.collect(), langs.schema)  # at most ``most`` rows
    share = max(1, min(per_lang, most // max(1, langs.count())))
    # hashes below a bound that leaves about twice the sample: what is ranked stays small
    likely = ranked.join(F.broadcast(langs), "__lang").where(F.pmod("h", F.lit(1 << 40)) < (2.0 * share + 100) / F.col("rows") * (1 << 40))
    n = F.row_number().over(Window.partitionBy("__lang").orderBy("h", "doc_id"))
    chosen = likely.withColumn("n", n).where(F.col("n") <= share).select(F.col("doc_id").alias("__id"), "__lang").distinct()
    # at most ``most`` ids: a proven size for the broadcast
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")
    found = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    counts = [(r["lang"], r["word"], r["count"]) for r in found.collect()]
    return build(counts) if counts else Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), 0.0)


def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior over the mean evidence of a word."""
        import regex

        words = regex.findall(WORD, (text or "").lower())
        if not words or not self.langs:
            return UND, 0.0
        total, row = np.zeros(len(self.langs)), self.row
        for at in range(0, len(words), KEPT_SCORES):
            some = words[at : at + KEPT_SCORES]
            if self.used + len(some) > len(self.table):
                row = self.row = dict(self.words)
                self.used = self.fixed
            rows = [row[w] if w in row else self._new(w) for w in some]
            total += self.table[rows].sum(axis=0)
        means = total / len(words)
        best = int(np.argmax(means))
        return self.langs[best], float(1.0 / np.exp(means - means[best]).sum())


def build(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (lang, word, count); add-half smoothing over all languages' words."""
    langs = sorted({c[0] for c in counts})
    at = {x: i for i, x in enumerate(langs)}

    def logs(counted: dict[str, list[float]]) -> np.ndarray:
        found = np.array(list(counted.values()), float).reshape(len(counted), len(langs))
        return np.log((found + 0.5) / (found.sum(axis=0) + 0.5 * (len(counted) + 1)))

    words: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(langs))
    by_length: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(LONGEST + 1)]
    for lang, word, n in counts:
        words[word][at[lang]] += n
        marked = f"<{word}>"
        for k in range(1, LONGEST + 1):
            for i in range(len(marked) - k + 1):
                by_length[k][marked[i : i + k]][at[lang]] += n
    # long n-grams seen once say little and make most of the table
    kept = [{g: v for g, v in by_length[k].items() if k < 3 or sum(v) > 1} for k in range(1, LONGEST + 1)]
    names = [g for grams in kept for g in grams]
    return Model(langs, {w: i for i, w in enumerate(words)}, logs(words), {g: i for i, g in enumerate(names)}, np.concatenate([logs(g) for g in kept]), math.log(1e-6))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 1000, top_words: int = 20_000, max_langs: int = 200) -> Model:
    rows = unambiguous(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    ranked = rows.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    langs = {r["lang"]: r["count"] for r in ranked.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), 0.0)
    # hashes below a bound that leaves about twice the sample: what is ranked stays small
    bound = F.element_at(F.create_map(*(F.lit(x) for k, n in langs.items() for x in (k, min(1.0, (2.0 * per_lang + 100) / n)))), F.col("lang"))
    likely = ranked.where(F.col("lang").isin(list(langs))).where(F.pmod("h", F.lit(1 << 40)) < bound * (1 << 40))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = likely.withColumn("n", n).where(F.col("n") <= per_lang).select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")).distinct()
    # at most per_lang * max_langs ids: a proven size for the broadcast
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")), "left_semi")
    found = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("n") <= top_words)
    return build([(r["lang"], r["word"], r["count"]) for r in top.select("lang", "word", "count").collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns) with lang_pred and score. Texts alone go to Python. The model is broadcast:
    its bounds are fit's."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)
    held: list[Model] = []

    @F.pandas_udf("lang_pred string, score double")
    def call(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Model(*shared.value))
        return pd.DataFrame([held[0].predict(t) for t in texts], columns=["lang_pred", "score"])

    found = docs.withColumn("__found", call.asNondeterministic()("text"))
    return found.withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")


def op9(docs: DataFrame) -> DataFrame:
    few = unambiguous(docs, "doc_id", "text", "lang")
    rows = predict(few.select("doc_id", "text"), fit(few))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document's language must be likelier than all other learned languages together.
LEAST_SCORE = 0.5


def known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without those called ``und`` or scored below least_score; lang becomes what was predicted.
    Where nothing can be learned, documents without a letter go and lang stays. Columns are found by
    their exact names, else by the first that differs in case only; extra ones stay as they are."""
    names = docs.columns
    lower = [c.lower() for c in names]
    text, lang = (names.index(n) if n in names else lower.index(n) for n in ("text", "lang"))
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    model = fit(docs)
    if not model.langs:
        return plain.where(F.col(f"c{text}").rlike(r"\p{L}")).toDF(*names)
    rows = predict(plain.withColumnRenamed(f"c{text}", "text"), model)
    kept = rows.where((F.col("lang_pred") != UND) & (F.col("score") >= least_score))
    return kept.withColumn(f"c{lang}", F.col("lang_pred")).drop("lang_pred", "score").toDF(*names)
