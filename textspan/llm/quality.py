"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements;
versioned policies and ablations are then bitwise work on the ledger.

Null text counts as a text without words: all measurements 0, so base_failed. Nothing else of a
row is looked at; repeated rows give repeated rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspan.llm.common import BLANKS, unambiguous, words

WINDOW = 5
#: Positions packed beside 40 hash bits when repeated windows are looked for.
PLACE_BITS = 24
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger; ``fails`` is SQL over the measurements."""

    name: str
    fails: str


#: The order gives the bits and is never changed; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Which rules reject in each version.
POLICIES = {
    "v1": (*BASE, "symbols", "short_words", "long_words", "repeated_lines"),
    "base": BASE,
    "lenient": (*BASE, "symbols"),
}


def mask(names: tuple[str, ...] | list[str]) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in set(names))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of each whole text.

    Repeated windows are found by sorting one packed long for each window (hash above, place
    below); neighbours that agree on the 40 hash bits are compared again by the whole 64-bit
    hash, as are all windows of a text too long for the packing.
    """
    limit, low = 1 << PLACE_BITS, (1 << PLACE_BITS) - 1
    joined = ", ".join(f"get(__hw, i + {k})" for k in range(WINDOW))
    near = " or ".join(f"coalesce(shiftright(x ^ get(__s, k {d} 1), {PLACE_BITS}) = 0, false)" for d in "+-")
    same = " or ".join(f"coalesce(e.h = get(__e, k {d} 1).h, false)" for d in "+-")
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumns({"__w": words(F.col(text)), "__l": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))})
        .withColumns({
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__hw": F.transform("__w", lambda w: F.xxhash64(w)),
        })
        .drop("__w", "__l")
        .withColumn("__h", F.expr(f"if(size(__hw) < {WINDOW}, array(), transform(sequence(0, size(__hw) - {WINDOW}), i -> xxhash64({joined})))"))
        .drop("__hw")
        .withColumn("__h", F.expr("if(size(array_distinct(__h)) = size(__h), array(), __h)"))
        .withColumn("__s", F.expr(f"if(size(__h) < {limit}, sort_array(transform(__h, (h, i) -> shiftleft(h, {PLACE_BITS}) | cast(i as bigint))), array())"))
        .withColumn("__c", F.expr(f"if(size(__h) < {limit}, transform(filter(__s, (x, k) -> {near}), x -> cast(x & {low} as int)), sequence(0, size(__h) - 1))"))
        .withColumn("__e", F.expr("array_sort(transform(__c, i -> named_struct('h', get(__h, i), 'i', i, 'n', size(__h))))"))
        .withColumn("__p", F.expr(f"array_sort(transform(filter(__e, (e, k) -> {same}), e -> e.i))"))
        .withColumn("n_repeat_words", F.expr(f"aggregate(transform(__p, (i, k) -> least({WINDOW}, coalesce(get(__p, k + 1), i + {WINDOW}) - i)), 0L, (a, x) -> a + x)"))
        .drop("__h", "__s", "__c", "__e", "__p")
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all measurements and ``failed``: bit i is set where RULES[i] fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("failed", bits)


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a ledger row is kept by a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it rejects, and rows kept if it alone were dropped.
    One pass; a count for each rule."""
    names, whole = POLICIES[policy], F.lit(mask(POLICIES[policy])).cast("long")
    hit = F.col("failed").bitwiseAND(whole)
    counts = rows.agg(
        F.coalesce(F.bit_or(hit), F.lit(0).cast("long")).alias("any_failed"),
        *(F.count_if(hit.bitwiseAND(F.lit(mask([n])).cast("long")) != 0).alias(f"r_{n}") for n in names),
        *(F.count_if(hit == F.lit(mask([n])).cast("long")).alias(f"o_{n}") for n in names),
    )
    return counts.select(
        F.inline(F.array(*(
            F.struct(
                F.lit(n).alias("rule"),
                F.col(f"r_{n}").alias("rejected"),
                F.col(f"o_{n}").alias("rescued"),
                (F.col("any_failed").bitwiseAND(F.lit(mask([n])).cast("long")) != 0).alias("ever_fails"),
            )
            for n in names
        )))
    )


def op10(docs: DataFrame, policy: str = "v1") -> DataFrame:
    rows = ledger(unambiguous(docs, "doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failed",
    )
