"""The fallback chain and the side-by-side comparison, as joins and unions of outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspan.functions import fixed, text
from textspan.operators import clean, match
from textspan.sources.stored import stored


def prepared(requests: DataFrame, mode: str = "latex") -> DataFrame:
    """requests (req_id, html, copied) with what the methods share: clean text, captions, references. A
    page is read once for all of them; a chain that asks for several methods stores this first."""
    return requests.select("req_id", "html", "copied", clean.cited_page(F.col("html"), mode).alias("clean"), clean.captions("html").alias("captions"), clean.references("html").alias("items"))


def attempt(rows: DataFrame, method: str, mode: str = "latex", references: str = "none", **settings) -> DataFrame:
    """(req_id, method, outcome fields) of one method."""
    if method == "hybrid":
        got = match.hybrid(F.col("clean"), F.col("copied"), references, F.col("items"), F.col("captions"), **settings)
    elif method in match.RAW:
        got = match.matched(method, F.col("html"), F.col("copied"), mode=mode, **settings)
    else:
        got = match.matched(method, F.col("clean"), F.col("copied"), **settings)
    return rows.select("req_id", F.lit(method).alias("method"), got.alias("o")).select("req_id", "method", "o.*")


def attempts(rows: DataFrame, order: tuple[str, ...] = fixed.FALLBACKS, made: list[DataFrame] | None = None, **settings) -> DataFrame:
    """(req_id, seq, method, outcome): each method is tried on the requests that all before it
    failed; a method's outcomes are a table, since the next anti-join reads them too. ``made`` gets the tables, for
    a caller who drops them when the result is written."""
    tried, left, made = [], stored(rows, "prepared"), [] if made is None else made
    made.append(left)
    for seq, method in enumerate(order):
        now = attempt(left, method, **settings).withColumn("seq", F.lit(seq))
        if seq + 1 < len(order):
            now = stored(now, f"tried-{method}")
            made.append(now)
            left = left.join(now.where("status = 'ok'").select("req_id"), "req_id", "left_anti")
        tried.append(now)
    return reduce(DataFrame.unionByName, tried)


def report(order: tuple[str, ...] = fixed.FALLBACKS) -> Column:
    """Lines of a combined report over the attempts gathered in ``attempts`` (ordered structs)."""
    final = F.get(F.filter("attempts", lambda a: a["status"] == "ok"), F.lit(0))["method"]
    lines = F.transform("attempts", lambda a: F.concat(F.lit("- "), a["method"], F.lit(": "), a["status"], F.when(a["error"] != "", F.concat(F.lit(", "), a["error"])).otherwise("")))
    bodies = F.flatten(F.transform("attempts", lambda a: F.concat(F.array(F.lit(""), F.concat(F.lit("--- "), a["method"], F.lit(" report ---"))), a["report"])))
    head = F.array(F.lit(f"Fallback order: {' -> '.join(order)}"), F.concat(F.lit("Final method: "), F.coalesce(final, F.lit("none"))), F.lit(""), F.lit("Attempts:"))
    return F.concat(head, lines, bodies)


def best(rows: DataFrame, order: tuple[str, ...] = fixed.FALLBACKS, made: list[DataFrame] | None = None, **settings) -> DataFrame:
    """(req_id, status, method, text, start, end, report): the first method that places a request."""
    tried = attempts(rows, order, made, **settings)
    gathered = tried.groupBy("req_id").agg(F.sort_array(F.collect_list(F.struct("seq", "method", "status", "error", "text", "start", "end", "report"))).alias("attempts"))
    won = F.get(F.filter("attempts", lambda a: a["status"] == "ok"), F.lit(0))
    return gathered.select(
        "req_id",
        F.when(won.isNull(), "error").otherwise("ok").alias("status"),
        won["method"].alias("method"),
        won["text"].alias("text"),
        won["start"].alias("start"),
        won["end"].alias("end"),
        F.when(won.isNull(), "failed: all partial best fallback methods failed").otherwise("").alias("error"),
        F.array_join(report(order), "\n").alias("report"),
    )


def compared(rows: DataFrame, root: str = "output", mode: str = "latex", settings: dict[str, dict] | None = None) -> DataFrame:
    """All methods on all requests: a row of COMPARISON_FIELDS (as strings, timings empty: Spark's own
    metrics hold them) for each, with equality to the two baselines. rows also has title and lang."""
    per, rows = settings or {}, stored(rows, "prepared")
    tried = stored(reduce(DataFrame.unionByName, (attempt(rows, m, mode, **per.get(m, {})) if m in match.RAW else attempt(rows, m, **per.get(m, {})) for m in fixed.METHODS)), "tried")
    base = rows.select("req_id", "title", "lang", "copied")
    ok = lambda m: tried.where(f"method = '{m}' and status = 'ok'").select("req_id", F.col("text").alias(f"{m}_text"))
    joined = tried.join(base, "req_id").join(ok("hybrid"), "req_id", "left").join(ok("token"), "req_id", "left")
    fact = lambda i: F.element_at(F.create_map(*(F.lit(x) for m, f in fixed.METHOD_FACTS.items() for x in (m, str(f[i])))), F.col("method"))
    good, words = F.col("status") == "ok", text.edge_words(F.col("text"))
    same = lambda m: F.when(good & (F.col("method") != m) & F.col(f"{m}_text").isNotNull(), F.when(F.col("text") == F.col(f"{m}_text"), "True").otherwise("False")).otherwise("")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = {
        "schema_version": F.lit(fixed.COMPARISON_VERSION), "run_id": F.col("req_id").cast("string"), "timestamp_utc": F.lit(""), "topic": F.col("title"), "lang": F.col("lang"),
        "input_file": F.lit(""), "input_sha256": text.digest(F.col("copied")), "input_chars": F.length("copied").cast("string"), "math_mode": F.lit(mode), "method": F.col("method"),
        "method_family": fact(0), "match_surface": fact(1), "offset_basis": fact(2), "uses_full_clean": fact(3), "status": F.col("status"),
        "fetch_seconds": F.lit(""), "full_clean_seconds": F.lit(""), "match_seconds": F.lit(""), "estimated_total_seconds": F.lit(""),
        "output_file": text.method_path(root, F.col("title"), F.col("lang"), F.col("method")), "output_chars": F.when(good, F.length("text")).otherwise(0).cast("string"),
        "output_sha256": F.when(good, text.digest(F.col("text"))).otherwise(""), "output_first_word": F.when(good, words["first"]).otherwise(""), "output_last_word": F.when(good, words["last"]).otherwise(""),
        "equals_hybrid": same("hybrid"), "equals_token": same("token"), "start_offset": value("start"), "end_offset": value("end"), "start_score": value("start_score"), "end_score": value("end_score"),
        "score_summary": F.when(good, "").otherwise(F.coalesce(F.get("report", F.lit(0)), F.lit(""))), "settings": F.lit(str(per)), "error": F.col("error"),
    }
    return joined.select(*(row[f].alias(f) for f in fixed.COMPARISON_FIELDS))
