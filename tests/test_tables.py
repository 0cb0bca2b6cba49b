"""Column functions and tables against the plain rules, and requests end to end."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textspan.functions import align, prose, text
from textspan.operators import clean, match, segment
from textspan.plans import best, registry
from textspan.sources import pages
from textspan.streaming import requests

CASES = [
    "", " ", "\n", "Plain text.", "A ( ) b [1] c , d .\n\n\n\n== Head ==\nx\n=== Sub ===\n\ny", "Body text, long enough.\nSee also\nOther\nNotes\nA note, with words, stays.",
    "^ a b Note text here, fine.\n^c Another\n  ^d^e Third, one", "x = y + 2\n\nProse that has several words here.\n\nok\n\na\nb", "8 (=23) and 9 (=32), 10 (=100) end of it",
    "The rule {\\displaystyle x^{2}} holds.\n\nMore prose follows on here.", "tail  \t\nnext \t line\r\nlast\r", "== References ==\n1. x\n== Later ==\nkept prose, really.",
]


@pytest.mark.parametrize("mode", ["remove", "latex", "keep"])
def test_native_cleaning_is_the_chain(spark, mode):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([*CASES, None])], "i int, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", clean.clean(F.col("t"), mode).alias("v")).collect()}
    assert got == {i: prose.clean(c, mode) for i, c in enumerate(CASES)} | {len(CASES): None}


def test_cleaning_clean_text_changes_nothing(spark):
    once = [prose.clean(c, "keep") for c in CASES]
    assert [prose.clean(c, "keep") for c in once] == once


def test_line_rules_agree(spark):
    lines = ["", "abc", "12 + 3 = x", "edit", "ab", "a constant.", "f(x)", "see the sin (x) there", "== T ==", "Ünïcode wörds hier", "----", "x = 3 holds", "∑", "a b c"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    c = F.col("x")
    found = rows.select("x", text.rendered_math(c).alias("r"), text.noise(c).alias("n"), text.math_heavy(c).alias("h"), text.math_word(c).alias("w"), text.math_fragment(c).alias("f"), text.title_of(c).alias("t")).collect()
    for r in found:
        assert (r["r"], r["n"], r["h"], r["w"], r["f"], r["t"]) == (prose.rendered_math(r["x"]), prose.noise(r["x"]), prose.math_heavy(r["x"]), prose.math_word(r["x"]), prose.math_fragment(r["x"]), prose.title_of(r["x"])), r["x"]


def test_tokens_and_headings_agree(spark):
    t = "== One ==\nWords here [1, 2] and 3 more é x.\n  == Two ==  \nend"
    docs = spark.createDataFrame([(1, t)], "doc_id int, text string")
    got = segment.tokens(docs).orderBy("pos").collect()
    assert [(r["value"], r["start"], r["end"]) for r in got] == [tuple(x) for x in prose.tokens(t)]
    heads = segment.headings(docs).orderBy("start").collect()
    assert [(r["title"], r["start"], r["end"]) for r in heads] == [tuple(h) for h in prose.headings(t)]


def test_skipped_spans_hide_tokens(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd")], "doc_id int, text string")
    skip = spark.createDataFrame([(1, 3, 8)], "doc_id int, start int, end int")
    assert [r["value"] for r in segment.tokens(docs, skip=skip).orderBy("pos").collect()] == ["aa", "dd"]


def test_passages_find_an_exact_window(spark):
    words = [f"word{i % 37}x{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of the kind at all here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[50:90]))], "item_id long, text string")
    (r,) = match.passages(docs, items).collect()
    assert (r["item_id"], r["doc_id"], r["start"], r["end"], round(r["score"], 9)) == (7, 1, 50, 90, 1.0)


def test_page_requests(spark):
    urls = ["https://en.wikipedia.org/wiki/Albert_Einstein", "https://example.org/wiki/X", "https://fi.wikipedia.org/wiki/", "https://de.wikipedia.org/wiki/A%2BB_+_c", "nonsense", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(pages.page_request(F.col("u")).alias("r")).select("r.*").collect()
    assert [(r["status"], r["title"], r["lang"]) for r in rows] == [("ok", "Albert Einstein", "en"), ("error", None, None), ("error", None, None), ("ok", "A+B + c", "de"), ("error", None, None), ("error", None, None)]


def test_answers(spark):
    answers = [json.dumps({"query": {"pages": [{"extract": "text"}]}}), json.dumps({"query": {"pages": [{"missing": True}]}}), json.dumps({"error": {"info": "bad"}})]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select(pages.answered_extract(F.col("a")).alias("r")).select("r.*").collect()
    assert [(r["status"], r["text"], r["error"]) for r in rows] == [("ok", "text", ""), ("error", "", "page not found"), ("error", "", "bad")]


def _html(n):
    from tests.test_align import page

    lines = page(n)
    return "".join(f"<p>{x}</p>" for x in lines), lines


@pytest.fixture(scope="module")
def asked(spark):
    a, lines = _html(3)
    return spark.createDataFrame([(1, a, "\n\n".join(lines[5:12]), "T", "en"), (2, a, "Not there, not at all, nothing like this was ever written on that page before now.", "T", "en"), (3, None, "x", "T", "en")], "req_id long, html string, copied string, title string, lang string")


def test_fallback_chain(asked):
    got = {r["req_id"]: r for r in best.best(best.prepared(asked)).collect()}
    assert got[1]["status"] == "ok" and got[1]["method"] == "dmp_raw_html" and "Final method: dmp_raw_html" in got[1]["report"]
    assert got[2]["status"] == got[3]["status"] == "error" and "Final method: none" in got[2]["report"] and got[2]["report"].count(" report ---") == 3


def test_five_way_rows(asked):
    rows = best.compared(best.prepared(asked).join(asked.select("req_id", "title", "lang"), "req_id")).where("run_id = '1'").collect()
    by = {r["method"]: r for r in rows}
    assert list(by["token"].asDict()) == text.fixed.COMPARISON_FIELDS and len(rows) == 5
    assert by["token"]["status"] == "ok" and by["dmp"]["equals_token"] == "True" and by["token"]["equals_token"] == ""
    assert by["token_raw_html"]["offset_basis"] == "raw_html_chars" and by["dmp"]["output_file"] == "output/T/English/partial_benchmark_dmp_text.txt"


def test_sinks(spark, asked, tmp_path):
    rows = best.compared(best.prepared(asked).join(asked.select("req_id", "title", "lang"), "req_id"))
    pages.append_comparison(rows, str(tmp_path / "c"))
    pages.append_comparison(rows, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 30
    pages.append_comparison(rows.select("method"), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 15
    pages.write_texts(spark.createDataFrame([("A b", "fi", "x")], "title string, lang string, text string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().asDict() == {"text": "x", "topic": "A_b", "language": "Suomi"}


def test_stream_of_requests(spark, asked, tmp_path):
    asked.where("req_id < 3").select("req_id", "html", "copied").write.json(str(tmp_path / "in"))
    q = requests.start(requests.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["req_id"]: r["status"] for r in got.collect()} == {1: "ok", 2: "error"}


def test_pasted_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("some\ntext")
    (tmp_path / "b.txt").write_text(" \n")
    assert [r["copied"] for r in pages.pasted(spark, str(tmp_path)).collect()] == ["some\ntext"]


@pytest.mark.parametrize("name", ["passage_alignment", "cited_numbers", "heading_spans", "merged_spans", "reference_choice"])
def test_queries_agree_with_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = registry.QUERIES[name](spark, folder)
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == rows and set(got.columns) == set(names)


def test_files_stand_where_the_paths_say(spark, tmp_path):
    from pyspark.sql import functions as F

    from textspan.functions import text
    from textspan.sources import pages

    rows = spark.createDataFrame([("Low Water", "en", "token", "ebb é"), ("Low Water", "fi", "dmp", "flood"), ("x", "en", "token", None)], "title string, lang string, method string, text string")
    placed = rows.select(text.method_path(str(tmp_path), F.col("title"), F.col("lang"), F.col("method")).alias("path"), "text")
    written = {r["path"]: r["chars"] for r in pages.write_files(placed).collect()}
    assert len(written) == 2 and sorted(written.values()) == [5, 5]
    at = tmp_path / "Low_Water" / "English" / "partial_benchmark_token_text.txt"
    assert str(at) in written and at.read_text() == "ebb é" and [p.name for p in at.parent.iterdir()] == [at.name, f".{at.name}.crc"][:1]
    assert pages.clear_method_files(spark, str(at.parent)) == 1 and not at.exists()


def test_each_method_takes_its_own_rows(spark):
    from textspan.operators import clean

    rows = [(1, "Quay", "extracts", "The quay ( ) is old.[7]"), (2, "Pier", "html", "<p>Nets <b>dry</b> there.</p>"), (3, "Mole", "pdf", "x"), (4, None, "html", None)]
    got = {r["id"]: (r["status"], r["text"]) for r in clean.by_method(spark.createDataFrame(rows, "id int, title string, method string, body string")).collect()}
    assert got[1] == ("ok", "== Quay ==\n\nThe quay is old.") and got[2] == ("ok", "== Pier ==\n\nNets dry there.")
    assert got[3] == ("error", None) and got[4] == ("ok", None)


def test_anchor_scores_on_doubled_words(spark, tmp_path):
    lines = ["In. Enor to to.", "By the the a it.", "Gekeitä in in.", "short", "A line that is long enough of itself"]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["ord"]): r["least"] for r in registry.QUERIES["anchor_scores"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = {(d, o): x for d, o, x in db.execute(registry.ORACLES["anchor_scores"]).fetchall()}
    assert got == want and got[1, 1] == 0.92
    # the matchers' own rule takes a doubled word once
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r["v"] for r in rows.select(text.least_score(F.col("x"), 0.92).alias("v")).collect()] == [align.least_score(x, 0.92) for x in lines]


def test_passages_keep_only_pairs_that_hold_enough(spark, monkeypatch):
    """Documents that share the words of an item, but too few or too far apart, never get candidate windows."""
    item = " ".join(f"word{i}" for i in range(40))
    near = " ".join(f"word{i}" for i in range(40) if i % 8)
    far = " ".join(f"word{i} " + "filler " * 30 for i in range(40))
    texts = [f"ab {item} cd", f"ef {near} gh", far, *(f"word{i} word{i + 1} and more of it" for i in range(39))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows, keep = {}, match.stored
    monkeypatch.setattr(match, "stored", lambda df, label: (lambda t: rows.update({label: t}) or t)(keep(df, label)))
    got = sorted(r["doc_id"] for r in match.passages(docs, items).collect())
    assert got == [0, 1]
    assert {r["doc_id"] for r in rows["candidates"].collect()} == {0, 1}
    assert {r["doc_id"] for r in rows["postings"].collect()} == {0, 1, 2}


def test_offsets_come_in_runs(spark):
    """No batch of answers holds the offsets of many long texts, whatever number of rows Spark sends."""
    texts = ["Ab  c" * 1000, None, "", "x" * 5000, "É ß"]
    sizes = [len(r) for r in clean.runs(pd.Series(texts), 4000)]
    assert sum(sizes) == len(texts) and len(sizes) > 1 and list(clean.runs(pd.Series([], dtype="object"))) == []
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    for column, rule in ((clean.folded, prose.folded), (clean.diff_form, lambda t: prose.folded(t, tight=True))):
        got = {r["i"]: (r["v"]["text"], r["v"]["places"]) for r in rows.select("i", column("t").alias("v")).collect()}
        assert got == {i: (None, None) if t is None else rule(t) for i, t in enumerate(texts)}
