"""Texts to tables of lines, paragraphs, headings, citations, tokens and postings; each row knows its
document and its offsets. Native: split parts, and running lengths by a window for each document. Rows that
share a key are taken as one document; give them keys of their own first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspan.functions import fixed, text


def lines(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, ord, text, start, end) of lines between line feeds, the line feed not counted."""
    cut = docs.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("ord", "text"))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return cut.withColumn("start", before).withColumn("end", F.col("start") + F.length("text"))


def headings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, title, start, end), and next_start or null."""
    s = text.squeeze_ends(F.col("text"))
    found = lines(docs, key, body).where(text.is_heading(s))
    start = F.col("start") + F.length(F.regexp_extract("text", r"(?U)^\s*", 0))
    out = found.select(key, text.squeeze_ends(F.regexp_extract(s, text.U + fixed.HEADING, 2)).alias("title"), start.cast("int").alias("start"), (start + F.length(s)).cast("int").alias("end"))
    return out.withColumn("next_start", F.lead("start").over(Window.partitionBy(key).orderBy("start")))


def section_spans(heads: DataFrame, docs: DataFrame, titles=fixed.DROPPED_TITLES, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, start, end) of sections with the given titles, to the next heading or the end."""
    sizes = docs.select(key, F.length(body).alias("size"))
    named = heads.where(F.lower("title").isin(sorted(titles)))
    return named.join(sizes, key).select(key, "start", F.coalesce("next_start", "size").alias("end"))


def pieces(docs: DataFrame, pattern: str, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, ord, value, start, end) of all matches of a pattern without groups: the gaps between
    matches give the offsets."""
    found = F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(body), pattern, -1)
    both = docs.select(key, F.posexplode(F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"))).alias("ord", "m"))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.value") + F.length("m.gap")
    end = F.sum(size).over(w).cast("int")
    return both.select(key, "ord", F.col("m.value").alias("value"), (end - F.length("m.value")).cast("int").alias("start"), end.alias("end"))


def tokens(docs: DataFrame, key: str = "doc_id", body: str = "text", skip: DataFrame | None = None) -> DataFrame:
    """(key, pos, value, start, end) of ASCII words outside citations and the skipped spans."""
    # a citation's digits are masked by as many blanks, so offsets stay
    masked = docs.select(key, _masked(F.col(body)).alias(body))
    found = pieces(masked, "[A-Za-z0-9]+", key, body)
    if skip is not None:
        spans = skip.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        joined = found.join(spans, key, "left")
        found = joined.where(~F.coalesce(F.exists("spans", lambda s: (F.col("start") >= s["start"]) & (F.col("start") < s["end"])), F.lit(False))).drop("spans")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    return found.select(key, pos.alias("pos"), F.lower("value").alias("value"), "start", "end")


def _masked(c: Column) -> Column:
    cited = F.regexp_extract_all(c, F.lit(text.CITATION), F.lit(0))
    gaps = F.split(c, text.CITATION, -1)
    blank = F.transform(cited, lambda x: F.repeat(F.lit(" "), F.length(x)))
    pairs = F.zip_with(gaps, blank, lambda g, b: F.concat(g, F.coalesce(b, F.lit(""))))
    return F.when(F.size(cited) == 0, c).otherwise(F.array_join(pairs, ""))


def citations(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, ord, number, start, end); number is the payload."""
    found = pieces(docs, text.CITATION, key, body)
    return found.select(key, "ord", F.btrim("value", F.lit("[]")).alias("number"), "start", "end")


def postings(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value, n, positions)."""
    return found.groupBy(key, "value").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("pos")).alias("positions"))


def frequencies(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key, "value").agg(F.count("*").alias("n"))


def paragraph_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text.newlines(c), r"\n\s*\n"), lambda p: text.squeeze_ends(p) != ""))


def citation_runs(found: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """(key, ord, sequence, start, end): each run of ``size`` citations."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(0, size - 1)
    out = found.select(key, "ord", F.collect_list("number").over(w).alias("sequence"), F.first("start").over(w).alias("start"), F.last("end").over(w).alias("end"))
    return out.where(F.size("sequence") == size)


def merged_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping or touching spans of a document as one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("end > start").withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def copied_headings(lines_of: DataFrame, heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pasted lines (key, ord, text) that are headings of the page: (key, ord, title, start of the
    last heading so called)."""
    known = heads.groupBy(key, text.comparable_plain(F.col("title")).alias("name")).agg(F.max("start").alias("heading_start"))
    named = lines_of.withColumn("title", F.btrim("text", F.lit(" =\t\r\n"))).withColumn("name", text.comparable_plain(F.col("title")))
    return named.where(~F.col("name").isin(sorted(fixed.DROPPED_TITLES))).join(known, [key, "name"]).select(key, "ord", "title", "heading_start")


def without_ignored(lines_of: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pasted lines outside References, See also and External links: a running last() of the line
    that opened or ended such a section. known: (key, name) of the page's headings."""
    names = known.where(~F.col("name").isin(sorted(fixed.DROPPED_TITLES))).select(key, "name", F.lit(True).alias("known")).distinct()
    named = lines_of.withColumn("name", text.comparable_plain(F.btrim(text.squeeze_ends(F.col("text")), F.lit(" =\t"))))
    marked = named.join(names, [key, "name"], "left")
    event = F.when(F.col("name").isin(sorted(fixed.DROPPED_TITLES)), True).when(F.col("known"), False)
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False))).where("not inside").select(key, "ord", "text")


def token_chunks(docs: DataFrame, size: int = 60, least: int = 8, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, start, end) of the token chunks that anchor a passage: ``size`` tokens each, a last one of
    ``least`` or more, and the only one whatever its size."""
    counted = docs.select(key, F.size(text.ascii_words(F.col(body))).alias("n")).where("n > 0")
    cut = counted.select(key, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size))).alias("start")).withColumn("end", F.least("n", F.col("start") + size))
    return cut.where((F.col("n") <= size) | (F.col("end") - F.col("start") >= least)).select(key, "start", "end")


def windows(found: DataFrame, size: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, start) of windows of ``size`` sentences, one after the other, and the last one. found: a row for
    each sentence (key, idx)."""
    n = found.groupBy(key).agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= size)
    begins = F.array_union(F.sequence(F.lit(0), F.col("n") - size, F.lit(size)), F.array(F.col("n") - size))
    return n.select(key, F.explode(begins).alias("start"))


def chosen_references(cited: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number, entry, renumbered): the numbers a text cites, in the order of their first citation;
    those with an entry are numbered anew, the others have null. cited: (key, ord, number); entries:
    (key, number, entry)."""
    first = cited.groupBy(key, "number").agg(F.min("ord").alias("ord"))
    found = first.join(entries, [key, "number"], "left")
    place = F.row_number().over(Window.partitionBy(key, F.col("entry").isNotNull()).orderBy("ord"))
    return found.select(key, "number", "entry", F.when(F.col("entry").isNotNull(), place).alias("renumbered"))
