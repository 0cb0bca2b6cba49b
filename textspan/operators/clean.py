"""Cleaning of plain extracts and pages.

Most texts need no fold over lines or braces: column expressions clean them inside the JVM. Only
texts with a formula, a power hint or a section to leave out are handed to Python; the function
gets null for all others, so that no other text crosses over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspan.functions import fixed, markup, prose, text


def arrow(ddl: str):
    """An Arrow function over batches that is made when it is called: no session is needed before."""
    return lambda f: lambda *columns: F.pandas_udf(f, ddl)(*columns)


#: Characters of texts that are answered together where every character has an answer of its own.
TOGETHER = 1 << 20
#: Bytes of an Arrow batch that Spark sends to a worker, and what it is where nobody has set it.
_SENT, _SENT_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def runs(texts: pd.Series, most: int = TOGETHER) -> Iterator[pd.Series]:
    """A batch in runs of about ``most`` characters; a longer text is a run of its own."""
    before = texts.str.len().fillna(0).astype("int64").cumsum() // most if len(texts) else texts
    for _, run in texts.groupby(before.to_numpy(), sort=False):
        yield run


def placed(rule: Callable[[str], tuple[str, list[int]]]):
    """An Arrow function from texts to texts with the offset of each character. Offsets are 32-bit numbers
    from the start on, and no more of them are held than those of a run of texts."""

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run in runs(batch):
                found = [(None, None) if t is None else ((got := rule(t))[0], np.array(got[1], dtype="int32")) for t in run]
                yield pd.DataFrame(found, columns=["text", "places"])

    def column(c: Column | str) -> Column:
        spark = SparkSession.active()
        if spark.conf.get(_SENT) == _SENT_DEFAULT:
            spark.conf.set(_SENT, "8m")

        @F.pandas_udf("text string, places array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            return answers(batches)

        return run(c)

    return column


def needs_fold(c: Column, mode: str) -> Column:
    """Whether a text may need a fold: cheap tests of the whole text, which may say yes too often."""
    titles = "|".join(sorted(fixed.DROPPED_TITLES | fixed.NOTE_TITLES))
    end = r"[\v\x1c-\x1e]"
    titled = c.rlike(rf"(?iU)(?:\A|{end})\s*=*\s*(?:{titles})\s*=*\s*(?:\z|{end})")
    power = c.contains("(=") & c.rlike(r"(?U)\d\s+\(=\d{2,6}\)")
    return titled | power | (c.contains("$") if mode == "latex" else F.lit(False)) | (c.contains(fixed.FORMULA_MARK) if mode != "keep" else F.lit(False))


def _native(c: Column, mode: str, citations: bool) -> Column:
    caret = r"(?dmU)^[^\S\n]*\^(?:[^\S\n]*\^|[^\S\n]*[\p{L}\p{N}](?=\s|\^|\p{Lu}|$))*[^\S\n]*"
    c = F.regexp_replace(text.one_text(c), caret, "")
    c = text.heading_lines(c if citations else text.drop_citations(c))
    if mode != "keep":
        # no fragment is longer than 120 characters
        c = F.transform(F.split(c, "\n{2,}"), lambda p: F.struct(p.alias("p"), text.squeeze_ends(p).alias("s")))
        c = F.array_join(F.transform(F.filter(c, lambda x: (F.length(x["s"]) > 120) | ~text.fragment(x["s"])), lambda x: x["p"]), "\n\n")
    return text.final_spacing(F.regexp_replace(c, r"(?U)\s*\(\s*\)", ""))


def _folded(mode: str, citations: bool, references: bool):
    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else prose.clean(t, mode, citations, references))

    return folded


def clean(c: Column, mode: str = "remove", citations: bool = False, references: bool = False) -> Column:
    """The whole chain on a plain extract; null stays null."""
    if mode not in fixed.MATH_MODES:
        raise ValueError(f"no such math mode: {mode}")
    fold = needs_fold(c, mode)
    return F.when(fold, _folded(mode, citations, references)(F.when(fold, c))).otherwise(_native(c, mode, citations))


def cleaned(df: DataFrame, body: str = "text", mode: str = "remove", citations: bool = False, references: bool = False) -> DataFrame:
    """df with ``body`` clean, as two plans: rows that need a fold go to Arrow, no other row does."""
    if mode not in fixed.MATH_MODES:
        raise ValueError(f"no such math mode: {mode}")
    fold = F.coalesce(needs_fold(F.col(body), mode), F.lit(False))
    native = df.where(~fold).withColumn(body, _native(F.col(body), mode, citations))
    return native.unionByName(df.where(fold).withColumn(body, _folded(mode, citations, references)(F.col(body))))


def extracts(df: DataFrame, body: str = "text", title: str = "title", mode: str = "remove") -> DataFrame:
    """df with ``body`` as plain extracts are handed out: clean, without empty notes, under the title.
    A column for each step, as each step reads the one before more than once."""
    # a generator stands between: the steps below read the clean text, not the chain that makes it
    df = cleaned(df, body, mode).withColumn(body, F.explode(F.array(body)))
    # most texts have no such word at all
    df = df.withColumn("__noted", F.col(body).rlike(r"(?i)notes?"))
    df = df.withColumn("__notes", F.when(F.col("__noted"), text.note_section(F.col(body))))
    bodied = F.size(F.filter(text.lines(F.col("__notes")), lambda x: text.squeeze_ends(x) != "")) > 1
    df = df.withColumn("__kept", F.when(F.col("__noted") & ~bodied, text.without_notes_title(F.col(body))).otherwise(F.col(body)))
    return df.withColumn(body, text.under_topic(F.col("__kept"), F.col(title))).drop("__noted", "__notes", "__kept")


def page(html: Column, mode: str = "remove") -> Column:
    """A rendered page as clean text."""

    @F.pandas_udf("string")
    def cleaned(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else markup.clean_page(h, mode))

    return cleaned(html)


def by_method(df: DataFrame, mode: str = "remove") -> DataFrame:
    """df (title, method, body, and others) with the text that each row's method makes of its body under the
    title's heading, and status: plain extracts and pages take a plan each, other methods are error rows."""
    known = F.coalesce(F.col("method"), F.lit(""))
    plain = extracts(df.where(known == "extracts").withColumn("text", F.col("body")), "text", "title", mode).withColumn("status", F.lit("ok"))
    pages = df.where(known == "html").withColumn("text", page(F.col("body"), mode))
    pages = pages.withColumn("text", text.with_topic(F.col("text"), F.col("title"))).withColumn("status", F.lit("ok"))
    other = df.where(~known.isin("extracts", "html")).withColumn("text", F.lit(None).cast("string")).withColumn("status", F.lit("error"))
    return plain.unionByName(pages).unionByName(other)


def cited_page(html: Column, mode: str = "remove", markers: bool = True) -> Column:
    """Clean text with the rebuilt References section."""

    @F.pandas_udf("string")
    def cleaned(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else markup.clean_cited(h, mode, markers))

    return cleaned(html)


@arrow("array<string>")
def captions(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: None if h is None else markup.captions(h))


@arrow("array<string>")
def references(pages: pd.Series) -> pd.Series:
    """Texts of the numbered references; their place is their number."""
    return pages.map(lambda h: None if h is None else markup.reference_list(h))


def reference_entries(items: Column) -> Column:
    """A map from number to text of ``references``."""
    return F.map_from_arrays(F.transform(items, lambda x, i: (i + 1).cast("string")), items)


#: Raw-visible text and the page offset of each of its characters.
visible = placed(markup.visible)
#: Case and blanks folded, with offsets.
folded = placed(prose.folded)
#: As ``folded``, without citations and blanks before punctuation.
diff_form = placed(lambda t: prose.folded(t, [m.span() for m in prose.CITATION.finditer(t)], tight=True))


@arrow("array<struct<text: string, start: int, end: int>>")
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [s._asdict() for s in prose.sentences(t)])


@arrow("string")
def comparable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else prose.comparable(t))


@arrow("string")
def copied_math(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else prose.copied_math(t))


@arrow("double")
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else prose.ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


@arrow("array<string>")
def unified(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else prose.unified(a, b) for a, b in zip(left, right, strict=True)])


