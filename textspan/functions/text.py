"""Column functions over texts, all built in: they stay in one code-generated stage.

Patterns carry ``(?U)`` where blanks and digits are Unicode. Offsets come from lengths of split parts
(code points), never from regexp_instr.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textspan.functions import fixed

U = "(?U)"
CITATION = U + fixed.CITATION
#: Line ends that Python's splitlines knows.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _in(values) -> list[str]:
    return sorted(values)


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, U + r"\s+", " "))


def tighten(c: Column) -> Column:
    return F.regexp_replace(c, U + r"\s+([,.;:!?])", "$1")


def drop_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def drop_maintenance(c: Column) -> Column:
    return F.regexp_replace(c, "(?iU)" + fixed.MAINTENANCE, "")


def tidy(c: Column) -> Column:
    return F.trim(tighten(F.regexp_replace(c, U + r"\s+", " ")))


def caption(c: Column) -> Column:
    return tidy(F.regexp_replace(drop_citations(c), r"(?iU)\bedit\b", ""))


def latex(c: Column) -> Column:
    c = F.replace(F.regexp_replace(c, U + r"\s+", " "), F.lit("\\text{"), F.lit("\\mathrm{"))
    return F.regexp_replace(F.trim(c), "[,.;:]+$", "")


def identifiers(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\(?:displaystyle|mathrm|text|operatorname)\s*", " ")
    c = F.regexp_replace(c, r"\\(?:frac|begin|end|sum|log|Pr|mid|left|right)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\\[A-Za-z]+", " "), "[^0-9A-Za-z]+", " "))


def lines(c: Column) -> Column:
    """Lines as Python's splitlines gives them, no empty one after a final line end; one empty line
    for an empty text. c stands once in the result, so that chains don't evaluate it again."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def is_heading(line: Column) -> Column:
    return line.rlike(U + fixed.HEADING)


def title_of(line: Column) -> Column:
    inner = F.regexp_extract(line, U + fixed.HEADING, 2)
    return F.lower(F.trim(F.when(is_heading(line), inner).otherwise(squeeze_ends(line))))


def squeeze_ends(c: Column) -> Column:
    """strip(): Unicode blanks off both ends."""
    return F.regexp_replace(c, U + r"^\s+|\s+\z", "")


def plain_headings(c: Column) -> Column:
    titled = lambda x: F.when(is_heading(x), F.concat(F.lit("== "), F.trim(F.regexp_extract(x, U + fixed.HEADING, 2)), F.lit(" =="))).otherwise(x)
    return F.array_join(F.transform(lines(c), titled), "\n")


def final_spacing(c: Column) -> Column:
    # patterns match only what changes: a single blank or line feed is left alone
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]{2,}|\t", " "), " \n ?|\n ", "\n")
    c = tighten(F.regexp_replace(c, "\n{3,}", "\n\n"))
    c = F.regexp_replace(c, r"(?m)(?:\n*\n|\A)[ \t]*(==\s+[^\n]+?\s+==)[ \t]*$", "\n\n$1")
    return squeeze_ends(c)


def one_text(c: Column) -> Column:
    """The same lines, parted by line feeds alone."""
    return F.regexp_replace(F.regexp_replace(newlines(c), f"(?:{LINE_END})\\z", ""), LINE_END, "\n")


def heading_lines(c: Column) -> Column:
    """``plain_headings`` of ``one_text``, by one pattern over the whole text."""
    return F.regexp_replace(c, r"(?dmU)^[^\S\n]*(=+)[^\S\n]*(.*?)[^\S\n]*\1[^\S\n]*$", "== $2 ==")


def glyph(c: Column) -> Column:
    return (F.length(squeeze_ends(c)) > 0) & ~c.rlike(r"[\p{L}\p{N}_]")


def rendered_math(line: Column) -> Column:
    s = F.regexp_replace(squeeze_ends(line), "[,.;:]+$", "")
    n = F.length(s)
    telling = s.rlike("[" + fixed.MATH_OPERATORS + "\u0370-\u03ff\u2061]") | s.rlike(fixed.MATH_CALL)
    return (
        ((n <= 2) & s.rlike("^[A-Za-z0-9]*$"))
        | (s == "a constant")
        | s.rlike(fixed.MATH_LINE)
        | ((n <= 30) & s.rlike(fixed.MATH_SIGN))
        | ((n <= 80) & ~s.contains(" ") & s.rlike(r"[A-Za-z]\("))
        | (telling & (n <= 180))
    )


def math_fragment(paragraph: Column) -> Column:
    return fragment(squeeze_ends(paragraph))


def fragment(s: Column) -> Column:
    """``math_fragment`` of a paragraph without blanks at its ends."""
    n = F.length(s)
    short = ((n <= 2) & s.rlike("^[A-Za-z0-9]+$")) | ((n <= 40) & s.contains("\n") & s.rlike(r"^[A-Za-z0-9\s.]+$")) | (s == "a constant.")
    wordy = (F.regexp_count(s, F.lit(r"\b[A-Za-z]{3,}\b")) >= 2) | (F.regexp_count(s, F.lit("[A-Za-z]{2,}")) >= 4)
    return (s != "") & ~is_heading(s) & (short | (~wordy & (n <= 120) & s.rlike(fixed.MATH_ONLY) & s.rlike(fixed.MATH_SIGN)))


def math_word(line: Column) -> Column:
    s = squeeze_ends(line)
    return (s == "") | (s.rlike("^[a-z ]+$") & (F.length(s) <= 60))


def noise(line: Column) -> Column:
    s = squeeze_ends(line)
    seen = F.length(F.regexp_replace(s, U + r"\s", ""))
    letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
    return (seen == 0) | (letters / F.greatest(seen, F.lit(1)) < 0.30) | F.lower(s).isin("edit", "source", "map", "image") | ((F.length(s) < 40) & s.rlike(r"^[^\p{L}]+$"))


def math_heavy(line: Column) -> Column:
    s = squeeze_ends(line)
    seen = F.length(F.regexp_replace(s, U + r"\s", ""))
    letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
    signs = F.regexp_count(s, F.lit(r"[+\-=*/^_{}\\∝×÷√∑∫≤≥≈≠−]"))
    part = F.greatest(seen, F.lit(1))
    heavy = ((signs >= 2) & (signs / part >= 0.12)) | ((seen >= 3) & (letters / part < 0.35) & (signs >= 1)) | s.rlike(r"\b[a-zA-Z]\s*[=∝]\s*[A-Za-z0-9]")
    return (seen > 0) & heavy


def comparable_plain(c: Column, doubled: bool = False) -> Column:
    """The comparable form of a text without formulas. doubled: a word met twice in a row stays twice."""
    c = drop_citations(newlines(c))
    c = c if doubled else F.regexp_replace(c, r"(?U)\b([A-Za-z][A-Za-z0-9_]*)\s+\1\b", "$1")
    return F.trim(F.lower(F.regexp_replace(tighten(c), U + r"\s+", " ")))


def words(c: Column) -> Column:
    """Unicode words of a comparable text."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def set_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger set; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def in_order(anchor: Column, window: Column) -> Column:
    """Share of the anchor's words met in one pass over the window."""
    step = lambda s, w: F.when(
        F.array_position(F.slice(window, s["at"] + 1, F.greatest(F.size(window) - s["at"], F.lit(0))), w) > 0,
        F.struct((s["at"] + F.array_position(F.slice(window, s["at"] + 1, F.greatest(F.size(window) - s["at"], F.lit(0))), w).cast("int")).alias("at"), (s["met"] + 1).alias("met")),
    ).otherwise(s)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("met"))
    met = F.aggregate(anchor, start, step)["met"]
    return F.when((F.size(anchor) == 0) | (F.size(window) == 0), F.lit(0.0)).otherwise(met / F.size(anchor))


def weight(token: Column, count: Column) -> Column:
    light = token.isin(_in(fixed.STOP_WORDS)) | (F.length(token) <= 2)
    return F.when(light, F.lit(0.25)).otherwise(F.lit(1.0)) / F.sqrt(F.greatest(count, F.lit(1)).cast("double"))


def citations(c: Column) -> Column:
    """Payloads of [n] markers in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(0)), lambda x: F.btrim(x, F.lit("[]")))


def numbers_in(payload: Column) -> Column:
    """``1, 3-5`` as 1, 3, 4, 5; ranges up to 100."""
    ranged = U + r"^(\d+)\s*[\u2013-]\s*(\d+)$"

    def part(p: Column) -> Column:
        a, b = F.regexp_extract(p, ranged, 1).try_cast("long"), F.regexp_extract(p, ranged, 2).try_cast("long")
        fits = p.rlike(ranged) & (b - a >= 0) & (b - a <= 100)
        return F.when(fits, F.transform(F.sequence(a, F.when(fits, b).otherwise(a)), lambda n: n.cast("string"))).when(p.rlike(U + r"^\d+$"), F.array(p)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(payload, ","), lambda p: part(squeeze_ends(p))))


def cited_numbers(c: Column) -> Column:
    return F.flatten(F.transform(citations(c), numbers_in))


def unique(numbers: Column) -> Column:
    """Each value once, in the order of first occurrence."""
    return F.array_distinct(numbers)


def without_references(c: Column) -> Column:
    """Without the References section, which lasts to the next heading."""
    return squeeze_ends(F.regexp_replace(c, r"(?s)\s*(?m:^)== References ==(?m:$).*?(?=(?m:^)== |\z)", "\n\n"))


def context(c: Column, end: Column, many: int = 3, reach: int = 240) -> Column:
    """The first words behind a citation that ends at ``end``."""
    return F.slice(words(comparable_plain(F.substring(c, end + 1, F.lit(reach)))), 1, many)


def reference_block(numbers: Column, texts: Column) -> Column:
    items = F.zip_with(numbers, texts, lambda n, t: F.concat(n, F.lit(". "), t))
    return F.when(F.size(numbers) == 0, F.lit("")).otherwise(F.concat(F.lit("== References ==\n\n"), F.array_join(items, "\n\n")))


def topic(title: Column) -> Column:
    return F.concat(F.lit("== "), title, F.lit(" =="))


def under_topic(c: Column, title: Column) -> Column:
    """c, without blanks at its ends, under a heading that it may have already."""
    head = topic(title)
    return F.when(c == "", head).when(F.lower(F.left(c, F.length(head))) == F.lower(head), c).otherwise(F.concat(head, F.lit("\n\n"), c))


def with_topic(c: Column, title: Column) -> Column:
    return under_topic(squeeze_ends(c), title)


def note_section(c: Column) -> Column:
    """From the first Note(s) line on."""
    cut = lines(c)
    at = F.array_position(F.transform(cut, lambda x: title_of(x).isin(_in(fixed.NOTE_TITLES))), True)
    return F.when(at > 0, squeeze_ends(F.array_join(F.slice(cut, at.cast("int"), F.greatest(F.size(cut), F.lit(1))), "\n"))).otherwise("")


def notes_have_body(c: Column) -> Column:
    return F.size(F.filter(lines(note_section(c)), lambda x: squeeze_ends(x) != "")) > 1


def without_notes_title(c: Column) -> Column:
    return squeeze_ends(F.regexp_replace(c, r"(?iU)\n{0,2}(?:==\s*)?(?:Notes?)(?:\s*==)?\s*\z", ""))


def drop_empty_notes(c: Column) -> Column:
    return F.when(notes_have_body(c), c).otherwise(without_notes_title(c))


def short(anchor: Column, limit: int = 180) -> Column:
    s = squeeze(anchor)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 3), F.lit("...")))


def least_score(plain: Column, threshold: float, doubled: bool = False) -> Column:
    """Score an anchor must have; ``plain`` holds no formula. doubled: words met twice in a row count twice."""
    mathy = math_heavy(plain) | plain.contains("$") | (F.regexp_count(F.right(plain, F.lit(140)), F.lit(r"(?U)\b[A-Za-z]\b")) >= 5)
    return F.when(F.length(comparable_plain(plain, doubled)) < 14, F.lit(max(threshold, 0.95))).when(mathy, F.lit(max(0.87, threshold - 0.05))).otherwise(F.lit(threshold))


# -- spans ---------------------------------------------------------------------------------------


def source_span(places: Column, start: Column, end: Column) -> Column:
    """The span of the source under [start, end) of a folded text."""
    a = F.least(F.greatest(start, F.lit(0)), F.size(places) - 1)
    b = F.greatest(a + 1, F.least(end, F.size(places)))
    empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.when(F.size(places) == 0, empty).otherwise(F.struct(F.get(places, a).cast("int").alias("start"), (F.get(places, b - 1) + 1).cast("int").alias("end")))


def page_place(places: Column, at: Column, end: bool = False) -> Column:
    i = F.greatest(F.least(at - int(end), F.size(places) - 1), F.lit(0))
    return F.coalesce(F.get(places, i) + int(end), F.lit(0))


def cut_out(c: Column, start: Column, end: Column) -> Column:
    """Without [start, end) and the blanks beside it."""
    return F.concat(F.regexp_replace(F.substring(c, F.lit(1), start), "[ \t]+$", ""), F.regexp_replace(F.substring(c, end + 1, F.length(c)), "^[ \t]+", ""))


def at_line_start(c: Column, start: Column) -> Column:
    return squeeze_ends(F.substring_index(F.substring(c, F.lit(1), start), "\n", -1)) == ""


def find_exact(page: Column, window: Column, last: bool = False) -> Column:
    """0-based place of a window, or -1."""
    if last:
        back = F.call_function("locate", F.reverse(window), F.reverse(page))
        return F.when(back > 0, F.length(page) - back - F.length(window) + 1).otherwise(-1)
    return F.call_function("locate", window, page) - 1


def telling(chunk: Column) -> Column:
    n = F.regexp_count(chunk, F.lit("[a-z0-9]{3,}"))
    return (n >= 2) | ((F.length(squeeze_ends(chunk)) >= 18) & (n >= 1))


def tag_of(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?\s*([A-Za-z0-9:-]+)", 1))


# -- files and reports ---------------------------------------------------------------------------


def safe_name(c: Column) -> Column:
    c = F.regexp_replace(F.replace(squeeze_ends(c), F.lit(" "), F.lit("_")), "[<>:\"/\\\\|?*\\x00-\\x1f]", "_")
    c = F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("wikipedia_page"))


def language_folder(lang: Column) -> Column:
    low = F.lower(lang)
    return reduce(lambda rest, kv: F.when(low == kv[0], F.lit(kv[1])).otherwise(rest), fixed.LANGUAGE_FOLDERS.items(), low)


def folder(root: str, title: Column, lang: Column) -> Column:
    return F.concat_ws("/", F.lit(root), safe_name(title), language_folder(lang))


#: What follows the folder in each kind of file; {stem} is the lower-case safe title.
FILES = {
    "comparison": "{stem}_comparison.txt",
    "runtime": "{stem}_runtime.txt",
    "references": "{stem}_html_references.txt",
    "raw_html": "{stem}_raw_html.txt",
    "raw_extracts": "{stem}_raw_extracts.txt",
    "partial": "partial_text.txt",
    "partial_report": "partial_match_report.txt",
    "hybrid": "partial_hybrid_text.txt",
    "hybrid_report": "partial_hybrid_match_report.txt",
    "token": "partial_token_text.txt",
    "token_report": "partial_token_match_report.txt",
    "dmp": "partial_dmp_text.txt",
    "dmp_report": "partial_dmp_match_report.txt",
    "dmp_raw_html": "partial_dmp_raw_html_text.txt",
    "dmp_raw_html_report": "partial_dmp_raw_html_match_report.txt",
    "token_raw_html": "partial_token_raw_html_text.txt",
    "token_raw_html_report": "partial_token_raw_html_match_report.txt",
    "best": "partial_best_text.txt",
    "best_report": "partial_best_match_report.txt",
    "benchmark": "{stem}_partial_benchmark_5way.csv",
}


def path(root: str, title: Column, lang: Column, kind: str) -> Column:
    before, stem, after = FILES[kind].partition("{stem}")
    name = F.concat(F.lit(before), F.lower(safe_name(title)), F.lit(after)) if stem else F.lit(before)
    return F.concat_ws("/", folder(root, title, lang), name)


def text_path(root: str, title: Column, lang: Column, method: str, mode: str) -> Column:
    return F.concat_ws("/", folder(root, title, lang), F.concat(F.lower(safe_name(title)), F.lit(f"_{method}_{mode}.txt")))


def with_method(path: Column, method: Column) -> Column:
    """A path with the method before its ending; ``.txt`` where it has none."""
    name, ending = r"^(.*/)?([^/]+?)(\.[^./]*)?$", F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    stem = F.concat(F.regexp_extract(path, name, 1), F.regexp_extract(path, name, 2))
    return F.concat(stem, F.lit("_"), method, F.when(ending == "", ".txt").otherwise(ending))


def runtime_label(base: Column, mode: Column, title: Column) -> Column:
    """A timing's label, which names the page."""
    return F.concat(base, F.lit(" ("), mode, F.lit(", "), title, F.lit(")"))


def runtime_lines(label: Column, seconds: Column) -> Column:
    return F.concat(label, F.lit(": "), F.format_number(seconds, "0.000"), F.lit(" seconds"))


def method_path(root: str, title: Column, lang: Column, method: Column) -> Column:
    return F.concat_ws("/", folder(root, title, lang), F.concat(F.lit("partial_benchmark_"), method, F.lit("_text.txt")))


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def edge_words(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0))
    return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")).alias("last"))


def report_value(report: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(report, rf"(?m)^\Q{label}\E:\s*(.+)$", 1))


def failure_text(method: Column, error: Column, report: Column) -> Column:
    head = F.concat(F.lit("Benchmark method failed\n\nMethod: "), method, F.lit("\nError: "), error)
    body = squeeze_ends(report)
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\n\nReport:\n"), body))


def label_order(label: Column) -> Column:
    # The order of runtime labels.
    starts = ("Extracts API runtime", "HTML parser runtime", "Runtime mismatch", "Partial HTML runtime", "Partial hybrid runtime", "Partial token runtime", "Partial DMP runtime")
    return reduce(lambda rest, i: F.when(label.startswith(starts[i]), F.lit(i)).otherwise(rest), reversed(range(len(starts))), F.lit(9))
