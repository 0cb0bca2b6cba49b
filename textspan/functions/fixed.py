"""Word lists, class lists and patterns that define results."""

# Words that carry little weight when tokens are matched.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have in is it of on or that the their these this to was were with".split()
)
# Identifiers that may be repeated beside their formula.
FORMULA_NAMES = frozenset("argmax argmin cos exp gelu ln log max min pr relu sigmoid sin softmax tan tanh".split())
# Section titles.
DROPPED_TITLES = frozenset({"see also", "references", "external links"})
DROPPED_IDS = frozenset({"See_also", "References", "External_links"})
NOTE_TITLES = frozenset({"note", "notes"})
# Folder names of languages.
LANGUAGE_FOLDERS = {"bn": "Bangla", "en": "English", "fi": "Suomi"}
# Policies.
MATH_MODES = ("remove", "latex", "keep")
REFERENCE_MODES = ("none", "original", "smart")
CONFIRM_MODES = ("none", "fuzzy")
METHODS = ("hybrid", "token", "dmp", "token_raw_html", "dmp_raw_html")
FALLBACKS = ("dmp_raw_html", "hybrid", "token_raw_html")

# Tags and classes of pages.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAK_TAGS = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
)
RAW_BREAK_TAGS = BREAK_TAGS | {"td", "th"}
SKIPPED_TAGS = frozenset("figcaption figure map script style table".split())
SKIPPED_CLASSES = frozenset(
    "ambox asbox catlinks hatnote infobox image imagemap locmap metadata mw-cite-backlink mw-file-description mw-kartographer-map mw-editsection navbox noexcerpt noprint noviewer reference reflist sidebar thumb thumbcaption thumbinner toc vertical-navbox".split()
)
MATH_CLASSES = frozenset(
    "mwe-math-element mwe-math-fallback-image-display mwe-math-fallback-image-inline mwe-math-mathml-display mwe-math-mathml-inline".split()
)
CAPTION_CLASSES = frozenset("gallerytext mw-kartographer-caption thumbcaption".split())
CAPTION_NOISE = frozenset("mw-cite-backlink mw-editsection noprint reference".split())
REFERENCE_NOISE = frozenset("mw-cite-backlink mw-editsection noprint".split())
SPACED_TAGS = frozenset("br div li p".split())

# Patterns, in a syntax that Python and Java share.
CITATION = r"\[\d+(?:\s*[,\u2013-]\s*\d+)*\]"
MAINTENANCE = r"\[\s*(?:citation needed|better source needed|clarification needed|dubious\s*[\u2013\u2014-]\s*discuss)\s*\]"
HEADING = r"^\s*(=+)\s*(.*?)\s*\1\s*$"
FORMULA_MARK = "{\\displaystyle"
MATH_SIGN = r"[+\-–−=∝×*/^{}\\]"
MATH_ONLY = r"^[\sA-Za-z0-9+\-–−=∝×*/^().,{}\\]+$"
MATH_LINE = r"^[+\-–−=∝×*/^(),.{}\\]+$"
MATH_OPERATORS = "=∝×÷√∑∫≤≥≈≠−|"
HEAVY_SIGNS = "+-=*/^_{}\\∝×÷√∑∫≤≥≈≠−"
MATH_CALL = r"\b(?:Pr|log|sin|cos|tan|exp|token)\s*\("
ALWAYS_JOINS = r"\b(?:al|e\.g|i\.e)\.$"
MAY_JOIN = r"\b(?:etc|vs|fig|no|vol|pp)\.$"
FLAT_POWER = r"(\b\d+)\s+\(=(\d{2,6})\)"
HEADING_LINE = r"(?m)\n+[^\S\n]*(==[^\S\n]+[^\n]+?[^\S\n]+==)[^\S\n]*$"
#: (pattern, replacement) for a symbol before its own formula, in this order.
SYMBOL_TWINS = (
    (r"\b([A-Za-z]{4,})([A-Za-z])\s+\$\2\$", r"\1 $\2$"),
    (r"\b([A-Za-z]\([^$\n]+?\))\s+\$\1\$", r"$\1$"),
    (r"\b((?=\w{1,3}\s|[A-Za-z]+[\d_]|(?i:" + "|".join(sorted(FORMULA_NAMES)) + r")\s)[A-Za-z][A-Za-z0-9_]*)\s+\$\1\$", r"$\1$"),
    (r"(\$[A-Za-z][A-Za-z0-9_]*\$)\s+([\"”])", r"\1\2"),
)
RAW_ABBREVIATIONS = frozenset({"al", "e.g", "i.e", "etc", "fig", "vs"})

# The columns of a comparison row, in order.
COMPARISON_FIELDS = (
    "schema_version run_id timestamp_utc topic lang input_file input_sha256 input_chars math_mode method method_family match_surface offset_basis "
    "uses_full_clean status fetch_seconds full_clean_seconds match_seconds estimated_total_seconds output_file output_chars output_sha256 "
    "output_first_word output_last_word equals_hybrid equals_token start_offset end_offset start_score end_score score_summary settings error"
).split()
COMPARISON_VERSION = "2"
METHOD_FACTS = {
    "hybrid": ("hybrid", "clean_text", "clean_text_chars", True),
    "token": ("token", "clean_text", "clean_text_chars", True),
    "dmp": ("dmp", "clean_text", "clean_text_chars", True),
    "token_raw_html": ("token", "raw_html", "raw_html_chars", False),
    "dmp_raw_html": ("dmp", "raw_html", "raw_html_chars", False),
}
