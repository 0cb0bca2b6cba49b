"""Each matcher on pages with a passage that can, and one that can't, be placed."""

import difflib
import random

import pytest

from textspan.functions import align, markup, prose

WORDS = [f"{a}{b}{c}" for a in ("str", "pl", "m", "tr") for b in ("ato", "eni", "uri", "ola", "ibe") for c in ("n", "th", "rk", "ssa", "v")]


def page(seed: int, n: int = 30) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(14)).capitalize() + f" number {seed * 100 + i}." for i in range(n)]


def as_text(lines: list[str]) -> str:
    parts = ["\n\n".join(lines[:10]), "== Middle ==", "\n\n".join(lines[10:20]), "== Late ==", "\n\n".join(lines[20:]), "== References ==", "1. Source"]
    return "\n\n".join(parts)


@pytest.fixture(scope="module")
def lines():
    return page(7)


@pytest.mark.parametrize("matcher", [align.fuzzy, align.token, align.diff])
def test_exact_passages_are_found(matcher, lines):
    copied = "\n\n".join(lines[3:9])
    got = matcher(as_text(lines), copied)
    assert got.status == "ok" and got.text == copied and as_text(lines)[got.start : got.end].strip() == copied


def test_hybrid_without_structure_looks_at_the_last_paragraphs(lines):
    text = "\n\n".join(lines)
    got = align.hybrid(text, "\n\n".join(lines[-6:]))
    assert got.status == "ok" and got.text == "\n\n".join(lines[-6:]) and got.confidence == "medium"
    assert align.hybrid(text, "\n\n".join(lines[3:9])).error == "failed: hybrid start sentence-window match was not reliable"


@pytest.mark.parametrize("matcher", [align.token, align.diff])
def test_noisy_passages_are_found(matcher, lines):
    copied = "\n\n".join(x.replace("number", "[3] numbr") for x in lines[3:9])
    got = matcher(as_text(lines), copied)
    assert got.status == "ok" and got.text.startswith(lines[3][:30]) and lines[8] in got.text


@pytest.mark.parametrize("matcher", [align.fuzzy, align.token, align.diff, align.hybrid])
def test_foreign_passages_are_outcomes(matcher, lines):
    got = matcher(as_text(lines), "Completely different prose about nothing that was ever written there, over and over, until the very end of it all today.")
    assert got.status == "error" and got.error.startswith("failed") and got.report


def test_short_passages_are_outcomes(lines):
    assert "not enough copied tokens" in align.token(as_text(lines), "too short").error
    assert "not enough copied text" in align.diff(as_text(lines), "too short").error


def test_hybrid_follows_headings(lines):
    copied = "\n\n".join([*lines[7:10], "Middle", *lines[10:13]])
    got = align.hybrid(as_text(lines), copied)
    assert got.status == "ok" and got.confidence == "high" and got.text.startswith(lines[7]) and got.text.endswith(lines[12])
    assert "Matched headings: Middle" in got.report


def test_hybrid_citations_and_references(lines):
    cited = [x[:-1] + f".[{i + 1}]" for i, x in enumerate(lines)]
    copied = "\n\n".join(cited[12:16])
    got = align.hybrid(as_text(cited), copied, references="smart", entries={"13": "thirteen", "15": "fifteen"})
    assert got.status == "ok" and "== References ==\n\n1. thirteen\n\n2. fifteen" in got.text and "Missing reference entries: 14, 16" in got.report


def test_raw_matchers(lines):
    html = "<body><script>var x;</script>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
    copied = "\n".join(lines[4:10])
    for matcher in (align.raw_token, align.raw_diff):
        got = matcher(html, copied)
        assert got.status == "ok" and got.text == "\n\n".join(lines[4:10])
        assert markup.clean_page(html[got.start : got.end]) == got.text


def test_captions_are_stripped(lines):
    caption = "A caption that says what can be seen in the picture of the moons"
    copied = "\n".join([lines[3], caption, *lines[4:8]])
    assert prose.drop_captions(copied, [caption])[1] == 1
    assert align.token(as_text(lines), copied, captions=[caption]).text == "\n\n".join(lines[3:8])


def test_settings_are_checked():
    with pytest.raises(ValueError, match="window"):
        align.token("a", "b", window=10)
    with pytest.raises(ValueError, match="chunk"):
        align.diff("a", "b", chunk=40)


def test_ties_and_orders():
    from textspan.functions.locate import Surface, chunks, in_order

    there = Surface("alpha beta gamma delta alpha beta gamma delta")
    assert there.find(["alpha", "beta", "gamma"], 0.5).first == 0
    assert there.find(["alpha", "beta", "gamma"], 0.5, last=True).first == 4
    assert chunks(130, 60) == [(0, 60), (60, 120), (120, 130)] and chunks(125, 60) == [(0, 60), (60, 120)]
    assert chunks(130, 60, backward=True) == [(70, 130), (10, 70), (0, 10)]
    assert in_order(["a", "x", "b", "a"], ["a", "b", "a"]) == 0.75


def test_likeliest_is_the_best_of_all_spans(monkeypatch):
    rng, compared = random.Random(3), []
    monkeypatch.setattr(prose, "ratio", lambda a, b: compared.append(b) or difflib.SequenceMatcher(None, a, b).ratio())
    for lost in (0, 2, 8, 40):
        page = "".join(rng.choice("abcdeé  ") for _ in range(1500))
        form = "".join(c if rng.random() * 150 > lost else "x" for c in page[600:750])
        tried = [(a, a + n) for n in (70, 110, 150) for a in range(0, 1500 - n, 30)]
        want = max(((difflib.SequenceMatcher(None, form, page[a:b]).ratio(), -i) for i, (a, b) in enumerate(tried)))
        assert align.likeliest(form, page, tried) == (want[0], *tried[-want[1]])
        # a good place leaves few others to compare
        assert lost > 8 or len(compared) < len(tried) / 4
        compared.clear()
