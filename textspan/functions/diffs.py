"""Character differences by the published greedy O(ND) algorithm in linear space, with the usual
clean-up of equalities too short to pay for the edits around them."""

from __future__ import annotations

import re

EDIT_COST = 4


def _middle(a: str, b: str) -> tuple[int, int] | None:
    """A point on a shortest path, found by searching from both ends; None: nothing is shared."""
    n, m = len(a), len(b)
    limit, delta = (n + m + 1) // 2, n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range(limit + 1):
        for k in range(-d, d + 1, 2):
            x = ahead.get(k + 1, -1) if k == -d or k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1) else ahead[k - 1] + 1
            y = x - k
            while 0 <= x < n and 0 <= y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and -(d - 1) <= delta - k <= d - 1 and x + back.get(delta - k, -1) >= n and 0 <= y <= m and x <= n:
                return x, y
        for k in range(-d, d + 1, 2):
            x = back.get(k + 1, -1) if k == -d or k != d and back.get(k - 1, -1) < back.get(k + 1, -1) else back[k - 1] + 1
            y = x - k
            while 0 <= x < n and 0 <= y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if delta % 2 == 0 and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n and 0 <= y <= m and x <= n:
                return n - x, m - y
    return None


def _runs(a: str, b: str, out: list[tuple[str, str]]) -> None:
    """Append (kind, text) with kind ``=``, ``-`` (only in a) or ``+`` (only in b)."""
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    if p:
        out.append(("=", a[:p]))
    x, y, tail = a[p : len(a) - s], b[p : len(b) - s], a[len(a) - s :]
    if x and y and (len(x) > 1 or len(y) > 1) and set(x) & set(y) and (cut := _middle(x, y)) and cut not in ((0, 0), (len(x), len(y))):
        _runs(x[: cut[0]], y[: cut[1]], out)
        _runs(x[cut[0] :], y[cut[1] :], out)
    else:
        out.extend(r for r in (("-", x), ("+", y)) if r[1])
    if tail:
        out.append(("=", tail))


def diff(a: str, b: str) -> list[tuple[str, str]]:
    """Equalities with the deletions and insertions between them, each kind joined."""
    raw: list[tuple[str, str]] = []
    _runs(a, b, raw)
    out: list[tuple[str, str]] = []
    cut = add = ""

    def flush() -> None:
        nonlocal cut, add
        out.extend(r for r in (("-", cut), ("+", add)) if r[1])
        cut = add = ""

    for kind, text in raw:
        if kind == "-":
            cut += text
        elif kind == "+":
            add += text
        elif out and out[-1][0] == "=" and not cut and not add:
            out[-1] = ("=", out[-1][1] + text)
        else:
            flush()
            out.append((kind, text))
    flush()
    return out


def efficient(runs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Equalities shorter than the cost of an edit become edits where edits of both kinds lie on
    both sides, or of three kinds in all if they are under half of it."""
    changed = True
    while changed:
        changed = False
        for i, (kind, text) in enumerate(runs):
            if kind != "=" or len(text) >= EDIT_COST:
                continue
            before, after, j = set(), set(), i - 1
            while j >= 0 and runs[j][0] != "=":
                before.add(runs[j][0])
                j -= 1
            j = i + 1
            while j < len(runs) and runs[j][0] != "=":
                after.add(runs[j][0])
                j += 1
            if before and after and (len(before) + len(after) == 4 or len(text) < EDIT_COST / 2 and len(before) + len(after) == 3):
                edits: dict[str, str] = {"-": "", "+": ""}
                a, b = i - len(before), i + 1 + len(after)
                for k, t in runs[a:b]:
                    for e in "-+" if k == "=" else k:
                        edits[e] += t
                runs = runs[:a] + [(k, t) for k, t in edits.items() if t] + runs[b:]
                changed = True
                break
    return runs


def telling(chunk: str) -> bool:
    words = re.findall(r"[a-z0-9]{3,}", chunk)
    return len(words) >= 2 or bool(words) and len(chunk.strip()) >= 18


def coverage(clean: str, copied: str) -> tuple[float, int, int]:
    """(share of the copied text in equalities, span in the clean text of the telling ones, or all)."""
    if not clean or not copied:
        return 0.0, 0, 0
    equal, at, spans = 0, 0, []
    for kind, text in efficient(diff(clean, copied)):
        if kind == "=":
            equal += len(text)
            if telling(text):
                spans.append((at, at + len(text)))
        if kind != "+":
            at += len(text)
    return equal / len(copied), *((spans[0][0], spans[-1][1]) if spans else (0, len(clean)))
