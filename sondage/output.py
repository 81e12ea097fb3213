"""Printing of results the way grep does it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Row

RESET, BOLD_RED, GREEN, MAGENTA, CYAN = "\x1b[0m", "\x1b[1;31m", "\x1b[32m", "\x1b[35m", "\x1b[36m"


def _paint(text: str, code: str, color: bool) -> str:
    return f"{code}{text}{RESET}" if color and text else text


def highlight(line: str, start: int, end: int, color: bool) -> str:
    """``line`` with its bytes from ``start`` to ``end`` coloured; ranges are clamped to the line and to whole characters."""
    raw = line.encode()
    a, b = max(0, min(start, len(raw))), max(0, min(end, len(raw)))
    if not color or b <= a:
        return line
    cut = lambda x: x.decode(errors="ignore")
    return cut(raw[:a]) + _paint(cut(raw[a:b]), BOLD_RED, True) + cut(raw[b:])


def content(rows: Iterable[Row], color: bool = False, heading: bool | None = None) -> str:
    """Matching lines with their context, ``--`` between groups that don't touch, a blank line between files.

    Paths head their groups if there are several files, unless ``heading`` says otherwise; else they lead each line.
    """
    rows = list(rows)
    if heading is None:
        heading = len({r["path"] for r in rows}) > 1
    out: list[str] = []
    path = last = None

    def put(number: int, mark: str, text: str) -> None:
        lead = "" if heading else _paint(path, MAGENTA, color) + mark
        out.append(f"{lead}{_paint(str(number), GREEN, color)}{mark}{text}")

    for r in rows:
        before = list(r["context_before"] or []) if "context_before" in r else []
        after = list(r["context_after"] or []) if "context_after" in r else []
        if r["path"] != path:
            if path is not None:
                out.append("")
            path, last = r["path"], None
            if heading:
                out.append(_paint(path, MAGENTA, color))
        first = before[0]["line_number"] if before else r["line_number"]
        if last is not None and first > last + 1:
            out.append(_paint("--", CYAN, color))
        for c in before:
            put(c["line_number"], "-", c["line"])
        put(r["line_number"], ":", highlight(r["line"], r["match_start"], r["match_end"], color))
        for c in after:
            put(c["line_number"], "-", c["line"])
        last = after[-1]["line_number"] if after else r["line_number"]
    return "\n".join(out) + "\n" if out else ""


def file_list(rows: Iterable[Row], color: bool = False) -> str:
    """Distinct paths in the order they come."""
    return "".join(_paint(p, MAGENTA, color) + "\n" for p in dict.fromkeys(r["path"] for r in rows))


def counts(rows: Iterable[Row], color: bool = False) -> str:
    """``path:count`` in order of path."""
    return "".join(f"{_paint(r['path'], MAGENTA, color)}:{r['n_matches']}\n" for r in sorted(rows, key=lambda r: r["path"]))


def expand_tabs(text: str, width: int = 4) -> str:
    """Tabs as spaces up to the next multiple of ``width``."""
    return text.expandtabs(width)
