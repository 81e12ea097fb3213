"""Globs and regular expressions, translated on the driver."""

from __future__ import annotations

import re


def glob_to_regex(glob: str) -> str | None:
    """Java regular expression for a path glob, to be matched whole; None if the glob is malformed.

    ``*`` and ``?`` stay within a path component, ``**`` doesn't; ``[...]`` and ``{a,b}`` work as usual.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            stars = len(glob[i:]) - len(glob[i:].lstrip("*"))
            whole = (i == 0 or glob[i - 1] == "/") and (i + stars == len(glob) or glob[i + stars] == "/")
            if stars == 2 and whole:
                if i + 2 < len(glob):
                    out.append("(?:[^/]*/)*")
                    i += 1
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            i += stars
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 1)
            if glob[i + 1 : i + 2] in ("]",) or glob[i + 1 : i + 3] in ("!]", "^]"):
                end = glob.find("]", end + 1)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out.append(f"(?!/)[{'^' * negated}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                return None
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return None if depth else "(?s)^" + "".join(out) + r"\z"


_LOOK = re.compile(r"\(\?(?:[=!>]|<[=!])")
#: What the dialect's ``(?-u:\b)`` says: a border of a run of ASCII letters, digits and underscores.
_ASCII_BORDER = r"(?-u:\b)"
_JAVA_BORDER = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "word": r"\w", "xdigit": r"\p{XDigit}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def java_regex(pattern: str, whole_text: bool = False) -> str | None:
    """A pattern of the linear-time dialect as a Java one; None if that dialect would reject it.

    There is no look-around and no back-reference.  Classes are Unicode's, the line break is ``\\n`` alone, and ``$`` is the end
    of the text, which differs from Java's only in ``whole_text``, where a line break may come last.
    """
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            if not following or following in "123456789QEGkhHVRXZ":
                return None
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0:
                name = pattern[i + 2 : end]
                negated = name.startswith("^")
                if name[negated:] not in _POSIX:
                    return None
                out.append(("[^" + _POSIX[name[1:]] + "]") if negated else _POSIX[name])
                i = end + 2
                continue
            if c == "[":
                in_class += 1
            elif c == "]":
                in_class -= 1
            out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if pattern.startswith(_ASCII_BORDER, i):
            out.append(_JAVA_BORDER)
            i += len(_ASCII_BORDER)
            continue
        if c == "(" and _LOOK.match(pattern, i):
            return None
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            # A quantified quantifier, which Java would take as possessive.
            out.append(c + "{1,}" if c != "+" else c)
            i += 2
            continue
        out.append(r"\z" if c == "$" and whole_text and "(?m" not in pattern else c)
        i += 1
    return None if in_class else "(?Ud)" + "".join(out)


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def regex_prefix(pattern: str) -> str | None:
    """Text that every match of ``pattern`` begins with, if that is known and at least three bytes long."""
    if re.search(r"(?<!\\)(?:\\\\)*\|", pattern):
        return None
    rest, prefix = pattern.removeprefix("^"), ""
    i = 0
    while i < len(rest):
        c = rest[i]
        if c == "\\":
            following = rest[i + 1 : i + 2]
            if not following or following in _ALNUM and following not in "ntr":
                break
            prefix += {"n": "\n", "t": "\t", "r": "\r"}.get(following, following)
            i += 2
            continue
        if c in "*?{":
            prefix = prefix[:-1]
            break
        if c in ".+[]()}$":
            break
        prefix += c
        i += 1
    return prefix if len(prefix.encode()) >= 3 else None


def escape(literal: str) -> str:
    """``literal`` as a pattern that matches it."""
    return re.sub(r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\\1", literal)


_HUMP = re.compile(r"([a-z])([A-Z])")


def query_tokens(text: str) -> list[tuple[str, int]]:
    """Tokens of a query with their ordinals, as the index has them; short and long ones take an ordinal but are left out."""
    words = [w for w in re.split(r"[^a-z0-9]+", _HUMP.sub(r"\1 \2", text).lower()) if w]
    return [(w, k) for k, w in enumerate(words) if 2 <= len(w) <= 128]


def whole_tokens(text: str) -> list[tuple[str, int]]:
    """Those of :func:`query_tokens` that are whole wherever ``text`` occurs: not the first and last unless it has a cut before and after them."""
    parts = re.split(r"[^a-z0-9]+", _HUMP.sub(r"\1 \2", text).lower())
    last = len([w for w in parts if w]) - 1
    return [(w, k) for w, k in query_tokens(text) if (k > 0 or not parts[0]) and (k < last or not parts[-1])]


def query_trigrams(text: str) -> list[int]:
    """Distinct byte trigrams of a query in order, as integers; texts under three bytes have none."""
    raw = text.encode()
    return sorted({raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)})
