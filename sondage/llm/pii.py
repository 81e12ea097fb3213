"""Personal data and secrets: regular expressions propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table

#: Spans that score less are not reported.
MIN_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.2
#: Characters before a span in which words that speak against it count, and by how much.
AGAINST_CHARS = 24
CONTEXT_LOSS = 0.3
#: Every pattern needs a digit, an at sign or these words; texts with none never leave the JVM.
_POSSIBLE = "[0-9@]|PRIVATE KEY"
#: Characters of an IBAN by country.
_IBAN_CHARS = {
    n: {*countries.split()}
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_IBAN_SIZE = {country: n for n, countries in _IBAN_CHARS.items() for country in countries}


def luhn(text: str) -> bool:
    """Whether the digits of ``text`` end in their Luhn check digit."""
    digits = [int(c) for c in text if c.isdigit()]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return bool(digits) and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def mod97(text: str) -> bool:
    """Whether ``text`` is an IBAN whose check digits are right."""
    flat = "".join(text.split()).upper()
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _iban(text: str) -> int:
    """Characters of ``text`` that are an IBAN of its country's length: words of four letters after it may look like more of it."""
    size = _IBAN_SIZE.get(text[:2].upper())
    if size is None:
        return len(text) * mod97(text)
    seen = 0
    for at, c in enumerate(text):
        seen += c != " "
        if seen == size:
            return (at + 1) * (mod97(text[: at + 1]) and text[at + 1 : at + 2] in ("", " "))
    return 0


def _card(text: str) -> int:
    digits = [c for c in text if c.isdigit()]
    return len(text) * (13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(text))


def _ip(text: str) -> int:
    try:
        return len(text) * (not ipaddress.ip_address(text).is_unspecified)
    except ValueError:
        return 0


def _ip6(text: str) -> int:
    groups = [x for x in text.split(":") if x]
    return _ip(text) * (len(groups) >= 3 and any(c.isdigit() for c in text))


def _phone(text: str) -> int:
    return len(text) * (8 <= sum(c.isdigit() for c in text) <= 15)


def _ssn(text: str) -> int:
    area, group, serial = text.split("-")
    return len(text) * (area not in ("000", "666") and area < "900" and group != "00" and serial != "0000")


def _secret(text: str) -> int:
    return len(text) * (any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and len(set(text)) >= 6)


@dataclass(frozen=True)
class Kind:
    """A pattern that proposes spans, its group if it has one, and their scores.

    ``confirmed`` is the score of what passes the validator, which says how many characters do; what doesn't is dropped.  Without a
    validator ``base`` is the score.  ``context`` are words that raise it, ``against`` words that lower it.
    """

    name: str
    pattern: re.Pattern
    base: float
    confirmed: float
    valid: Callable[[str], int] | None
    context: re.Pattern
    against: re.Pattern | None = None


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])", re.IGNORECASE)


_SECRET_WORDS = _words("token", "secret", "key", "api", "password", "passwd", "bearer", "auth")
#: In order of precedence among overlapping spans of equal score.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.ASCII), 0.8, 0.8, None, _words("e-?mail", "mail", "contact", "correo", "kontakt", "courriel")),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII), 0.2, 0.9, _iban, _words("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("card", re.compile(r"(?<![A-Za-z0-9.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])", re.ASCII), 0.2, 0.8, _card, _words("card", "credit", "visa", "mastercard", "payment", "karte", "tarjeta", "carte"), _words("isbn", "issn", "ean", "order", "tracking", "invoice", "article")),
    Kind("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?![\dA-Za-z]|\.\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)", re.ASCII), 0.3, 0.6, _phone, _words("phone", "tel", "call", "mobile", "fax", "telefon", "tel[eé]fono", "t[eé]l[eé]phone"), _words("isbn", "issn")),
    Kind("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII), 0.3, 0.5, _ssn, _words("ssn", "social", "security"), _words("part", "model", "serial", "isbn")),
    Kind("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", re.ASCII), 0.3, 0.6, _ip, _words("ip", "address", "host", "server", "login"), _words("version", "release", "section", "chapter")),
    Kind("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", re.ASCII), 0.3, 0.6, _ip6, _words("ip", "ipv6", "address", "host", "server", "login")),
    # A private key with its armour, closed or not; the body is base64.
    Kind("secret", re.compile(r"-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY(?: BLOCK)?-----(?:\s{0,2}[A-Za-z-]{1,32}: [^\n]{0,200}\n){0,8}(?:\s*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s*+[A-Za-z0-9+/=]{1,15}+)?\s*+-----END [A-Z0-9 ]{0,32}PRIVATE KEY(?: BLOCK)?-----)?"), 0.9, 0.9, None, _SECRET_WORDS),
    # Keys that their issuers' prefixes give away.
    Kind("secret", re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|(?<![_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])", re.ASCII), 0.5, 0.8, _secret, _SECRET_WORDS),
    Kind("secret", re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])", re.ASCII), 0.3, 0.4, _secret, _SECRET_WORDS),
    # A value that a name of a secret is set to.
    Kind("secret", re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|auth[ _-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,}+)", re.IGNORECASE | re.ASCII), 0.5, 0.7, _secret, _words("login", "user", "credentials?")),
)


def spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int, str, float]]:
    """Disjoint spans ``(start, end, kind, score)`` of ``text`` in order, with character offsets."""
    found = []
    for rank, kind in enumerate(KINDS):
        for m in kind.pattern.finditer(text):
            a, b = m.span(m.re.groups)
            if kind.valid is None:
                score = kind.base
            elif size := kind.valid(text[a:b]):
                score, b = kind.confirmed, a + size
            else:
                continue
            if kind.context.search(text[max(0, a - CONTEXT_CHARS) : a] + " " + text[b : b + CONTEXT_CHARS]):
                score = min(1.0, score + CONTEXT_GAIN)
            if kind.against is not None and kind.against.search(text[max(0, a - AGAINST_CHARS) : a]):
                score -= CONTEXT_LOSS
            if score >= min_score:
                found.append((-score, a - b, rank, a, b, kind.name))
    # The spans that stay are disjoint, so that only the two neighbours of a new one can overlap it.
    out: list[tuple[int, int, str, float]] = []
    for score, _, _, a, b, name in sorted(found):
        at = bisect_left(out, (a,))
        if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
            out.insert(at, (a, b, name, round(-score, 6)))
    return out


def redacted(text: str, min_score: float = MIN_SCORE) -> str:
    """``text`` with each span replaced by its kind in capitals and brackets."""
    parts, at = [], 0
    for a, b, kind, _ in spans(text, min_score):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def personal_data(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Columns ``doc_id, kind, start, end, score`` of every span; offsets count characters, ``end`` is past the last.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null and empty texts have no spans; rows with a null id
    report theirs with it; repeated rows report theirs again.  Of overlapping spans the one with the higher score stays,
    then the longer, then the kind that comes first in :data:`KINDS`, then the first.  Very long texts and texts of very many spans are read
    whole, in linear time but for sorting; a span may be of any length.  The values themselves are not carried on.
    """

    def emit(batches):
        for batch in batches:
            rows = [(i, *s) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for s in spans(t, min_score)]
            ids, start, end, kind, score = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())],
                names=["doc_id", "kind", "start", "end", "score"],
            )

    possible = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").rlike(_POSSIBLE))
    return possible.mapInArrow(emit, "doc_id bigint, kind string, start int, end int, score double")


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``[KIND]`` and ``n_chars``, if there, made the new length.

    No row goes; null texts stay null; all other columns stay as they are.
    """

    @F.pandas_udf("string")
    def clean(text):
        return text.map(lambda t: redacted(t, min_score))

    # Texts that can't hold a span go around Python: the two branches split the rows.
    possible = F.coalesce(F.col("text").rlike(_POSSIBLE), F.lit(False))
    changed = docs.where(possible).withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~possible).union(changed.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
