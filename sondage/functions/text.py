"""Text as columns: lines, byte offsets, tokens, identifiers, trigrams and content checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIFF_BYTES = 8192
MINIFIED_BYTES = 65536


def lines(text: Column) -> Column:
    """Lines of a text: cut at ``\\n``, one ``\\r`` before it dropped, none after a final ``\\n``; an empty text has none."""
    parts = F.split(text, "\n", -1)
    last_empty = (text == "") | text.endswith("\n")
    kept = F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    stripped = F.transform(kept, lambda x: F.when(x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x))
    return F.when(F.contains(text, F.lit("\r")), stripped).otherwise(kept)


def bytes_before(line: Column, place: Column) -> Column:
    """Bytes of ``line`` before its character number ``place``, counted from one."""
    return F.octet_length(F.left(line, place - 1)).cast("int")


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def _kept(word: Column) -> Column:
    return F.length(word).between(2, 128)


def tokens(text: Column) -> Column:
    """Distinct lower-cased tokens: ASCII letters and digits, cut at other characters and before a capital after a small letter."""
    return F.array_distinct(F.filter(_words(text), _kept))


def token_positions(text: Column) -> Column:
    """Tokens with their ordinals, ``array<struct<token, pos>>``; dropped short and long tokens take an ordinal."""
    placed = F.transform(_words(text), lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
    return F.filter(placed, lambda x: _kept(x["token"]))


def identifiers(text: Column) -> Column:
    """Distinct runs of ``[A-Za-z0-9_]`` that begin at a letter or underscore, of two characters at least."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)))


def _line_starts(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
    ends = ends - ends[0]
    start = np.union1d(ends[:-1], np.flatnonzero(data == 10) + 1)
    # No line begins where a text ends; the next text may begin there.
    some = ends[:-1][ends[1:] > ends[:-1]]
    start = start[~np.isin(start, ends[1:]) | np.isin(start, some)]
    doc = np.searchsorted(ends, start, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    offsets = np.r_[0, np.cumsum(count)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(start - ends[doc]), mask=pc.is_null(texts) if texts.null_count else None)


def line_starts(text: Column) -> Column:
    """Byte offset of each line's first byte, for the lines that :func:`lines` gives; null for a null text."""
    return F.arrow_udf(_line_starts, "array<bigint>")(text)


def line_of_offset(starts: Column, offset: Column) -> Column:
    """Number of the line that holds a byte offset."""
    return F.size(F.filter(starts, lambda s: s <= offset))


def is_binary(content: Column) -> Column:
    """Whether the first bytes of ``content`` (binary) hold over a tenth of NULs or over an eighth of control characters."""
    head = F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1")
    n = F.least(F.octet_length(content), F.lit(SNIFF_BYTES))
    nulls = n - F.length(F.translate(head, "\x00", ""))
    controls = n - F.length(F.translate(head, "".join(chr(c) for c in range(32) if c not in (9, 10, 13)), ""))
    return (nulls > F.floor(n / 10)) | (controls > F.floor(n / 8))


def is_minified(content: Column) -> Column:
    """Whether the lines at the start of ``content`` (binary) are as long as generated code's.

    With line breaks: the longest terminated line over 1000 bytes and the mean over 500; without: over 10240 bytes in all.
    """
    size = F.least(F.octet_length(content), F.lit(MINIFIED_BYTES))
    parts = F.split(F.decode(F.substring(content, 1, MINIFIED_BYTES), "ISO-8859-1"), "\n", -1)
    terminated = F.slice(parts, F.lit(1), F.size(parts) - 1)
    longest = F.aggregate(terminated, F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    many = (longest > 1000) & (F.floor(size / F.size(parts)) > 500)
    return F.when(F.size(parts) > 1, many).otherwise(F.octet_length(content) > 10240)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content)


def format_size(n: Column) -> Column:
    """Bytes in the largest fitting unit with two decimals, halves rounded to even."""
    kb = 1024

    def unit(size: int, name: str) -> Column:
        return F.concat(F.call_function("format_number", n / size, F.lit("0.00")), F.lit(f" {name}"))

    return (
        F.when(n >= kb**3, unit(kb**3, "GB"))
        .when(n >= kb**2, unit(kb**2, "MB"))
        .when(n >= kb, unit(kb, "KB"))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def format_timestamp(seconds: Column) -> Column:
    """Unix seconds as ``YYYY-MM-DD HH:MM:SS UTC``, whatever the session's zone."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat_ws(" ", days.cast("string"), clock, F.lit("UTC"))


def _byte_slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.r_[-1, (np.cumsum(size) - size) // limit]))
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large string array without nulls, and where each text begins and ends in them."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _keyed(docs: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, str]:
    """``docs`` with ``keys`` and ``text`` alone, and the keys' types."""
    chosen = docs.select(*(F.col(k).cast("bigint").alias(k) if k == "doc_id" else F.col(k) for k in keys), "text")
    return chosen, ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)


_HUMP = re.compile("([a-z])([A-Z])")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LOWER, _IS_UPPER = (np.isin(np.arange(256), np.arange(a, a + 26)) for a in (97, 65))
_IS_WORD = _IS_LOWER | _IS_UPPER | np.isin(np.arange(256), np.arange(48, 58))


def token_lists(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``token, *keys, positions``: the distinct tokens of each row's text with their ascending ordinals, as :func:`token_positions` has them."""
    chosen, kinds = _keyed(docs, keys)

    def emit(batches):
        for batch in batches:
            for part in _byte_slices(batch) if batch.num_rows else ():
                texts = pc.fill_null(part.column(len(keys)).cast(pa.large_string()), "")
                # The two capitals beyond ASCII whose small letters have ASCII in them.
                if pc.any(pc.match_substring_regex(texts, "[\u0130\u212a]")).as_py():
                    texts = pa.array([_HUMP.sub(r"\1 \2", t).lower() for t in texts.to_pylist()], pa.large_string())
                data, ends = _text_bytes(texts)
                inside = _IS_WORD[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1] | (_IS_LOWER[data[:-1]] & _IS_UPPER[data[1:]])
                edge = ends[ends < len(data)]
                begins[edge] = inside[edge]
                start = np.flatnonzero(begins)
                if not len(start):
                    continue
                offsets = np.r_[np.cumsum(inside, dtype=np.int64)[start] - 1, np.count_nonzero(inside)]
                doc = np.searchsorted(ends, start, side="right") - 1
                place = np.arange(len(start)) - np.searchsorted(start, ends[doc])
                size = np.diff(offsets)
                kept = np.flatnonzero((size >= 2) & (size <= 128))
                if not len(kept):
                    continue
                words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_LOWER[data[inside]]))
                coded = words.take(pa.array(kept)).dictionary_encode()
                pair = doc[kept] * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.diff(pair[order], prepend=-1))
                positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(place[kept][order].astype(np.int32)))
                lead = order[first]
                columns = [coded.dictionary.take(coded.indices.take(pa.array(lead))), *(part.column(k).take(pa.array(doc[kept][lead])) for k in range(len(keys))), positions]
                yield pa.RecordBatch.from_arrays(columns, names=["token", *keys, "positions"])

    return chosen.mapInArrow(emit, f"token string, {kinds}, positions array<int>")


def trigrams(docs: DataFrame, lower: bool = True, keys: tuple[str, ...] = ("doc_id",), positions: bool = False, only: list[int] | None = None) -> DataFrame:
    """Columns ``*keys, gram``: the distinct byte trigrams of each text, lower-cased unless ``lower`` is off; of those in ``only`` if given.

    With ``positions`` every occurrence has a row, with its byte offset in ``pos``.
    """
    chosen, kinds = _keyed(docs, keys)
    names = [*keys, "gram", *["pos"] * positions]

    def emit(batches):
        for batch in batches:
            for part in _byte_slices(batch) if batch.num_rows else ():
                texts = pc.fill_null(part.column(len(keys)).cast(pa.large_string()), "")
                data, ends = _text_bytes(pc.utf8_lower(texts) if lower else texts)
                if len(data) < 3:
                    continue
                data = data.astype(np.int32)
                code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
                if only is not None:
                    at = np.flatnonzero(np.isin(code, np.array(only, np.int32)))
                    doc, code = np.searchsorted(ends, at, side="right") - 1, code[at]
                else:
                    at = np.arange(len(code))
                    doc = np.repeat(np.arange(len(texts)), np.diff(ends))[:-2]
                inside = at + 3 <= ends[doc + 1]
                at, doc, code = at[inside], doc[inside], code[inside]
                if not positions:
                    pairs = np.sort(doc << 24 | code)
                    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
                    doc, code = pairs >> 24, pairs & 0xFFFFFF
                columns = [part.column(k).take(pa.array(doc)) for k in range(len(keys))] + [pa.array(code.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array((at - ends[doc]).astype(np.int32))] if positions else []), names=names)

    return chosen.mapInArrow(emit, ", ".join([kinds, "gram int", *["pos int"] * positions]))
