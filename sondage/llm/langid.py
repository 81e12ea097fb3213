"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded labelled sample is built.  A document is parsed against it into
longest matches; the number of phrases times log2 of the sample's length, over the document's length, estimates the cross
entropy.  The language with the least wins.  A whole batch is parsed at once: one NumPy step advances every segment of
every document in all languages by one byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, small, table
from .wordgrams import slices, string_bytes

#: Normalised bytes of the labelled sample for each language, and the documents that it is taken from.
TRAIN_BYTES = 32768
TRAIN_DOCS = 96
#: Characters from which a text is preferred for the sample; shorter ones only fill up languages with fewer than ``TRAIN_DOCS`` such.
TRAIN_CHARS = 200
#: Phrases end at multiples of so many normalised bytes, so that long texts are parsed side by side.
SEGMENT = 512
#: Bits a byte beyond which a text is in none of the languages.  One phrase isn't counted here, or else short texts would fail.
MAX_ENTROPY = 4.5
UNDETERMINED = "und"

_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[range(97, 123)] = range(97, 123)
_SYMBOL[range(128, 256)] = range(128, 256)


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts, each run of ASCII that isn't letters made one space, none at the start."""
    data, offsets = string_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    data = _SYMBOL[data]
    letter = np.zeros(len(data) + 1, bool)
    letter[1:] = data != 32
    before = letter[:-1].copy()
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = letter[1:] | before
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return data[keep], kept[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``text``; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The automata of all languages as one table of transitions."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        symbols = sorted({c for text in samples.values() for c in text})
        self.width = len(symbols) + 1
        self.symbol = np.zeros(256, np.int32)
        self.symbol[symbols] = np.arange(1, self.width)
        tables, self.roots, states = [], [], 0
        for language in self.languages:
            automaton = suffix_automaton(samples[language])
            root = states * self.width
            rows = np.full((len(automaton), self.width), ~root, np.int32)
            for c, to in automaton[0].items():
                rows[:, self.symbol[c]] = ~(root + to * self.width)
            for state, moves in enumerate(automaton):
                for c, to in moves.items():
                    rows[state, self.symbol[c]] = root + to * self.width
            tables.append(rows.reshape(-1))
            self.roots.append(root)
            states += len(automaton)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = np.log2([max(2, len(samples[x])) for x in self.languages])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases (texts x languages)."""
        size = np.diff(offsets)
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), parts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[:-1][owner] + within * SEGMENT
        long = np.minimum(SEGMENT, offsets[1:][owner] - start)
        order = np.argsort(-long, kind="stable")
        start, long, owner = start[order], long[order], owner[order]
        symbols = self.symbol[data]
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(start), axis=1)
        count = np.zeros(state.shape, np.int32)
        alive = len(start)
        for step in range(int(long[0]) if len(long) else 0):
            while long[alive - 1] <= step:
                alive -= 1
            to = self.table[state[:, :alive] + symbols[start[:alive] + step]]
            failed = to >> 31
            count[:, :alive] -= failed
            state[:, :alive] = to ^ failed
        count += state != roots
        out = np.zeros((len(size), len(self.roots)), np.int64)
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(owner, weights=count[k], minlength=len(size))
        return out


def labelled_samples(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> dict[str, bytes]:
    """Normalised text of each language in column ``lang``: of ``train_docs`` documents by hash order, an equal share of each.

    Texts of :data:`TRAIN_CHARS` characters or more come first and share among themselves; shorter ones follow as far as there is
    room, and have the whole sample where a language has no others.  Texts without letters are left out.  The result is bounded
    by the two parameters and the number of languages, whatever the size of ``docs``.
    """
    labelled = (
        docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").alias("language"), "text")
        .where("id is not null and language is not null and text is not null")
        .where(F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
        .withColumn("long", F.length("text") >= TRAIN_CHARS)
    )
    order = Window.partitionBy("language").orderBy(F.desc("long"), F.xxhash64("id", F.lit(11)), "id")
    chosen = labelled.select("id", "language", "long").withColumn("n", F.row_number().over(order)).where(F.col("n") <= train_docs)
    rows = labelled.join(small(cut(chosen)), ["id", "language", "long"]).select("language", "n", "long", F.substring("text", 1, train_bytes).alias("text")).collect()
    out: dict[str, bytes] = {}
    for language in sorted({r.language for r in rows}):
        own = sorted((r for r in rows if r.language == language), key=lambda r: (r.n, r.text))
        data, offsets = normalise(pa.array([r.text for r in own]))
        share = -(-train_bytes // (sum(r.long for r in own) or len(own)))
        out[language] = b"".join(data[a : min(b, a + share)].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True))[:train_bytes]
    return {k: v for k, v in out.items() if v}


def identified(docs: DataFrame, samples: dict[str, bytes], max_entropy: float = MAX_ENTROPY) -> DataFrame:
    """Columns ``doc_id, language, entropy, runner_up, n_bytes`` for every row of ``docs`` (``doc_id``, ``text``).

    ``entropy`` is that of the best language in bits a normalised byte; ties go to the name that sorts first;
    ``runner_up`` is the second language.  Null texts, texts without letters and those beyond ``max_entropy`` are ``und``
    (the first two with null entropy), as is everything if there are no samples.  Repeated rows each get a row, null ids
    too.  Very long texts are parsed whole, in segments side by side.  Other columns are ignored.
    """
    kept: dict[int, Parser] = {}
    names = np.array([*sorted(samples), UNDETERMINED], dtype=object)

    def emit(batches):
        if 0 not in kept:
            kept[0] = Parser(samples)
        parser = kept[0]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                data, offsets = normalise(part.column("text"))
                n, some = np.diff(offsets), len(parser.roots)
                best, second, least = np.full(len(n), some), np.full(len(n), some), np.full(len(n), np.nan)
                if some:
                    phrases = parser.phrases(data, offsets)
                    h = phrases * parser.bits / np.maximum(n, 1)[:, None]
                    ranked = np.argsort(h, axis=1, kind="stable")
                    least = np.where(n > 0, h[np.arange(len(n)), ranked[:, 0]], np.nan)
                    beyond = np.take_along_axis((phrases - 1) * parser.bits, ranked[:, :1], 1)[:, 0] > max_entropy * n
                    best = np.where((n > 0) & ~beyond, ranked[:, 0], some)
                    if some > 1:
                        second = np.where(n > 0, ranked[:, 1], some)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(np.round(least, 9), mask=np.isnan(least)), pa.array(names[second], pa.string()), pa.array(n)],
                    names=["doc_id", "language", "entropy", "runner_up", "n_bytes"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        emit, "doc_id bigint, language string, entropy double, runner_up string, n_bytes bigint"
    )


def in_known_language(docs: DataFrame, samples: dict[str, bytes], max_entropy: float = MAX_ENTROPY) -> DataFrame:
    """Rows of ``docs`` whose text is in a language of ``samples``, with that language in column ``lang``.

    Rejected are null texts, texts without letters and those beyond ``max_entropy``.  All other columns stay as they are.
    """
    fields = docs.columns
    at = fields.index("text")
    out = docs.select(*fields).withColumn("lang", F.lit(None).cast("string")) if "lang" not in fields else docs
    place = out.columns.index("lang")
    kept: dict[int, Parser] = {}
    names = pa.array([*sorted(samples)], pa.string())

    def emit(batches):
        if 0 not in kept:
            kept[0] = Parser(samples)
        parser = kept[0]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                data, offsets = normalise(part.column(at))
                n = np.diff(offsets)
                if not parser.roots:
                    continue
                cost = parser.phrases(data, offsets) * parser.bits
                best = np.argmin(cost, axis=1)
                good = np.flatnonzero((n > 0) & (cost[np.arange(len(n)), best] - parser.bits[best] <= max_entropy * n))
                rows = part.take(pa.array(good))
                yield rows.set_column(place, rows.schema.field(place).name, names.take(pa.array(best[good])))

    return out.mapInArrow(emit, out.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, labelled_samples(docs))
