"""Document quality by a linear-chain conditional random field over lines.

Each line gets the label good or bad from its own features, those of its neighbours and the labels next to it.  The field is
fitted on a bounded sample of documents that are labelled as wholes.  All lines of a good document are good; of a bad one it
is only known that not all are, so that its lines' labels stay hidden and their likelihood is that of any labels but all good.
Runs of lines of bad documents that are spliced into good ones show where labels change.  The marginals of every line,
weighted by its length, make the document's quality.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table
from .wordgrams import slices, string_bytes, words_of

#: Labelled documents that the field is fitted on, by hash order; those of more characters or lines are passed over.
TRAIN_DOCS = 2000
TRAIN_CHARS = 1 << 16
TRAIN_LINES = 1000
#: Splices for each bad document, and their lines at most.
SPLICES = 2
SPLICE_LINES = 3
ROUNDS = 200
#: First rounds, in which the lines of bad documents count as bad.
WARM_ROUNDS = 60
STEP = 0.3
PENALTY = 2e-4
#: Documents of at least this quality are good.
MIN_QUALITY = 0.7

_UPPER, _DIGIT, _SPACE, _MARK, _NOISE, _LETTER = (np.zeros(256, bool) for _ in range(6))
_UPPER[range(65, 91)] = True
_DIGIT[range(48, 58)] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK[[ord(c) for c in "!?"]] = True
_NOISE[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\/"]] = True

#: Of a line itself; then the first of these again for the line before and the line after.
OWN = ("upper", "digits", "marks", "noise", "repeated words", "long words", "short", "empty", "no words", "length")
NEAR = 5
FEATURES = (*OWN, *(f"{x} before" for x in OWN[:NEAR]), *(f"{x} after" for x in OWN[:NEAR]), "as before", "as after", "first", "last", "bias")


def _sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[end] - total[start]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the number of lines of each text (none if null or empty)."""
    data, offsets = string_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    start = np.union1d(offsets[:-1][some], breaks + 1)
    # A final line break ends the last line and begins none.
    start = start[~np.isin(start, offsets[1:]) | np.isin(start, offsets[:-1][some])]
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.r_[start[1:], len(data)], offsets[doc + 1]) if len(start) else start
    last = data[end - 1] == 10 if len(start) else np.zeros(0, bool)
    end = end - last
    n = np.maximum(end - start, 1)
    letters = np.maximum(_sums(_LETTER[data], start, end), 1)
    words = words_of(texts.cast(pa.large_string()), lower=False)
    first, stop = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    count = np.maximum(stop - first, 1)
    again = np.zeros(len(words.code), bool)
    again[1:] = words.code[1:] == words.code[:-1]
    length = end - start
    own = np.stack(
        [
            _sums(_UPPER[data], start, end) / letters,
            _sums(_DIGIT[data], start, end) / n,
            np.minimum(1, 8 * _sums(_MARK[data], start, end) / n),
            np.minimum(1, 4 * _sums(_NOISE[data], start, end) / n),
            _sums(again, first, stop) / count,
            np.minimum(1, (length / count) / 20),
            length < 20,
            length == 0,
            stop == first,
            np.log1p(length) / 8,
        ],
        axis=1,
    ).astype(np.float64)
    head = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    tail = np.r_[doc[1:] != doc[:-1], True] if len(doc) else head
    before, after = np.zeros((len(doc), NEAR)), np.zeros((len(doc), NEAR))
    same = np.zeros(len(doc), bool)
    if len(doc):
        before[1:], after[:-1] = own[:-1, :NEAR], own[1:, :NEAR]
        before[head], after[tail] = 0, 0
        # Two lines are the same if they hash to the same words.
        total = np.zeros(len(words.code) + 1, np.uint64)
        np.cumsum(words.code, out=total[1:])
        code = total[stop] - total[first]
        same[1:] = (code[1:] == code[:-1]) & ~head[1:] & (stop > first)[1:]
    as_after = np.r_[same[1:], False] if len(doc) else same
    out = np.column_stack([own, before, after, same, as_after, head, tail, np.ones(len(doc))])
    return out, length, np.bincount(doc, minlength=len(texts))


def _sequences(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First lines and numbers of lines of the texts that have any, longest first."""
    some = np.flatnonzero(count)
    order = some[np.argsort(-count[some], kind="stable")]
    return (np.cumsum(count) - count)[order], count[order]


def marginals(energy: np.ndarray, moves: np.ndarray, count: np.ndarray, with_moves: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Forward-backward over all texts at once.

    ``energy`` (lines x 2) and ``moves`` (2 x 2) are log potentials.  Gives each line's marginals, the probability of each move
    to it (lines x 2 x 2; none to a first line) unless ``with_moves`` is false, and each text's log partition function.
    """
    first, size = _sequences(count)
    total = len(energy)
    forward, backward, scale = np.zeros((total, 2)), np.ones((total, 2)), np.ones(total)
    top = energy.max(axis=1, keepdims=True) if total else energy
    own, step = np.exp(energy - top), np.exp(moves - moves.max())
    alive = len(first)
    ends = []
    for t in range(int(size[0]) if len(size) else 0):
        while size[alive - 1] <= t:
            alive -= 1
        ends.append(alive)
        at = first[:alive] + t
        now = own[at] if t == 0 else own[at] * (forward[at - 1] @ step)
        scale[at] = now.sum(axis=1)
        forward[at] = now / scale[at][:, None]
    pairs = np.zeros((total, 2, 2)) if with_moves else None
    for t in range(len(ends) - 1, 0, -1):
        at = first[: ends[t]] + t
        inner = own[at] * backward[at] / scale[at][:, None]
        if pairs is not None:
            pairs[at] = forward[at - 1][:, :, None] * step * inner[:, None, :]
        backward[at - 1] = inner @ step.T
    owner = np.repeat(np.arange(len(count)), count)
    log = np.bincount(owner, np.log(scale) + top[:, 0] if total else scale, minlength=len(count)) + moves.max() * np.maximum(count - 1, 0)
    return forward * backward, pairs, log


def fit(features: np.ndarray, count: np.ndarray, label: np.ndarray, hidden: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features) and moves (2 x 2) of greatest penalised likelihood, by Adam.

    ``label`` has a label for each line.  Those of texts that are ``hidden`` hold for the first rounds only; then all is known of such a
    text is that not all its lines are good.
    """
    weights, moves = np.zeros(features.shape[1]), np.zeros((2, 2))
    label, owner = label.astype(int), np.repeat(np.arange(len(count)), count)
    later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    given = np.zeros((len(label), 2, 2))
    given[later, label[later - 1], label[later]] = 1
    good = np.zeros((len(label), 2, 2))
    good[later, 1, 1] = 1
    unknown = hidden[owner] if len(owner) else np.zeros(0, bool)
    memory = [np.zeros((2, len(weights))), np.zeros((2, 2, 2))]
    n = max(1, len(label))
    for k in range(1, rounds + 1):
        score = features @ weights
        p, pairs, log = marginals(np.stack([np.zeros(len(score)), score], axis=1), moves, count)
        want, wanted = label.astype(float), given
        if k > WARM_ROUNDS:
            # What is expected of a text's lines if not all are good.
            whole = np.bincount(owner, score, minlength=len(count)) + np.maximum(count - 1, 0) * moves[1, 1] - log
            share = np.minimum(np.exp(np.minimum(whole, 0)), 1 - 1e-9)[owner]
            want = np.where(unknown, (p[:, 1] - share) / (1 - share), want)
            share = share[:, None, None]
            wanted = np.where(unknown[:, None, None], (pairs - share * good) / (1 - share), given)
        slopes = (features.T @ (want - p[:, 1]) / n - penalty * weights, (wanted - pairs).sum(axis=0) / n - penalty * moves)
        for x, slope, m in zip((weights, moves), slopes, memory, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.99 * m[1] + 0.01 * slope**2
            x += STEP * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-9)
    return weights, moves


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    return lines if lines[-1] else lines[:-1]


def training_texts(texts: list[str], good: list[bool], seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts, and runs of lines of the bad ones spliced into good ones; a label for each line; whether a text's labels are hidden."""
    draw = random.Random(seed)
    split = [_lines(t) for t in texts]
    fine, poor = [x for x, y in zip(split, good, strict=True) if y and x], [x for x, y in zip(split, good, strict=True) if not y and x]
    sequences = [(x, [int(y)] * len(x), not y) for x, y in zip(split, good, strict=True) if x]
    for x in poor if fine else []:
        for _ in range(SPLICES):
            home, n, a = draw.choice(fine), draw.randint(1, SPLICE_LINES), draw.randrange(len(x))
            run, at = x[a : a + n], draw.randint(0, len(home))
            sequences.append((home[:at] + run + home[at:], [1] * at + [0] * len(run) + [1] * (len(home) - at), False))
    label = np.array([y for _, ys, _ in sequences for y in ys], np.int64)
    return ["\n".join(x) + "\n" for x, _, _ in sequences], label, np.array([h for _, _, h in sequences], bool)


def trained(texts: list[str], good: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The field for texts that are labelled as wholes."""
    spliced, label, hidden = training_texts(texts, good)
    features, _, count = line_features(pa.array(spliced, pa.string()))
    return fit(features, count, label, hidden)


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The field for ``labels`` (``doc_id, quality``); documents with several labels count by the least.

    At most ``train_docs`` documents reach the driver, none of more than :data:`TRAIN_CHARS` characters or :data:`TRAIN_LINES` lines.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("good"))
        .where("id is not null and good in (0, 1)")
        .groupBy("id")
        .agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("id", F.lit(5)), "id")
        .limit(train_docs)
    )
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
        .where((F.length("text") <= TRAIN_CHARS) & (breaks < TRAIN_LINES))
        .join(F.broadcast(known), "id")
        .distinct()
        .select("id", "good", "text")
        .orderBy(F.xxhash64("id", F.lit(5)), "id", "text")
        .limit(train_docs)
        .collect()
    )
    return trained([r.text for r in rows], [r.good == 1 for r in rows])


def scored(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], min_quality: float = MIN_QUALITY) -> DataFrame:
    """Columns ``doc_id, quality, n_lines, good`` for every row of ``docs`` (``doc_id, text``); other columns are ignored.

    ``quality`` is the mean of the lines' probabilities of being good, weighted by their bytes.  It is null, and ``good`` false, for
    null and empty texts and those of empty lines only; one that ties with ``min_quality`` is good.  Repeated rows each get a row, null ids
    too.  Very long texts are read whole, in time linear in their lines.
    """
    weights, moves = field

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                features, length, count = line_features(part.column("text"))
                score = features @ weights
                p = marginals(np.stack([np.zeros(len(score)), score], axis=1), moves, count, False)[0]
                doc = np.repeat(np.arange(len(count)), count)
                weight = np.bincount(doc, weights=length, minlength=len(count))
                mean = np.bincount(doc, weights=length * p[:, 1], minlength=len(count)) / np.maximum(weight, 1)
                none = weight == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.round(mean, 6), mask=none), pa.array(count.astype(np.int32)), pa.array((mean >= min_quality) & ~none)],
                    names=["doc_id", "quality", "n_lines", "good"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(emit, "doc_id bigint, quality double, n_lines int, good boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
