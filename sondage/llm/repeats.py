"""Maximal repeats of at least ``min_words`` words, by an enhanced suffix array and its tree of common-prefix intervals.

Below depth ``min_words`` the interval tree falls apart into subtrees, one for each distinct prefix of that length.  All
suffixes with one such prefix have the same anchor, the least k-gram hash of the prefix (winnowing), so that spreading
suffixes by anchor keeps subtrees whole.  Each partition sorts and scans its own suffixes.  Three facts keep what is
spread small without losing a repeat:

* only suffixes whose anchor occurs twice can begin a repeat;
* if the words before an anchor are the same at all its occurrences, every repeat there extends to the left, so that no
  maximal one begins there;
* a suffix can be cut where the first prefix with a single anchor ends, as no repeat reaches further.

In each partition a stack scan of the suffix array finds the intervals whose suffixes share a prefix; one whose suffixes
follow different words is a maximal repeat, reported with all its occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import among, cut, table
from .wordgrams import RunCodes, Words, finalise, gram_codes, signed, slices, window_minima, words_of

MIN_WORDS = 50
#: Buckets of suffixes for each shuffle partition; a bucket is sorted in memory.
BUCKETS = 8

REPEATS = "array_id bigint, rank bigint, doc_id bigint, start_word int, end_word int, group_id bigint, n_words int, first_rank bigint, last_rank bigint"


def _windows(part: pa.RecordBatch, least: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words and k-grams of some texts, the starts of their runs of ``least`` words, and the anchor of each run."""
    k = (least + 1) // 2
    words = words_of(part.column("text"))
    grams, valid = gram_codes(words, k)
    return words, grams, *window_minima(grams, valid, words.doc, least - k + 1)


def _packed(body: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(body, asbytes=True)


def anchors(texts: DataFrame, least: int) -> DataFrame:
    """Columns ``key, pos, gram, before`` of the anchors of a frame with ``key, text``.

    ``before`` hashes as many words before the anchor as a run can begin before it, and the one before those; it is null
    where the text begins within them.
    """
    back = least - (least + 1) // 2 + 1

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, grams, _, anchor = _windows(part, least)
                at = np.unique(anchor)
                doc = np.searchsorted(words.first, at, side="right") - 1
                before, _ = gram_codes(words, back)
                some = at - words.first[doc] >= back
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(doc)),
                        pa.array((at - words.first[doc]).astype(np.int32)),
                        signed(grams[at]),
                        pa.array(before[np.where(some, at - back, 0)].view(np.int64) if len(at) else np.zeros(0, np.int64), mask=~some),
                    ],
                    names=["key", "pos", "gram", "before"],
                )

    return texts.mapInArrow(emit, "key bigint, pos int, gram bigint, before bigint")


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of ``text`` that start at ``wanted``, and the common prefix of each with the one before.

    Ranks of prefixes are doubled until they are all different; the ranks of each length then give the common prefixes.
    Every run of equal text must end in a symbol of its own.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
    ranks, length = [rank], 1
    while True:
        now = ranks[-1]
        if len(np.unique(now[wanted])) == len(wanted) or length >= n:
            break
        key = now.astype(np.int64) * np.int64(n + 2)
        key[: n - length] += now[length:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        ranks.append(rank)
        length *= 2
    order = wanted[np.argsort(ranks[-1][wanted], kind="stable")]
    common = np.zeros(len(order), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    total = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = np.zeros(len(a), bool)
        equal[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = 1 << level
        total[equal] += step
        a[equal] += step
        b[equal] += step
    common[1:] = total
    return order, common


def maximal_intervals(common: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a suffix array that are maximal repeats of at least ``least`` symbols: first and last entry, length, seam.

    ``left`` holds the symbol before each suffix, negative if there is none; an interval counts if two of them differ or one is
    missing, as then no extension to the left keeps all occurrences.  The seam is the first entry in the interval whose common
    prefix with the one before is just the length: no other interval has it.
    """
    # An interval is uniform to the left if its first and last entries are in one run of equal symbols.
    run = np.zeros(len(left), np.int64)
    if len(left) > 1:
        run[1:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))
    out, stack = [], []
    for i, depth in enumerate([*common[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, high, seam = stack.pop()
            out.append((first, i - 1, high, seam))
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((first, depth, i))
    first, last, high, seam = np.array(out, np.int64).reshape(-1, 4).T
    diverse = (run[first] != run[last]) | (left[first] < 0)
    return first[diverse], last[diverse], high[diverse], seam[diverse]


def longest_over(first: np.ndarray, last: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Length of the innermost of nested intervals over each of ``n`` entries; 0 where there is none."""
    out, at, stack = np.zeros(n, np.int64), 0, []

    def fill(end: int) -> None:
        nonlocal at
        if end > at:
            out[at:end] = stack[-1][1]
            at = end

    for x in np.lexsort((-last, first)).tolist():
        while stack and stack[-1][0] <= first[x]:
            fill(stack[-1][0])
            stack.pop()
        if stack:
            fill(int(first[x]))
        at = max(at, int(first[x]))
        stack.append((int(last[x]) + 1, int(high[x])))
    while stack:
        fill(stack[-1][0])
        stack.pop()
    return out


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Groups of maximal repeats: every passage of at least ``min_words`` words that occurs twice and can be extended neither
    to the left nor to the right without losing an occurrence, with all its occurrences, as an interval tree.

    Each row is a place where such a passage begins, at ``rank`` of the suffix array ``array_id``: ``doc_id``, ``start_word`` and ``end_word``, past
    the longest passage that begins there.  A row may also hold a group: ``group_id`` (hash of the passage), its ``n_words`` and the
    ranks ``first_rank`` to ``last_rank`` of its occurrences in this array; these columns are null elsewhere.  So the rows are at most as
    many as the words, though the occurrences of nested groups can be as many as their square; :func:`occurrences` lists them.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Words are compared without case or punctuation; passages end at
    the end of a text.  Null texts, texts of fewer words and rows with a null id have none.  Repeated rows (same id and text) count as
    one; an id with several texts has the occurrences of each.  Occurrences within one text count, those that overlap too.  Equal
    passages are one group; they are ranked by id and place.
    """
    spark = docs.sparkSession
    # An id may have several texts; the key tells them apart.  Should two rows ever share one, each has the other's anchors as well,
    # and so only more to sort.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text").where("id is not null and text is not null")
    found = cut(anchors(texts, min_words))
    twice = (
        found.groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("before").alias("low"), F.max("before").alias("high"), F.count("before").alias("known"))
        .where("n > 1")
        .select("gram", (F.expr("known < n or low != high")).alias("edge"))
    )
    state = (
        found.select("key", "pos", "gram")
        .join(twice, "gram")
        .groupBy(F.col("key").alias("of"))
        .agg(F.collect_set(F.struct("pos", "edge")).alias("anchors"))
        .where(F.exists("anchors", lambda a: a["edge"]))
    )
    buckets = np.uint64(BUCKETS * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def spread(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, grams, start, anchor = _windows(part, min_words)
                marks = part.column("anchors")
                many = np.diff(np.asarray(marks.offsets))
                pos = marks.flatten().field("pos").to_numpy() + np.repeat(words.first[:-1], many)
                edge = marks.flatten().field("edge").to_numpy(zero_copy_only=False)
                own = pos < np.repeat(words.first[1:], many)
                pos, edge = pos[own], edge[own]
                repeated = np.zeros(len(words.code), bool)
                repeated[pos] = True
                begins = np.zeros(len(words.code), bool)
                begins[pos[edge]] = True
                alone = np.where(repeated[anchor], len(words.code), start)
                ends = words.first[np.searchsorted(words.first, start, side="right")]
                until = np.minimum(np.minimum.accumulate(alone[::-1])[::-1] + min_words - 1, ends)
                some = repeated[anchor] & begins[anchor]
                start, until, target = start[some], until[some], (finalise(grams[anchor[some]]) % buckets).astype(np.int64)
                order = np.lexsort((start, until, target))
                start, until, target = start[order], until[order], target[order]
                rows = np.flatnonzero(np.r_[True, (until[1:] != until[:-1]) | (target[1:] != target[:-1])]) if len(start) else start
                first = start[rows]
                doc = np.searchsorted(words.first, first, side="right") - 1
                led = first > words.first[doc]
                spans = zip(words.start[first - led].tolist(), words.end[until[rows] - 1].tolist(), strict=True) if len(rows) else ()
                bodies = [words.data[a:b].tobytes() for a, b in spans]
                places = [(start[a:b] - start[a]).astype(np.int32).tobytes() for a, b in zip(rows.tolist(), [*rows[1:].tolist(), len(start)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(target[rows]),
                        part.column("id").take(pa.array(doc)),
                        part.column("key").take(pa.array(doc)),
                        pa.array((first - words.first[doc]).astype(np.int32)),
                        pa.array(led),
                        pa.array([len(b) for b in bodies], pa.int32()),
                        pa.array([_packed(b) for b in bodies], pa.binary()),
                        pa.array(places, pa.binary()),
                    ],
                    names=["bucket", "id", "key", "start", "led", "size", "body", "places"],
                )

    # Few texts without edges are shuffled.
    state = cut(state)
    some = texts.where(among(state.select("of"))(F.col("key")))
    passages = (
        some.join(state, F.col("key") == F.col("of"))
        .select("id", "key", "text", "anchors")
        .mapInArrow(spread, "bucket bigint, id bigint, key bigint, start int, led boolean, size int, body binary, places binary")
    )
    return passages.groupBy("bucket").applyInArrow(lambda t: scan(t, min_words), REPEATS)


def scan(passages: pa.Table, least: int) -> pa.Table:
    """Maximal repeats among the marked suffixes of the passages of one bucket.

    Equal passages are sorted once; their occurrences come back at the end.
    """
    copies: dict[tuple, set[tuple[int, int, int]]] = {}
    for i, start, key, *kind in zip(*(passages.column(c).to_pylist() for c in ("id", "start", "key", "led", "size", "body", "places")), strict=True):
        copies.setdefault(tuple(kind), set()).add((i, start, key))
    kinds = sorted(copies)
    homes = [np.array(sorted(copies[x]), np.int64) for x in kinds]
    led = np.array([x[0] for x in kinds], np.int64)
    words = words_of(pa.array([pa.Codec("zstd").decompress(body, n, asbytes=True) for _, n, body, _ in kinds], pa.binary()).cast(pa.large_string()), lower=False)
    size = np.diff(words.first)
    first = words.first[:-1] + np.arange(len(size))
    code = np.zeros(len(words.code) + len(size), np.uint64)
    code[np.arange(len(words.code)) + words.doc] = words.code
    names = np.unique(code, return_inverse=True)[1].astype(np.int64)
    names[first + size] = len(code) + np.arange(len(size))
    marks = [np.frombuffer(x[3], np.int32).astype(np.int64) + x[0] for x in kinds]
    owner = np.repeat(np.arange(len(kinds)), [len(m) for m in marks])
    wanted = np.concatenate([f + m for f, m in zip(first.tolist(), marks, strict=True)])
    order, common = suffix_order(names, wanted)
    back = np.zeros(len(code), np.int64)
    back[wanted] = owner
    owner = back[order]
    left = np.where(order > first[owner], names[order - 1], -1)
    # Entries of equal passages become neighbours that share all the rest of the passage.
    many = np.array([len(h) for h in homes])[owner]
    reach = first[owner] + size[owner] - order
    entry = np.repeat(np.arange(len(order)), many)
    head = np.r_[True, entry[1:] != entry[:-1]]
    place = np.concatenate([homes[x] for x in owner.tolist()])
    common = np.where(head, common[entry], reach[entry])
    low, high, length, seam = maximal_intervals(common, left[entry], least)
    longest = longest_over(low, high, length, len(entry))
    kept = np.flatnonzero(longest)
    rank = np.cumsum(longest > 0) - 1
    group = np.full(len(entry), -1)
    group[seam] = np.arange(len(seam))
    group = group[kept]
    codes = finalise(RunCodes(code).of(order[entry[low]], length) ^ length.astype(np.uint64)).view(np.int64)
    start = place[kept, 1] + (order - first[owner] - led[owner])[entry[kept]]
    columns = [np.full(len(kept), passages.column("bucket")[0].as_py()), rank[kept], place[kept, 0], start, start + longest[kept]]
    columns = [pa.array(c) for c in columns] + [pa.array(np.append(c, 0)[group], mask=group < 0) for c in (codes, length, rank[low], rank[high])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([c.cast(ty) for c, ty in zip(columns, types, strict=True)], names=[c.split()[0] for c in REPEATS.split(", ")])


def occurrences(found: DataFrame) -> DataFrame:
    """All occurrences of every group of :func:`repeats`: ``group_id, n_words, n_occurrences, doc_id, start_word, end_word``.

    Groups may be nested, so that the rows can be many more than those of ``found``, which should be a written table.
    """
    groups = found.where("group_id is not null").select(
        "array_id", "group_id", "n_words", (F.col("last_rank") - F.col("first_rank") + 1).cast("int").alias("n_occurrences"), F.explode(F.sequence("first_rank", "last_rank")).alias("rank")
    )
    return groups.join(found.select("array_id", "rank", "doc_id", "start_word"), ["array_id", "rank"]).select(
        "group_id", "n_words", "n_occurrences", "doc_id", "start_word", (F.col("start_word") + F.col("n_words")).alias("end_word")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
