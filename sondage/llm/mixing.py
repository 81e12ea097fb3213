"""Mixing sources to target weights by fitting token budgets exactly.

Documents are counted by source and exact token length.  For each source the bulk of its budget is taken in proportion
from all lengths, and a bounded-knapsack dynamic programme, which may also give back what was taken, fits the rest: to the token
where any subset of lengths does.  Documents are then chosen by seeded order within each length.
"""

from __future__ import annotations

import random
from itertools import accumulate
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, only, small, table, without

SEED = 17
#: Tokens by which sums in the dynamic programme first stray from the share taken of every length; more only where none meets the budget.
WINDOW_TOKENS = 32768
#: Documents of one source and length that are ranked by one task; of more, all but those about the last one taken are chosen by hash alone.
RANKED = 65536
#: Without given weights, a source weighs its tokens to this power.
TEMPERATURE = 0.5
#: Then the scarcest sources that together hold at most this share of all tokens are kept whole and don't scale the others down.
STRAY_SHARE = 0.01
_NO_SOURCE = "\x00none"


class _Sums:
    """Sums that can be reached from 0 within ``low .. high``, as bits of an integer, and how."""

    def __init__(self, low: int, high: int):
        self.low, self.mask, self.reach = low, (1 << (high - low + 1)) - 1, 1 << -low
        self.steps: list[tuple[int, int, int]] = []

    def add(self, length: int, take: int) -> None:
        """Allow ``take`` more (or less, if negative) documents of a length, together."""
        by = length * take
        after = self.reach | (self.reach << by if by > 0 else self.reach >> -by) & self.mask
        if after != self.reach:
            self.steps.append((length, take, self.reach))
            self.reach = after

    def reaches(self, total: int) -> bool:
        return bool(self.reach >> (total - self.low) & 1)

    def best(self, most: int) -> int:
        return (self.reach & ((1 << (most - self.low + 1)) - 1)).bit_length() - 1 + self.low

    def path(self, total: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for length, take, before in reversed(self.steps):
            if not before >> (total - self.low) & 1:
                out[length] = out.get(length, 0) + take
                total -= length * take
        return out


def bounded_subset(lengths: list[int], counts: list[int], target: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near below ``target`` as can be; exact where possible.

    Counts are split into powers of two, each a single item; reachable sums are the bits of an integer.
    """
    sums = _Sums(0, target)
    for length, count in zip(lengths, counts, strict=True):
        for take in _powers(min(count, target // length) if length else 0):
            if sums.reaches(target):
                break
            sums.add(length, take)
    return sums.path(sums.best(target))


def _powers(count: int) -> list[int]:
    out, part = [], 1
    while count > 0:
        out.append(min(part, count))
        count -= out[-1]
        part *= 2
    return out


def fit(counts: dict[int, int], budget: int, seed: int = SEED, window: int = WINDOW_TOKENS) -> dict[int, int]:
    """Documents to take of each length, ``counts`` of which there are: a sum as near below ``budget`` as any subset has.

    The same share of every length is taken first, and the rest filled up from the longest.  The dynamic programme then adds and
    gives back documents, with sums up to ``window`` away from that start; where none meets the budget the window grows, at last to all
    sums that there are.
    """
    counts = {n: c for n, c in sorted(counts.items()) if n > 0 and c > 0}
    have = sum(n * c for n, c in counts.items())
    if budget >= have:
        return counts
    if budget <= 0:
        return {}
    # Only multiples of the common divisor can be met.
    unit = gcd(*counts)
    if unit > 1:
        return {n * unit: k for n, k in fit({n // unit: c for n, c in counts.items()}, budget // unit, seed, window).items()}
    taken = {n: c * budget // have for n, c in counts.items()}
    left = budget - sum(n * k for n, k in taken.items())
    for n in reversed(counts):
        more = min(left // n, counts[n] - taken[n])
        taken[n] += more
        left -= n * more
    order = list(counts)
    random.Random(seed).shuffle(order)
    start = budget - left
    while left:
        low, high = max(-start, -window), min(have - start, max(window, left))
        sums = _Sums(low, high)
        for n in order:
            more, less = counts[n] - taken[n], taken[n]
            ups, downs = _powers(min(more, (high - low) // n)), _powers(min(less, (high - low) // n))
            for take in (*ups, *(-x for x in downs)):
                if sums.reaches(left):
                    break
                sums.add(n, take)
        whole = low == -start and high == have - start
        if sums.reaches(left) or whole:
            for n, k in sums.path(sums.best(left)).items():
                taken[n] += k
            break
        window *= 8
    return {n: k for n, k in taken.items() if k}


def budgets(tokens: dict[str, int], weights: dict[str, float] | None = None, total: int | None = None) -> dict[str, int]:
    """Token budget of each source.

    Without ``weights`` each source weighs its tokens to the power :data:`TEMPERATURE`; sources without a weight get nothing.
    Without ``total`` the budgets are the largest in these proportions that no source falls short of; without both, the
    scarcest sources, with at most :data:`STRAY_SHARE` of all tokens together, may fall short, and keep all they have.
    """
    spare = 0.0
    if weights is None:
        spare = STRAY_SHARE * sum(tokens.values())
        weights = {s: t**TEMPERATURE for s, t in tokens.items() if t > 0}
    weights = {s: w for s, w in weights.items() if w > 0 and tokens.get(s, 0) > 0}
    whole = sum(weights.values())
    if not whole:
        return {}
    if total is None:
        scarcest = sorted(weights, key=lambda s: tokens[s] / weights[s])
        stray = {s for s, held in zip(scarcest, accumulate(tokens[s] for s in scarcest)) if held <= spare}
        scale = min(tokens[s] / weights[s] for s in scarcest[len(stray) :])
        return {s: tokens[s] if s in stray else min(tokens[s], int(w * scale)) for s, w in weights.items()}
    return {s: min(tokens[s], int(total * w / whole)) for s, w in weights.items()}


def token_lengths(docs: DataFrame) -> DataFrame:
    """Columns ``id, source, n_tokens`` by document; tokens are runs of anything but white space.

    Repeated rows of one id are one document, with all their tokens and the least source.
    """
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"\S+")))
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE)).alias("source"), words.cast("bigint").alias("n"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("source").alias("source"), F.sum("n").alias("n_tokens"))
    )


def chosen(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, ranked: int = RANKED) -> DataFrame:
    """Columns ``doc_id, source, n_tokens`` of the documents that make the mix.

    ``docs`` needs ``doc_id, text, source``; other columns are ignored.  A null source is a source of its own, whose key in
    ``weights`` is None.  Rows with a null id and documents without tokens are never chosen.  Within a source and length
    documents are taken by the hash of id and seed, ties of it by id.  Each source's tokens are at most its budget, and equal it where
    any subset of its documents does.  A very long text is a document like others, taken whole or not at all.
    """
    return _chosen(cut(token_lengths(docs)), weights, total, seed, ranked)


def _chosen(every: DataFrame, weights: dict[str, float] | None, total: int | None, seed: int, ranked: int) -> DataFrame:
    """:func:`chosen` from a written table of :func:`token_lengths`."""
    if weights is not None:
        weights = {_NO_SOURCE if s is None else s: w for s, w in weights.items()}
    measured = every.where("n_tokens > 0")
    counts = cut(measured.groupBy("source", "n_tokens").agg(F.count("*").alias("held")))
    # A row a source; a source's distinct lengths, at most as many as its longest document has tokens, go to one task each.
    tokens = {r["source"]: int(r["tokens"]) for r in counts.groupBy("source").agg(F.sum(F.col("n_tokens").cast("decimal(38,0)") * F.col("held")).alias("tokens")).collect()}
    goal = budgets(tokens, weights, total)

    def fitted(t: pa.Table) -> pa.Table:
        source = t.column("source")[0].as_py()
        held = dict(zip(t.column("n_tokens").to_pylist(), t.column("held").to_pylist(), strict=True))
        quota = fit(held, goal.get(source, 0), seed)
        lengths = [n for n, k in quota.items() if k]
        return pa.table(
            {
                "source": pa.array([source] * len(lengths), pa.string()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "quota": pa.array([quota[n] for n in lengths], pa.int64()),
                "bins": pa.array([-(-held[n] // ranked) for n in lengths], pa.int64()),
            }
        )

    quotas = cut(counts.groupBy("source").applyInArrow(fitted, "source string, n_tokens bigint, quota bigint, bins bigint"))
    # The hash, from 0 to 1, orders a length's documents; whole bins of it are in or out, but for the one in which the quota ends.
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1)
    drawn = measured.join(small(quotas), ["source", "n_tokens"]).withColumn("place", place)
    drawn = drawn.withColumn("bin", F.floor(F.col("place") / F.lit(2.0**63) * F.col("bins")).cast("bigint"))
    keys = ["source", "n_tokens", "bin"]
    filled = drawn.where("bins > 1").groupBy(*keys).agg(F.count("*").alias("inside"))
    before = filled.withColumn("before", F.sum("inside").over(Window.partitionBy("source", "n_tokens").orderBy("bin")) - F.col("inside"))
    many = drawn.where("bins > 1").join(small(cut(before)), keys).withColumn("rest", F.col("quota") - F.col("before")).where("rest > 0")
    edge = many.where("rest < inside").select("id", "source", "n_tokens", "place", "bin", "rest").union(drawn.where("bins = 1").select("id", "source", "n_tokens", "place", "bin", F.col("quota").alias("rest")))
    last = edge.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "id"))).where("rank <= rest")
    out = many.where("rest >= inside").select("id", "source", "n_tokens").union(last.select("id", "source", "n_tokens"))
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("source") != _NO_SOURCE, F.col("source")).alias("source"), "n_tokens")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that make the mix, with their columns."""
    every = cut(token_lengths(docs))
    ids = cut(_chosen(every, weights, total, seed, RANKED).select("doc_id"))
    # Whichever are fewer are looked up, those that stay or those that go.
    if 2 * ids.count() <= every.count():
        return only(docs, ids, "doc_id")
    rest = cut(every.select(F.col("id").alias("doc_id")).join(ids, "doc_id", "left_anti"))
    return without(docs.where(F.col("doc_id").isNotNull()), rest, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(table(spark, sf_dir, "documents"))
