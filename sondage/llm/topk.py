"""Exact top-k search by a three-phase uniform threshold.

A score is a sum over parts of the vectors, each part held as a node of its own.  First every node lists its best partial
scores for a query among one tile of items a partition, and the exact scores of what is listed give a cutoff that the k-th best
can't be below.  Then the cutoff goes out: an item that reaches it must reach an equal share of it at some node, so that the
nodes collect every entry that does, in one pass over all items.  Last the entries collected are resolved exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, table

K = 10
#: The query set: every row whose id is divisible by this.
QUERY_STEP = 100
#: Nodes: more give cheaper lists but a weaker cutoff for each.
PARTS = 2
#: Vectors in a tile; tiles are the unit that is paired.
TILE = 1024
#: Scores are compared at so many decimals, so that equal scores tie in any order of summation.
DECIMALS = 9
#: Values beyond, whose products could leave the range of doubles, count as not finite.
MOST = 1e100

RESULT = "query_id bigint, rank int, vec_id bigint, score double"
_TILES = "tile bigint, head boolean, dim int, ids binary, vectors binary"
_ENTRIES = "tile bigint, query_id bigint, vec_id bigint, score double"


def tiles(vectors: DataFrame, size: int = TILE) -> DataFrame:
    """Vectors packed into tiles of one dimension each; of several vectors of an id the least is taken.

    Rows with a null id, and vectors that are null, empty, or hold a null or a value that isn't finite, are left out.  ``head`` marks the
    first tile that a partition has of a dimension.
    """
    good = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > MOST))
    )
    each = good.groupBy("id").agg(F.min("v").alias("v"))

    def pack(batches):
        from pyspark import TaskContext

        tile = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}
        begun: set[int] = set()

        def flush(dim: int):
            nonlocal tile
            part, rest = waiting[dim][:size], waiting[dim][size:]
            waiting[dim] = rest
            tile += 1
            ids = np.array([x[0] for x in part], np.int64)
            head = dim not in begun
            begun.add(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([tile]), pa.array([head]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([b"".join(x[1] for x in part)], pa.binary())],
                names=["tile", "head", "dim", "ids", "vectors"],
            )

        for batch in batches:
            lists = batch.column("v")
            values, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            for i, a, b in zip(batch.column("id").to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
                waiting.setdefault(int(b - a), []).append((i, values[a:b].tobytes()))
            for dim in waiting:
                while len(waiting[dim]) >= size:
                    yield flush(dim)
        for dim in waiting:
            if waiting[dim]:
                yield flush(dim)

    return each.mapInArrow(pack, _TILES)


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def _split(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _best(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of each query, ties by item; entries that come twice count once."""
    order = np.lexsort((item, -score, query))
    query, item, score = query[order], item[order], score[order]
    if len(query):
        new = np.r_[True, (query[1:] != query[:-1]) | (item[1:] != item[:-1])]
        query, item, score = query[new], item[new], score[new]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        query, item, score = query[place < k], item[place < k], score[place < k]
    return query, item, score


def _entries(tile: int, ids: np.ndarray, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(query), tile, np.int64)), pa.array(ids[query].astype(np.int64)), pa.array(item.astype(np.int64)), pa.array(score.astype(np.float64))],
        names=["tile", "query_id", "vec_id", "score"],
    )


def _exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores summed from the first value to the last; rounded where a double has that many decimals."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), 65536):
        left, right = a[rows[at : at + 65536]], b[columns[at : at + 65536]]
        total = np.zeros(len(left))
        for j in range(a.shape[1]):
            total += left[:, j] * right[:, j]
        out[at : at + 65536] = total
    return np.where(np.abs(out) < 2.0**53 / 10.0**DECIMALS, np.round(out, DECIMALS), out)


def _runs(batches) -> Iterator[tuple[int, Iterator[dict]]]:
    """Pairs of tiles as runs with one left tile each."""

    def pairs():
        for batch in batches:
            columns = batch.schema.names
            for r in range(batch.num_rows):
                # Buffers, not copies.
                yield {c: v.as_buffer() if isinstance(v := batch.column(k)[r], pa.BinaryScalar) else v.as_py() for k, c in enumerate(columns)}

    return itertools.groupby(pairs(), key=lambda row: row["tile"])


def local_lists(pairs: DataFrame, k: int) -> DataFrame:
    """Phase one: of every node's ``k`` best partial scores of each query, the exact scores; the ``k`` best of these."""

    def emit(batches):
        for tile, rows in _runs(batches):
            known = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for row in rows:
                ids, a = _unpack(row["ids"], row["vectors"], row["dim"])
                others, b = _unpack(row["other_ids"], row["other_vectors"], row["dim"])
                for part in _split(row["dim"]):
                    local = a[:, part] @ b[:, part].T
                    # One more than k, as the query itself may be there.
                    n = min(k + 1, len(others))
                    at, column = np.repeat(np.arange(len(ids)), n), np.argpartition(local, -n, axis=1)[:, -n:].reshape(-1)
                    other = ids[at] != others[column]
                    at, column = at[other], column[other]
                    known = _best(*(np.concatenate(x) for x in zip(known, (at, others[column], _exact(a, b, at, column)), strict=True)), k)
            yield _entries(tile, ids, *known)

    return pairs.mapInArrow(emit, _ENTRIES)


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much a product as the processor sums it, and rounding, can miss the exact score of each row of ``a``: twice the
    bound of a sum's error in any order, by the norms, and one unit of the last decimal."""
    return (a.shape[1] + 2) * 2.0**-51 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max(initial=0) + 10.0**-DECIMALS


def sufficient(pairs: DataFrame, k: int) -> DataFrame:
    """Phase two and three: the items that reach the cutoff's share at a node are collected and resolved exactly.

    ``cuts`` holds the cutoffs of the left tile's queries.  As better entries are found a query's cutoff rises.
    """

    def emit(batches):
        for tile, rows in _runs(batches):
            floor, known = None, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for row in rows:
                ids, a = _unpack(row["ids"], row["vectors"], row["dim"])
                others, b = _unpack(row["other_ids"], row["other_vectors"], row["dim"])
                if floor is None:
                    safe = {x["query_id"]: x["score"] for x in row["cuts"] or ()}
                    floor = np.array([safe.get(i, -np.inf) for i in ids.tolist()])
                parts = _split(row["dim"])
                least = (floor - slack(a, b))[:, None]
                total, enough = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
                for part in parts:
                    local = a[:, part] @ b[:, part].T
                    enough |= local >= least / len(parts)
                    total += local
                enough &= total >= least
                at, column = np.nonzero(enough)
                other = ids[at] != others[column]
                at, column = at[other], column[other]
                if not len(at):
                    continue
                known = _best(*(np.concatenate(x) for x in zip(known, (at, others[column], _exact(a, b, at, column)), strict=True)), k)
                last = np.flatnonzero(np.r_[known[0][1:] != known[0][:-1], True])
                full = np.diff(np.r_[-1, last]) == k
                where = known[0][last[full]]
                floor[where] = np.maximum(floor[where], known[2][last[full]])
            yield _entries(tile, ids, *known)

    return pairs.mapInArrow(emit, _ENTRIES)


def _ranked(entries: DataFrame) -> DataFrame:
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Columns ``query_id, rank, vec_id, score``: the ``k`` of ``vectors`` with another id and the greatest inner product with each of ``queries``.

    Both need ``vec_id`` and ``embedding``; other columns are ignored.  Rows with a null id or a null, empty or not finite vector
    take no part (values beyond :data:`MOST` count as not finite).  Repeated rows count once; of several vectors of an id the least
    counts.  Only vectors of the same length are compared.  Ties go to the lower ``vec_id``; with fewer than ``k`` others all are
    listed.
    """
    width = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed, asked = cut(tiles(vectors)), cut(tiles(queries)).drop("head")
    blocks = max(1, min(asked.count(), width))
    left = asked.repartition(blocks, "tile").hint("shuffle_replicate_nl")
    # Every block of queries meets every tile, in tasks enough for all cores; a task keeps k entries of a query.
    items = packed.coalesce(max(1, 4 * width // blocks)).select("head", F.col("dim").alias("other_dim"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    alike = (F.col("dim") - F.col("other_dim")) == 0
    listed = _ranked(local_lists(left.join(items.where("head").drop("head"), alike), k)).where(F.col("rank") == k)
    cuts = cut(listed.groupBy("tile").agg(F.collect_list(F.struct("query_id", "score")).alias("cuts")))
    informed = asked.join(cuts, "tile", "left").repartition(blocks, "tile").hint("shuffle_replicate_nl")
    return _ranked(sufficient(informed.join(items.drop("head"), alike), k)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_dot_product(a.e, b.e), {DECIMALS}) AS x
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, x AS score FROM r WHERE rank <= {K}
"""
