"""What all operators of this subpackage share: reading tables, cutting lineage, checked broadcasts and filters by id."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordgrams import finalise

#: Bytes of rows, as measured, up to which a side of a join may be broadcast; and of a Bloom filter at most.
BROADCAST_BYTES = 64 << 20
#: Of a Bloom filter: bits an id, while there is room, and places an id.
_BITS, _PLACES = 12, 5
_CHUNK = 1 << 15

#: Tables written by :func:`cut` that are still there.
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, local sessions get a temporary one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor costs no recomputation.

    The table stays until :func:`released` ends around the call, or the program does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _forget(first: int) -> None:
    while len(_written) > first:
        spark, path = _written.pop()
        if not spark.sparkContext._jsc or spark.sparkContext._jsc.sc().isStopped():
            continue
        delete(spark, path)


@contextmanager
def released() -> Iterator[None]:
    """Deletes the tables cut inside at the end: only for results that are written by then."""
    first = len(_written)
    try:
        yield
    finally:
        _forget(first)


@atexit.register
def _at_exit() -> None:
    try:
        _forget(0)
    except Exception:  # noqa: BLE001 - the session may be gone by now, and the folder with it
        _written.clear()


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + 24
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(c, F.lit(0).cast("bigint"), lambda total, x: total + _bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(0).cast("bigint")) + 24
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("bigint"))
    return F.lit(8).cast("bigint")


def fits(df: DataFrame) -> bool:
    """Whether the rows of ``df`` fit :data:`BROADCAST_BYTES` as Spark holds them for a join: their own bytes and 32 each.

    ``df`` should be cheap to read: a written table or a scan.
    """
    row = sum((_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(32).cast("bigint"))
    return (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast only if it :func:`fits`; else Spark shuffles both sides."""
    return F.broadcast(df) if fits(df) else df


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of each id in a filter of ``bits`` bits, a power of two."""
    h = finalise(ids.astype(np.int64).view(np.uint64))
    step = finalise(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return ((h + np.arange(_PLACES, dtype=np.uint64)[:, None] * step) & np.uint64(bits - 1)).astype(np.int64)


def among(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition on a bigint column that holds for all of ``ids`` (one bigint column) and few others, by a Bloom filter.

    The filter is made in parts by the executors and takes at most :data:`BROADCAST_BYTES`; with more ids than that has room for more
    others pass, never less.  Nulls don't.
    """
    name = ids.columns[0]
    room = max(_CHUNK, min(8 * max(BROADCAST_BYTES, 0), _BITS * ids.count()))
    bits = 1 << (room.bit_length() - 1)

    def spread(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // _CHUNK), pa.array((at % _CHUNK).astype(np.int32))], names=["chunk", "at"])

    def chunk(t: pa.Table) -> pa.Table:
        held = np.zeros(_CHUNK, bool)
        held[t.column("at").to_numpy()] = True
        return pa.table({"chunk": t.column("chunk")[:1], "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    parts = ids.where(F.col(name).isNotNull()).mapInArrow(spread, "chunk bigint, at int").groupBy("chunk").applyInArrow(chunk, "chunk bigint, held binary").collect()
    held = np.zeros(bits // 8, np.uint8)
    for r in parts:
        held[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = np.frombuffer(r["held"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def known(x):
        import pandas as pd

        at = _places(x.to_numpy(), bits)
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return lambda c: c.isNotNull() & known(F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")))


def only(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is in ``ids`` (that one column, written).

    Beyond what may be broadcast a Bloom filter goes first, so that of the others few are shuffled.
    """
    if fits(ids):
        return docs.join(F.broadcast(ids), on, "left_semi").select(docs.columns)
    return docs.where(among(ids)(F.col(on))).join(ids, on, "left_semi").select(docs.columns)


def without(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is null or not in ``ids`` (that one column, written); the rest is as :func:`only` says."""
    if fits(ids):
        return docs.join(F.broadcast(ids), on, "left_anti").select(docs.columns)
    may = among(ids)(F.col(on))
    return docs.where(~may).union(docs.where(may).join(ids, on, "left_anti").select(docs.columns))


def matched(texts: DataFrame, found: DataFrame, on: str, key: str) -> DataFrame:
    """Inner join of ``texts`` with ``found`` (written), ``on`` equal to ``key``, by the same means."""
    if fits(found):
        return texts.join(F.broadcast(found), F.col(on) == F.col(key))
    return texts.where(among(found.select(key))(F.col(on))).join(found, F.col(on) == F.col(key))
