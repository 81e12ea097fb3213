"""Keeping an index current: differences, deltas, compaction, and when to do which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from .index import assign_segments

REBUILD_PERCENT = 30
TOMBSTONE_RATIO = 0.15
DELTA_SEGMENTS = 15


def difference(scan: DataFrame, docs: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Columns ``path, change`` of every path that differs between a scan (``path, mtime``) and the valid ``docs``.

    ``change`` is ``new``, ``modified`` (another mtime, be it older) or ``deleted``.  Paths in ``rejected`` (``path, mtime``) with the same
    time are skipped unless they are indexed.
    """
    now = scan.select("path", F.col("mtime").alias("now"))
    then = docs.where(model.is_valid(F.col("flags"))).select("path", F.col("mtime").alias("then"))
    both = now.join(then, "path", "full_outer")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified")
    out = both.withColumn("change", change).where(F.col("change").isNotNull())
    if rejected is not None:
        known = rejected.select("path", F.col("mtime").alias("now")).withColumn("change", F.lit("new"))
        out = out.join(known, ["path", "now", "change"], "left_anti")
    return out.select("path", "change")


def should_rebuild(changes: int, documents: int, percent: int = REBUILD_PERCENT) -> bool:
    """Whether so many changes are better served by a full build; an empty index always is."""
    return documents == 0 or changes * 100 // documents > percent


def should_compact(deltas: int, baseline: int, tombstones: int, documents: int, segments: int = DELTA_SEGMENTS) -> bool:
    return documents > 0 and tombstones / documents > TOMBSTONE_RATIO or max(0, deltas - baseline) >= segments


def apply_delta(docs: DataFrame, gone: DataFrame, fresh: DataFrame, next_id: int, segment: int) -> DataFrame:
    """``docs`` with the paths of ``gone`` marked as tombstones, and the files of ``fresh`` in a new segment.

    ``fresh`` has ``path, size, mtime, flags, text``; its files get ids from ``next_id`` in order of path.
    """
    dead = gone.select("path").distinct().withColumn("__gone", F.lit(True))
    flags = F.when(F.col("__gone"), F.col("flags").bitwiseOR(model.TOMBSTONE)).otherwise(F.col("flags"))
    marked = docs.join(dead, "path", "left").withColumn("flags", flags).select(docs.columns)
    added = assign_segments(fresh, 0, next_id).withColumn("segment_id", F.lit(segment)).withColumn("language", model.language_of(F.col("path")))
    return marked.unionByName(added.select(docs.columns))


def compacted(docs: DataFrame) -> DataFrame:
    """Valid documents only, renumbered from 1 in order of their ids, in one segment."""
    kept = docs.where(model.is_valid(F.col("flags"))).withColumnRenamed("doc_id", "__old")
    return assign_segments(kept, 0, 1, order="__old").select(docs.columns)


def renumbering(docs: DataFrame) -> DataFrame:
    """Columns ``old_id, new_id`` of a compaction."""
    kept = docs.where(model.is_valid(F.col("flags"))).select(F.col("doc_id").alias("old_id"))
    return assign_segments(kept, 0, 1, order="old_id").select("old_id", F.col("doc_id").alias("new_id"))
