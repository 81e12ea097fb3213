"""Refreshing an index from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import model
from ..operators import upkeep
from ..operators.index import assign_segments
from ..operators.snapshots import SnapshotStore
from ..sources import corpus
from .changes import WatchConfig, batched, coalesce_pair


def ignore_filter(events: DataFrame, patterns: list[str]) -> DataFrame:
    """Events of paths that are indexed at all."""
    return events.where(~corpus.is_hidden_or_pruned(F.col("path")) & ~corpus.ignored(F.col("path"), patterns))


def coalesced_stream(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """Streaming twin of the debouncing fold: each path's pending kind, sent once it has been quiet for ``quiet_ms``."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if have is not None:
                yield pd.DataFrame({"path": [key[0]], "kind": [have]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for kind in rows["kind"]:
            have = coalesce_pair(have, kind)
        state.update((have,))
        state.setTimeoutDuration(quiet_ms)
        yield from ()

    return events.groupBy("path").applyInPandasWithState(fold, "path string, kind string", "kind string", "append", GroupStateTimeout.ProcessingTimeTimeout)


class IndexWatcher:
    """Applies micro-batches of change events to a snapshot store.

    ``read`` gives the current files of a list of paths (``path, size, mtime, flags, text``) as a frame; deleted paths are absent.
    ``patterns`` are those of the ignore files; ``applied`` is called after each new version.
    """

    def __init__(self, store: SnapshotStore, read: Callable[[DataFrame], DataFrame], config: WatchConfig = WatchConfig(), patterns: list | None = None, applied: Callable[[], object] | None = None):
        self.store, self.read, self.config, self.patterns, self.applied = store, read, config, patterns or [], applied
        self.query, self.checkpoint = None, None

    def flush(self, events: DataFrame, batch_id: int = 0) -> int:
        """Apply one batch, by a delta or, if it is large, a rebuild; gives the version that is then current."""
        lists = batched(ignore_filter(events, self.patterns)).persist()
        try:
            touched = lists.count()
            if not touched:
                return self.store.version()
            with self.store.lock():
                version = self._apply(lists, touched)
        finally:
            lists.unpersist()
        if self.applied is not None:
            self.applied()
        return version

    def _apply(self, lists: DataFrame, touched: int) -> int:
        meta = self.store.meta()
        fresh = self.read(lists.where("created or modified").select("path")).select("path", "size", "mtime", "flags", "text")
        gone = lists.select("path")
        if upkeep.should_rebuild(touched, meta["valid_doc_count"], self.config.rebuild_threshold_percent):
            docs = self.store.read("docs")
            kept = docs.where(model.is_valid(F.col("flags"))).join(gone, "path", "left_anti").select(fresh.columns)
            rebuilt = assign_segments(kept.unionByName(fresh))
            return self.store.commit(rebuilt.withColumn("language", model.language_of(F.col("path"))), self.store.read("rejected"))
        version = self.store.commit_delta(gone, fresh)
        now = self.store.meta()
        if upkeep.should_compact(len(now["segments"]), now["delta_baseline"], now["tombstone_count"], now["doc_count"], self.config.merge_segment_threshold):
            version = self.store.compact()
        return version

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False):
        """Run :meth:`flush` on a stream of events every flush interval, once each path has been quiet; or once over what is there."""
        self.checkpoint = checkpoint
        if available_now:
            stream, interval = events, {"availableNow": True}
        else:
            quiet = coalesced_stream(ignore_filter(events, self.patterns), self.config.debounce_ms)
            # One event a path, so that there is no order among them.
            stream = quiet.withColumn("ts", F.lit(0).cast("timestamp")).withColumn("seq", F.lit(0).cast("bigint"))
            interval = {"processingTime": f"{self.config.delta_flush_interval_secs} seconds"}
        writer = stream.writeStream.foreachBatch(lambda df, i: self.flush(df, i) and None).option("checkpointLocation", checkpoint)
        self.query = writer.trigger(**interval).start()
        return self.query

    def pending(self) -> DataFrame | None:
        """Events (``path, kind``) that wait for quiet, from the stream's state; None if it keeps none."""
        if self.query is None or not (self.query.lastProgress or {}).get("stateOperators"):
            return None
        state = self.store.spark.read.format("statestore").load(self.checkpoint)
        return state.select(F.col("key.path").alias("path"), F.col("value.groupState.kind").alias("kind")).where("kind is not null")

    def status(self) -> tuple[bool, int]:
        """Whether the stream runs, and how many paths wait for quiet or, if it keeps no state, came with the last micro-batch."""
        running = self.query is not None and self.query.isActive
        last = self.query.lastProgress if self.query is not None else None
        if not last:
            return running, 0
        operators = last["stateOperators"]
        return running, int(operators[0]["numRowsTotal"] if operators else last["numInputRows"])

    def stop(self) -> None:
        """End the stream; what still waits for quiet is applied, so that nothing that was seen is lost."""
        if self.query is None:
            return
        self.query.stop()
        waiting = self.pending()
        if waiting is not None:
            self.flush(waiting.withColumn("ts", F.lit(0).cast("timestamp")).withColumn("seq", F.lit(0).cast("bigint")))
