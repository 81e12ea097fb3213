"""Change events and what they come to: debounced per path, gathered into batches, flushed in windows.

Events are rows ``path, kind, ts, seq``; ``kind`` is Created, Modified, Deleted or Renamed, and ``ts, seq`` is their order.
The batch forms fold each path's events in order; the streaming form keeps the same fold as state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("Created", "Modified", "Deleted", "Renamed")


def coalesce_pair(have: str | None, kind: str) -> str | None:
    """State of a path with pending state ``have`` after an event of ``kind``; None means that nothing is pending."""
    if have is None:
        return kind
    if (have, kind) == ("Created", "Deleted"):
        return None
    if kind == "Renamed":
        return "Deleted"
    if (have, kind) == ("Created", "Modified"):
        return "Created"
    if have == "Deleted" and kind in ("Created", "Modified"):
        return "Modified"
    return kind


def batch_step(lists: tuple[bool, bool, bool], kind: str) -> tuple[bool, bool, bool]:
    """Lists (created, modified, deleted) that a path is in after an event of ``kind``."""
    created, modified, deleted = lists
    return (
        kind == "Created" or kind != "Deleted" and created,
        kind == "Modified" and not created or kind != "Deleted" and modified,
        deleted or kind in ("Deleted", "Renamed"),
    )


def _folded(events: DataFrame, by: tuple[str, ...], states: list, step: Callable) -> DataFrame:
    """Columns ``*by, path, state``: place in ``states`` to which each path's events lead, in order, from the first.

    An event is a map of states to states, and so is a run of events.  Runs are made within ranges of path and time, so that a path
    with very many events is spread over several; only the runs, a few numbers each, are gathered by path.
    """
    n = len(states)
    table = F.lit([states.index(step(s, k)) for k in KINDS for s in states])
    after = lambda s, k: F.element_at(table, (k * n + s + 1).cast("int"))
    kind = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1
    known = events.where(F.col("kind").isin(*KINDS)).select(*by, "path", "ts", "seq", kind.alias("kind"))
    placed = known.repartitionByRange(*by, "path", "ts", "seq").withColumn("run", F.spark_partition_id())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "kind"))), lambda e: e["kind"])
    runs = placed.groupBy(*by, "path", "run").agg(ordered.alias("kinds"))
    maps = runs.select(*by, "path", "run", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.aggregate("kinds", s, after)).alias("map"))
    whole = maps.groupBy(*by, "path").agg(F.array_sort(F.collect_list(F.struct("run", "map"))).alias("maps"))
    return whole.select(*by, "path", F.aggregate("maps", F.lit(0), lambda s, m: F.element_at(m["map"], s + 1)).alias("state"))


def coalesced(events: DataFrame, *by: str) -> DataFrame:
    """Columns ``path, kind`` (after those of ``by``): what is pending of each path once its events are folded; none if they cancel.

    Events of other kinds than :data:`KINDS` don't count.
    """
    states = [None, *KINDS]
    kind = F.element_at(F.lit(list(KINDS)), F.col("state"))
    return _folded(events, by, states, coalesce_pair).where("state > 0").select(*by, "path", kind.alias("kind"))


def batched(events: DataFrame, *by: str) -> DataFrame:
    """Columns ``path, created, modified, deleted`` (after those of ``by``): which lists of a batch a path ends up in.

    Unlike :func:`coalesced`, a deletion stays even of a path created before, a modification after a creation adds nothing, a
    rename deletes without taking the path from the other lists, and a creation after a deletion leaves both.
    """
    states = [(c, m, d) for c in (False, True) for m in (False, True) for d in (False, True)]
    has = lambda bit: (F.col("state").bitwiseAND(bit) != 0)
    lists = has(4).alias("created"), has(2).alias("modified"), has(1).alias("deleted")
    return _folded(events, by, states, batch_step).where("state > 0").select(*by, "path", *lists)


def debounced(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """Columns ``start, end, n_events``: spans of events of any path that are followed by ``quiet_ms`` without one.

    Spans are global, but no task sees all events: equal times are counted first, gaps are looked for within ranges of time, and only the
    first and last time of each range and its number of gaps are laid side by side.
    """
    quiet = F.expr(f"INTERVAL {quiet_ms / 1000:.3f} SECOND")
    times = events.where(F.col("ts").isNotNull()).groupBy("ts").agg(F.count("*").alias("n"))
    placed = times.repartitionByRange("ts").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy("ts")
    before = F.lag("ts").over(inner)
    placed = placed.withColumn("gap", F.when(before.isNotNull() & (F.col("ts") >= before + quiet), 1).otherwise(0)).withColumn("within", F.sum("gap").over(inner))
    parts = placed.groupBy("part").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("within").alias("gaps"))
    order = Window.orderBy("first")
    opens = F.when(F.lag("last").over(order).isNull() | (F.col("first") >= F.lag("last").over(order) + quiet), 1).otherwise(0)
    # A span's number: the gaps of the ranges before, and the borders between ranges that are gaps, up to here.
    parts = parts.withColumn("opens", opens).select("part", (F.sum(F.col("gaps") + F.col("opens")).over(order) - F.col("gaps")).alias("base"))
    spans = placed.join(F.broadcast(parts), "part").groupBy((F.col("base") + F.col("within")).alias("span"))
    return spans.agg(F.min("ts").alias("start"), (F.max("ts") + quiet).alias("end"), F.sum("n").alias("n_events")).drop("span")


def flush_windows(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Columns ``start, n_events, n_paths`` of tumbling flush windows."""
    window = F.window("ts", f"{seconds} seconds")
    return events.groupBy(window).agg(F.count("*").alias("n_events"), F.countDistinct("path").alias("n_paths")).select("window.start", "n_events", "n_paths")


@dataclass(frozen=True)
class WatchConfig:
    """Timings and thresholds; :meth:`load` takes the environment before a TOML file before these."""

    debounce_ms: int = 500
    delta_flush_interval_secs: int = 60
    merge_segment_threshold: int = 15
    rebuild_threshold_percent: int = 30

    @classmethod
    def load(cls, file: str | None = None, environ: dict[str, str] | None = None, prefix: str = "SONDAGE_") -> "WatchConfig":
        import os
        import tomllib

        values: dict[str, int] = {}
        if file and os.path.exists(file):
            try:
                with open(file, "rb") as f:
                    values |= {k: v for k, v in tomllib.load(f).items() if k in cls.__dataclass_fields__ and type(v) is int and v >= 0}
            except tomllib.TOMLDecodeError:
                pass
        env = os.environ if environ is None else environ
        for k in cls.__dataclass_fields__:
            if (v := env.get(prefix + k.upper(), "")).isdigit():
                values[k] = int(v)
        return cls(**values)
