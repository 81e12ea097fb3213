"""The engine: an indexed corpus with search, upkeep and a result cache."""

from __future__ import annotations

import hashlib
import logging
import os
import time
from collections import OrderedDict
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import index as I
from .operators import search as S
from .operators import upkeep
from .operators.snapshots import SnapshotStore, list_indexes
from .plans import narrow
from .plans.parser import build_pattern, parse_query
from .plans.syntax import Query
from .sources import corpus
from .streaming.watch import IndexWatcher, WatchConfig

log = logging.getLogger(__name__)

CACHE_SIZE = 128
#: Languages that figures of an index name; of the others only the number is given.
TOP_LANGUAGES = 15
STALE_SECONDS = 3600
_COLUMNS = [c.split()[0] for c in model.DOCS.split(", ")]


class LruCache:
    """Results by key, the least recently used going first."""

    def __init__(self, size: int = CACHE_SIZE):
        self.size, self.items = size, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key):
        if key in self.items:
            self.hits += 1
            self.items.move_to_end(key)
            return self.items[key]
        self.misses += 1
        return None

    def put(self, key, value: DataFrame) -> DataFrame:
        self.items[key] = value
        while len(self.items) > self.size:
            self.items.popitem(last=False)[1].unpersist()
        return value

    def clear(self) -> None:
        for df in self.items.values():
            df.unpersist()
        self.items.clear()


def index_folder(base: str, root: str) -> str:
    """Folder under ``base`` of the index of ``root``: its name and a hash of its whole path."""
    whole = os.path.realpath(root)
    return str(Path(base) / f"{Path(whole).name}-{hashlib.sha256(whole.encode()).hexdigest()[:16]}")


class Engine:
    """Searches one corpus.

    ``Engine.over(docs)`` searches a frame as it is; ``Engine.open`` and ``Engine.build`` use an index on a shared file system, which
    narrows the documents that are read and never changes a result.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None, store: SnapshotStore | None = None, now=time.time):
        self.spark, self.store, self.now = spark, store, now
        self._docs = docs
        self.version, self.queries, self.started = 0, 0, now()
        self.cache = LruCache()
        self.watcher: IndexWatcher | None = None
        if store is not None:
            self.reload()

    @classmethod
    def over(cls, docs: DataFrame, **options) -> "Engine":
        return cls(docs.sparkSession, docs, **options)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options) -> "Engine":
        return cls(spark, store=SnapshotStore(spark, folder), **options)

    @classmethod
    def build(cls, spark: SparkSession, root: str, folder: str, chunk: int = model.FILES_PER_SEGMENT, force: bool = False, **options) -> "Engine":
        """Index the tree ``root``: in full if there is no index, ``force`` is set or much has changed, else the difference."""
        store = SnapshotStore(spark, folder)
        with store.lock():
            scan = corpus.scan_tree(spark, root)
            store.clean()
            if store.version() == 0 or force or not _update(store, scan):
                good, rejected = corpus.split_rejected(scan)
                docs = I.assign_segments(good, chunk).withColumn("language", model.language_of(F.col("path")))
                store.commit(docs.select(_COLUMNS), rejected, os.path.realpath(root))
        return cls(spark, store=store, **options)

    @property
    def docs(self) -> DataFrame:
        return self._docs

    def reload(self) -> int:
        """Switch to the current version; cached results of another are dropped."""
        version = self.store.version()
        if version != self.version:
            self.version = version
            self.cache.clear()
        if not version:
            raise FileNotFoundError(f"no index in {self.store.folder}")
        self._docs = self.store.read("docs", version)
        age = self.now() - self.store.meta(version)["updated_at"]
        if age > STALE_SECONDS:
            log.warning("the index is %d minutes old", age // 60)
        return version

    def _narrowed(self, query: Query) -> DataFrame:
        if self.store is None:
            return self._docs
        read = lambda t: self.store.read(t, self.version)
        return narrow.narrowed(self._docs, query, read("grams"), read("frequency"), self.store.meta(self.version)["valid_doc_count"], read("stops"), read("tokens"))

    def _cached(self, key: tuple, make) -> DataFrame:
        self.queries += 1
        found = self.cache.get((self.version, *key))
        if found is None:
            found = self.cache.put((self.version, *key), make().persist(StorageLevel.MEMORY_AND_DISK))
        return found

    def search(self, query: str, limit: int = 0, weights: S.Weights = S.Weights()) -> DataFrame:
        """Ranked matches, as many as the query's ``top:`` and then ``limit`` allow; 0 allows all.

        Scores are of the time of asking, to the hour: cached ones are no older.
        """
        parsed, now = parse_query(query), int(self.now())
        found = self._cached(("search", query, weights, now // 3600), lambda: S.ranked(self._docs, parsed, now, weights, self._narrowed(parsed)))
        return found.limit(limit) if limit else found

    def grep(self, pattern: str, limit: int = 0, before: int = 0, after: int = 0, ignore_case: bool = False) -> DataFrame:
        """Matching lines in order of path and line; all of them unless ``limit`` is given."""
        parsed = parse_query(pattern, ignore_case)
        return self._cached(("grep", pattern, before, after, ignore_case, limit), lambda: S.grep(self._narrowed(parsed), parsed, before, after, limit))

    def files(self, pattern: str, limit: int = 0, ignore_case: bool = False) -> DataFrame:
        parsed = parse_query(pattern, ignore_case)
        return self._cached(("files", pattern, ignore_case, limit), lambda: S.files(self._narrowed(parsed), parsed, limit))

    def count(self, pattern: str, ignore_case: bool = False) -> DataFrame:
        parsed = parse_query(pattern, ignore_case)
        return self._cached(("count", pattern, ignore_case), lambda: S.count_by_file(self._narrowed(parsed), parsed))

    def content_search(self, patterns: list[str], word: bool = False, **options) -> DataFrame:
        """:meth:`grep` for command-line patterns."""
        return self.grep(build_pattern(patterns, word), **options)

    def page(self, df: DataFrame, offset: int, limit: int) -> DataFrame:
        return df.offset(offset).limit(limit)

    def preview(self, path: str, line: int, height: int = 20, lead: int = 5) -> DataFrame:
        """``height`` lines of a file from ``lead`` before ``line`` on."""
        from .functions import text as T

        first = max(1, line - lead)
        each = self._docs.where((F.col("path") == path) & model.is_valid(F.col("flags"))).select(F.posexplode(T.lines(F.col("text"))).alias("n", "line"))
        return each.select((F.col("n") + 1).alias("line_number"), "line").where(F.col("line_number").between(first, first + height - 1)).orderBy("line_number")

    def stats(self) -> dict:
        """Corpus figures, the largest languages and the size of the index."""
        out = I.corpus_stats(self._docs).first().asDict()
        counted = I.language_counts(self._docs)
        out["languages"] = {r["language"]: r["n_files"] for r in counted.limit(TOP_LANGUAGES).collect()}
        out["more_languages"] = max(0, counted.count() - TOP_LANGUAGES)
        if self.store is not None:
            out["index_bytes"] = self.store.bytes(self.version)
            out |= self.store.meta(self.version)
        return out

    def status(self) -> dict:
        asked = self.cache.hits + self.cache.misses
        n = self._docs.count()
        return {
            "uptime": int(self.now() - self.started),
            "documents": n,
            "queries": self.queries,
            "cache_hit_rate": self.cache.hits / asked if asked else 0.0,
            "memory_bytes": 100 * n + (1 << 20),
            "watching": self.watcher is not None and self.watcher.status()[0],
        }

    def ping(self) -> str:
        return "pong"

    def compact(self) -> int:
        """Rewrite the valid documents as one segment."""
        with self.store.lock():
            self.store.compact()
        return self.reload()

    def watch(self, events: DataFrame, checkpoint: str, root: str | None = None, config: WatchConfig | None = None, available_now: bool = False):
        """Reconcile with the tree once, then keep applying a stream of change events.

        Events of paths that aren't indexed are dropped, those of a path gathered until it is quiet, and this engine reads each new
        version as soon as it is there.  ``available_now`` applies what the stream has by now, without waiting for quiet.
        """
        root = root or self.store.meta()["root"]
        with self.store.lock():
            _update(self.store, corpus.scan_tree(self.spark, root))
        self.reload()

        def read(paths: DataFrame) -> DataFrame:
            return corpus.split_rejected(corpus.read_files(self.spark, root, paths))[0]

        self.watcher = IndexWatcher(self.store, read, config or WatchConfig.load(), corpus.ignore_patterns(root), self.reload)
        return self.watcher.start(events, checkpoint, available_now)


def _update(store: SnapshotStore, scan: DataFrame) -> bool:
    """Apply what differs between a scan and the index; False if a full build is better."""
    meta, docs, rejected = store.meta(), store.read("docs"), store.read("rejected")
    change = upkeep.difference(scan, docs, rejected).persist()
    try:
        n = change.count()
        if n == 0:
            return True
        if upkeep.should_rebuild(n, meta["valid_doc_count"]):
            return False
        good, binary = corpus.split_rejected(scan.join(change.where("change <> 'deleted'"), "path", "left_semi"))
        known = rejected.join(binary, "path", "left_anti").unionByName(binary)
        store.commit_delta(change.where("change <> 'new'"), good, known)
        now = store.meta()
        if upkeep.should_compact(len(now["segments"]), now["delta_baseline"], now["tombstone_count"], now["doc_count"]):
            store.compact()
        return True
    finally:
        change.unpersist()


__all__ = ["Engine", "LruCache", "index_folder", "list_indexes"]
