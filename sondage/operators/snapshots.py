"""Versioned snapshots of an index on a shared file system.

A full build writes a generation: documents by segment, and postings in parts, each part sorted by term.  A change writes only one
segment and one part more, and a small table of the documents that are gone.  A version is a manifest that names the last
segment and part that count; the pointer file is replaced last, so that readers see the old version or the new one.  A lock
keeps writers apart.
"""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..sources.shared import SharedFolder
from . import index as I
from . import upkeep

POINTER = "CURRENT"
_COLUMNS = [c.split()[0] for c in model.DOCS.split(", ")]
#: Tables of a generation, in parts, and of a version.
PARTS = {
    "grams": "gram int, doc_id bigint, segment_id int",
    "tokens": "token string, doc_id bigint, segment_id int, positions array<int>",
    "frequency": "gram int, df bigint",
}
VERSIONED = {"rejected": "path string, mtime bigint", "tombstones": "doc_id bigint, segment_id int"}


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self.shared = SharedFolder(spark, self.folder)

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """Held by one writer at a time."""
        with self.shared.lock():
            yield

    def version(self) -> int:
        """The current version; 0 if there is none."""
        return int(self.shared.text(POINTER) or 0)

    def meta(self, version: int | None = None) -> dict:
        return json.loads(self.shared.text(f"v{version or self.version()}/meta.json"))

    def _generation(self, meta: dict, table: str) -> str:
        return f"{self.folder}/g{meta['generation']}/{table}"

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version: ``docs``, one of :data:`PARTS` or :data:`VERSIONED`, or ``stops``.

        Postings may hold documents that are gone; ``docs`` has them marked as tombstones.
        """
        version = version or self.version()
        meta = self.meta(version)
        if table in VERSIONED:
            return self.spark.read.schema(VERSIONED[table]).parquet(f"{self.folder}/v{version}/{table}")
        if table == "stops":
            return self.spark.read.schema(PARTS["frequency"]).parquet(self._generation(meta, table))
        if table in PARTS:
            found = self.spark.read.schema(f"{PARTS[table]}, part int").parquet(self._generation(meta, table)).where(F.col("part") <= meta["last_part"]).drop("part")
            return found.groupBy("gram").agg(F.sum("df").alias("df")) if table == "frequency" and meta["last_part"] else found
        docs = self.spark.read.schema(model.DOCS).parquet(self._generation(meta, table)).where(F.col("segment_id") <= meta["last_segment"]).select(_COLUMNS)
        if not meta["tombstone_count"]:
            return docs
        # Few by the rule of compaction; Spark broadcasts them if their files are small enough.
        dead = self.read("tombstones", version).withColumn("__dead", F.lit(model.TOMBSTONE))
        flags = F.col("flags").bitwiseOR(F.coalesce("__dead", F.lit(0)))
        return docs.join(dead, ["segment_id", "doc_id"], "left").withColumn("flags", flags).select(_COLUMNS)

    def postings(self, table: str, version: int | None = None) -> DataFrame:
        """``grams`` or ``tokens`` of the documents that aren't gone."""
        found = self.read(table, version)
        if not self.meta(version)["tombstone_count"]:
            return found
        return found.join(self.read("tombstones", version), ["segment_id", "doc_id"], "left_anti").select(found.columns)

    def _write_part(self, meta: dict, grams: DataFrame, tokens: DataFrame) -> None:
        """Postings clustered by term, so that a lookup reads the row groups whose range holds it."""
        where = lambda t: f"{self._generation(meta, t)}/part={meta['last_part']}"
        write = lambda df, *by: df.repartitionByRange(by[0]).sortWithinPartitions(*by).write.mode("overwrite")
        write(grams, "gram", "segment_id", "doc_id").parquet(where("grams"))
        write(tokens, "token", "segment_id", "doc_id").option("parquet.bloom.filter.enabled#token", "true").parquet(where("tokens"))
        own = self.spark.read.schema(PARTS["grams"]).parquet(where("grams"))
        write(I.document_frequency(own), "gram").parquet(where("frequency"))

    def _publish(self, meta: dict, rejected: DataFrame | None, tombstones: DataFrame | None) -> int:
        version = meta["version"]
        for name, df in (("rejected", rejected), ("tombstones", tombstones)):
            df = self.spark.createDataFrame([], VERSIONED[name]) if df is None else df.select([c.split()[0] for c in VERSIONED[name].split(", ")])
            df.coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        meta["tombstone_count"] = self.spark.read.schema(VERSIONED["tombstones"]).parquet(f"{self.folder}/v{version}/tombstones").count()
        meta["valid_doc_count"] = meta["doc_count"] - meta["tombstone_count"] - meta["stale_count"]
        meta["updated_at"] = int(time.time())
        self.shared.replace(f"v{version}/meta.json", json.dumps(meta))
        self.shared.replace(POINTER, str(version))
        return version

    def commit(self, docs: DataFrame, rejected: DataFrame | None = None, root: str = "", postings: tuple[DataFrame, DataFrame] | None = None) -> int:
        """Write a new generation with all of ``docs`` and make it current; documents that are gone are written and stay so.

        ``postings`` are those of the valid documents (``grams, tokens``) where they are known already.
        """
        version = self.version()
        before = self.meta(version) if version else {}
        meta = {"version": version + 1, "generation": version + 1, "root": root or before.get("root", ""), "last_part": 0, "created_at": before.get("created_at", int(time.time()))}
        docs.select(_COLUMNS).sortWithinPartitions("segment_id", "doc_id").write.mode("overwrite").partitionBy("segment_id").parquet(self._generation(meta, "docs"))
        docs = self.spark.read.schema(model.DOCS).parquet(self._generation(meta, "docs"))
        valid = docs.where(model.is_valid(F.col("flags")))
        self._write_part(meta, *(postings or (I.grams(valid), I.tokens(valid))))
        s = docs.agg(F.count("*").alias("n"), F.count_if(~model.is_valid(F.col("flags"))).alias("gone"), F.max("doc_id").alias("top"), F.sort_array(F.collect_set("segment_id")).alias("segments")).first()
        frequency = self.spark.read.schema(PARTS["frequency"]).parquet(f"{self._generation(meta, 'frequency')}/part=0")
        I.stop_grams(frequency, s["n"] - s["gone"]).write.mode("overwrite").parquet(self._generation(meta, "stops"))
        segments = list(s["segments"])
        meta |= {"doc_count": s["n"], "stale_count": s["gone"], "next_id": (s["top"] or 0) + 1, "segments": segments, "last_segment": max([0, *segments]), "delta_baseline": len(segments)}
        return self._publish(meta, rejected, None)

    def commit_delta(self, gone: DataFrame, fresh: DataFrame, rejected: DataFrame | None = None) -> int:
        """Make current what is left without the paths of ``gone`` and with the files of ``fresh`` (``path, size, mtime, flags, text``).

        Only a segment of the fresh files is written, with its postings; what was written before stays as it is.
        """
        version = self.version()
        meta = self.meta(version)
        docs = self.read("docs", version)
        dead = docs.where(model.is_valid(F.col("flags"))).select("doc_id", "segment_id", "path").join(gone.select("path").distinct(), "path", "left_semi")
        tombstones = self.read("tombstones", version).unionByName(dead.select("doc_id", "segment_id"))
        rejected = self.read("rejected", version) if rejected is None else rejected
        meta |= {"version": version + 1, "last_segment": meta["last_segment"] + 1, "last_part": meta["last_part"] + 1}
        own = f"{self._generation(meta, 'docs')}/segment_id={meta['last_segment']}"
        added = I.assign_segments(fresh.select("path", "size", "mtime", "flags", "text"), 0, meta["next_id"]).withColumn("language", model.language_of(F.col("path")))
        added.select([c for c in _COLUMNS if c != "segment_id"]).write.mode("overwrite").parquet(own)
        added = self.spark.read.schema(model.DOCS).parquet(own).withColumn("segment_id", F.lit(meta["last_segment"]))
        n = added.count()
        self._write_part(meta, I.grams(added), I.tokens(added))
        meta |= {"doc_count": meta["doc_count"] + n, "next_id": meta["next_id"] + n, "segments": meta["segments"] + [meta["last_segment"]] * bool(n)}
        return self._publish(meta, rejected, tombstones)

    def compact(self) -> int:
        """Write the documents that aren't gone as one segment of a new generation; postings are merged, not made anew."""
        docs = self.read("docs")
        ids = upkeep.renumbering(docs).persist()
        try:
            one = F.lit(1).alias("segment_id")
            moved = lambda t: self.postings(t).join(ids, F.col("doc_id") == F.col("old_id")).drop("doc_id", "segment_id", "old_id").withColumnRenamed("new_id", "doc_id").select("*", one)
            grams, tokens = moved("grams").select("gram", "doc_id", "segment_id"), moved("tokens").select("token", "doc_id", "segment_id", "positions")
            return self.commit(upkeep.compacted(docs), self.read("rejected"), postings=(grams, tokens))
        finally:
            ids.unpersist()

    def bytes(self, version: int | None = None) -> int:
        meta = self.meta(version)
        return self.shared.size(f"g{meta['generation']}") + self.shared.size(f"v{meta['version']}")

    def clean(self) -> None:
        """Remove what writers left that didn't finish: versions and generations beyond the current one, and pending files."""
        version = self.version()
        for name in self.shared.names():
            if name.endswith(".tmp") or name[:1] in "vg" and name[1:].isdigit() and int(name[1:]) > version:
                self.shared.delete(name)

    def forget_before(self, version: int) -> None:
        """Remove older versions, which no reader may use any more, and generations that none is left of."""
        kept = [int(p[1:]) for p in self.shared.names() if p[:1] == "v" and p[1:].isdigit() and int(p[1:]) >= version]
        used = {self.meta(v)["generation"] for v in kept if self.shared.exists(f"v{v}/meta.json")}
        for p in self.shared.names():
            if p[1:].isdigit() and (p[0] == "v" and int(p[1:]) < version or p[0] == "g" and int(p[1:]) < version and int(p[1:]) not in used):
                self.shared.delete(p)

    def remove(self) -> None:
        self.shared.delete()


def list_indexes(base: str) -> list[dict]:
    """Metadata of every index under the local folder ``base``, with ``missing`` set where the indexed tree is gone."""
    out = []
    for p in sorted(Path(base).glob(f"*/{POINTER}")):
        meta = json.loads((p.parent / f"v{p.read_text()}" / "meta.json").read_text())
        out.append(meta | {"index": str(p.parent), "missing": not Path(meta["root"]).is_dir()})
    return out
