"""Folders that all executors share: small files, atomic replacement and locks on any file system that Spark reads."""

from __future__ import annotations

import contextlib
import fcntl
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: A lock file of another system than the local one is taken over once it is so old.
LOCK_SECONDS = 6 * 3600


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; local sessions without that setting get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


class SharedFolder:
    """Files of a folder by name, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    @property
    def local(self) -> bool:
        return self._fs.getScheme() == "file"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def size(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def text(self, name: str) -> str | None:
        """Content of a file; None if there is none."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Make ``text`` the content of a file: readers see the old or the new one whole."""
        pending = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._at(pending), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = getattr(self._hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._at(pending), self._at(name), how)

    @contextlib.contextmanager
    def lock(self, wait: float = 600.0) -> Iterator[None]:
        """Held by one writer at a time."""
        self._fs.mkdirs(self._at(""))
        if self.local:
            with open(os.path.join(self.spark._jvm.java.net.URI(self._at("").toUri().toString()).getPath(), "LOCK"), "w") as f:
                fcntl.flock(f, fcntl.LOCK_EX)
                yield
            return
        until = time.time() + wait
        while True:
            try:
                self._fs.create(self._at("LOCK"), False).close()
                break
            except Exception:
                if self.exists("LOCK") and time.time() - self._fs.getFileStatus(self._at("LOCK")).getModificationTime() / 1000 > LOCK_SECONDS:
                    self.delete("LOCK")
                elif time.time() > until:
                    raise
                else:
                    time.sleep(1)
        try:
            yield
        finally:
            self.delete("LOCK")
