"""Document frames from tables of texts and from trees of files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as T
from ..functions.patterns import glob_to_regex

EPOCH_2024 = 1704067200
_EXTENSIONS = ("rs", "py", "md", "json", "txt")


def from_documents(documents: DataFrame) -> DataFrame:
    """``docs`` of a table ``doc_id, text, lang, source``: paths, times and segments are derived from the id."""
    key = F.col("doc_id")
    ext = F.element_at(F.array(*(F.lit(e) for e in _EXTENSIONS)), (key % 5 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), key.cast("string"), F.lit("."), ext)
    return documents.select(
        key,
        path.alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.lit(EPOCH_2024) + key % 365 * 86400).cast("bigint").alias("mtime"),
        model.language_of(path).alias("language"),
        F.lit(0).alias("flags"),
        (F.floor(key / model.FILES_PER_SEGMENT) + 1).cast("int").alias("segment_id"),
        F.col("text"),
    )


def ignore_patterns(root: str) -> list[tuple[str, str]]:
    """Lines of the user's ignore files and the tree's own, each with the folder that it is about (relative, "" for all of the tree).

    Files in folders below come after those above, so that the nearest has the last word.
    """
    home = Path.home()
    out: list[tuple[str, str]] = []
    for p in (home / ".gitignore_global", home / ".config/git/ignore", Path(root, ".git/info/exclude")):
        if p.is_file():
            out += [("", line) for line in p.read_text(errors="replace").splitlines()]
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if not d.startswith(".") and d not in model.IGNORED_DIRS)
        if ".gitignore" in names:
            at = os.path.relpath(folder, root)
            out += [("" if at == "." else at, line) for line in Path(folder, ".gitignore").read_text(errors="replace").splitlines()]
    return sorted(out, key=lambda x: x[0].count("/") + bool(x[0]))


def ignored(path: Column, patterns: list[str] | list[tuple[str, str]]) -> Column:
    """Whether the last pattern that a relative path or one of its folders matches excludes it; ``!`` includes again.

    A pattern may come with the folder that it is about.
    """
    out = F.lit(False)
    for raw in patterns:
        base, raw = raw if isinstance(raw, tuple) else ("", raw)
        line = raw.rstrip() if not raw.endswith("\\ ") else raw
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:].removeprefix("\\")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        glob = glob_to_regex(line.lstrip("/") if anchored else line)
        if glob is None or not line:
            continue
        body = glob.removeprefix("(?s)^").removesuffix(r"\z")
        regex = "(?s)^" + (_quoted(base) + "/" if base else "") + ("" if anchored else "(?:.*/)?") + f"(?:{body})" + ("/" if folder else r"(?:/|\z)")
        out = F.when(F.rlike(path, F.lit(regex)), F.lit(not keep)).otherwise(out)
    return out


def is_hidden_or_pruned(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.exists(parts, lambda p: p.startswith(".") | p.isin(*model.IGNORED_DIRS))


def escapes_root(path: Column) -> Column:
    """Whether a relative path is absolute or climbs out of its root."""
    return path.startswith("/") | F.exists(F.split(path, "/", -1), lambda p: p == "..")


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """Those of a tree's files that ``paths`` (column ``path``, relative) names, as :func:`scan_tree` gives them.

    Each is opened by its path, by the executors, so that a few changes don't list the whole tree.
    """
    base = os.path.realpath(root)

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                whole = os.path.join(base, path)
                if os.path.realpath(whole) == whole and os.path.isfile(whole) and 1 <= os.path.getsize(whole) <= model.MAX_FILE_BYTES:
                    data = Path(whole).read_bytes()
                    rows.append((path, int(os.path.getmtime(whole)), len(data), data))
            yield pd.DataFrame(rows, columns=["path", "mtime", "size", "content"])

    named = paths.select("path").distinct().where(~model.extension(F.col("path")).isin(*sorted(model.BINARY_EXTENSIONS)) & ~is_hidden_or_pruned(F.col("path")) & ~escapes_root(F.col("path")))
    return named.mapInPandas(read, "path string, mtime bigint, size bigint, content binary")


def scan_tree(spark: SparkSession, root: str, patterns: list | None = None) -> DataFrame:
    """Regular files of a tree: ``path, mtime, size, content``; binary extensions, hidden and ignored files are left out.

    Sizes are checked before contents are read.  Symbolic links are not followed.
    """
    base = os.path.realpath(root)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace("path", "^file:/*" + _quoted(base) + "/", "")
    found = listed.select(relative.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    links = [os.path.relpath(os.path.join(d, f), base) for d, dirs, names in os.walk(base) for f in [*dirs, *names] if os.path.islink(os.path.join(d, f))]
    found = found.where(F.col("size").between(1, model.MAX_FILE_BYTES) & ~model.extension(F.col("path")).isin(*sorted(model.BINARY_EXTENSIONS)))
    if links:
        found = found.where(~F.col("path").isin(*links))
    patterns = ignore_patterns(root) if patterns is None else patterns
    return found.where(~is_hidden_or_pruned(F.col("path")) & ~ignored(F.col("path"), patterns) & ~escapes_root(F.col("path")))


def _quoted(path: str) -> str:
    return "\\Q" + path.lstrip("/") + "\\E"


def split_rejected(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose content is UTF-8 text, with ``text`` and ``flags``, and the rejected others, with path and time alone."""
    rejected = T.is_binary(F.col("content")) | ~T.is_utf8(F.col("content"))
    good = files.where(~rejected).select(
        "path",
        "mtime",
        "size",
        F.decode("content", "UTF-8").alias("text"),
        F.when(T.is_minified(F.col("content")), model.MINIFIED).otherwise(0).alias("flags"),
    )
    return good, files.where(rejected).select("path", "mtime")


def find_root(start: str, indexed=lambda p: False) -> str:
    """Nearest folder from ``start`` up that holds ``.git``; else the nearest that ``indexed`` accepts; else ``start``."""
    here = Path(start).resolve()
    chain = [here, *here.parents]
    return str(next((p for p in chain if (p / ".git").exists()), next((p for p in chain if indexed(str(p))), here)))
