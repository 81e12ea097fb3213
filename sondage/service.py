"""Requests and responses as dictionaries over several engines, and their framing as JSON.

A request is ``{"type": ..., "request_id": ...}`` with the fields of its kind; the response repeats the id.  Any transport will do: a
stream of frames is served by :func:`serve`.
"""

from __future__ import annotations

import json
import os
import struct
import time
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import DataFrame, Row

from . import __version__
from .engine import Engine
from .sources.corpus import find_root

PROTOCOL_VERSION = 1
#: Rows that a response holds at most, as it is one message; ``truncated`` says whether there are more.
MAX_ROWS = 100_000
MAX_FRAME = 100 << 20


class Service:
    """Engines by the root of their tree, opened when they are first asked for."""

    def __init__(self, open_engine: Callable[[str], Engine]):
        self.open_engine, self.engines, self.stopping = open_engine, {}, False
        self.started = time.time()

    def resolve(self, root: str | None) -> str:
        """Root that a request is about: that of its path, or the only one that is open."""
        if root is not None:
            if not os.path.exists(root):
                raise ValueError(f"there is no {root}")
            return find_root(root, lambda p: p in self.engines)
        if len(self.engines) == 1:
            return next(iter(self.engines))
        if not self.engines:
            raise ValueError("root_path is needed, as no index is open")
        raise ValueError("root_path is needed, as several indexes are open: " + ", ".join(sorted(self.engines)))

    def engine(self, root: str | None) -> tuple[str, Engine]:
        where = self.resolve(root)
        if where not in self.engines:
            self.engines[where] = self.open_engine(where)
        return where, self.engines[where]

    def handle(self, request: dict) -> dict:
        """Response to a request; whatever goes wrong makes an ``Error``."""
        try:
            act = getattr(self, f"_{str(request.get('type', '')).lower()}", None)
            began = time.perf_counter()
            out = act(request) if act else {"type": "Error", "message": f"unknown request {request.get('type')!r}"}
            if "matches" in out:
                out["duration_ms"] = round((time.perf_counter() - began) * 1000, 3)
        except Exception as e:  # a bad request must not end the service
            out = {"type": "Error", "message": str(e)}
        return out | ({"request_id": request["request_id"]} if request.get("request_id") is not None else {})

    def _search(self, r: dict) -> dict:
        root, engine = self.engine(r.get("root_path"))
        hits = engine.cache.hits
        rows, more = _rows(engine.search(r["query"], int(r.get("limit", 0))))
        return {"type": "Search", "cached": engine.cache.hits > hits, "truncated": more, "matches": [{"path": x["path"], "line_number": x["line_number"], "score": x["score"]} for x in rows], "resolved_root": root}

    def _contentsearch(self, r: dict) -> dict:
        root, engine = self.engine(r.get("root_path"))
        options, limit = r.get("options") or {}, int(r.get("limit", 0))
        fold = bool(options.get("case_insensitive", False))
        if options.get("files_only"):
            rows, more = _rows(engine.files(r["pattern"], limit, fold))
            matches = [{"path": x["path"], "line_number": 1, "line_content": "", "match_start": 0, "match_end": 0, "context_before": [], "context_after": []} for x in rows]
        else:
            rows, more = _rows(engine.grep(r["pattern"], limit, int(options.get("context_before", 0)), int(options.get("context_after", 0)), fold))
            around = lambda x, c: [[y["line_number"], y["line"]] for y in x[c] or []] if c in x else []
            matches = [
                {"path": x["path"], "line_number": x["line_number"], "line_content": x["line"], "match_start": x["match_start"], "match_end": x["match_end"]}
                | {c: around(x, c) for c in ("context_before", "context_after")}
                for x in rows
            ]
        return {"type": "ContentSearch", "matches": matches, "files_with_matches": len({m["path"] for m in matches}), "truncated": more, "resolved_root": root}

    def _status(self, r: dict) -> dict:
        each = [e.status() for e in self.engines.values()]
        named = {"documents": "total_docs", "queries": "queries_served", "memory_bytes": "memory_bytes"}
        hits, asked = sum(e.cache.hits for e in self.engines.values()), sum(e.cache.hits + e.cache.misses for e in self.engines.values())
        return {
            "type": "Status",
            "uptime_secs": int(time.time() - self.started),
            "indexes_loaded": len(each),
            "loaded_roots": sorted(self.engines),
            "cache_hit_rate": hits / asked if asked else 0.0,
            "protocol_version": PROTOCOL_VERSION,
            "server_version": __version__,
        } | {name: sum(s[k] for s in each) for k, name in named.items()}

    def _reload(self, r: dict) -> dict:
        root, engine = self.engine(r.get("root_path"))
        return {"type": "Reloaded", "success": True, "message": f"version {engine.reload()}", "resolved_root": root}

    def _watchstatus(self, r: dict) -> dict:
        root, engine = self.engine(r.get("root_path"))
        watching, pending = engine.watcher.status() if engine.watcher else (False, 0)
        return {"type": "WatchStatus", "watching": watching, "pending_changes": pending, "resolved_root": root}

    def _ping(self, r: dict) -> dict:
        return {"type": "Pong"}

    def _hello(self, r: dict) -> dict:
        return {"type": "Hello", "protocol_version": PROTOCOL_VERSION, "server_version": __version__}

    def _shutdown(self, r: dict) -> dict:
        self.stopping = True
        return {"type": "ShuttingDown"}


def _rows(df: DataFrame) -> tuple[list[Row], bool]:
    rows = df.limit(MAX_ROWS + 1).collect()
    return rows[:MAX_ROWS], len(rows) > MAX_ROWS


def write_frame(out: BinaryIO, message: dict) -> None:
    """Length as four bytes, the lowest first, then the message as JSON."""
    body = json.dumps(message).encode()
    out.write(struct.pack("<I", len(body)) + body)
    out.flush()


def read_frame(source: BinaryIO) -> dict | None:
    """The next message; None at the end of the stream."""
    head = source.read(4)
    if not head:
        return None
    (size,) = struct.unpack("<I", head) if len(head) == 4 else (MAX_FRAME + 1,)
    if size > MAX_FRAME:
        raise ValueError("the frame is broken or too large")
    body = source.read(size)
    if len(body) < size:
        raise ValueError("the frame ends early")
    return json.loads(body)


def serve(service: Service, source: BinaryIO, out: BinaryIO) -> None:
    """Answer frames in order until the stream ends or a shutdown is asked for."""
    while not service.stopping and (request := read_frame(source)) is not None:
        write_frame(out, service.handle(request))
