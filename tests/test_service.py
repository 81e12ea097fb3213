import io

import pytest

from sondage.engine import Engine
from sondage.service import MAX_FRAME, Service, read_frame, serve, write_frame


@pytest.fixture
def service(make_docs, tmp_path):
    docs = make_docs([("a.rs", "one license\ntwo"), ("b.rs", "LICENSE")])
    for name in ("x", "y"):
        (tmp_path / name / ".git").mkdir(parents=True)
    return Service(lambda root: Engine.over(docs, now=lambda: 1000)), str(tmp_path / "x"), str(tmp_path / "y")


def test_requests(service):
    s, x, y = service
    assert "root_path is needed" in s.handle({"type": "Status", "request_id": "7"} | {"type": "Search", "query": "a"})["message"]
    got = s.handle({"type": "ContentSearch", "pattern": "license", "root_path": x, "limit": 0, "options": {"context_after": 1}, "request_id": "1"})
    assert got["request_id"] == "1" and got["files_with_matches"] == 2 and got["resolved_root"] == x
    assert got["matches"][0] == {"path": "a.rs", "line_number": 1, "line_content": "one license", "match_start": 4, "match_end": 11, "context_before": [], "context_after": [[2, "two"]]}
    first, again = (s.handle({"type": "Search", "query": "license", "limit": 1}) for _ in range(2))
    assert [m["path"] for m in first["matches"]] == ["a.rs"] and not first["cached"] and again["cached"] and again["duration_ms"] > 0
    assert [m["path"] for m in s.handle({"type": "ContentSearch", "pattern": '"LICENSE"', "options": {"files_only": True}})["matches"]] == ["b.rs"]
    assert s.handle({"type": "Status"})["total_docs"] == 2 and s.handle({"type": "Ping"}) == {"type": "Pong"}
    assert s.handle({"type": "WatchStatus"})["watching"] is False and s.handle({"type": "Hello"})["protocol_version"] == 1
    s.engine(y)
    assert "several" in s.handle({"type": "Search", "query": "a"})["message"]
    assert s.handle({"type": "Nonsense"})["type"] == "Error" and s.handle({"type": "Search", "query": "a", "root_path": "/no/such"})["type"] == "Error"


def test_frames(service):
    asked, answered = io.BytesIO(), io.BytesIO()
    for r in ({"type": "Ping", "request_id": "a"}, {"type": "Shutdown"}, {"type": "Ping"}):
        write_frame(asked, r)
    asked.seek(0)
    serve(service[0], asked, answered)
    answered.seek(0)
    assert [read_frame(answered) for _ in range(3)] == [{"type": "Pong", "request_id": "a"}, {"type": "ShuttingDown"}, None]
    for bad in (b"\x01", (MAX_FRAME + 1).to_bytes(4, "little"), b"\x05\x00\x00\x00{}"):
        with pytest.raises(ValueError):
            read_frame(io.BytesIO(bad))
