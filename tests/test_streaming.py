import datetime
import time

import pytest

from sondage.streaming.changes import WatchConfig, batched, coalesce_pair, coalesced, debounced, flush_windows
from sondage.streaming.watch import coalesced_stream, ignore_filter

C, M, D, R = "Created", "Modified", "Deleted", "Renamed"


def events(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    data = [(p, k, start + datetime.timedelta(milliseconds=ms), n) for n, (p, k, ms) in enumerate(rows)]
    return spark.createDataFrame(data, "path string, kind string, ts timestamp, seq bigint")


@pytest.mark.parametrize(
    ("kinds", "out"),
    [
        ([C, M], C), ([C, D], None), ([M, D], D), ([D, C], M), ([D, M], M), ([C, R], D), ([R, C], C), ([M, M], M), ([C, D, M], M), ([M, C], C), ([C, D, C], C), ([R, R], D),
    ],
)
def test_coalescing(spark, kinds, out):
    have = None
    for k in kinds:
        have = coalesce_pair(have, k)
    assert have == out
    df = coalesced(events(spark, [("p", k, 0) for k in kinds]))
    assert [r["kind"] for r in df.collect()] == ([out] if out else [])


def test_batches_keep_other_rules(spark):
    rows = [("cd", C, 0), ("cd", D, 1), ("cm", C, 0), ("cm", M, 1), ("dc", D, 0), ("dc", C, 1), ("r", R, 0), ("mr", M, 0), ("mr", R, 1), ("md", M, 0), ("md", D, 1)]
    got = {r["path"]: (r["created"], r["modified"], r["deleted"]) for r in batched(events(spark, rows)).collect()}
    assert got == {
        "cd": (False, False, True), "cm": (True, False, False), "dc": (True, False, True),
        "r": (False, False, True), "mr": (False, True, True), "md": (False, False, True),
    }


def test_windows(spark):
    df = events(spark, [("a", C, 0), ("b", C, 400), ("a", M, 899), ("c", C, 2000), ("c", M, 61_000)])
    assert sorted(r["n_events"] for r in debounced(df).collect()) == [1, 1, 3]
    assert sorted((r["n_events"], r["n_paths"]) for r in flush_windows(df).collect()) == [(1, 1), (4, 3)]


def test_folds_equal_those_of_one_path_at_a_time(spark):
    import random

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"p{rng.randrange(30)}", rng.choice([C, M, D, R]), rng.randrange(5000)) for _ in range(600)]
    df = events(spark, rows).repartition(4)
    order = sorted((r["path"], r["ts"], r["seq"], r["kind"]) for r in df.collect())
    pending, lists = {}, {}
    for path, _, _, kind in order:
        pending[path] = coalesce_pair(pending.get(path), kind)
        c, m, d = lists.get(path, (False, False, False))
        lists[path] = (True if kind == C else False if kind == D else c, True if kind == M and not c else False if kind == D else m, d or kind in (D, R))
    assert {r["path"]: r["kind"] for r in coalesced(df).collect()} == {p: k for p, k in pending.items() if k}
    assert {r["path"]: tuple(r)[1:] for r in batched(df).collect()} == {p: x for p, x in lists.items() if any(x)}
    spans, last = [], None
    times = sorted(r["ts"] for r in df.collect())
    for t in times:
        if last is None or t - last >= datetime.timedelta(milliseconds=20):
            spans.append(0)
        spans[-1] += 1
        last = t
    got = sorted((r["start"], r["n_events"]) for r in debounced(df, 20).collect())
    assert [n for _, n in got] == spans and len(spans) > 20 and debounced(df.limit(0)).count() == 0


def test_ignored_paths(spark):
    df = events(spark, [("src/a", C, 0), (".git/x", C, 0), ("a.log", C, 0)])
    assert [r["path"] for r in ignore_filter(df, ["*.log"]).collect()] == ["src/a"]


def test_configuration(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('debounce_ms = 10\ndelta_flush_interval_secs = 5\nmerge_segment_threshold = "x"\n')
    config = WatchConfig.load(str(file), {"SONDAGE_DEBOUNCE_MS": "20", "SONDAGE_REBUILD_THRESHOLD_PERCENT": "no"})
    assert config == WatchConfig(20, 5, 15, 30)
    file.write_text("= broken")
    assert WatchConfig.load(str(file), {}) == WatchConfig()


def test_stateful_stream(spark, tmp_path):
    df = events(spark, [("a", C, 0), ("a", M, 1), ("b", C, 0), ("b", D, 1), ("c", D, 0), ("c", C, 5)])
    source = tmp_path / "in"
    df.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    query = coalesced_stream(stream, 200).writeStream.format("memory").queryName("pending").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("pending").count() < 2:
            time.sleep(0.5)
        assert {tuple(r) for r in spark.table("pending").collect()} == {("a", C), ("c", M)}
    finally:
        query.stop()
