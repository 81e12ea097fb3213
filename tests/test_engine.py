"""Trees of files, snapshots, the engine and the command line."""

import io
import os

import pytest
from pyspark.sql import functions as F

from sondage import output
from sondage.cli import main
from sondage.engine import Engine, LruCache, index_folder, list_indexes
from sondage.operators.snapshots import SnapshotStore
from sondage.plans.parser import parse_query
from sondage.sources import corpus


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {
        "src/main.rs": b"fn main() {\n  license();\n}\n", "src/lib.rs": b"// License here\nlicense again\n", "a b+c%41.txt": b"odd name license\n",
        ".hidden/x.rs": b"license", "node_modules/y.js": b"license", "skip.log": b"license", "pic.png": b"license", "bin.dat": b"\x00\x01license",
        "latin.txt": b"license \xe9\xe8", "empty.md": b"", ".gitignore": b"*.log\n",
    }
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink(root / "src/main.rs", root / "src/link.rs")
    return root


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_scan(spark, tree):
    scan = corpus.scan_tree(spark, str(tree), [*(tree / ".gitignore").read_text().splitlines()])
    assert paths(scan) == ["a b+c%41.txt", "bin.dat", "latin.txt", "src/lib.rs", "src/main.rs"]
    good, rejected = corpus.split_rejected(scan)
    assert paths(good) == ["a b+c%41.txt", "src/lib.rs", "src/main.rs"] and paths(rejected) == ["bin.dat", "latin.txt"]


def test_find_root(tmp_path):
    (tmp_path / "r/.git").mkdir(parents=True)
    (tmp_path / "r/x/y").mkdir(parents=True)
    assert corpus.find_root(str(tmp_path / "r/x/y")) == str((tmp_path / "r").resolve())
    assert corpus.find_root(str(tmp_path), lambda p: p == str(tmp_path.resolve())) == str(tmp_path.resolve())


def test_life_of_an_index(spark, tree, tmp_path):
    folder = index_folder(str(tmp_path / "base"), str(tree))
    engine = Engine.build(spark, str(tree), folder)
    assert engine.version == 1 and paths(engine.files("license")) == ["a b+c%41.txt", "src/lib.rs", "src/main.rs"]
    assert engine.store.meta()["segments"] == [1] and engine.stats()["languages"] == {"Rust": 2, "Unknown": 1}
    # Nothing changed: no new version.  The rejected file is remembered.
    assert Engine.build(spark, str(tree), folder).version == 1
    assert paths(engine.store.read("rejected")) == ["bin.dat", "latin.txt"]
    # A file of three is over the rebuild threshold; the engine sees it after a reload.
    (tree / "src/new.rs").write_text("new license\n")
    assert Engine.build(spark, str(tree), folder).version == 2
    assert len(paths(engine.files("license"))) == 3
    engine.reload()
    assert len(paths(engine.files("license"))) == 4
    assert [x["missing"] for x in list_indexes(str(tmp_path / "base"))] == [False]
    assert engine.compact() == 3 and len(paths(engine.files("license"))) == 4
    engine.store.forget_before(3)
    assert len(paths(Engine.open(spark, folder).files("license"))) == 4


def test_small_change_makes_a_delta(spark, tree, tmp_path):
    for k in range(12):
        (tree / f"pad{k}.txt").write_text(f"padding {k}\n")
    folder = str(tmp_path / "i")
    Engine.build(spark, str(tree), folder)
    (tree / "pad3.txt").write_text("changed needle\n")
    os.utime(tree / "pad3.txt", (1, 1))
    (tree / "pad4.txt").unlink()
    engine = Engine.build(spark, str(tree), folder)
    meta = engine.store.meta()
    assert meta["segments"] == [1, 2] and meta["tombstone_count"] == 2 and meta["valid_doc_count"] == 14
    assert paths(engine.files("padding")) == sorted(f"pad{k}.txt" for k in range(12) if k not in (3, 4)) and paths(engine.files("needle")) == ["pad3.txt"]


def files_of(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*") if p.is_file()}


def test_a_delta_writes_its_own_segment_alone(make_docs, spark, tmp_path):
    docs = make_docs([(f"f{k}.rs", f"common word{k}") for k in range(20)]).withColumn("segment_id", (F.col("doc_id") / 5).cast("int") + 1)
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.commit(docs)
    before = files_of(tmp_path / "s")
    fresh = spark.createDataFrame([("f3.rs", 9, 5, 0, "common changed"), ("new.rs", 8, 5, 0, "brand common")], "path string, size bigint, mtime bigint, flags int, text string")
    gone = spark.createDataFrame([("f3.rs",), ("f4.rs",), ("none",)], "path string")
    assert store.commit_delta(gone, fresh) == 2
    after = files_of(tmp_path / "s")
    assert {p: t for p, t in after.items() if p in before and "CURRENT" not in p.name} == {p: t for p, t in before.items() if "CURRENT" not in p.name}
    assert {p.parts[1] + "/" + p.parts[2] for p in after if p not in before and p.parts[0] == "g1"} == {"docs/segment_id=6", "grams/part=1", "tokens/part=1", "frequency/part=1"}
    meta = store.meta()
    assert meta["segments"] == [1, 2, 3, 4, 5, 6] and (meta["doc_count"], meta["valid_doc_count"], meta["tombstone_count"], meta["next_id"]) == (22, 20, 2, 23)
    # A reader of the old version still sees it whole.
    assert store.read("docs", 1).where("flags = 0").count() == 20 and store.read("docs", 2).where("flags = 0").count() == 20
    live = {r["path"]: r["doc_id"] for r in store.read("docs").where("flags = 0").collect()}
    assert "f4.rs" not in live and live["f3.rs"] == 21 and live["new.rs"] == 22
    tokens = lambda: {(r["token"], r["doc_id"]) for r in store.postings("tokens").collect()}
    assert {i for t, i in tokens() if t == "common"} == set(live.values()) and ("word3", 4) not in tokens()
    assert store.read("frequency").where("gram = 6516589").first()["df"] == 22  # "com" of old and new parts
    # Merging gives the postings that a build from the same documents gives.
    store.compact()
    merged = {t: sorted(map(repr, store.read(t).collect())) for t in ("grams", "tokens", "frequency")}
    other = SnapshotStore(spark, str(tmp_path / "o"))
    other.commit(store.read("docs"))
    assert merged == {t: sorted(map(repr, other.read(t).collect())) for t in merged}
    assert store.meta()["segments"] == [1] and store.meta()["tombstone_count"] == 0
    store.forget_before(3)
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["g3", "v3"]
    (tmp_path / "s/v9").mkdir()
    store.clean()
    assert not (tmp_path / "s/v9").exists() and store.read("docs").count() == 20


def test_the_index_saves_reading(make_docs, spark, tmp_path):
    docs = make_docs([(f"f{k}.rs", f"common word{k} in {'needle' if k in (3, 4) else 'hay'}") for k in range(40)]).withColumn("segment_id", (F.col("doc_id") / 4).cast("int"))
    SnapshotStore(spark, str(tmp_path / "s")).commit(docs)
    engine = Engine.open(spark, str(tmp_path / "s"))
    found = engine._narrowed(parse_query("needle"))
    scan = found.select("text")
    assert sorted(r["path"] for r in engine.grep("needle").collect()) == ["f3.rs", "f4.rs"]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "segment_id" in plan.split("PartitionFilters: ")[1].split("]")[0]
    read = {f.split("segment_id=")[1].split("/")[0] for f in engine._docs.where(F.col("segment_id").isin(1)).inputFiles()}
    assert "1" in read
    numbers = {int(r[0]) for r in found.select("segment_id").distinct().collect()}
    assert numbers == {1}
    # Ranked search reads as little, and still finds names in all.
    assert [r["path"] for r in engine.search("needle").collect()] == ["f3.rs", "f4.rs"]
    assert [r["path"] for r in engine.search("f7").collect()] == ["f7.rs"]


def test_watching_waits_for_quiet_and_loses_nothing(spark, tree, tmp_path):
    import time

    from test_streaming import events

    from sondage.streaming.changes import WatchConfig

    for k in range(12):
        (tree / f"pad{k}.txt").write_text(f"padding {k}\n")
    engine = Engine.build(spark, str(tree), str(tmp_path / "i"))
    assert engine.files("needle").count() == 0
    (tree / "pad1.txt").write_text("needle one\n")
    source = tmp_path / "events"
    first = events(spark, [("pad1.txt", "Modified", 0), ("pad1.txt", "Modified", 3), ("skip.log", "Modified", 0), (".hidden/x.rs", "Created", 0)])
    first.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(first.schema).parquet(str(source))
    engine.watch(stream, str(tmp_path / "ck"), config=WatchConfig(debounce_ms=300, delta_flush_interval_secs=1))
    try:
        end = time.time() + 120
        while time.time() < end and engine.version < 2:
            time.sleep(0.5)
        # This engine reads the new version by itself.
        assert paths(engine.files("needle")) == ["pad1.txt"] and engine.status()["watching"]
    finally:
        engine.watcher.stop()
    # What still waits for quiet when the stream ends is applied.
    (tree / "pad2.txt").write_text("needle two\n")
    second = events(spark, [("pad2.txt", "Modified", 0)])
    second.coalesce(1).write.mode("append").parquet(str(source))
    engine.watch(spark.readStream.schema(first.schema).parquet(str(source)), str(tmp_path / "ck2"), config=WatchConfig(debounce_ms=3_600_000, delta_flush_interval_secs=1))
    end = time.time() + 120
    while time.time() < end and engine.watcher.status()[1] == 0:
        time.sleep(0.5)
    assert engine.watcher.status()[1] > 0
    engine.watcher.stop()
    assert paths(engine.files("needle")) == ["pad1.txt", "pad2.txt"]


def test_ignore_files_in_folders_below(spark, tree):
    (tree / "src/.gitignore").write_text("*.rs\n!main.rs\n/deep/only.txt\n")
    for name in ("src/deep/only.txt", "src/x/deep/only.txt", "other.rs"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("text")
    assert paths(corpus.scan_tree(spark, str(tree))) == ["a b+c%41.txt", "bin.dat", "latin.txt", "other.rs", "src/main.rs", "src/x/deep/only.txt"]


def test_watching(spark, tree, tmp_path):
    from test_streaming import events

    for k in range(12):
        (tree / f"pad{k}.txt").write_text(f"padding {k}\n")
    engine = Engine.build(spark, str(tree), str(tmp_path / "i"))
    (tree / "pad1.txt").write_text("needle one\n")
    os.utime(tree / "pad1.txt", (1, 1))
    (tree / "pad2.txt").unlink()
    changes = events(spark, [("pad1.txt", "Modified", 0), ("pad2.txt", "Deleted", 1)])
    changes.write.parquet(str(tmp_path / "events"))
    engine.store.lock()
    query = engine.watch(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "events")), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None
    engine.reload()
    assert paths(engine.files("needle")) == ["pad1.txt"] and "pad2.txt" not in paths(engine.files("padding"))
    assert engine.watcher.status()[0] is False and engine.status()["documents"] >= 14


def test_cache_and_status(make_docs):
    engine = Engine.over(make_docs([("a.rs", "x license")]), now=lambda: 1000)
    assert engine.grep("license").count() == 1 and engine.grep("license").count() == 1
    assert engine.status() | {"uptime": 0} == {"uptime": 0, "documents": 1, "queries": 2, "cache_hit_rate": 0.5, "memory_bytes": 100 + (1 << 20), "watching": False}
    assert engine.search("license", limit=1).count() == 1 and engine.content_search(["license"], word=True).count() == 1
    assert [r["line"] for r in engine.preview("a.rs", 1).collect()] == ["x license"] and engine.ping() == "pong"
    cache = LruCache(1)

    class Frame:
        def unpersist(self):
            self.gone = True

    one, two = Frame(), Frame()
    cache.put("a", one)
    cache.put("b", two)
    assert one.gone and cache.get("a") is None and cache.get("b") is two


def test_output(make_docs):
    docs = make_docs([("a.rs", "one\nhit a\nthree\nfour\nfive\nhit b"), ("b.rs", "hit c")])
    engine = Engine.over(docs)
    rows = engine.grep("hit", before=1, after=1).collect()
    assert output.content(rows) == "a.rs\n1-one\n2:hit a\n3-three\n--\n5-five\n6:hit b\n\nb.rs\n1:hit c\n"
    assert output.content(rows[:1]) == "a.rs-1-one\na.rs:2:hit a\na.rs-3-three\n" and output.content([]) == ""
    assert output.highlight("añb", 1, 3, True) == "a\x1b[1;31mñ\x1b[0mb" and output.highlight("ab", 5, 9, True) == "ab"
    assert output.file_list(rows) == "a.rs\nb.rs\n" and output.counts(engine.count("hit").collect()) == "a.rs:2\nb.rs:1\n"
    assert output.expand_tabs("a\tb") == "a   b"


def test_command_line(spark, tree, tmp_path, capsys):
    base = ["--base", str(tmp_path / "base")]
    (tree / ".git").mkdir()

    def run(*args):
        out = io.StringIO()
        code = main([*base, *args], spark, out)
        return code, out.getvalue()

    where = ["-p", str(tree)]
    assert run("index", str(tree)) == (0, "3 files\n")
    assert run("grep", "again", *where) == (0, "src/lib.rs:2:license again\n")
    assert run("grep", "-l", "license", *where)[1].splitlines() == ["a b+c%41.txt", "src/lib.rs", "src/main.rs"]
    assert run("grep", "-c", "license", *where)[1] == "a b+c%41.txt:1\nsrc/lib.rs:2\nsrc/main.rs:1\n"
    assert run("grep", '"license here"', "-i", "-C", "1", *where)[1] == "src/lib.rs:1:// License here\nsrc/lib.rs-2-license again\n"
    assert run("grep", "-e", "again", "-e", "odd", "-m", "1", *where)[1] == "a b+c%41.txt:1:odd name license\n"
    assert run("grep", "-w", "lic", *where) == (1, "") and run("grep", "-v", "x", *where)[0] == 2
    assert run("search", "main", *where)[1].startswith("src/main.rs:1\t")
    assert run("list")[1].endswith("\t3 files\n") and '"n_docs": 3' in run("stats", str(tree))[1]
    assert run("compact", str(tree))[0] == 0 and run("remove", str(tree))[0] == 0 and run("list")[1] == ""
