import datetime
import json
import time

from helpers import rows
from pyspark.sql import functions as F

from engrama.operators import facade
from engrama.schemas import SCHEMAS
from engrama.sources import crawl
from engrama.sources.snapshots import SnapshotStore
from engrama.streaming import watch

NOW = F.lit(datetime.datetime(2024, 1, 1))


def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "src/a.py": "import os\n\ndef func_a():\n    return 1\n", "src/b.py": "from src.a import func_a\n\nclass K:\n    def method_b(self):\n        return func_a()\n", "README.md": "# Title\ntext\n", "conf.json": '{"key": 1}',
        "node_modules/x.js": "var x", "src/a.pyc": "x", ".hidden/y.py": "x = 1", "empty.py": "", ".env": "S=1", "notes.txt": "n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_crawl_filters_hashes_and_classifies(spark, tmp_path):
    root = tree(tmp_path)
    files, gone, report = crawl.crawl(spark, str(root), "p", spark.createDataFrame([], SCHEMAS["nodes"]))
    assert rows(files, "relative_path", "category") == [("README.md", "doc"), ("conf.json", "config"), ("src/a.py", "code"), ("src/b.py", "code")]
    r = report.first()
    assert (r.scanned, r.new, r.unchanged, r.code) == (4, 4, 0, 2) and gone.count() == 0
    names = spark.createDataFrame([(x,) for x in ("a.PY", "b.tsx", "c.md", "d.yml", "e.log", "f", ".bashrc", "g.xyz")], "p string")
    assert [r.c for r in names.select(crawl.category(F.col("p")).alias("c")).collect()] == ["code", "code", "doc", "config", "conversation", "unknown", "unknown", "unknown"]


def test_mine_again_change_and_delete(spark, tmp_path):
    root = tree(tmp_path)
    empty = {"nodes": spark.createDataFrame([], SCHEMAS["nodes"]), "edges": spark.createDataFrame([], SCHEMAS["edges"]), "vectors": spark.createDataFrame([], "doc_id string, embedding array<float>, node_id long, project_uuid string")}
    one, report = facade.mine(spark, str(root), "p", empty, NOW)
    labels = {r.label for r in one["nodes"].collect()}
    assert {"src/a.py::func_a", "src/b.py::K", "src/b.py::K.method_b", "src/a.py", "README.md::Title"} <= labels
    ids = {r.label: r.id for r in one["nodes"].collect()}
    calls = rows(one["edges"].where("relation_type = 'calls'"), "source_id", "target_id")
    assert (ids["src/b.py::K.method_b"], ids["src/a.py::func_a"]) in calls
    assert one["vectors"].count() == one["nodes"].where("content <> ''").count()
    two, report = facade.mine(spark, str(root), "p", one, NOW)
    assert report.first().new == 0 and rows(two["nodes"], "id") == rows(one["nodes"], "id")
    (root / "src/a.py").write_text("import os\n\ndef func_a():\n    return 2\n\ndef func_c():\n    pass\n")
    (root / "src/b.py").unlink()
    three, report = facade.mine(spark, str(root), "p", one, NOW)
    labels = [r.label for r in three["nodes"].collect()]
    assert "src/a.py::func_c" in labels and not any(x.startswith("src/b.py") for x in labels) and len(labels) == len(set(labels))
    assert three["vectors"].join(three["nodes"], F.col("node_id") == F.col("id"), "left_anti").count() == 0


def test_change_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda path, content, seq, d=False: json.dumps({"path": path, "content": content, "is_directory": d, "seq": seq, "changed_at": "2024-01-01T00:00:00Z"})
    (log / "1.json").write_text("\n".join([line("core/a.py", "def f(): pass", 1), line("core", None, 2, True), line("x.pyc", "z", 3), line("core/a.py", "def f(): pass\ndef g(): pass", 4)]))
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    seen = []
    run = lambda: watch.watch(watch.change_stream(spark, str(log)), store, f"file://{tmp_path}/ck", lambda df: seen.append(rows(df))).awaitTermination()
    run()
    assert rows(store.read("files"), "path", "is_dirty", "community_id") == [("core/a.py", True, "core")] and rows(store.read("communities"), "id", "is_dirty") == [("core", True)]
    (log / "2.json").write_text(line("core/a.py", "def f(): pass\ndef g(): return 1\ndef g(): pass", 5))
    (log / "3.json").write_text(line("core/a.py", "def f(): pass\ndef g(): pass\n# end", 6))
    run()
    assert rows(store.read("files"), "path", "is_dirty") == [("core/a.py", False)] and rows(store.read("communities"), "is_dirty") == [(False,)]
    assert len(seen) >= 2


def test_windows_and_sessions(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    e = spark.createDataFrame([(1, t(0), "a"), (1, t(9), "a"), (1, t(40), "b"), (2, t(5), None), (2, None, "a")], "user_id long, ts timestamp, event_type string")
    assert watch.windowed_counts(e, "10 minutes", "1 hour", ["event_type"]).agg({"n_events": "sum"}).first()[0] == 4
    assert rows(watch.sessions(e, "30 minutes", "1 hour", "user_id"), "user_id", "n_events") == [(1, 1), (1, 2), (2, 1)]
    i = spark.createDataFrame([(t(0), False), (t(0), True)], "s timestamp, f boolean").select(watch.idle(F.col("s"), F.col("f"), F.lit(t(1))).alias("v"), watch.idle(F.col("s"), F.col("f"), F.lit(t(50))).alias("w"))
    assert rows(i) == [(False, True), (True, True)]


def test_maintenance_reports_are_kept(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    job = lambda: spark.createDataFrame([(False, 1, 2)], "skipped_idle_lock boolean, decayed long, archived long")
    stop = []
    q = watch.maintenance_loop(spark, job, f"file://{tmp_path}/ck", 1, store, lambda: bool(stop))
    end = time.time() + 60
    while store.read("maintenance_reports").count() < 2 and time.time() < end:
        time.sleep(0.5)
    stop.append(1)
    q.stop()
    got = store.read("maintenance_reports").collect()
    assert len(got) >= 2 and {(r.decayed, r.archived, r.contexts) for r in got} == {(1, 2, None)} and all(r.finished_at for r in got)


def test_ignore_files_of_a_tree_are_obeyed(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in ("src/a.py", "src/b.tmpx", "src/keep.tmpx", "c.mdx"):
        (tmp_path / name).write_text("x = 1")
    (tmp_path / ".gitignore").write_text("*.tmpx\n!keep.tmpx\n")
    (tmp_path / ".engramaignore").write_text("c.mdx\n")
    files, _, _ = crawl.crawl(spark, str(tmp_path), "p", spark.createDataFrame([], SCHEMAS["nodes"]))
    assert sorted(r.relative_path for r in files.collect()) == ["src/a.py", "src/keep.tmpx"]


def test_ingest_stores_summaries_and_tags(spark, tmp_path):
    (tmp_path / "a.py").write_text("import fastapi\n\ndef f():\n    return 1\n")
    empty = {"nodes": spark.createDataFrame([], SCHEMAS["nodes"]), "edges": spark.createDataFrame([], SCHEMAS["edges"]), "vectors": spark.createDataFrame([], "doc_id string, embedding array<float>, node_id long, project_uuid string")}
    out, _ = facade.mine(spark, str(tmp_path), "p", empty, NOW, call=lambda t: json.dumps({"summary": f"{len(t)} long", "tags": ["told"]}))
    got = {r.label: (r.summary, r.tags) for r in out["nodes"].collect()}
    assert got["a.py::f"] == ("21 long", '["told"]') and "fastapi" in json.loads(got["a.py"][1]) and got["a.py"][0] == "14 long"
    plain, _ = facade.mine(spark, str(tmp_path), "p", empty, NOW, auto_tag=False)
    assert all(r.summary.startswith("[DUMB] ") and r.tags is None for r in plain["nodes"].collect())
