"""Scans, parsers and the engine over a small tree."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from fathomix.plans.engine import Engine
from fathomix.sources import extract, files, python_parser, script_parser
from fathomix.streaming import changes as streams

TREE = os.path.join(os.path.dirname(__file__), "fixtures", "tree")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tree") / "t")
    shutil.copytree(TREE, folder)
    # Names that an ignore file of this repository could hold back are written here.
    os.makedirs(f"{folder}/node_modules/x", exist_ok=True)
    for name, text in ((".gitignore", "ignored.js\n"), ("node_modules/x/no.js", "function no() {}\n"), ("ignored.js", "function ig() {}\n"), ("blob.js", "a\0b")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    return folder


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    report = e.index(tree)
    assert report["indexed"] == 8 and report["errors"] == 2
    return e


def names(parsed, kind):
    return [s["name"] for s in parsed["symbols"] if s["kind"] == kind]


def test_script_parser():
    with open(f"{TREE}/src/shapes.ts") as f:
        p = script_parser.parse(f.read())
    assert names(p, "method") == ["Square.handler", "Square.constructor", "Square.size", "Square.make"]
    assert names(p, "function") == ["check", "inner", "clamp", "twice"]
    assert (names(p, "interface"), names(p, "type"), names(p, "enum"), names(p, "constant")) == (["Shape"], ["Pair"], ["Color"], ["LIMIT", "pattern"])
    square = next(s for s in p["symbols"] if s["name"] == "Square")
    assert square["implements"] == ["Shape", "Named"] and square["extends"] == ["Base<number>"] and (square["line"], square["end_line"]) == (22, 42)
    assert [(i["imported"], i["local"]) for i in p["imports"]] == [("area", "measure"), ("Unit", "Unit"), ("*", "log"), ("default", "Config"), (None, None)]
    assert ("twice", "double") in [(e["local"], e["exported"]) for e in p["exports"]]
    assert ("Square.size", "measure") in [(c["caller"], c["callee"]) for c in p["calls"]] and not p["errors"]


def test_broken_files():
    with open(f"{TREE}/src/broken.ts") as f:
        p = script_parser.parse(f.read())
    assert names(p, "function") == ["good", "after"] and p["errors"]
    with open(f"{TREE}/src/broken.py") as f:
        q = python_parser.parse(f.read())
    assert names(q, "function") == ["fine"] and q["errors"][0]["line"] == 4
    for text in ("", "{", "}", "class", "import", "export", "const x", "function(", "`", "/*", "a(" * 50, "export default", "type X ="):
        assert script_parser.parse(text) is not None
    assert python_parser.parse("")["symbols"] == []


def test_python_parser():
    with open(f"{TREE}/lib/config.py") as f:
        p = python_parser.parse(f.read())
    assert names(p, "method") == ["Config.__init__", "Config.size"] and names(p, "function") == ["inner", "make"]
    assert [(i["source"], i["imported"], i["local"]) for i in p["imports"]] == [("os", "*", "os"), (".other", "load", "read"), (".other", "save", "save")]
    assert ("make", "helper") in [(c["caller"], c["callee"]) for c in p["calls"]]


def test_scan(spark, tree):
    found = {r.file_path: r.language for r in files.scan(spark, tree, files.rules_of(spark, tree)).collect()}
    assert found == {"README.md": "markdown", "lib/config.py": "python", "lib/measure.js": "javascript", "src/broken.py": "python", "src/broken.ts": "typescript", "src/log.js": "javascript", "src/shapes.ts": "typescript", "blob.js": "javascript"}
    flat = files.scan(spark, tree, files.rules_of(spark, tree), max_depth=0)
    assert {r.file_path: r.content is None for r in flat.collect()} == {"README.md": False, "blob.js": True}
    assert {(r.name, r.is_folder) for r in files.listing(files.scan(spark, tree, files.rules_of(spark, tree), extensions=[".py", ".md"])).collect()} == {("README.md", False), ("lib", True), ("src", True)}


def test_definitions(engine):
    d = engine.find_def("check").collect()
    assert len(d) == 1 and d[0].file_path == "src/shapes.ts" and d[0].code.startswith("export function check") and "inner" in d[0].calls and "info" in d[0].called_by
    assert [r.kind for r in engine.find_def("size").limit(5).collect()] == ["method", "method"]
    assert {(r.file_path, r.reference_type) for r in engine.find_refs("check").collect()} == {("src/shapes.ts", "definition"), ("src/log.js", "import")}
    assert {(r.file_path, r.caller) for r in engine.callers("check").collect()} == {("src/log.js", "info"), ("src/shapes.ts", "Square.constructor")}
    assert {r.callee for r in engine.callees("check").collect()} == {"Error", "inner"}
    assert "Square.constructor" in {r.name for r in engine.call_hierarchy("clamp", 4).collect()}


def test_search(engine):
    best = engine.search("square size shape", limit=3).collect()
    assert best[0].file_path == "src/shapes.ts" and best[0].anchor.startswith("src/shapes.ts:") and [r.score for r in best] == sorted((r.score for r in best), reverse=True)
    assert {r.file_path for r in engine.search("config", directory="lib").collect()} <= {"lib/config.py", "lib/measure.js"}
    assert {r.file_path for r in engine.search("config", language="python").collect()} <= {"lib/config.py", "src/broken.py"}
    assert [r.file_path for r in engine.full_text("shapes sizes").collect()][0] == "README.md"
    assert engine.text_search("good()", ignore_case=True).count() == 2
    for bad in ({"limit": 0}, {"query": " "}):
        with pytest.raises(ValueError):
            engine.search(**{"query": "x", **bad})


def test_files(engine):
    row = engine.open_at("lib/measure.js", 2).first()
    assert row.exists and row.start_line == 1 and len(row.lines) == 5
    assert not engine.open_at("nowhere.ts", 1).first().exists
    assert engine.symbols("lib/measure.js", "function").count() == 2
    assert engine.stats().first().n_files == 8
    assert {r.status for r in engine.doctor().collect()} == {"present"}
    kinds = {r.chunk_type for r in engine.chunks().collect()}
    assert {"function", "method", "async_method", "constructor", "class", "property"} <= kinds
    assert {r.name for r in engine.documented().collect()} >= {"Shape"}


def test_modules(engine):
    deps = {(r.caller, r.callee) for r in engine.dependencies().collect()}
    assert {("src/shapes.ts", "src/log.js"), ("src/log.js", "src/shapes.ts"), ("src/shapes.ts", "lib/measure.js")} <= deps
    assert [sorted(r.cycle) for r in engine.circular_dependencies().collect()] == [["src/log.js", "src/shapes.ts"]]
    assert ("src/broken.ts", "good") in {(r.file_path, r.exported) for r in engine.unused_exports().collect()}
    assert "unused" in {r.name for r in engine.unused_functions().collect()}


def test_doc_tags(spark):
    row = spark.range(1).select(extract.doc_tags(F.lit("Makes.\n@param x the x\n@returns all\nmore")).alias("t")).first()
    assert [tuple(t) for t in row.t] == [("param", "x the x"), ("returns", "all")]


def test_refresh(spark, tree, tmp_path):
    copy = str(tmp_path / "t")
    shutil.copytree(tree, copy)
    e = Engine(spark, str(tmp_path / "index"))
    e.index(copy)
    assert e.refresh(copy)["updated"] == 0 and e.version() == 1
    time.sleep(0.05)
    with open(f"{copy}/src/log.js", "a") as f:
        f.write("export function extra() { return done(); }\n")
    os.remove(f"{copy}/README.md")
    with open(f"{copy}/src/new.py", "w") as f:
        f.write("def fresh():\n    pass\n")
    report = e.refresh(copy)
    assert (report["added"], report["updated"], report["deleted"]) == (1, 1, 1) and e.version() == 2
    assert e.symbols_exact("extra").count() == 1 and e.symbols_exact("fresh").count() == 1
    assert e.table("files").filter("file_path = 'README.md'").count() == 0 and e.symbols_exact("info").count() == 1
    e.clear()
    assert e.version() is None


def test_stream_debounce(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ['{"id":1,"path":"a","type":"create","ts":"2024-01-01T00:00:00.000Z"}', '{"id":2,"path":"a","type":"modify","ts":"2024-01-01T00:00:00.200Z"}', '{"id":3,"path":"b","type":"create","ts":"2024-01-01T00:00:00.100Z"}', '{"id":4,"path":"b","type":"delete","ts":"2024-01-01T00:00:00.300Z"}', '{"id":5,"path":"c","type":"odd","ts":"2024-01-01T00:00:00.300Z"}']
    (folder / "1.json").write_text("\n".join(lines))
    (folder / "2.json").write_text('{"id":9,"path":"z","type":"modify","ts":"2024-01-01T01:00:00.000Z"}')
    events = streams.source(spark, str(folder), 1)
    q = streams.debounced(events).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.path, r.type, r.id) for r in spark.table("debounced").collect()] == [("a", "create", 1)]


def test_cli_parser():
    from fathomix.plans.cli import parser

    a = parser().parse_args(["--index", "i", "search", "words", "--limit", "5"])
    assert (a.command, a.query, a.limit) == ("search", "words", 5)


def test_parsed_rows_leave_in_parts():
    """A task holds what it parsed of a part of a batch, not of the whole."""
    frames = []
    taken = []

    class Files:
        """Stands for a table; runs the map on one batch in this process."""

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            for out in run(iter(frames)):
                taken.append(len(out))

    import pandas as pd

    text = "function f() {}\n" * 1024
    frames.append(pd.DataFrame({"file_path": [f"{i}.js" for i in range(64)], "language": ["javascript"] * 64, "content": [text] * 63 + [None]}))
    extract.parse_files(Files())
    assert sum(taken) == 64 and max(taken) == 16
    taken.clear()
    frames[0] = pd.DataFrame({"file_path": [str(i) for i in range(2500)], "language": ["text"] * 2500, "content": [""] * 2500})
    extract.parse_files(Files())
    assert taken == [1000, 1000, 500]


def test_several_tasks_write_a_part(spark, tmp_path):
    files = spark.range(200).selectExpr("concat('f', id, '.js') AS file_path", "1.0D AS mtime_ms", "20L AS bytes", "'javascript' AS language", "concat('function f', id, '() { g(); }') AS content")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e = Engine(spark, str(tmp_path / "i"), parts=1)
        e.index_frame(files)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("files", "symbols", "call_edges", "vectors", "postings", "lengths"):
        written = [f for f in os.listdir(tmp_path / "i" / "v1" / name / "part=0") if f.endswith(".parquet")]
        assert len(written) == 4, name
    assert e.symbols().count() == 200 and e.callers("g").count() == 200 and e.symbols_exact("f7").count() == 1
