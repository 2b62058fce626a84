"""Settings, maintenance, streams that start again, pruned scans and the command line."""

import json
import os

import pytest

from fathomix.functions import paths as P
from fathomix.operators.ranking import RankingConfig
from fathomix.plans import cli, config
from fathomix.plans.engine import Engine
from fathomix.sources import brace_parser, files, maintenance, python_parser, script_parser
from fathomix.storage import Scratch, read_text
from fathomix.streaming import changes as streams


def test_ranking_settings(tmp_path):
    path = tmp_path / "ranking.json"
    s = config.RankingSettings(str(path))
    assert s.get() == RankingConfig()
    path.write_text(json.dumps({"fusion": {"alpha": 0.7, "beta": 0.3, "gamma": 0}, "top_k": 5}))
    assert (s.get().alpha, s.get().top_k, s.problem) == (0.7, 5, None)
    for bad in ("{{{", json.dumps({"alpha": 7}), json.dumps({"nothing": 1}), json.dumps([1])):
        path.write_text(bad)
        assert s.get().alpha == 0.7 and s.problem, bad
    path.write_text(json.dumps({"alpha": 0.2}))
    assert s.get().alpha == 0.2 and s.problem is None


def test_settings_of_a_folder(tmp_path, monkeypatch):
    assert config.parse_env("# no\nA=1\nexport B = 'x y' # why\nC=\"q\"\nD=a # b\nbad line\n") == {"A": "1", "B": "x y", "C": "q", "D": "a"}
    made = config.initialise(str(tmp_path / "i"))
    assert len(made["made"]) == 3 and not made["problems"] and not config.initialise(str(tmp_path / "i"))["made"]
    (tmp_path / "i" / ".env").write_text("FATHOMIX_MODE=fast\nOTHER=1\n")
    monkeypatch.setenv("FATHOMIX_LEVEL", "3")
    found = config.settings(str(tmp_path / "i"))
    assert (found["mode"], found["level"], found["batch_size"]) == ("fast", "3", 100) and "other" not in found


def test_checks(spark):
    assert config.problems({"batch_size": 0, "version": "1.x"}, config.PROJECT_RANGES) == ["batch_size must be from 1 to 1000", "version must be three numbers with dots"]
    for wrong in (lambda: config.WatcherConfig(debounce_ms=5), lambda: config.HookConfig("post-commit", "p", blocking=True), lambda: config.HookConfig("other", "p")):
        with pytest.raises(ValueError):
            wrong()
    assert config.profile("heavy")["fallback"] and config.profile("balanced")["dimensions"] == 768
    diff = config.CommitDiff("commit_range", [("a", "M"), ("b", "R090")], "x", "y")
    assert diff.is_valid() and not config.CommitDiff("commit_range", [("a", "M")]).is_valid()
    assert [(r.path, r.status) for r in diff.frame(spark).collect()] == [("a", "modified"), ("b", "renamed")]


def test_backups(spark, tmp_path):
    table, backups = str(tmp_path / "t"), str(tmp_path / "b")
    spark.range(10).write.parquet(table)
    names = [maintenance.backup(spark, table, backups) for _ in range(3)]
    spark.range(3).write.mode("overwrite").parquet(table)
    assert {r.name for r in maintenance.backups_of(spark, backups).collect()} == set(names)
    assert maintenance.clean_backups(spark, backups, 1) == names[1::-1]
    maintenance.restore(spark, backups, names[2], table)
    assert spark.read.parquet(table).count() == 10
    with pytest.raises(ValueError):
        maintenance.restore(spark, backups, names[0], table)
    spark.range(100).repartition(8).write.mode("overwrite").parquet(table)
    assert maintenance.compact(spark, table) == 1 and spark.read.parquet(table).count() == 100


def test_stream_starts_again(spark, tmp_path):
    """The state of the first run is there in the second, which has another object."""
    folder, source = str(tmp_path / "index"), str(tmp_path / "in")
    schema = "path string, id long, type string, ts timestamp"
    rows = lambda *x: spark.createDataFrame([(p, i, t, None) for p, i, t in x], schema)
    rows(("x", 1, "create"), ("y", 2, "create")).coalesce(1).write.parquet(source)
    for more in (None, rows(("y", 3, "delete"), ("z", 4, "create"))):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(source)
        index = streams.IndexTable(spark, folder)
        streams.apply_stream(spark.readStream.schema(schema).parquet(source), index, str(tmp_path / "c")).awaitTermination()
    assert {r.path for r in streams.IndexTable(spark, folder).read().collect()} == {"x", "z"}
    assert streams.IndexTable(spark, str(tmp_path / "none")).read().count() == 0


def test_pruned_scan(spark, tmp_path):
    """Ignored folders are not listed; a rule that takes files back keeps them in the listing."""
    for name in ("src/a.py", "build/x/b.py", "node_modules/m/c.js", "src/gen/d.py", "e.py"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    rules = P.IgnoreRules(["build/", "src/gen/"])
    assert rules.prunes("build") and rules.prunes("src/gen") and not rules.prunes("src")
    assert not P.IgnoreRules(["build/", "!build/x/b.py"]).prunes("build")
    listed = files.roots(spark, str(tmp_path), rules)
    assert not [p for p in listed if "build" in p or "node_modules" in p or "gen" in p]
    assert {r.file_path for r in files.scan(spark, str(tmp_path), rules).collect()} == {"src/a.py", "e.py"}
    kept = P.IgnoreRules(["build/*", "!build/x/"])
    assert "src/a.py" in {r.file_path for r in files.scan(spark, str(tmp_path), kept).collect()}


def test_refresh_keeps_options(spark, tmp_path, capsys):
    tree = tmp_path / "t"
    tree.mkdir()
    for i in range(6):
        (tree / f"f{i}.py").write_text(f"def f{i}():\n    return g{i}()\n")
    (tree / "n.js").write_text("function no() {}\n")
    e = Engine(spark, str(tmp_path / "index"), parts=3)
    assert e.index(str(tree), extensions=[".py"])["indexed"] == 6
    assert e.refresh(str(tree))["added"] == 0 and e.version() == 1
    (tree / "f1.py").write_text("def changed():\n    pass\n# longer than before\n")
    os.utime(tree / "f1.py", (4e9, 4e9))
    report = e.refresh(str(tree))
    assert (report["updated"], report["added"], e.version()) == (1, 0, 2)
    written = {n for n in os.listdir(tmp_path / "index" / "v2" / "files") if n.startswith("part=")}
    assert len(written) == 1  # the part of the changed file only
    assert e.symbols_exact("changed").count() == 1 and e.symbols_exact("f1").count() == 0 and e.symbols_exact("f2").count() == 1
    assert e.vacuum() and e.table("symbols").count() == 6
    cli.show(e.symbols(kind="function").orderBy("name"), "json")
    assert len([json.loads(x) for x in capsys.readouterr().out.splitlines()]) == 6
    cli.show(e.table("files").select("file_path"), "tree")
    assert "f1.py" in capsys.readouterr().out.split()


def test_other_embedder(spark, tmp_path):
    """Any function from texts to vectors may take the place of the hashed words."""
    from fathomix.operators import sparse, stats

    sparse.Embedders.register("lengths", lambda texts: [[1.0, len(t) / 100] for t in texts])
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.py").write_text("def short(): pass\n")
    (tree / "b.py").write_text("def quite_a_long_name_that_goes_on_and_on(): pass\n" * 5)
    e = Engine(spark, str(tmp_path / "i"), embedder="lengths", parts=1)
    e.index(str(tree))
    assert [r.file_path for r in e.search("x", dense_weight=1.0, sparse_weight=0.0).collect()] == ["b.py", "a.py"]
    stats.write_log(e.stats(), str(tmp_path / "log"))
    stats.write_log(e.stats(), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sized = {r.table_name: r for r in stats.table_sizes(spark, {n: str(tmp_path / "i" / "v1" / n) for n in ("files", "vectors")}, ("vectors",)).collect()}
    assert sized["files"].n_rows == 2 and 0 < sized["vectors"].index_overhead < 100


def test_command_line_prints_all_rows(spark, capsys):
    cli.show(spark.range(1500), "table")
    assert len(capsys.readouterr().out.splitlines()) == 1501


def test_call_metadata():
    js = script_parser.parse("const r = array\n  .filter(x => x > 0)\n  .map(x => x * 2)\n  .reduce((s, x) => s + x, 0);\nfunction f() { helper(); console.log('x'); new Thing(1); table[key](2); }")
    calls = {c["callee"]: c for c in js["calls"]}
    assert [(calls[n]["chain_position"], calls[n]["chain_previous"], calls[n]["chain_next"]) for n in ("filter", "map", "reduce")] == [(0, None, "map"), (1, "filter", "reduce"), (2, "map", None)]
    assert (calls["helper"]["kind"], calls["log"]["kind"], calls["log"]["receiver"], calls["Thing"]["kind"], calls["<dynamic>"]["receiver"]) == ("function", "method", "console", "constructor", "table")
    py = python_parser.parse("def f():\n    a.b(1).c(2, x=3).d()\n    table[0]()\n    Thing()\n")
    calls = {c["callee"]: c for c in py["calls"]}
    assert [(calls[n]["chain_position"], calls[n]["n_args"]) for n in "bcd"] == [(0, 1), (1, 2), (2, 0)] and calls["c"]["chain_next"] == "d"
    assert calls["<dynamic>"]["receiver"] == "table[0]" and calls["Thing"]["kind"] == "constructor"
    long = "x" * 2000
    assert script_parser.parse(f"const a = '{long}';")["symbols"][0]["value"].count("x") == 2000


SAMPLES = {
    "java": ("package a;\nimport java.util.List;\nimport static java.lang.Math.*;\n/** A doc. */\npublic class Foo<T> extends Bar implements Baz {\n  public static final int MAX = 10;\n  public Foo(int a) { if (a > 1) { go(a, 2); } }\n  @Override public String toString() { return \"class Not {\"; }\n}\n", [("class", "Foo"), ("constant", "MAX"), ("method", "Foo.Foo"), ("method", "Foo.toString")], ["List", "*"], [("Foo.Foo", "go", 2)]),
    "csharp": ("using System;\npublic class A : B { public const int MAX = 3; public int Get(string s) { return Parse(s); } }\n", [("class", "A"), ("constant", "MAX"), ("method", "A.Get")], ["*"], [("A.Get", "Parse", 1)]),
    "kotlin": ("import a.b.C as D\nconst val MAX = 3\nclass A : B { fun run(a: Int): String { return go(a) } }\nfun top(x: Int) = other(x)\n", [("constant", "MAX"), ("class", "A"), ("method", "A.run"), ("function", "top")], ["C"], [("A.run", "go", 1), ("top", "other", 1)]),
    "scala": ("import a.b.C\ntrait T\nobject Main extends App { def run(a: Int): Int = { go(a) } }\n", [("interface", "T"), ("class", "Main"), ("method", "Main.run")], ["C"], [("Main.run", "go", 1)]),
    "go": ("package m\nimport (\n\t\"os\"\n\ts \"strings\"\n)\nconst Max = 1\ntype P struct { X int }\nfunc (p *P) Area(a int) error {\n\treturn fmt.Go(`}`, a)\n}\n", [("constant", "Max"), ("class", "P"), ("method", "P.Area")], ["*", "*"], [("P.Area", "Go", 2)]),
    "rust": ("use std::{io, fmt};\npub struct P { x: u8 }\nimpl Shape for P { fn area(&self) -> u8 { calc(self.x) } }\npub trait Shape { fn area(&self) -> u8; }\n", [("class", "P"), ("method", "P.area"), ("interface", "Shape"), ("method", "Shape.area")], ["io", "fmt"], [("P.area", "calc", 1)]),
    "swift": ("import UIKit\nclass A: B { func run(a: Int) -> String { return go(a) } }\nprotocol Q { }\n", [("class", "A"), ("method", "A.run"), ("interface", "Q")], ["*"], [("A.run", "go", 1)]),
    "c": ("#include <stdio.h>\n#define N 10\nstruct node { int v; };\nstatic int add(int a, int b) { return a + b; }\nint main(void) { printf(\"%d {\", add(1, 2)); return 0; }\n", [("constant", "N"), ("class", "node"), ("function", "add"), ("function", "main")], ["*"], [("main", "printf", 2), ("main", "add", 2)]),
    "cpp": ("#include \"a.h\"\nclass Foo : public Bar {\n public:\n  Foo(int a) { init(a); }\n  virtual int run(int x) const { return go(x); }\n};\nint Foo::other(int y) { return y; }\n", [("class", "Foo"), ("method", "Foo.Foo"), ("method", "Foo.run"), ("method", "Foo.other")], ["*"], [("Foo.Foo", "init", 1), ("Foo.run", "go", 1)]),
    "php": ("<?php\nuse App\\Models\\User;\nclass A extends B { const MAX = 1; public function run(int $a): string { return $this->go($a, 2); } }\n", [("class", "A"), ("constant", "MAX"), ("method", "A.run")], ["User"], [("A.run", "go", 2)]),
    "ruby": ("require 'json'\nclass Foo < Bar\n  LIMIT = 10\n  def run(a)\n    if a\n      help(a)\n    end\n  end\nend\n", [("class", "Foo"), ("constant", "LIMIT"), ("method", "Foo.run")], ["*"], [("Foo.run", "help", 1)]),
}


@pytest.mark.parametrize("language", sorted(brace_parser.LANGUAGES))
def test_languages(language):
    text, symbols, imports, calls = SAMPLES[language]
    p = brace_parser.parse(text, language)
    assert [(s["kind"], s["name"]) for s in p["symbols"]] == symbols
    assert [i["imported"] for i in p["imports"]] == imports
    assert [(c["caller"], c["callee"], c["n_args"]) for c in p["calls"]] == calls and not p["errors"]
    for odd in ("", "{", "}}}", "class", text[: len(text) // 2], "\x00", "(" * 500, '"' * 501):
        assert brace_parser.parse(odd, language) is not None


def test_broken_code_takes_linear_time():
    import time

    for text in ("{ " * 100_000, "int a(b, " * 40_000, "class A { " * 20_000, SAMPLES["java"][0] * 2000):
        began = time.time()
        brace_parser.parse(text, "java")
        assert time.time() - began < 20


def test_scratch(spark):
    s = Scratch(spark, "t")
    small, df = s.write(spark.range(10)), spark.range(1000)
    assert "Broadcast" in s.join_small(df, small, ["id"], "left_semi")._jdf.queryExecution().toString()
    assert s.join_small(df, small, ["id"], "left_semi").count() == 10
    s.drop(small)
    with pytest.raises(Exception):  # noqa: B017
        small.count()


def test_hidden_files_are_read(spark, tmp_path):
    (tmp_path / ".hidden").write_text("é\n")
    assert read_text(spark, str(tmp_path / ".hidden")) == "é\n"
