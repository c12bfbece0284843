import json
import os

import pytest

from codeloom.functions import exprs as X
from codeloom.operators import reach
from codeloom.plans import replies
from codeloom.plans.analyze import Analysis
from codeloom.sources.config import Config, manifest_entries, merge, DEFAULTS
from codeloom.sources.scan import Ignore, list_directories, scan, scan_matching, scan_stats

TREE = {
    "src/index.js": "import { a } from './a'\nimport fs from 'node:fs'\nconst e = require('express')\nimport './data.json'\na()\n",
    "src/a.js": "// comment\nimport { b } from './b.js'\nexport { a }\nfunction a() { return b() }\n\n",
    "src/b.js": "import { a } from './a.js'\nexport default function process() {}\nfunction load() {}\n",
    "src/dead.js": "export default function orphan() {}\nfunction load() {}\n",
    "src/dead2.js": "import './dead.js'\nexport default 1\n",
    "lib/classes.js": "class One { load() {} render() {} }\nclass Two { load() {} loads() {} }\nmodule.exports = One\n",
    "bin/run.js": "#!/usr/bin/env node\nrequire('../lib/classes.js')\n",
    "src/broken.js": "function ( {\n",
    ".hidden.js": "",
    "_under.mjs": "export * from './src/b.js'\n",
    "src/notes.txt": "no source",
    "node_modules/p/index.js": "module.exports = 1",
    ".github/x.js": "x()",
    "dist/out.js": "x()",
    "skip/keep.js": "x()",
    "skip/gone.js": "x()",
    ".gitignore": "skip/*\n!skip/keep.js\n# no\n",
    "package.json": json.dumps({"main": "src/index.js", "bin": {"r": "./bin/run.js"}, "exports": {".": {"import": "./src/a.js", "default": "./src/b.js"}}}),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink(root / "src/a.js", root / "src/link.js")
    return str(root)


@pytest.fixture(scope="module")
def analysis(spark, tree):
    return Analysis.of(spark, tree, Config(merge(DEFAULTS, {"entryPoints": ["src/index.js"]})))


def test_scan(spark, tree):
    names = {r.relative_path for r in scan(spark, tree, DEFAULTS["ignore"]).select("relative_path").collect()}
    assert names == {"src/index.js", "src/a.js", "src/b.js", "src/dead.js", "src/dead2.js", "lib/classes.js", "bin/run.js", "src/broken.js", ".hidden.js", "_under.mjs", "skip/keep.js"}
    assert {r.relative_path for r in scan_matching(spark, tree, "dead").select("relative_path").collect()} == {"src/dead.js", "src/dead2.js"}
    stats = scan_stats(tree, DEFAULTS["ignore"])
    assert stats["included"] == 11 and stats["ignored"] >= 5
    assert [d["name"] for d in list_directories(tree)["directories"]][:2] == [".github", "bin"]
    with pytest.raises(FileNotFoundError):
        scan(spark, tree + "/none").count()


@pytest.mark.parametrize(
    "patterns,path,is_dir,want",
    [
        (["*.log"], "a/b.log", False, True), (["/a.js"], "b/a.js", False, False), (["build/"], "x/build", True, True), (["build/"], "build", False, False),
        (["**/t/*.js"], "q/t/x.js", False, True), (["a/**"], "a/b/c.js", False, True), (["*.js", "!k.js"], "k.js", False, False),
        (["d/", "!d/k.js"], "d/k.js", False, True), (["[ab].js"], "b.js", False, True), (["?.js"], "ab.js", False, False), (["#x", "\\#y"], "#y", False, True),
        ([], "a.gitx/b.js", False, True), ([], "x/node_modules_old/a.js", False, True),
    ],
)
def test_ignore(patterns, path, is_dir, want):
    assert Ignore(patterns)(path, is_dir) is want


def test_graph(analysis, tree):
    at = lambda p: f"{tree}/{p}"
    edges = {(r.src, r.dst) for r in analysis.edges.collect()}
    assert (at("src/index.js"), at("src/a.js")) in edges and (at("src/index.js"), "express") in edges
    assert (at("src/index.js"), at("src/data.json")) in edges
    nodes = {r.path: r for r in analysis.nodes.collect()}
    assert nodes[at("src/data.json")].is_missing and nodes[at("src/broken.js")].parse_error and nodes[at("src/a.js")].loc == 3
    assert {r.id for r in analysis.externals.collect()} == {"node:fs", "express"}
    exports = {(r.src, r["name"]) for r in analysis.exports.collect()}
    assert (at("src/a.js"), "a") in exports and (at("lib/classes.js"), "module.exports") in exports and (at("_under.mjs"), "*") in exports


def test_dead_code_and_paths(analysis, tree):
    dead = {os.path.relpath(r.path, tree) for r in analysis.dead.dead_files.collect()}
    assert dead == {"src/dead.js", "src/dead2.js", "_under.mjs"}
    unused = {(os.path.relpath(r.src, tree), r["name"]) for r in analysis.dead.unused_exports.collect()}
    assert unused == {("src/dead2.js", "default"), ("_under.mjs", "*")}
    assert [os.path.relpath(p, tree) for p in analysis.path_to("src/b.js")][-1] == "src/b.js"
    assert analysis.path_to("src/dead2.js") is None
    order = [r.id for r in reach.preorder(analysis.edges, f"{tree}/src/index.js").orderBy("position").collect()]
    assert [os.path.basename(x) for x in order[:3]] == ["index.js", "a.js", "b.js"]


def test_duplicates(analysis):
    groups = {r.bare: (r["count"], r.category) for r in analysis.groups.collect()}
    assert groups == {"load": (4, "mixed")}
    s = analysis.stats
    assert s["duplicate_groups"] == 1 and s["total_duplicates"] == 4 and s["total_functions"] == 9


def test_sinks_and_reports(analysis, spark, tmp_path):
    text = replies.report(analysis, entry="src/index.js")
    assert "## Reachability" in text and "`./src/dead.js`" in text and "## Way from the entry point" in text
    assert "- ./src/dead.js" in replies.dead_code(analysis, "text") and "## Unused exports" in replies.dead_code(analysis, "text")
    assert json.loads(replies.duplicates_json(analysis))["duplicates"][0]["name"] == "load"
    analysis.write("ntriples", str(tmp_path / "nt"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "nt")).collect()]
    assert len(lines) == analysis.stats["total_triples"] and all(x.endswith(" .") for x in lines)
    analysis.write("json", str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/nodes")).filter("is_dead").count() == 3
    with pytest.raises(ValueError):
        analysis.write("csv", str(tmp_path / "x"))
    assert analysis.passed()["duplicates"] is False
    assert analysis.hubs(threshold=2).count() >= 1 and analysis.structure().first().health > 0


def test_config(tmp_path, tree):
    assert manifest_entries(TREE["package.json"], "/r") == ["/r/src/index.js", "/r/bin/run.js", "/r/src/a.js", "/r/src/b.js"]
    assert manifest_entries("no json", "/r") == []
    (tmp_path / ".codeloom.json").write_text(json.dumps({"thresholds": {"fileLines": 9}, "entryPoints": ["x.js"]}))
    c = Config.load(folder=str(tmp_path), home=str(tmp_path / "none"))
    assert c.threshold("fileLines") == 9 and c.threshold("functionLines") == 50 and c.entry_points == ["x.js"] and c.validate()
    assert Config.load(path=str(tmp_path / "missing"), folder="/nowhere", home="/nowhere").values == Config().values
    with pytest.raises(ValueError):
        Config(merge(DEFAULTS, {"thresholds": {"fileLines": -1}, "languages": "js"})).validate()


def test_paths_and_scalars(spark):
    rows = [("./b", "/r/a.js", "/r/b.js"), ("../x/./y.mjs", "/r/s/a.js", "/r/x/y.mjs"), ("./x.service", "/r/a.js", "/r/x.service"), ("pkg/sub", "/r/a.js", "pkg/sub"), ("/abs", "/r/a.js", "/abs.js"), ("../../../up", "/r/a.js", "/up.js")]
    df = spark.createDataFrame(rows, "s string, f string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", X.resolve_import("s", "f")).collect())
    t = spark.createDataFrame([("a\n\n  // c\n * d\n/* e */ f\n ﻿\n g ",), (None,), ("",)], "t string")
    assert [r.n for r in t.select(X.lines_of_code("t").alias("n")).collect()] == [2, 0, 0]
    s = spark.createDataFrame([("parseSource", "parceSource"), ("", ""), ("a", "b")], "a string, b string")
    assert [round(r.x, 3) for r in s.select(X.similarity("a", "b").alias("x")).collect()] == [0.909, 1.0, 0.0]
    e = spark.createDataFrame([("/p/bin/x.js",), ("/p/src/x.js",), ("/p/a.test.js",), ("/p/Tests/a.js",), ("/p/myapp.js",)], "p string")
    assert [r.x for r in e.select(X.looks_like_entry("p").alias("x")).collect()] == [True, False, True, True, True]


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 4), ("x", "y", 5)], "src string, dst string, first_seq long")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in reach.reachable(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert reach.shortest_path(edges, ["x", "a"], "d") == ["a", "b", "c", "d"]
