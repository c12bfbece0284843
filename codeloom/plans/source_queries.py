"""Queries that read and parse sources: one made of each row of ``part``, and a small tree of files; with DuckDB oracles.

The sources of ``part`` hold every construct that the reader knows, filled from the row, so that what it finds can be told in SQL. The tree
tests what needs a folder: the scan, ignore patterns, configuration, and an analysis from end to end.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.operators import graph
from codeloom.plans import replies
from codeloom.plans.analyze import Analysis
from codeloom.plans.catalogue import query
from codeloom.sources.config import DEFAULTS, Config, manifest_entries, merge
from codeloom.sources.scan import Ignore, list_directories, parse_files, relations, scan, scan_matching, scan_stats
from codeloom.tables import written

#: Lines of a source; #p, #s and #m are the row's key, size and key modulo 7. Double quotes only.
LINES = (
    'import def, { a as b, c } from "./lib/m#m"',
    'import * as ns from "pkg-#s"',
    'import "./side.mjs"',
    'const r = require("../up/f#s")',
    "const d = require(name + 1)",
    'export { x as y, z } from "/abs/re"',
    'export * from "./all"',
    "export default function main#p(a, b) { helper(a) }",
    "export class K#p {",
    "  constructor() {}",
    "  static async load(x) { return x }",
    "  get v() { return 1 }",
    "}",
    "// a comment",
    "async function go(a, b, c) { await wait(1) }",
    "function* gen() { yield 1 }",
    "",
    "exports.thing#p = go",
    "module.exports = gen",
    'const u = () => import("./dyn.js")',
)
_FILLED = "replace(replace(replace('{}', '#p', CAST(p_partkey AS STRING)), '#s', CAST(p_size AS STRING)), '#m', CAST(p_partkey % 7 AS STRING))"
_CONTENT = f"concat_ws(chr(10), {', '.join(_FILLED.format(line) for line in LINES)})"
#: Sources that cannot be read are those of keys that 97 divides.
SOURCES = f"""
SELECT concat('/proj/src/p', p_partkey, '.js') AS path, CAST(p_partkey AS BIGINT) AS scan_seq, CAST(p_size AS BIGINT) AS size,
       CASE WHEN p_partkey % 97 = 0 THEN 'function ( {{{{' ELSE {_CONTENT.replace("{", "{{").replace("}", "}}")} END AS content FROM {{part}}
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SOURCES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _parsed(spark: SparkSession, sf_dir: str, dynamic: bool = False) -> DataFrame:
    return parse_files(sources(spark, sf_dir), dynamic)


def _made(values: str, columns: str) -> str:
    """One row of each value for each source that can be read."""
    return f"""SELECT '/proj/src/p' || p_partkey || '.js' AS path, {columns}
               FROM (SELECT p_partkey, p_size, p_partkey % 7 AS m FROM part WHERE p_partkey % 97 <> 0), (VALUES {values}) AS v({_names(values)})"""


def _names(values: str) -> str:
    return ", ".join(f"c{k}" for k in range(len(json.loads("[" + values[1 : values.index(")")].replace("'", '"').replace("NULL", "null") + "]"))))


_SOURCE = "replace(replace(c1, '#s', CAST(p_size AS VARCHAR)), '#m', CAST(m AS VARCHAR))"
_IMPORTS = """('import', './lib/m#m', 'default,a,c', 1), ('import', 'pkg-#s', '*', 2), ('import', './side.mjs', '*', 3), ('require', '../up/f#s', NULL, 4),
              ('require', NULL, NULL, 5), ('import', '/abs/re', 'y,z', 6), ('import', './all', '*', 7)"""


@query(_made(_IMPORTS, f"c0 AS type, {_SOURCE} AS source, c2 AS specifiers, c0 = 'require' AND c1 IS NULL AS dynamic, c3 AS line"))
def parse_imports(spark, d):
    rows = _parsed(spark, d).select("path", F.explode("imports").alias("r")).select("path", "r.*")
    return rows.select("path", "type", "source", F.array_join("specifiers", ",").alias("specifiers"), F.coalesce("dynamic", F.lit(False)).alias("dynamic"), "line")


@query(_made("('dynamic-import', './dyn.js', 20)", "c0 AS type, c1 AS source, c2 AS line"))
def parse_dynamic_imports(spark, d):
    rows = _parsed(spark, d, dynamic=True).select("path", F.explode("imports").alias("r")).select("path", "r.type", "r.source", "r.line")
    return rows.filter("type = 'dynamic-import'")


@query(
    _made(
        "('named', 'y,z', NULL, NULL, 6), ('all', NULL, './all', NULL, 7), ('default', 'default', NULL, NULL, 8), ('named', '', NULL, NULL, 9), ('commonjs', NULL, NULL, 'thing', 18), ('commonjs', NULL, NULL, NULL, 19)",
        "c0 AS type, c1 AS specifiers, c2 AS source, c3 || p_partkey AS property, c4 AS line",
    )
)
def parse_exports(spark, d):
    rows = _parsed(spark, d).select("path", F.explode("exports").alias("r")).select("path", "r.*")
    return rows.select("path", "type", F.array_join("specifiers", ",").alias("specifiers"), "source", "property", "line")


_FUNCTIONS = """('main', 'function', NULL, 2, false, NULL, NULL, 8), ('K', 'method', 'constructor', 0, false, false, 'constructor', 10), ('K', 'method', 'load', 1, true, true, 'method', 11),
                ('K', 'method', 'v', 0, false, false, 'get', 12), ('go', 'function', NULL, 3, true, NULL, NULL, 15), ('gen', 'function', NULL, 0, false, NULL, NULL, 16)"""


@query(
    _made(
        _FUNCTIONS,
        """CASE WHEN c1 = 'method' THEN c0 || p_partkey || '.' || c2 WHEN c0 = 'main' THEN c0 || p_partkey ELSE c0 END AS name, c1 AS type,
           CASE WHEN c1 = 'method' THEN c0 || p_partkey END AS class_name, c2 AS method_name, c3 AS params, c4 AS is_async, c5 AS is_static, c6 AS kind, c7 AS line,
           CASE WHEN c1 = 'function' THEN c0 = 'gen' END AS is_generator""",
    )
)
def parse_functions(spark, d):
    rows = _parsed(spark, d).select("path", F.explode("functions").alias("r")).select("path", "r.*")
    return rows.select("path", "name", "type", "class_name", "method_name", "params", "is_async", "is_static", "kind", "line", "is_generator")


@query(_made("('require', 4), ('require', 5), ('helper', 8), ('wait', 15)", "c0 AS function, c1 AS line"))
def parse_calls(spark, d):
    return _parsed(spark, d).select("path", F.explode("calls").alias("r")).select("path", "r.function", "r.line")


@query("SELECT '/proj/src/p' || p_partkey || '.js' AS path, p_partkey % 97 = 0 AS parse_error, CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 18 END AS loc FROM part")
def parse_errors(spark, d):
    files = sources(spark, d)
    return relations(files, parse_files(files))["files"].select("path", "parse_error", "loc")


@query(
    _made(
        """('./lib/m#m', '/proj/src/lib/m#m.js', false), ('pkg-#s', 'pkg-#s', true), ('./side.mjs', '/proj/src/side.mjs', false), ('../up/f#s', '/proj/up/f#s.js', false),
           ('/abs/re', '/abs/re.js', false), ('./all', '/proj/src/all.js', false)""",
        _SOURCE + " AS dst, c2 AS is_external",
    )
)
def resolved_imports(spark, d):
    files = sources(spark, d)
    return relations(files, parse_files(files))["imports"].select(F.col("src").alias("path"), "dst", "is_external")


@query(
    _made("('y', 'named', 6), ('z', 'named', 6), ('*', 'all', 7), ('default', 'default', 8), ('thing', 'commonjs', 18), ('module.exports', 'commonjs', 19)",
          "CASE WHEN c0 = 'thing' THEN c0 || p_partkey ELSE c0 END AS name, c1 AS export_type, c2 AS line")
)
def export_names(spark, d):
    files = sources(spark, d)
    return relations(files, parse_files(files))["exports"].select(F.col("src").alias("path"), "name", "export_type", "line")


@query("SELECT DISTINCT '/proj/src/p' || p_partkey || '.js' AS path, 7 - CASE WHEN p_partkey % 97 = 0 THEN 7 ELSE 0 END AS imports FROM part")
def parse_once(spark, d):
    """Sources of equal content are read once and found again."""
    from codeloom.sources.scan import parse_cached
    from codeloom.tables import shared_path

    cache, files = shared_path(spark, "parse_cache"), sources(spark, d)
    parse_cached(files.filter("scan_seq % 2 = 0"), cache)
    return parse_cached(files.unionByName(files), cache).select("path", F.size("imports").alias("imports")).distinct()


# A tree of files

TREE = {
    "src/index.js": 'import { a } from "./a"\nimport fs from "node:fs"\nconst e = require("express")\nimport "./data.json"\na()\n',
    "src/a.js": '// comment\nimport { b } from "./b.js"\nexport { a }\nfunction a() { return b() }\n',
    "src/b.js": 'import { a } from "./a.js"\nexport default function process() {}\nfunction load() {}\n',
    "src/Zeta.js": "function load(x) {}\nasync function parseSource() {}\n",
    "src/dead.js": "export default function parceSource() {}\nfunction load() {}\n",
    "src/dead2.js": 'import "./dead.js"\nexport default 1\n',
    "lib/classes.js": "class One { load() {} static async render() {} }\nclass Two { load() {} store() {} }\nclass Three { store() {} }\nmodule.exports = One\n",
    "bin/deep/run.js": '#!/usr/bin/env node\nrequire("../../lib/classes.js")\n',
    "src/broken.js": "function ( {\n",
    ".hidden.js": "",
    "src/notes.txt": "no source",
    "node_modules/p/index.js": "module.exports = 1",
    ".github/x.js": "x()",
    "dist/out.js": "x()",
    "skip/keep.mjs": "x()",
    "skip/gone.cjs": "x()",
    ".gitignore": "skip/*\n!skip/keep.mjs\n# no\n",
    "package.json": json.dumps({"main": "src/index.js", "bin": {"r": "./bin/deep/run.js"}, "exports": {".": {"import": "./src/a.js", "default": "./src/b.js"}}}),
}
CONFIGURED = {"entryPoints": ["src/index.js", "bin/**/*.js"]}


def _with_tree(make):
    """What ``make(root)`` returns, for the tree in a folder of the driver that goes afterwards."""
    root = tempfile.mkdtemp(prefix="codeloom-tree-")
    try:
        for name, text in TREE.items():
            path = os.path.join(root, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        os.symlink(os.path.join(root, "src/a.js"), os.path.join(root, "src/link.js"))
        return make(root)
    finally:
        shutil.rmtree(root)


def _rows(values: list[tuple], columns: str) -> str:
    """An oracle of literal rows."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, row)) + ')' for row in values)}) AS v({columns})"


_SCANNED = [".hidden.js", "bin/deep/run.js", "lib/classes.js", "skip/keep.mjs", "src/Zeta.js", "src/a.js", "src/b.js", "src/broken.js", "src/dead.js", "src/dead2.js", "src/index.js"]


@query(_rows([(p, len(TREE[p]), os.path.splitext(p)[1], TREE[p]) for p in _SCANNED], "relative_path, size, extension, content"))
def scan_tree(spark, d):
    def found(root):
        rows = scan(spark, root, DEFAULTS["ignore"]).select("relative_path", "size", "extension", "content", F.col("modified").isNotNull().alias("dated"))
        return written(rows.filter("dated").drop("dated"), "scanned")

    return _with_tree(found).withColumn("size", F.col("size").cast("int"))


@query(_rows([("src/dead.js",), ("src/dead2.js",)], "relative_path"))
def scan_pattern(spark, d):
    return _with_tree(lambda root: written(scan_matching(spark, root, "dea[d]", DEFAULTS["ignore"]).select("relative_path"), "scanned"))


@query(_rows([("ignored", 5), ("included", 11), ("scanned", 25)], "counter, n"))
def scan_counters(spark, d):
    return spark.createDataFrame(sorted(_with_tree(lambda root: scan_stats(root, DEFAULTS["ignore"])).items()), "counter string, n int")


@query(_rows([(k, name) for k, name in enumerate((".github", "bin", "dist", "lib", "node_modules", "skip", "src"))], "place, name"))
def folder_names(spark, d):
    names = _with_tree(lambda root: [x["name"] for x in list_directories(root)["directories"]])
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


_IGNORE_CASES = [
    ("*.log", "a/b.log", False, True), ("/a.js", "b/a.js", False, False), ("build/", "x/build", True, True), ("build/", "build", False, False),
    ("**/t/*.js", "q/t/x.js", False, True), ("a/**", "a/b/c.js", False, True), ("*.js\n!k.js", "k.js", False, False), ("d/\n!d/k.js", "d/k.js", False, True),
    ("[ab].js", "b.js", False, True), ("?.js", "ab.js", False, False), ("#x\n\\#y", "#y", False, True), ("", "a.gitx/b.js", False, True),
    ("", "x/node_modules_old/a.js", False, True), ("docs", "docs/x/y.js", False, True), ("**", "any/thing.js", False, True),
]


@query(_rows(_IGNORE_CASES, "patterns, path, is_dir, ignored"))
def ignore_rules(spark, d):
    cases = [(p, path, is_dir, Ignore(p.split("\n"))(path, is_dir)) for p, path, is_dir, _ in _IGNORE_CASES]
    return spark.createDataFrame(cases, "patterns string, path string, is_dir boolean, ignored boolean")


@query(
    _rows([("entryPoints", '["x.js"]'), ("ignore", json.dumps(DEFAULTS["ignore"])), ("includeTests", "false"), ("languages", '["javascript"]'), ("outputFormat", '"json"'),
           ("thresholds.cyclomaticComplexity", "10"), ("thresholds.fileLines", "9"), ("thresholds.functionLines", "50"), ("thresholds.functionParameters", "5"), ("valid", "true")], "key, value")
)
def config_values(spark, d):
    c = Config(merge(DEFAULTS, {"entryPoints": ["x.js"], "thresholds": {"fileLines": 9}, "ignore": None}))
    rows = [(k, json.dumps(c.get(k))) for k in ("entryPoints", "ignore", "includeTests", "languages", "outputFormat")]
    rows += [(f"thresholds.{k}", json.dumps(c.threshold(k))) for k in DEFAULTS["thresholds"]] + [("valid", json.dumps(c.validate()))]
    return spark.createDataFrame(rows, "key string, value string")


@query(_rows([("custom.json",), ("none",)], "source"))
def config_search(spark, d):
    """The file that is named, else one in the folder; a file that cannot be read is passed over."""

    def found(root):
        with open(os.path.join(root, "custom.json"), "w") as f:
            f.write('{"outputFormat": "custom.json"}')
        with open(os.path.join(root, ".codeloom.json"), "w") as f:
            f.write("{no json")
        named = Config.load(os.path.join(root, "custom.json"), folder=root, home=root)
        return [(named.output_format,), ("none" if Config.load(folder=root, home=root).values == Config().values else "other",)]

    return spark.createDataFrame(_with_tree(found), "source string")


@query(_rows([("/r/src/index.js",), ("/r/bin/deep/run.js",), ("/r/src/a.js",), ("/r/src/b.js",)], "path"))
def manifest_paths(spark, d):
    return spark.createDataFrame([(p,) for p in manifest_entries(TREE["package.json"], "/r")], "path string")


def _analysed(spark: SparkSession, make, configured: dict = CONFIGURED) -> list:
    """Rows that ``make(analysis)`` returns for the tree; its root is ``/r`` in texts."""

    def found(root):
        a = Analysis.of(spark, root, Config(merge(DEFAULTS, configured)))
        return [tuple(x.replace(root, "/r") if isinstance(x, str) else x for x in row) for row in make(a)]

    return _with_tree(found)


def _ids(df: DataFrame, column: str) -> list[tuple]:
    return [tuple(r) for r in df.select(column).collect()]


@query(
    _rows([("configured", "/r/src/index.js"), ("configured", "/r/bin/deep/run.js"), ("configured", "/r/.hidden.js"), ("configured", "/r/src/broken.js"), ("configured", "/r/src/Zeta.js"),
           ("configured", "/r/skip/keep.mjs"), ("manifest", "/r/src/index.js"), ("manifest", "/r/bin/deep/run.js"), ("manifest", "/r/src/a.js"), ("manifest", "/r/src/b.js")], "rule, id")
)
def tree_entries(spark, d):
    rows = _analysed(spark, lambda a: [("configured", r.id) for r in a.entries.collect()])
    rows += _analysed(spark, lambda a: [("manifest", r.id) for r in a.entries.collect()], {"entryPoints": []})
    return spark.createDataFrame(rows, "rule string, id string")


@query(_rows([("/r/src/dead.js", True), ("/r/src/dead2.js", True), ("/r/src/a.js", False)], "path, dead"))
def tree_dead_files(spark, d):
    def dead(a):
        gone = {r.path for r in a.dead.dead_files.collect()}
        return [(p, p in gone) for p in sorted(gone | {f"{a.root}/src/a.js"})]

    return spark.createDataFrame(_analysed(spark, dead), "path string, dead boolean")


_PATH = ["/r/src/index.js", "/r/src/a.js", "/r/src/b.js"]


@query(_rows([("shortest", k, p) for k, p in enumerate(_PATH)] + [("walk", k, p) for k, p in enumerate([*_PATH[1:], "/r/src/data.json"], 1)], "kind, place, id"))
def tree_paths(spark, d):
    def found(a):
        walk = a.critical_path("src/index.js").orderBy("position").collect()
        return [("shortest", k, p) for k, p in enumerate(a.path_to("src/b.js") or [])] + [("walk", k, r.id) for k, r in enumerate(walk, 1)]

    return spark.createDataFrame(_analysed(spark, found), "kind string, place int, id string")


@query(
    _rows([("load", 1, "./lib/classes.js:1", ""), ("load", 2, "./lib/classes.js:2", ""), ("load", 3, "./src/b.js:3", ""), ("load", 4, "./src/dead.js:2", ""), ("load", 5, "./src/Zeta.js:1", ""),
           ("store", 1, "./lib/classes.js:2", ""), ("store", 2, "./lib/classes.js:3", "")], "bare, place, location, qualifiers")
)
def tree_places(spark, d):
    """Places in the order of a dictionary, in which capitals do not come first."""
    rows = _analysed(spark, lambda a: [tuple(r) for r in a.places().select("bare", "place", "location", "qualifiers").collect()])
    return spark.createDataFrame(rows, "bare string, place int, location string, qualifiers string")


@query(_rows([("parceSource", "parseSource", "0.91", 2)], "a, b, alike, places"))
def tree_similar_names(spark, d):
    from codeloom.operators.duplicates import similar_occurrences

    def found(a):
        rows = similar_occurrences(a.functions, a.similar(0.8), True)
        counted = rows.groupBy("a", "b", "similarity").agg(F.count("*").alias("places"))
        return [tuple(r) for r in counted.select("a", "b", X.fixed_point("similarity", 2).alias("alike"), "places").collect()]

    return spark.createDataFrame(_analysed(spark, found), "a string, b string, alike string, places int")


_COUNTERS = [("files", 12), ("functions", 12), ("imports", 8), ("exports", 5), ("entry_points", 6), ("external_modules", 2), ("modules", 2), ("dead_files", 2), ("reachable_files", 10),
             ("total_files", 12), ("reachability", 83), ("unused_exports", 1), ("duplicate_groups", 2), ("total_duplicates", 7), ("cross_class", 1), ("cross_file", 0)]


@query(_rows(_COUNTERS, "counter, n"))
def tree_counters(spark, d):
    return spark.createDataFrame(_analysed(spark, lambda a: [(k, int(a.stats[k])) for k, _ in _COUNTERS]), "counter string, n int")


@query(_rows([("nodes", 14), ("edges", 8), ("dead", 2), ("duplicates", 7), ("stats", 12), ("score", 61)], "part, n"))
def tree_response(spark, d):
    def found(a):
        r = a.response()
        parts = {"nodes": r["nodes"].count(), "edges": r["edges"].count(), "dead": r["nodes"].filter("is_dead").count()}
        return list((parts | {"duplicates": r["duplicates"]["groups"].count(), "stats": len(r["stats"]), "score": int(r["health"]["score"])}).items())

    return spark.createDataFrame(_analysed(spark, found), "part string, n int")


@query(_rows([("json", 14, 8), ("ntriples", None, None), ("stats", 1, None)], "kind, first, second"))
def tree_exports(spark, d):
    """Rows of the files that the sinks write; an unknown format raises."""

    def found(a):
        out = a.root + "-out"
        try:
            for kind in ("json", "ntriples", "stats"):
                a.write(kind, f"{out}/{kind}")
            lines = spark.read.text(f"{out}/ntriples")
            whole = lines.count() == a.stats["total_triples"] == lines.filter(F.col("value").endswith(" .")).distinct().count()
            rows = [("json", spark.read.json(f"{out}/json/nodes").count(), spark.read.json(f"{out}/json/edges").count())]
            return [*rows, ("ntriples", None if whole else lines.count(), None), ("stats", spark.read.json(f"{out}/stats").count(), None)]
        finally:
            shutil.rmtree(out, ignore_errors=True)

    return spark.createDataFrame(_analysed(spark, found), "kind string, first int, second int")


_REPLIES = {
    "analyze": ["# Code graph of /r", "- Files: 12", "- Nodes: 14", "- Edges: 8"],
    "dead_code": ["# Dead code of /r", "- Unreached files: 2", "- ./src/dead.js", "- ./src/dead2.js"],
    "health": ["# Health of /r", "- Quality: 15 of 20, 1 missing files"],
    "isolated": ["# Isolated files of /r", "- ./src/dead.js", "- ./src/dead2.js"],
    "hubs": ["# Hubs of /r", "1. `./src/a.js` (Medium): 2 dependents, 1 imports, 1 exports", "Changes to these 1 files bear on 2 imports."],
    "functions": ["# Functions of /r", "- Functions and methods: 12", "- Methods: 5", "- Functions a file: 1.0", "1. ./lib/classes.js: 5"],
    "duplicates": ["# Repeated names of /r", "### load: 5 places, mixed", "### store: 2 places, cross-class", "### parceSource and parseSource: 91% alike"],
}
"""Some lines of each reply."""


@query(_rows([(tool, line) for tool, lines in _REPLIES.items() for line in lines], "tool, line"))
def tool_replies(spark, d):
    more = {"hubs": {"threshold": 2, "limit": 1}, "functions": {"show_files": True}, "duplicates": {"include_similar": True}}

    def found(root):
        rows = []
        for tool, lines in _REPLIES.items():
            said = replies.answer(spark, tool, directory=root, config=None, **more.get(tool, {})).replace(root, "/r").split("\n")
            rows += [(tool, line) for line in said if line in lines]
        return rows

    return spark.createDataFrame(_with_tree(found), "tool string, line string")


@query(_rows([("analyze", "directory", True, "string"), ("hubs", "threshold", False, "integer"), ("duplicates", "similarity", False, "number"), ("functions", "show_files", False, "boolean")], "tool, argument, required, type"))
def tool_arguments(spark, d):
    rows = [(s["name"], name, name in s["inputSchema"]["required"], about["type"]) for s in replies.schemas() for name, about in s["inputSchema"]["properties"].items()]
    wanted = {("analyze", "directory"), ("hubs", "threshold"), ("duplicates", "similarity"), ("functions", "show_files")}
    return spark.createDataFrame([r for r in rows if r[:2] in wanted], "tool string, argument string, required boolean, type string")


@query(_rows([("## Unreached files",), ("- `./src/dead.js`",), ("- load: 5 places, mixed",), ("  - 2 more places",), ("1. `./src/a.js`",), ("- 2 unreached file(s) could be deleted.",)], "line"))
def report_lines(spark, d):
    wanted = {"## Unreached files", "- `./src/dead.js`", "- load: 5 places, mixed", "  - 2 more places", "1. `./src/a.js`", "- 2 unreached file(s) could be deleted."}
    rows = _analysed(spark, lambda a: [(line,) for line in replies.report(a, "src/index.js").split("\n") if line in wanted])
    return spark.createDataFrame(sorted(set(rows)), "line string")
