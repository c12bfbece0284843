"""All registered queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.operators import deadcode, duplicates, graph, health, reach, visual
from codeloom.plans.driver_graph import oracle, relation
from codeloom.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "", *needs: str, name: str = ""):
    """Register a function as a query, with its oracle over the named relations."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = oracle(sql, *needs) if needs else sql
        return f

    return register


def _long(df: DataFrame) -> DataFrame:
    """Integers as longs, as DuckDB counts."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


class Graph:
    """Relations of the driver graph and what is derived from them, each built when first used.

    What several steps of a query read is written once: edges, nodes and what is reached.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        make = {
            "distinct_edges": lambda: graph.edges(self.imports),
            "edges": lambda: written(self.distinct_edges, "edges"),
            "sparse": lambda: graph.edges(self.sparse_imports),
            "nodes": lambda: written(graph.file_nodes(self.files, self.imports), "nodes"),
            "externals": lambda: graph.external_modules(self.imports),
            "export_nodes": lambda: graph.export_nodes(self.exports),
            "metrics": lambda: graph.node_metrics(self.nodes, self.edges, self.export_nodes, self.entries),
            "reached": lambda: reach.reachable(self.edges, self.entries, self.externals),
            "dead": lambda: self.nodes.select("path").join(self.reached.select(F.col("id").alias("path")), "path", "left_anti"),
            "groups": lambda: duplicates.duplicate_groups(self.functions, 2, ignore_common=False),
            "stats": lambda: deadcode.reach_stats(self.nodes, self.reached),
            "dup_stats": lambda: duplicates.duplicate_stats(self.functions, self.groups, ignore_common=False),
            "facts": lambda: graph.facts(self.files, self.imports, self.exports, self.functions, self.entries),
            "more_facts": lambda: graph.facts(
                self.timed_files, self.imports, self.exports, self.measured_functions, self.entries,
                calls=self.calls, classes=self.classes, references=self.references,
            ),
        }.get(name, lambda: relation(self.spark, self.sf_dir, name))
        made = make()
        setattr(self, name, made)
        return made

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


# Nodes and edges


@query("SELECT src, dst FROM edges", "edges")
def edges_distinct(spark, d):
    return Graph(spark, d).distinct_edges


@query("SELECT path FROM missing", "missing")
def missing_targets(spark, d):
    g = Graph(spark, d)
    return graph.missing_files(g.imports, g.files)


@query(
    "SELECT dst IN (SELECT path FROM files) AS exists, count(*) AS n, count(DISTINCT dst) AS targets FROM imports WHERE NOT is_external GROUP BY 1",
    "imports", "files",
)
def import_targets(spark, d):
    g = Graph(spark, d)
    return graph.resolved_targets(g.imports, g.files).groupBy("exists").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("targets"))


@query("SELECT id FROM externals", "externals")
def external_modules(spark, d):
    return Graph(spark, d).externals


@query("SELECT src, count(*) AS out_degree FROM edges GROUP BY src", "edges")
def out_degree(spark, d):
    return Graph(spark, d).distinct_edges.groupBy("src").agg(F.count("*").alias("out_degree"))


@query("SELECT dst, count(*) AS in_degree FROM edges GROUP BY dst", "edges")
def in_degree(spark, d):
    return Graph(spark, d).distinct_edges.groupBy("dst").agg(F.count("*").alias("in_degree"))


@query("SELECT path, import_count, dependent_count, export_count, is_missing, is_entry_point FROM metrics", "metrics")
def node_metrics(spark, d):
    return Graph(spark, d).metrics.select("path", "import_count", "dependent_count", "export_count", "is_missing", "is_entry_point")


_HUBS = """SELECT path, dependent_count, import_count, export_count, CASE WHEN dependent_count > 10 THEN 'Major' ELSE 'Medium' END AS tier
           FROM metrics WHERE NOT is_missing AND dependent_count >= 5 ORDER BY dependent_count DESC, path LIMIT 20"""


@query(_HUBS, "metrics")
def hubs_topk(spark, d):
    return graph.hubs(Graph(spark, d).metrics)


@query(f"SELECT CAST(sum(dependent_count) AS BIGINT) AS impact, count(*) AS hubs FROM ({_HUBS})", "metrics")
def hub_impact(spark, d):
    return graph.hubs(Graph(spark, d).metrics).agg(F.sum("dependent_count").alias("impact"), F.count("*").alias("hubs"))


@query(
    """SELECT a.src AS a, a.dst AS b FROM sparse_edges a JOIN sparse_edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""",
    "sparse_edges",
)
def two_cycles(spark, d):
    return graph.two_cycles(Graph(spark, d).sparse)


@query("SELECT src, dst FROM edges WHERE src = 'nation:3' UNION ALL SELECT src, dst FROM edges WHERE dst = 'nation:3'", "edges")
def neighbours(spark, d):
    return Graph(spark, d).distinct_edges.filter((F.col("src") == "nation:3") | (F.col("dst") == "nation:3"))


# Triples

_STATS = """SELECT
  (SELECT count(*) FROM nodes) + (SELECT count(*) FROM nodes WHERE size <> 0) + (SELECT count(*) FROM nodes WHERE loc <> 0)
  + (SELECT count(*) FROM files) + (SELECT count(*) FROM missing) + 2 * (SELECT count(*) FROM externals)
  + 4 * (SELECT count(*) FROM edges)
  + (SELECT count(*) FROM (SELECT DISTINCT src, dst, line FROM imports WHERE line <> 0))
  + (SELECT count(*) FROM (SELECT DISTINCT src, dst, type FROM imports))
  + 2 * (SELECT count(*) FROM (SELECT DISTINCT src, name FROM exports))
  + (SELECT count(*) FROM (SELECT DISTINCT src, name, export_type FROM exports)) + (SELECT count(*) FROM (SELECT DISTINCT src, name, line FROM exports WHERE line <> 0))
  + 8 * (SELECT count(*) FROM functions) + 3 * (SELECT count(*) FROM functions WHERE class_name IS NOT NULL)
  + (SELECT count(*) FROM functions WHERE line <> 0) + (SELECT count(*) FROM entries) AS total_triples,
  (SELECT count(*) FROM nodes) AS files, (SELECT count(*) FROM externals) AS modules, (SELECT count(*) FROM functions) AS functions,
  CAST(0 AS BIGINT) AS classes, (SELECT count(*) FROM edges) AS imports,
  (SELECT count(*) FROM (SELECT DISTINCT src, name FROM exports)) AS exports, CAST(0 AS BIGINT) AS calls,
  (SELECT count(*) FROM entries) AS entry_points, (SELECT count(*) FROM externals) AS external_modules"""


@query(_STATS, "nodes", "files", "missing", "externals", "edges", "imports", "exports", "functions", "entries")
def graph_stats(spark, d):
    return Graph(spark, d).facts.stats()


@query("SELECT src AS s, 'urn:codeloom:graph#imports' AS p, CASE WHEN dst LIKE '%:%' THEN dst ELSE 'urn:code:' || dst END AS o FROM edges", "edges")
def quads_by_predicate(spark, d):
    return Graph(spark, d).facts.triples(p=graph.NAMESPACES["graph"] + "imports").select("s", "p", "o")


@query("SELECT CASE WHEN id LIKE '%:%' THEN id ELSE 'urn:code:' || id END AS id FROM externals", "externals")
def modules_by_type(spark, d):
    return graph.nodes_of_type(Graph(spark, d).facts, "module")


@query(
    """SELECT path AS node, CASE WHEN size <> 0 THEN CAST(size AS VARCHAR) END AS size, CASE WHEN loc <> 0 THEN CAST(loc AS VARCHAR) END AS loc,
              CASE WHEN is_missing THEN 'true' END AS is_missing FROM nodes WHERE size <> 0 OR loc <> 0 OR is_missing""",
    "nodes",
)
def metadata_pivot(spark, d):
    known, N = Graph(spark, d).facts, graph.NAMESPACES
    rows = known.triples(p=N["code"] + "size").unionByName(known.triples(p=N["code"] + "loc")).unionByName(known.triples(p=N["graph"] + "isMissing"))
    wide = graph.metadata(rows).groupBy("node").pivot("property", ["size", "loc", "isMissing"]).agg(F.first("value"))
    return wide.withColumnRenamed("isMissing", "is_missing")


@query(
    """SELECT s || ' ' || cast(c AS VARCHAR) AS line FROM (
         SELECT 'file' AS s, count(*) AS c FROM nodes UNION ALL SELECT 'external-module', count(*) FROM externals
         UNION ALL SELECT 'edge', count(*) FROM edges UNION ALL SELECT 'entry', count(*) FROM entries)""",
    "nodes", "externals", "edges", "entries",
)
def graph_summary(spark, d):
    g = Graph(spark, d)
    nodes, links = graph.property_graph(g.metrics, g.externals, g.edges)
    counts = nodes.groupBy(F.col("type").alias("s")).agg(F.count("*").alias("c"))
    counts = counts.unionByName(nodes.agg(F.lit("entry").alias("s"), F.count_if("is_entry_point").alias("c")))
    counts = counts.unionByName(links.agg(F.lit("edge").alias("s"), F.count("*").alias("c")))
    return counts.select(F.concat("s", F.lit(" "), F.col("c").cast("string")).alias("line"))


@query("""SELECT '{"id":"' || path || '","size":' || size || ',"dependent_count":' || dependent_count || '}' AS json FROM metrics""", "metrics")
def json_nodes(spark, d):
    return Graph(spark, d).metrics.select(F.to_json(F.struct(F.col("path").alias("id"), "size", "dependent_count")).alias("json"))


@query("""SELECT '{"from":"' || src || '","to":"' || dst || '","type":"imports"}' AS json FROM edges""", "edges")
def json_edges(spark, d):
    g = Graph(spark, d)
    links = g.distinct_edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("imports").alias("type"))
    return links.select(F.to_json(F.struct("from", "to", "type")).alias("json"))


# All triples


def _triples_sql() -> str:
    """All distinct triples, as ``graph.quads`` makes them."""
    N = graph.NAMESPACES
    node = lambda x: f"CASE WHEN {x} LIKE '%:%' THEN {x} ELSE 'urn:code:' || {x} END"

    def iri(table, s, p, o, where="true"):
        return f"SELECT {s} AS s, '{p}' AS p, {o} AS o, 'iri' AS kind, '' AS dt FROM {table} WHERE {where}"

    def literal(table, s, p, column, dt, where):
        return f"SELECT {s}, '{p}', CAST({column} AS VARCHAR), 'literal', '{dt}' FROM {table} WHERE {where}"

    type_, label, line = N["rdf"] + "type", N["rdfs"] + "label", N["code"] + "line"
    g = lambda x: N["graph"] + x
    class_ = lambda x: f"'{g(x)}'"
    path, src, dst = node("path"), node("src"), node("dst")
    edge, export, fid = node("(src || '-imports-' || dst)"), node("(src || '#export:' || name)"), node("(file || '#' || name)")
    texts = ((label, "name"), (g("functionType"), "type"), (g("file"), "file"), (g("kind"), "kind"), (g("className"), "class_name"), (g("methodName"), "method_name"))
    flags = (("params", "params", "integer"), ("async", "is_async", "boolean"), ("generator", "is_generator", "boolean"), ("static", "is_static", "boolean"))
    parts = [
        iri("nodes", path, type_, class_("File")),
        literal("files", path, N["code"] + "size", "size", "integer", "size <> 0"),
        literal("files", path, N["code"] + "loc", "loc", "integer", "loc <> 0"),
        literal("files", path, g("parseError"), "parse_error", "boolean", "parse_error IS NOT NULL"),
        literal("missing", path, g("isMissing"), "true", "boolean", "true"),
        iri("externals", node("id"), type_, class_("Module")),
        literal("externals", node("id"), g("isExternal"), "true", "boolean", "true"),
        iri("edges", src, g("imports"), dst),
        iri("edges", edge, type_, class_("Import")),
        iri("edges", edge, g("from"), src),
        iri("edges", edge, g("to"), dst),
        literal("imports", edge, line, "line", "integer", "line <> 0"),
        literal("imports", edge, g("importType"), "type", "string", "type <> ''"),
        iri("exports", src, g("exports"), export),
        literal("exports", export, label, "name", "string", "name <> ''"),
        literal("exports", export, g("exportType"), "export_type", "string", "export_type <> ''"),
        literal("exports", export, line, "line", "integer", "line <> 0"),
        iri("functions", fid, type_, class_("Function")),
        *[literal("functions", fid, p, column, "string", f"{column} <> ''") for p, column in texts],
        literal("functions", fid, line, "line", "integer", "line <> 0"),
        *[literal("functions", fid, g(p), column, dt, f"{column} IS NOT NULL") for p, column, dt in flags],
        literal("entries", node("id"), g("isEntryPoint"), "true", "boolean", "true"),
    ]
    return f"(SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"


_TRIPLES = _triples_sql()
_RELATIONS = ("nodes", "files", "missing", "externals", "edges", "imports", "exports", "functions", "entries")


@query(f"SELECT s AS node, regexp_extract(p, '[^#/]*$') AS property, max(o) AS value FROM {_TRIPLES} GROUP BY ALL", *_RELATIONS)
def metadata_all(spark, d):
    return Graph(spark, d).facts.metadata()


@query(
    f"""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN kind = 'iri' THEN '<' || o || '>' WHEN dt = 'string' THEN '"' || o || '"'
               ELSE '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#' || dt || '>' END || ' .' AS value FROM {_TRIPLES}""",
    *_RELATIONS,
)
def ntriples(spark, d):
    return graph.ntriples(Graph(spark, d).facts.triples())


@query(f"SELECT p, o FROM {_TRIPLES} WHERE s = 'nation:3'", *_RELATIONS)
def node_triples(spark, d):
    return graph.node_triples(Graph(spark, d).facts.triples(), "nation:3").select("p", "o")


def _of_graph(*names: str) -> list[str]:
    return [graph.NAMESPACES["graph"] + n for n in names]


_CALLS, _REFERENCES, _FROM, _TO = _of_graph("calls", "references", "from", "to")
_TYPE, _LINE, _MODIFIED, _LOC, _COMPLEXITY = graph.NAMESPACES["rdf"] + "type", *(graph.NAMESPACES["code"] + n for n in ("line", "lastModified", "loc", "complexity"))
_CALL = "caller || '-calls-' || callee"


@query(
    f"""SELECT DISTINCT caller AS s, '{_CALLS}' AS p, callee AS o FROM calls UNION ALL SELECT DISTINCT {_CALL}, '{_TYPE}', '{_of_graph("Call")[0]}' FROM calls WHERE line <> 0
        UNION ALL SELECT DISTINCT {_CALL}, '{_FROM}', caller FROM calls WHERE line <> 0 UNION ALL SELECT DISTINCT {_CALL}, '{_TO}', callee FROM calls WHERE line <> 0
        UNION ALL SELECT DISTINCT {_CALL}, '{_LINE}', CAST(line AS VARCHAR) FROM calls WHERE line <> 0""",
    "calls",
)
def call_triples(spark, d):
    g = Graph(spark, d)
    none = g.imports.limit(0)
    known = graph.facts(g.files.limit(0), none, g.exports.limit(0), g.functions.limit(0), g.entries.limit(0), calls=g.calls)
    return known.triples().select("s", "p", "o")


@query("SELECT count(*) AS calls, (SELECT count(*) FROM classes) AS classes FROM (SELECT DISTINCT caller, callee FROM calls)", "calls", "classes")
def call_and_class_counts(spark, d):
    return Graph(spark, d).more_facts.stats().select("calls", "classes")


@query("SELECT DISTINCT caller || '-calls-' || callee AS id FROM calls WHERE line <> 0", "calls")
def call_nodes(spark, d):
    return graph.nodes_of_type(Graph(spark, d).more_facts, "call")


@query("SELECT id FROM classes", "classes")
def class_nodes(spark, d):
    return graph.nodes_of_type(Graph(spark, d).more_facts, "class").select(F.regexp_replace("id", "^urn:code:", "").alias("id"))


@query('SELECT DISTINCT src AS s, dst AS o FROM "references"', "references")
def reference_triples(spark, d):
    return Graph(spark, d).more_facts.triples(p=_REFERENCES).select("s", "o")


@query("SELECT path AS s, strftime(modified, '%Y-%m-%dT%H:%M:%S.000Z') AS o FROM timed_files", "timed_files")
def modified_triples(spark, d):
    return Graph(spark, d).more_facts.triples(p=_MODIFIED).select("s", "o")


@query(
    """SELECT id, loc, complexity FROM (SELECT file || '#' || name AS id, CASE WHEN loc <> 0 THEN CAST(loc AS VARCHAR) END AS loc,
              CASE WHEN complexity <> 0 THEN CAST(complexity AS VARCHAR) END AS complexity FROM measured_functions) WHERE loc IS NOT NULL OR complexity IS NOT NULL""",
    "measured_functions",
)
def function_measures(spark, d):
    known = Graph(spark, d).more_facts
    rows = known.triples(p=_COMPLEXITY).unionByName(known.triples(p=_LOC).filter(F.col("s").contains("#")))
    wide = graph.metadata(rows).groupBy("node").pivot("property", ["loc", "complexity"]).agg(F.first("value"))
    return wide.select(F.regexp_replace("node", "^urn:code:", "").alias("id"), "loc", "complexity")


@query("SELECT DISTINCT src || '#export:' || name AS export_id FROM exports", "exports")
def export_ids(spark, d):
    return graph.export_nodes(Graph(spark, d).exports).select("export_id")


@query("SELECT DISTINCT src || '-imports-' || dst AS id FROM imports", "imports")
def import_nodes(spark, d):
    return graph.nodes_of_type(Graph(spark, d).facts, "import")


# Entry points, reachability, dead code


@query("SELECT id FROM entries WHERE id IN (SELECT path FROM files)", "entries", "files")
def entry_config(spark, d):
    g = Graph(spark, d)
    return deadcode.configured_entries(g.files, g.entries)


_AUTO = """SELECT f.path AS id FROM files f WHERE f.path NOT IN (SELECT dst FROM sparse_edges)
           AND (f.size % 2 = 0 OR f.path NOT IN (SELECT src FROM exports))"""


@query(_AUTO, "files", "sparse_edges", "exports")
def entry_auto(spark, d):
    g = Graph(spark, d)
    return deadcode.likely_entries(g.files, g.sparse, g.exports, looks=F.col("size") % 2 == 0)


@query(
    f"""SELECT 'configured' AS rule, id FROM (SELECT id FROM entries WHERE id IN (SELECT path FROM files) UNION {_AUTO}
                                             UNION SELECT path FROM files WHERE path LIKE 'nation:1%')
        UNION ALL SELECT 'manifest', id FROM entries WHERE id IN (SELECT path FROM files)
        UNION ALL SELECT 'likely', id FROM ({_AUTO}) UNION ALL SELECT 'all', path FROM files""",
    "files", "sparse_edges", "exports", "entries",
)
def entry_pipeline(spark, d):
    g = Graph(spark, d)
    looks = F.col("size") % 2 == 0
    nobody = g.entries.limit(0)
    every = g.files.select(F.col("path").alias("src"))
    rules = {
        "configured": deadcode.entry_points(g.files, g.sparse, g.exports, configured=g.entries, patterns=["nation:1.*"], inferred=nobody, looks=looks),
        "manifest": deadcode.entry_points(g.files, g.sparse, g.exports, inferred=g.entries, looks=looks),
        "likely": deadcode.entry_points(g.files, g.sparse, g.exports, inferred=nobody, looks=looks),
        "all": deadcode.entry_points(g.files, g.sparse, every, inferred=nobody, looks=F.lit(False)),
    }
    found = None
    for name, ids in rules.items():
        rows = ids.select(F.lit(name).alias("rule"), "id")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("SELECT path FROM files WHERE path NOT IN (SELECT dst FROM sparse_edges)", "files", "sparse_edges")
def no_incoming(spark, d):
    g = Graph(spark, d)
    return deadcode.unimported(g.files, g.sparse).select("path")


@query("SELECT id FROM reached", "reached")
def reachable(spark, d):
    return Graph(spark, d).reached.select("id")


@query("SELECT path FROM nodes WHERE path NOT IN (SELECT id FROM reached)", "nodes", "reached")
def dead_files(spark, d):
    return Graph(spark, d).dead


@query("SELECT path FROM nodes WHERE path NOT IN (SELECT id FROM reached)", "nodes", "reached")
def isolated(spark, d):
    return Graph(spark, d).dead


@query("SELECT path FROM nodes WHERE path IN (SELECT id FROM reached)", "nodes", "reached")
def reachable_files(spark, d):
    g = Graph(spark, d)
    return g.nodes.select("path").join(g.reached.select(F.col("id").alias("path")), "path", "left_semi")


@query("SELECT DISTINCT src, name FROM exports WHERE src NOT IN (SELECT dst FROM sparse_edges WHERE src <> dst)", "exports", "sparse_edges")
def unused_exports(spark, d):
    g = Graph(spark, d)
    return deadcode.unused_exports(g.export_nodes, g.sparse).select("src", "name")


@query("SELECT total_files, reachable_files, dead_files, reachability FROM stats", "stats")
def reach_stats(spark, d):
    return Graph(spark, d).stats


@query(
    """SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM (
         SELECT id, 0 AS depth FROM entries UNION ALL SELECT dst, 1 FROM edges JOIN entries ON src = id
         UNION ALL SELECT b.dst, 2 FROM edges a JOIN entries ON a.src = id JOIN edges b ON a.dst = b.src
         UNION ALL SELECT c.dst, 3 FROM edges a JOIN entries ON a.src = id JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src)
       WHERE id NOT IN (SELECT id FROM externals) GROUP BY id""",
    "entries", "edges", "externals",
)
def shortest_path_depth(spark, d):
    return _long(Graph(spark, d).reached.select("id", "depth"))


@query(
    """SELECT dst AS id FROM edges WHERE src = 'orders:50' UNION SELECT b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'orders:50'
       UNION SELECT c.dst FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src WHERE a.src = 'orders:50'""",
    "edges",
)
def critical_path_set(spark, d):
    start = spark.createDataFrame([("orders:50",)], "id string")
    return reach.reachable(Graph(spark, d).edges, start).filter("depth > 0").select("id")


# Functions and duplicates


@query("SELECT bare, count FROM groups", "groups")
def dup_groups(spark, d):
    return Graph(spark, d).groups.select("bare", "count")


@query("SELECT bare, count, category FROM groups", "groups")
def dup_category(spark, d):
    return Graph(spark, d).groups


@query(
    """SELECT n.bare, n.name, n.file || ':' || CASE WHEN n.line > 0 THEN CAST(n.line AS VARCHAR) ELSE '?' END AS location
       FROM named n JOIN groups g USING (bare)""",
    "named", "groups",
)
def dup_occurrences(spark, d):
    g = Graph(spark, d)
    return duplicates.duplicate_occurrences(g.functions, g.groups, ignore_common=False).select("bare", "name", "location")


@query("SELECT total_functions, unique_names, duplicate_groups, total_duplicates FROM dup_stats", "dup_stats")
def dup_stats(spark, d):
    return Graph(spark, d).dup_stats.select("total_functions", "unique_names", "duplicate_groups", "total_duplicates")


@query("SELECT cross_class, redundancy FROM dup_stats", "dup_stats")
def redundancy(spark, d):
    return Graph(spark, d).dup_stats.select("cross_class", "redundancy")


@query(
    """SELECT DISTINCT p_name, lower(p_name) IN ('constructor','render','init','initialize','setup','destroy','toString','valueOf','get','set',
              'update','create','delete','handle','process','execute') AS common FROM (SELECT p_name FROM part UNION ALL SELECT 'Render' UNION ALL SELECT 'toString')"""
)
def common_name_filter(spark, d):
    names = Graph(spark, d).table("part").select("p_name").union(spark.range(1).select(F.lit("Render"))).union(spark.range(1).select(F.lit("toString")))
    return names.select("p_name", X.is_common_name("p_name").alias("common")).distinct()


_SIMILAR = """SELECT a, b, (n - dist)::DOUBLE / n AS similarity FROM (
  SELECT x.p_name AS a, y.p_name AS b, greatest(length(x.p_name), length(y.p_name)) AS n, levenshtein(x.p_name, y.p_name) AS dist
  FROM (SELECT DISTINCT p_name FROM part) x JOIN (SELECT DISTINCT p_name FROM part) y ON x.p_name < y.p_name)
  WHERE (n - dist)::DOUBLE / n >= 0.8 AND dist > 0"""


@query(_SIMILAR)
def similar_names(spark, d):
    return duplicates.similar_names(Graph(spark, d).table("part").select(F.col("p_name").alias("name")))


@query(f"""SELECT a, b, 'x' || CAST(p_partkey AS VARCHAR) AS name FROM ({_SIMILAR}) s JOIN part p ON p.p_name IN (s.a, s.b)""")
def similar_occurrences(spark, d):
    part = Graph(spark, d).table("part")
    pairs = duplicates.similar_names(part.select(F.col("p_name").alias("name")))
    rows = part.select(F.col("p_name").alias("name"), F.concat(F.lit("x"), "p_partkey").alias("file"), F.lit(0).alias("line"))
    found = duplicates.similar_occurrences(rows, pairs, ignore_common=False)
    return found.select("a", "b", F.regexp_replace("location", r":\?$", "").alias("name"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE type = 'method') AS methods, count(*) FILTER (WHERE type <> 'method') AS regular,
              count(*) FILTER (WHERE is_async) AS async_functions, count(*) FILTER (WHERE is_static) AS static_methods,
              count(*) FILTER (WHERE is_generator) AS generators, count(*) FILTER (WHERE is_async) / count(*) * 100 AS async_percent FROM functions""",
    "functions",
)
def function_stats(spark, d):
    return duplicates.function_stats(Graph(spark, d).functions)


@query("SELECT file, count(*) AS count FROM functions GROUP BY file ORDER BY count DESC, file LIMIT 10", "functions")
def functions_per_file(spark, d):
    return duplicates.functions_per_file(Graph(spark, d).functions)


@query("SELECT file || '#' || name AS id, name, type, line FROM functions", "functions")
def function_nodes(spark, d):
    return _long(graph.function_nodes(Graph(spark, d).functions).select("id", "name", "type", "line")).withColumn("line", F.col("line").cast("int"))


# Health


_SCORES = {
    "health_report": "greatest(0, CAST(floor(reachability * 0.7::DOUBLE + imports / files * 10 * 0.3::DOUBLE - redundancy * 10 + 0.5) AS BIGINT))",
    "health_cli": "CAST(floor(reachability * 0.7::DOUBLE + imports / files * 10 * 0.3::DOUBLE + 0.5) AS BIGINT)",
    "health_http": "greatest(0, CAST(floor(reachability * 0.7::DOUBLE + least(imports / files * 10, 30::DOUBLE) - redundancy * 10 + 0.5) AS BIGINT))",
    "health_client": "CAST(floor(reachable_files / files * 70 + least(imports / files * 10, 30::DOUBLE) + 0.5) AS BIGINT)",
}


def _scored(spark, d):
    g = Graph(spark, d)
    links = g.edges.agg(F.count("*").alias("imports"))
    row = g.stats.join(F.broadcast(links)).join(F.broadcast(g.dup_stats.select("redundancy", "duplicate_groups")))  # one row each
    return health.scores(row.withColumnRenamed("total_files", "files"))


def _health(name: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _scored(spark, d).select(name)
    ORACLES[name] = oracle(f"SELECT {sql} AS {name} FROM scored", "scored")


for _name, _sql in _SCORES.items():
    _health(_name, _sql)


@query(
    f"""SELECT CASE WHEN h >= 80 THEN 'Excellent' WHEN h >= 60 THEN 'Good' WHEN h >= 40 THEN 'Fair' ELSE 'Poor' END AS label
        FROM (SELECT {_SCORES["health_report"]} AS h FROM scored)""",
    "scored",
)
def health_label(spark, d):
    return _scored(spark, d).select("label")


@query(
    """SELECT connectivity + structure + quality AS health, connectivity, structure, quality FROM (
         SELECT CAST(floor(connected / files * 50 + 0.5) AS BIGINT) AS connectivity,
                least(CAST(floor((imports / files + exports / files) * 3 + 0.5) AS BIGINT), 30) AS structure, greatest(20 - missing * 5, 0) AS quality
         FROM (SELECT count(*) AS files, sum(import_count) AS imports, sum(export_count) AS exports, count(*) FILTER (WHERE is_missing) AS missing,
                      count(*) FILTER (WHERE dependent_count > 0 OR import_count > 0) AS connected FROM metrics))""",
    "metrics",
)
def health_structure(spark, d):
    return health.structure_score(Graph(spark, d).metrics).select("health", "connectivity", "structure", "quality")


@query(
    f"""SELECT NOT (total_files - s.reachable_files > 10 OR s.reachability < 70) AS report_passed, total_files = s.reachable_files AS dead_code_passed,
              {_SCORES["health_cli"].replace("reachability", "x.reachability")} >= 50 AS health_passed, duplicate_groups = 0 AS duplicates_passed
       FROM stats s, dup_stats, scored x""",
    "stats", "dup_stats", "scored",
)
def exit_conditions(spark, d):
    return health.passed(_scored(spark, d))


# Pictures


_VISUAL = """SELECT id, type, is_dead, radius, colour FROM (
  SELECT path AS id, 'file' AS type, path NOT IN (SELECT id FROM reached) AS is_dead,
         CASE WHEN is_missing THEN 14 WHEN size = 0 THEN 6 WHEN size < 1000 THEN 8 WHEN size < 5000 THEN 11 WHEN size < 10000 THEN 14
              WHEN size < 25000 THEN 18 WHEN size < 50000 THEN 23 WHEN size < 100000 THEN 28 WHEN size < 200000 THEN 34 ELSE 40 END AS radius,
         CASE WHEN parse_error THEN '#dc2626' WHEN path NOT IN (SELECT id FROM reached) THEN '#6b7280' WHEN size > 25000 AND dependent_count < 3 THEN '#f97316'
              WHEN dependent_count > 10 THEN '#4ade80' WHEN dependent_count > 5 THEN '#86efac' WHEN dependent_count = 0 THEN '#60a5fa'
              WHEN import_count > 10 THEN '#fb923c' WHEN import_count > 5 THEN '#fbbf24' ELSE '#4a9eff' END AS colour FROM metrics
  UNION ALL SELECT id, 'external-module', false, 5, '#a78bfa' FROM externals)"""


def _visual(spark, d):
    g = Graph(spark, d)
    nodes, links = graph.property_graph(g.metrics, g.externals, g.edges)
    return visual.visual_nodes(nodes, g.dead), links


@query(_VISUAL, "metrics", "externals", "reached")
def visual_nodes(spark, d):
    return _visual(spark, d)[0].select("id", "type", "is_dead", "radius", "colour")


@query('SELECT e.src AS "from", e.dst AS "to" FROM edges e WHERE e.dst NOT IN (SELECT id FROM externals)', "edges", "externals")
def visual_filter(spark, d):
    return visual.visible(*_visual(spark, d), external=False)[1].select("from", "to")


@query("SELECT path AS id FROM nodes WHERE path NOT IN (SELECT id FROM reached)", "nodes", "reached")
def visual_dead_only(spark, d):
    return visual.visible(*_visual(spark, d), dead_only=True)[0].select("id")


@query("SELECT path AS id, contains(path, 'ier:1') AS matches FROM nodes", "nodes")
def node_search(spark, d):
    return visual.search(Graph(spark, d).nodes.select(F.col("path").alias("id")), "IER:1").select("id", "matches")


# Text and sources


@query(
    r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g') <> ''
               AND NOT regexp_matches(regexp_replace(l, '^\s+', ''), '^(//|/\*|\*)'))) AS INTEGER) AS loc FROM documents"""
)
def loc_count(spark, d):
    return Graph(spark, d).table("documents").select("doc_id", X.lines_of_code("text").alias("loc"))


@query(
    r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g') <> ''
               AND NOT regexp_matches(regexp_replace(l, '^\s+', ''), '^(//|/\*|\*)'))) AS INTEGER) AS loc FROM documents ORDER BY loc DESC, doc_id LIMIT 5"""
)
def largest_files(spark, d):
    counted = Graph(spark, d).table("documents").select("doc_id", X.lines_of_code("text").alias("loc"))
    return counted.filter("loc > 0").orderBy(F.desc("loc"), "doc_id").limit(5)


_LINKS = """SELECT page_id, url, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS source FROM pages"""


@query(f"SELECT page_id, source, count(*) AS n FROM ({_LINKS}) GROUP BY page_id, source")
def link_extract(spark, d):
    links = Graph(spark, d).table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("source"))
    return links.groupBy("page_id", "source").agg(F.count("*").alias("n"))


@query(
    f"""SELECT source, source <> '' AND NOT regexp_matches(source, '^[./]') AS is_external, regexp_matches(source, '^[./]') AS is_relative
        FROM (SELECT DISTINCT source FROM ({_LINKS}) UNION SELECT DISTINCT o_orderpriority FROM orders)"""
)
def import_classify(spark, d):
    g = Graph(spark, d)
    links = g.table("pages").select(F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("source"))
    sources = links.union(g.table("orders").select("o_orderpriority")).distinct()
    return sources.select("source", X.is_external("source").alias("is_external"), X.is_relative("source").alias("is_relative"))


@query(
    """SELECT x, CASE WHEN regexp_matches(x, '^(https?|file)://') THEN x WHEN x LIKE '/%' THEN 'file://' || x WHEN x LIKE '%:%' THEN x
                 ELSE 'urn:code:' || replace(x, '/', ':') END AS id
       FROM (SELECT DISTINCT url AS x FROM pages UNION SELECT DISTINCT p_brand FROM part UNION SELECT '/a/b.js' UNION SELECT '@a/b')"""
)
def node_id(spark, d):
    g = Graph(spark, d)
    fixed = spark.createDataFrame([("/a/b.js",), ("@a/b",)], "x string")
    xs = g.table("pages").select(F.col("url").alias("x")).union(g.table("part").select("p_brand")).union(fixed).distinct()
    return xs.select("x", X.node_id("x").alias("id"))


@query(
    r"""SELECT url AS path, regexp_extract(url, '[^/]+(\.[^./]*)$', 1) AS ext, regexp_extract(url, '[^/]+(\.[^./]*)$', 1) IN ('.js','.mjs','.cjs','.jsx') AS supported FROM pages"""
)
def scan_ext_filter(spark, d):
    return Graph(spark, d).table("pages").select(F.col("url").alias("path"), X.extension("url").alias("ext"), X.is_source("url").alias("supported"))


# Scalar functions


@query(
    r"""SELECT x, coalesce(TRY_CAST(regexp_extract(x, '^\s*([+-]?[0-9]+)', 1) AS INTEGER), 0) AS n, x = 'true' AS truth
        FROM (SELECT DISTINCT CAST(o_totalprice AS VARCHAR) AS x FROM orders UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT 'true' UNION SELECT ' -7px' UNION SELECT '')"""
)
def number_and_truth(spark, d):
    g = Graph(spark, d)
    xs = g.table("orders").select(F.col("o_totalprice").cast("string").alias("x")).union(g.table("orders").select("o_orderpriority"))
    xs = xs.union(spark.createDataFrame([("true",), (" -7px",), ("",)], "x string")).distinct()
    return xs.select("x", X.int_or_zero("x").alias("n"), X.truthy("x").alias("truth"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM orders")
def iso_times(spark, d):
    return Graph(spark, d).table("orders").select("o_orderkey", X.iso_time(F.col("o_orderdate").cast("timestamp")).alias("at"))


@query("SELECT bare, CASE category WHEN 'cross-class' THEN '\U0001f504' WHEN 'cross-file' THEN '\U0001f4c1' ELSE '\u26a0\ufe0f' END AS mark FROM groups", "groups")
def category_marks(spark, d):
    return Graph(spark, d).groups.select("bare", X.category_mark("category").alias("mark"))


@query("SELECT p_partkey, printf('%.1f', (p_size + 0.01::DOUBLE) / 4) AS one, printf('%.2f', floor(p_partkey / 8 * 100 + 0.5) / 100) AS two FROM part")
def fixed_points(spark, d):
    part = Graph(spark, d).table("part")
    return part.select("p_partkey", X.fixed_point((F.col("p_size") + F.lit(0.01)) / 4, 1).alias("one"), X.fixed_point(F.col("p_partkey") / 8, 2).alias("two"))


@query(
    """SELECT id, name || CASE WHEN is_async AND is_static THEN ' [async, static]' WHEN is_async THEN ' [async]' WHEN is_static THEN ' [static]' ELSE '' END AS shown
       FROM (SELECT file || '#' || name AS id, * FROM functions)""",
    "functions",
)
def qualified_names(spark, d):
    rows = Graph(spark, d).functions
    return rows.select(F.concat("file", F.lit("#"), "name").alias("id"), F.concat("name", X.qualifiers(F.col("is_async"), F.col("is_static"))).alias("shown"))


@query(
    """SELECT url, CASE WHEN starts_with(url, 'https://www.') THEN '.' || substr(url, 13) ELSE url END AS shown, regexp_extract(url, '[^/]*$') AS label FROM pages"""
)
def shown_paths(spark, d):
    pages = Graph(spark, d).table("pages")
    return pages.select("url", X.display_path("url", "https://www.").alias("shown"), X.last_segment("url").alias("label"))


_LOOKS = r"""(/bin/|/scripts?/|server\.js$|main\.js$|app\.js$|index\.js$|\.config\.(js|mjs|cjs|ts)$|(?i:/(tests?|specs?|__tests__|__specs__)/)|\.(test|spec)\.(js|mjs|cjs|ts)$)"""
_PATHS = """SELECT path || rest AS path FROM (SELECT DISTINCT '/' || replace(p_type, ' ', '/') AS path FROM part),
  (SELECT unnest(['/bin/a.js', '/script/a.js', '/scripting/a.js', '/my-server.js', '/main.jsx', '/index.js', '/x.config.mjs', '/TESTS/a.js', '/a.spec.ts', '/a.spec.js.txt', '/custom.task.js']) AS rest)"""


@query(f"SELECT path, regexp_matches(path, '{_LOOKS}') AS likely, regexp_matches(path, '{_LOOKS}') OR regexp_matches(path, '[.]task[.]js$') AS with_custom FROM ({_PATHS})")
def likely_entry(spark, d):
    rests = ["/bin/a.js", "/script/a.js", "/scripting/a.js", "/my-server.js", "/main.jsx", "/index.js", "/x.config.mjs", "/TESTS/a.js", "/a.spec.ts", "/a.spec.js.txt", "/custom.task.js"]
    folders = Graph(spark, d).table("part").select(F.concat(F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/"))).alias("path")).distinct()
    paths = folders.select("path", F.explode(F.array(*map(F.lit, rests))).alias("rest")).select(F.concat("path", "rest").alias("path"))
    return paths.select("path", X.looks_like_entry("path").alias("likely"), X.looks_like_entry("path", ("[.]task[.]js$",)).alias("with_custom"))


@query("SELECT count(*) AS named FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE p_name END AS name FROM part) WHERE name IS NOT NULL AND name <> ''")
def unnamed_functions(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 2, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, "")
    rows = Graph(spark, d).table("part").select(name.alias("name"))
    return duplicates.named_functions(rows, ignore_common=False).agg(F.count("*").alias("named"))


@query("SELECT (SELECT count(*) FROM groups WHERE category = 'cross-class') AS cross_class, (SELECT count(*) FROM groups WHERE category = 'cross-file') AS cross_file", "groups")
def cross_counts(spark, d):
    return Graph(spark, d).dup_stats.select("cross_class", "cross_file")


@query(f"SELECT count(*) AS similar_groups FROM ({_SIMILAR})")
def similar_groups(spark, d):
    return duplicates.similar_stats(duplicates.similar_names(Graph(spark, d).table("part").select(F.col("p_name").alias("name"))))


@query("SELECT count(*) / (SELECT count(*) FROM nodes) AS per_file FROM functions", "functions", "nodes")
def functions_per_file_average(spark, d):
    g = Graph(spark, d)
    return duplicates.function_stats(g.functions, g.nodes).select("per_file")


@query("SELECT min(c_acctbal) AS min_x, max(c_acctbal) AS max_x, min(c_custkey) AS min_y, max(c_custkey) AS max_y FROM customer")
def drawing_bounds(spark, d):
    return visual.bounds(Graph(spark, d).table("customer").select(F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y")))


@query('SELECT src AS source, dst AS target, src AS "from", dst AS "to", \'imports\' AS type FROM edges', "edges")
def drawn_edges(spark, d):
    links = Graph(spark, d).distinct_edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("imports").alias("type"))
    return visual.visual_edges(links)


@query("SELECT CAST(0 AS BIGINT) AS total_files, CAST(0 AS BIGINT) AS reachable_files, CAST(0 AS BIGINT) AS dead_files, CAST(0 AS BIGINT) AS reachability, CAST(NULL AS BIGINT) AS unused_exports")
def no_entry_points(spark, d):
    g = Graph(spark, d)
    return deadcode.dead_code(g.nodes, g.edges, g.export_nodes, g.entries.limit(0), g.externals).stats


_CHAIN = "SELECT concat('customer:', c_custkey) AS src, concat('customer:', c_custkey // 2) AS dst FROM customer WHERE c_custkey > 1"


@query(
    f"""WITH RECURSIVE way AS (SELECT max(c_custkey) AS k, 1 AS step FROM customer UNION ALL SELECT k // 2, step + 1 FROM way WHERE k > 1)
        SELECT CAST(step AS BIGINT) AS step, concat('customer:', k) AS id FROM way"""
)
def shortest_path(spark, d):
    customers = Graph(spark, d).table("customer")
    half = F.expr("c_custkey div 2")
    links = customers.filter("c_custkey > 1").select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("customer:"), half).alias("dst"), F.col("c_custkey").cast("long").alias("first_seq"))
    last = customers.agg(F.max("c_custkey")).first()[0]
    path = reach.shortest_path(links, ["nobody", f"customer:{last}"], "customer:1") or []
    return spark.createDataFrame([(k, x) for k, x in enumerate(path, 1)], "step long, id string")


@query(
    """WITH RECURSIVE k AS (SELECT CAST(max(n_nationkey) AS BIGINT) AS most FROM nation),
         walk AS (SELECT CAST(1 AS BIGINT) AS n, '1' AS way FROM k UNION ALL SELECT c, way || '.' || lpad(CAST(c AS VARCHAR), 4, '0')
                  FROM (SELECT unnest([2 * n, 2 * n + 1]) AS c, way, most FROM walk, k) WHERE c <= most)
       SELECT row_number() OVER (ORDER BY way) - 1 AS position, 'nation:' || n AS id FROM walk"""
)
def preorder(spark, d):
    nations = Graph(spark, d).table("nation").filter("n_nationkey > 1")
    parent = F.expr("n_nationkey div 2")
    links = nations.select(F.concat(F.lit("nation:"), parent).alias("src"), F.concat(F.lit("nation:"), "n_nationkey").alias("dst"), F.col("n_nationkey").cast("long").alias("first_seq"))
    return reach.preorder(links, "nation:1")


@query("SELECT path, path NOT IN (SELECT id FROM reached) AS dead FROM nodes WHERE path IN ('region:0', 'orders:1', 'part:97')", "nodes", "reached")
def file_is_dead(spark, d):
    g = Graph(spark, d)
    found = deadcode.dead_code(g.nodes, g.edges, g.export_nodes, g.entries, g.externals)
    known = [r.path for r in g.nodes.filter(F.col("path").isin("region:0", "orders:1", "part:97")).collect()]
    return spark.createDataFrame([(p, deadcode.is_dead(found, p)) for p in known], "path string, dead boolean")
