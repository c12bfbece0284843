"""Metadata from the relations against metadata of all triples, and what it moves."""

from codeloom.operators import graph
from codeloom.plans import catalogue

FILES = [
    ("a", 9, 10, False), ("urn:code:a", 10, 9, True), ("a/b", 5, 0, None), ("a:b", 0, 7, False), ("x", 1, 1, False), ("x", 20, 3, True),
    ("a-imports-b", 4, 4, False), ("/abs", 3, 3, False), ("file:///abs", 30, 1, False), ("", 1, 1, False), (None, 2, 2, True),
]
IMPORTS = [
    ("a", "b-imports-c", 9, "import", False), ("a-imports-b", "c", 10, "require", False), ("a", "b", 0, "", False), ("a", "b", 2, None, False),
    ("a", "b", 11, "require", False), ("x", "react", 1, "import", True), ("x", "react", 1, "import", True), ("x", "x", 3, "dynamic", True),
    ("a/b", "http://h/y", 1, "import", False), ("a:b", "http://h/y", 2, "import", False), ("x", None, 5, "import", False),
    ("q", None, 5, "import", False), (None, "x", 6, "import", True), ("one", "two", 7, "import", False),
]
EXPORTS = [("a", "default", "default", 1), ("a", "default", "named", 12), ("a", "default", "", 3), ("x", "", "named", 0), ("x", None, None, None), ("y", "z", "named", 5)]
FUNCTIONS = [
    ("f", "a", "function", None, None, 3, 0, True, False, False, None), ("f", "a", "method", "C", "f", 12, 2, False, False, False, "method"),
    ("", "x", "function", "", None, 0, None, None, None, None, ""), ("g", None, "function", None, None, 9, 1, True, True, True, "get"),
    ("C", "k", "function", None, None, 1, 1, True, True, True, None),
]


def _relations(spark):
    make = spark.createDataFrame
    calls = make([("a", "x", 0), ("a", "x", 9), ("a", "x", 10), ("x", "y", 0), ("x", "z", None), (None, "z", 4), ("p", "q", 4)], "caller string, callee string, line int")
    return {
        "files": make(FILES, "path string, size long, loc int, parse_error boolean"),
        "imports": make(IMPORTS, "src string, dst string, line int, type string, is_external boolean"),
        "exports": make(EXPORTS, "src string, name string, export_type string, line int"),
        "functions": make(
            FUNCTIONS, "name string, file string, type string, class_name string, method_name string, line int, params int, is_async boolean, "
            "is_static boolean, is_generator boolean, kind string",
        ),
        "entries": make([("a",), ("a",), ("urn:code:a",), ("x",), (None,)], "id string"),
    }, {
        "calls": calls,
        "classes": make([("k#C", "C", 5), ("k#C", "D", 40), ("a", "", 0)], "id string, name string, loc int"),
        "references": make([("a", "x"), ("a", "y"), ("a", "y"), (None, "y")], "src string, dst string"),
    }


def _rows(df):
    return sorted((tuple(r) for r in df.select("node", "property", "value").collect()), key=str)


def test_metadata_of_relations(spark):
    """Nodes of one id, repeats, nulls and empty texts: as the greatest value of all triples."""
    always, more = _relations(spark)
    for relations in (always, always | more):
        known = graph.facts(**relations)
        expected = _rows(graph.metadata(known.triples()))
        found = _rows(known.metadata())
        assert found == expected
        assert ("q", "imports", None) not in found and ("urn:code:q", "imports", None) in found


def test_metadata_with_a_full_filter(spark, monkeypatch):
    """A filter that takes nearly every node for a repeated one changes nothing; nor do predicates of one local name."""
    always, more = _relations(spark)
    monkeypatch.setattr(graph, "FILTER_ROWS", 1)
    known = graph.facts(**always, **more, namespaces=graph.NAMESPACES | {"graph": "urn:g#type/"})
    assert _rows(known.metadata()) == _rows(graph.metadata(known.triples()))
    g = catalogue.Graph(spark, "/root/testdata/sf0.001")
    assert _rows(g.facts.metadata()) == _rows(graph.metadata(g.facts.triples()))


def _shuffled(spark, run) -> int:
    """Rows that the queries of ``run`` wrote to shuffles."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows, executions = 0, store.executionsList()
    for k in range(before, executions.size()):
        number = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for m in range(metrics.size()):
                if metrics.apply(m).name() == "shuffle records written" and values.contains(metrics.apply(m).accumulatorId()):
                    rows += int(values.apply(metrics.apply(m).accumulatorId()).replace(",", ""))
    return rows


def test_metadata_moves_nodes_not_triples(spark, tmp_path):
    """A hash for each node and little else is shuffled; values of nodes that one row describes stay where they are."""
    sf = "/root/testdata/sf0.01"
    moved = _shuffled(spark, lambda: catalogue.QUERIES["metadata_all"](spark, sf).write.parquet(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 880482
    assert 100_000 < moved < 500_000
