"""A code graph over the driver's tables: fixed SQL that Spark and DuckDB read alike.

Rows of six tables stand for files, foreign keys for imports, brands and priorities for external
packages, part names for functions. ``{table}`` places stand for the tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

FILES = """
SELECT concat('region:', r_regionkey) AS path, CAST(0 AS BIGINT) AS size, CAST(0 AS INT) AS loc, false AS parse_error FROM {region}
UNION ALL SELECT concat('nation:', n_nationkey), CAST(n_nationkey * 100 AS BIGINT), CAST(n_nationkey AS INT), false FROM {nation}
UNION ALL SELECT concat('customer:', c_custkey), CAST(floor(abs(c_acctbal)) AS BIGINT), CAST(c_nationkey AS INT), false FROM {customer}
UNION ALL SELECT concat('supplier:', s_suppkey), CAST(floor(abs(s_acctbal) * 10) AS BIGINT), CAST(s_nationkey AS INT), false FROM {supplier}
UNION ALL SELECT concat('part:', p_partkey), CAST(floor(p_retailprice * 20) AS BIGINT), CAST(p_size AS INT), p_partkey % 89 = 0
          FROM {part} WHERE p_partkey % 97 <> 0
UNION ALL SELECT concat('orders:', o_orderkey), CAST(floor(o_totalprice) AS BIGINT), CAST(o_orderkey % 120 AS INT), false FROM {orders}
"""

IMPORTS = """
SELECT concat('orders:', l_orderkey) AS src, concat('part:', l_partkey) AS dst, CAST(l_linenumber AS INT) AS line, 'import' AS type, false AS is_external
       FROM {lineitem}
UNION ALL SELECT concat('orders:', l_orderkey), concat('supplier:', l_suppkey), CAST(l_linenumber AS INT), 'require', false FROM {lineitem}
UNION ALL SELECT concat('orders:', o_orderkey), concat('customer:', o_custkey), CAST(0 AS INT), 'import', false FROM {orders}
UNION ALL SELECT concat('orders:', o_orderkey), o_orderpriority, CAST(1 AS INT), 'require', true FROM {orders}
UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), CAST(1 AS INT), 'import', false FROM {customer}
UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), CAST(1 AS INT), 'import', false FROM {supplier}
UNION ALL SELECT concat('nation:', n_nationkey), concat('region:', n_regionkey), CAST(1 AS INT), 'import', false FROM {nation}
UNION ALL SELECT concat('part:', p_partkey), p_brand, CAST(1 AS INT), 'import', true FROM {part} WHERE p_partkey % 97 <> 0
"""

#: Few enough imports that some files are imported by nothing.
SPARSE_IMPORTS = """
SELECT concat('orders:', l_orderkey) AS src, concat('part:', l_partkey) AS dst FROM {lineitem} WHERE l_quantity >= 49
UNION ALL SELECT concat('orders:', l_orderkey), concat('supplier:', l_suppkey) FROM {lineitem} WHERE l_quantity >= 49
UNION ALL SELECT concat('orders:', o_orderkey), concat('customer:', o_custkey) FROM {orders} WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey) FROM {customer}
UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey) FROM {supplier}
UNION ALL SELECT concat('nation:', n_nationkey), concat('region:', n_regionkey) FROM {nation}
UNION ALL SELECT concat('nation:', n_nationkey), concat('nation:', n_nationkey) FROM {nation} WHERE n_nationkey < 3
UNION ALL SELECT concat('region:', n_regionkey), concat('nation:', n_nationkey) FROM {nation} WHERE n_nationkey % 7 = 0
"""

EXPORTS = """
SELECT concat('part:', p_partkey) AS src, 'default' AS name, 'default' AS export_type, CAST(p_size AS INT) AS line FROM {part} WHERE p_partkey % 97 <> 0
UNION ALL SELECT concat('part:', p_partkey), p_type, 'named', CAST(p_size + 1 AS INT) FROM {part} WHERE p_partkey % 97 <> 0
UNION ALL SELECT concat('supplier:', s_suppkey), 'default', 'default', CAST(1 AS INT) FROM {supplier}
UNION ALL SELECT concat('customer:', c_custkey), c_mktsegment, 'named', CAST(2 AS INT) FROM {customer}
"""

_BARE = "concat(replace(p_name, ' ', '_'), '_', p_partkey % 37)"

FUNCTIONS = f"""
SELECT name, file, type, class_name, method_name, line, params, is_async, is_static, is_generator, kind, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY seq DESC) AS nth FROM (
    SELECT CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '.', {_BARE}) ELSE {_BARE} END AS name,
           p_type AS file, CASE WHEN p_size % 2 = 0 THEN 'method' ELSE 'function' END AS type,
           CASE WHEN p_size % 2 = 0 THEN p_brand END AS class_name, CASE WHEN p_size % 2 = 0 THEN {_BARE} END AS method_name,
           CAST(p_size AS INT) AS line, CAST(p_partkey % 5 AS INT) AS params, p_partkey % 3 = 0 AS is_async,
           p_size % 2 = 0 AND p_partkey % 4 = 0 AS is_static, p_partkey % 11 = 0 AS is_generator,
           CASE WHEN p_size % 2 = 0 THEN 'method' END AS kind, p_partkey AS seq FROM {{part}}) AS all_functions) AS numbered
WHERE nth = 1
"""

ENTRIES = "SELECT concat('orders:', o_orderkey) AS id FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0"

CALLS = """
SELECT concat('customer:', c_custkey) AS caller, concat('nation:', c_nationkey) AS callee, CAST(c_custkey % 3 AS INT) AS line FROM {customer}
UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), CAST(7 AS INT) FROM {customer} WHERE c_custkey % 10 = 0
"""

CLASSES = "SELECT DISTINCT concat(p_type, '#', p_brand) AS id, p_brand AS name, CAST(0 AS INT) AS loc FROM {part} WHERE p_size % 2 = 0"

REFERENCES = "SELECT concat('supplier:', s_suppkey) AS src, concat('nation:', s_nationkey) AS dst FROM {supplier}"

TIMED_FILES = """
SELECT concat('orders:', o_orderkey) AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(o_orderkey % 120 AS INT) AS loc, false AS parse_error,
       CAST(o_orderdate AS TIMESTAMP) AS modified FROM {orders}
"""

RELATIONS = {
    "files": FILES, "imports": IMPORTS, "sparse_imports": SPARSE_IMPORTS, "exports": EXPORTS, "functions": FUNCTIONS, "entries": ENTRIES,
    "calls": CALLS, "classes": CLASSES, "references": REFERENCES, "timed_files": TIMED_FILES,
    "measured_functions": f"SELECT *, CAST(line % 7 AS INT) AS loc, CAST(params AS INT) AS complexity FROM ({FUNCTIONS}) AS named_functions",
}
TABLES = "region nation customer supplier part orders lineitem".split()


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of the graph as a DataFrame over the tables of a folder."""
    text = RELATIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


@cache
def duck(name: str) -> str:
    return RELATIONS[name].format(**{t: t for t in TABLES})


# Derived relations, for oracles only.
DERIVED = {
    "edges": "SELECT DISTINCT src, dst FROM imports",
    "sparse_edges": "SELECT DISTINCT src, dst FROM sparse_imports",
    "missing": "SELECT DISTINCT dst AS path FROM imports WHERE NOT is_external AND dst NOT IN (SELECT path FROM files)",
    "nodes": """SELECT path, size, loc, parse_error, false AS is_missing FROM files
                UNION ALL SELECT path, 0, 0, false, true FROM missing""",
    "externals": "SELECT DISTINCT dst AS id FROM imports WHERE is_external",
    "metrics": """SELECT n.*, coalesce(i.c, 0) AS import_count, coalesce(d.c, 0) AS dependent_count, coalesce(e.c, 0) AS export_count,
                         n.path IN (SELECT id FROM entries) AS is_entry_point
                  FROM nodes n LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) i ON n.path = i.src
                  LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) d ON n.path = d.dst
                  LEFT JOIN (SELECT src, count(DISTINCT name) AS c FROM exports GROUP BY src) e ON n.path = e.src""",
    "reached": """SELECT id FROM entries UNION
                  SELECT e.dst FROM reached r JOIN edges e ON e.src = r.id WHERE e.dst NOT IN (SELECT id FROM externals)""",
    "named": """SELECT *, CASE WHEN position('.' IN name) > 0 THEN regexp_extract(name, '[^.]*$') ELSE name END AS bare FROM functions""",
    "groups": """SELECT * FROM (SELECT bare, count(*) AS count,
                   CASE WHEN count(DISTINCT class_name) = 1 AND count(*) > 1 AND NOT bool_or(class_name IS NULL) THEN 'same-class-overload'
                        WHEN count(DISTINCT class_name) > 1 AND NOT bool_or(class_name IS NULL) THEN 'cross-class'
                        WHEN count(DISTINCT file) > 1 AND bool_or(class_name IS NULL) AND NOT bool_or(class_name IS NOT NULL) THEN 'cross-file'
                        WHEN count(DISTINCT file) = 1 AND bool_or(class_name IS NULL) AND NOT bool_or(class_name IS NOT NULL) THEN 'same-file'
                        ELSE 'mixed' END AS category FROM named GROUP BY bare) WHERE count >= 2""",
    "counted": """SELECT CAST(count(*) AS BIGINT) AS total_files, count(*) FILTER (WHERE path IN (SELECT id FROM reached)) AS reachable_files FROM nodes""",
    "stats": """SELECT total_files, reachable_files, total_files - reachable_files AS dead_files,
                       CAST(floor(reachable_files / total_files * 100 + 0.5) AS BIGINT) AS reachability FROM counted""",
    "dup": """SELECT (SELECT count(*) FROM functions) AS total_functions, (SELECT count(DISTINCT bare) FROM named) AS unique_names,
                     count(*) AS duplicate_groups, CAST(sum(count) AS BIGINT) AS total_duplicates,
                     count(*) FILTER (WHERE category = 'cross-class') AS cross_class FROM groups""",
    "dup_stats": """SELECT *, least((total_duplicates + 2 * cross_class) / (2 * total_functions), 1.0::DOUBLE)::DOUBLE AS redundancy FROM dup""",
    "scored": """SELECT total_files AS files, (SELECT count(*) FROM edges) AS imports, s.reachability, s.reachable_files, d.redundancy
                 FROM stats s, dup_stats d""",
}

_NEEDS = {
    "edges": ["imports"], "sparse_edges": ["sparse_imports"], "missing": ["imports", "files"], "nodes": ["files", "missing"],
    "externals": ["imports"], "metrics": ["nodes", "edges", "exports", "entries"], "reached": ["entries", "edges", "externals"],
    "named": ["functions"], "groups": ["named"], "counted": ["nodes", "reached"], "stats": ["counted"], "dup": ["functions", "named", "groups"],
    "dup_stats": ["dup"], "scored": ["edges", "stats", "dup_stats"],
}


def oracle(select: str, *names: str) -> str:
    """DuckDB SQL: the named relations, and what they need, as common table expressions before a query."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f'"{n}" AS (' + f"{DERIVED[n] if n in DERIVED else duck(n)})" for n in order]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
