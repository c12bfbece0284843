"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

from codeloom.plans import catalogue, source_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    assert name in catalogue.ORACLES
    found = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(rel.columns)
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == canonical(rel.columns, rel.fetchall())


def test_similar_occurrences_of_all_rows(spark, duck):
    """Every row of a name with a similar one is told, whatever its key."""
    found = {r.name for r in catalogue.QUERIES["similar_occurrences"](spark, SF).select("name").distinct().collect()}
    told = duck.sql(f"SELECT DISTINCT 'x' || p_partkey FROM part WHERE p_name IN (SELECT unnest([a, b]) FROM ({catalogue._SIMILAR}))").fetchall()
    assert found == {name for (name,) in told}


def test_exports_of_all_nodes_and_triples(spark):
    """As many rows as nodes and triples, none left out by prefix or predicate."""
    g = catalogue.Graph(spark, SF)
    assert catalogue.QUERIES["json_nodes"](spark, SF).count() == g.nodes.count()
    assert catalogue.QUERIES["ntriples"](spark, SF).count() == g.facts.triples().count()
    assert catalogue.QUERIES["metadata_all"](spark, SF).select("node").distinct().count() == g.facts.triples().select("s").distinct().count()
