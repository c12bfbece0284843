"""End-to-end analysis of a source tree, and its results as JSON, N-Triples and exit conditions."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from codeloom.functions import exprs as X
from codeloom.operators import deadcode, duplicates, graph, health, reach, visual
from codeloom.sources.config import Config, manifest_entries
from codeloom.sources.scan import parse_files, pattern_regex, relations, scan
from codeloom.tables import written


@dataclass
class Analysis:
    """Lazily built results over one scanned and parsed tree; relations are written once."""

    spark: SparkSession
    root: str
    config: Config
    tables: dict[str, DataFrame]
    threshold: int = 2
    ignore_common: bool = True

    @classmethod
    def of(cls, spark: SparkSession, root: str, config: Config | None = None, dynamic_imports: bool = False, **options) -> Analysis:
        """Scan and parse root; raises FileNotFoundError where it is no directory."""
        root = os.path.abspath(root)
        if not os.path.isdir(root):
            raise FileNotFoundError(f"no such directory: {root}")
        config = config or Config()
        files = written(scan(spark, root, config.ignore), "files")
        parsed = written(parse_files(files, dynamic_imports), "parsed")
        found = {name: written(df, name) for name, df in relations(files, parsed).items()}
        return cls(spark, root, config, found, **options)

    @cached_property
    def nodes(self) -> DataFrame:
        return written(graph.file_nodes(self.tables["files"], self.tables["imports"]), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return written(graph.edges(self.tables["imports"]), "edges")

    @cached_property
    def externals(self) -> DataFrame:
        return graph.external_modules(self.tables["imports"])

    @cached_property
    def exports(self) -> DataFrame:
        return written(graph.export_nodes(self.tables["exports"]), "exports")

    @cached_property
    def functions(self) -> DataFrame:
        return written(graph.function_nodes(self.tables["functions"]), "functions")

    @cached_property
    def entries(self) -> DataFrame:
        """Entry points among all file nodes: configured paths and globs, else the manifest's, else likely ones, else all files."""
        names = self.spark.createDataFrame([(p,) for p in self.config.entry_points if not is_glob(p)], "path string")
        named = names.select(X.normalise_path(F.concat(F.lit(self.root + "/"), "path")).alias("id"))
        globs = [re.escape(self.root) + "/" + pattern_regex(p.removeprefix("./"))[0].pattern for p in self.config.entry_points if is_glob(p)]
        try:
            with open(os.path.join(self.root, "package.json"), encoding="utf-8") as f:
                inferred = manifest_entries(f.read(), self.root)
        except OSError:
            inferred = []
        found = deadcode.entry_points(
            self.nodes, self.edges, self.exports,
            configured=named if self.config.entry_points else None,
            patterns=globs,
            inferred=self.spark.createDataFrame([(p,) for p in inferred], "id string"),
            more=tuple(self.config.entry_patterns),
        )
        return written(found, "entries")

    @cached_property
    def metrics(self) -> DataFrame:
        return written(graph.node_metrics(self.nodes, self.edges, self.exports, self.entries), "metrics")

    @cached_property
    def facts(self) -> graph.Facts:
        t = self.tables
        return graph.facts(t["files"], t["imports"], t["exports"], self.functions, self.entries)

    @property
    def triples(self) -> DataFrame:
        return self.facts.triples()

    @cached_property
    def dead(self) -> deadcode.DeadCode:
        return deadcode.dead_code(self.nodes, self.edges, self.exports, self.entries, self.externals)

    @cached_property
    def groups(self) -> DataFrame:
        return written(duplicates.duplicate_groups(self.functions, self.threshold, self.ignore_common), "groups")

    @cached_property
    def stats(self) -> dict:
        """Counters, dead-code and duplicate statistics, and all scores, in one dict of numbers."""
        row = self.facts.stats().first().asDict() | self.dead.stats.first().asDict()
        row |= duplicates.duplicate_stats(self.functions, self.groups, self.ignore_common).first().asDict()
        one = self.spark.createDataFrame(
            [(row["files"], row["imports"], row["reachability"], row["reachable_files"], float(row["redundancy"]))],
            "files long, imports long, reachability long, reachable_files long, redundancy double",
        )
        return row | health.scores(one).first().asDict()

    def displayed(self, column: str) -> Column:
        """A path as reports show it: below the root with a leading dot."""
        return X.display_path(column, self.root)

    # Sinks

    def graph_json(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (with is_dead) and edges of the property graph, ids as in the triple view."""
        nodes, links = graph.property_graph(self.metrics, self.externals, self.edges)
        nodes = visual.visual_nodes(nodes, self.dead.dead_files)
        return nodes.withColumn("id", X.node_id("id")), links.withColumns({"from": X.node_id("from"), "to": X.node_id("to")})

    def write(self, kind: str, path: str) -> None:
        """json (nodes and edges), ntriples or stats as files below path."""
        if kind == "json":
            nodes, links = self.graph_json()
            nodes.write.mode("overwrite").json(f"{path}/nodes")
            links.write.mode("overwrite").json(f"{path}/edges")
        elif kind == "ntriples":
            graph.ntriples(self.triples).write.mode("overwrite").text(path)
        elif kind == "stats":
            self.facts.stats().write.mode("overwrite").json(path)
        else:
            raise ValueError(f"unknown export format: {kind}")

    def passed(self) -> dict[str, bool]:
        """Whether each command would end well."""
        s = self.stats
        return {
            "report": not (s["dead_files"] > 10 or s["reachability"] < 70),
            "dead_code": s["dead_files"] == 0,
            "health": s["health_cli"] >= 50,
            "duplicates": s["duplicate_groups"] == 0,
        }

    def places(self, most: int | None = None, each: int | None = None) -> DataFrame:
        """bare, count, category, and places of the duplicate names, most frequent first, ties by where a name was first seen.

        place: number in the group, by file (in the order of a dictionary) and line. ``most`` groups and ``each`` places of them are
        kept; other rows go before anything is gathered.
        """
        first = duplicates.named_functions(self.functions, self.ignore_common).groupBy("bare").agg(F.min("seq").alias("first_seen"))
        top = self.groups.join(first, "bare")
        if most is not None:
            top = top.orderBy(F.desc("count"), "first_seen").limit(most)
        rows = duplicates.duplicate_occurrences(self.functions, top, self.ignore_common)
        rows = rows.join(top.select("bare", "first_seen"), "bare").withColumn("location", self.displayed("location"))
        order = Window.partitionBy("bare").orderBy(F.collate(F.coalesce("file", F.lit("")), "UNICODE"), F.coalesce("line", F.lit(0)))
        rows = rows.withColumn("place", F.row_number().over(order))
        return rows if each is None else rows.filter(F.col("place") <= each)

    def similar(self, threshold: float) -> DataFrame:
        """Pairs of different names at least this alike: a, b, similarity."""
        named = duplicates.named_functions(self.functions, self.ignore_common)
        return duplicates.similar_names(named.select(F.col("bare").alias("name")), threshold)

    def hubs(self, threshold: int = 5, limit: int = 20) -> DataFrame:
        return graph.hubs(self.metrics, threshold, limit)

    def structure(self) -> DataFrame:
        return health.structure_score(self.metrics)

    def function_report(self) -> tuple[DataFrame, DataFrame]:
        """Counts by kind, and files of most functions."""
        return duplicates.function_stats(self.functions), duplicates.functions_per_file(self.functions)

    def critical_path(self, entry: str) -> DataFrame:
        """position and id of the files that an entry point leads to, in the order of a walk into depth; without the entry itself."""
        start = os.path.normpath(os.path.join(self.root, entry))
        return reach.preorder(self.edges, start).filter((F.col("id") != start) & F.col("id").startswith("/"))

    def response(self) -> dict:
        """What a graph viewer asks for: nodes (with is_dead) and edges as DataFrames, statistics, health, and the ten largest duplicate
        groups as rows of their places."""
        nodes, links = self.graph_json()
        s = self.stats
        return {
            "nodes": nodes,
            "edges": visual.visual_edges(links),
            "stats": {k: s[k] for k in COUNTERS} | {"reachable_files": s["reachable_files"], "dead_files": s["dead_files"]},
            "health": {"score": s["health_http"], "reachability": s["reachability"], "redundancy": s["redundancy"]},
            "duplicates": {"groups": self.places(10), "stats": {k: s[k] for k in DUPLICATE_COUNTERS}},
        }

    def path_to(self, target: str) -> list[str] | None:
        """The import path by which an entry point reaches a file; the first entry point that does counts."""
        starts = (r.id for r in self.entries.orderBy("id").toLocalIterator())
        return reach.shortest_path(self.edges, starts, os.path.normpath(os.path.join(self.root, target)))


COUNTERS = "total_triples files modules functions classes imports exports calls entry_points external_modules".split()
DUPLICATE_COUNTERS = "total_functions unique_names duplicate_groups total_duplicates cross_class cross_file redundancy".split()


def is_glob(path: str) -> bool:
    return any(c in path for c in "*?[")
