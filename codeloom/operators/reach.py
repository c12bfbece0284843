"""Reachability and paths by frontier loops: one round of joins for each level, no driver-side graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.tables import written


def reachable(edges: DataFrame, sources: DataFrame, blocked: DataFrame | None = None, max_rounds: int = 1_000_000) -> DataFrame:
    """id and depth of all nodes that sources (id) reach over edges (src, dst), themselves included.

    Nodes of ``blocked`` (id), such as external modules, are not entered. Edges are written once,
    without those into blocked nodes, and held by their source, so that a round moves only the last level's
    nodes and what they lead to. A graph deeper than ``max_rounds`` raises.
    """
    usable = edges.select("src", "dst").filter("src <> dst")
    if blocked is not None:
        usable = usable.join(blocked.select(F.col("id").alias("dst")), "dst", "left_anti")
    usable = written(usable.select("src", "dst"), "usable_edges")
    held = usable.repartition("src").persist()  # lost parts are read again from the written table
    front = written(sources.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    seen = front
    levels = 1
    try:
        for depth in range(1, max_rounds + 1):
            step = front.join(held, front["id"] == held["src"]).select(F.col("dst").alias("id")).distinct()
            step = step.join(seen.select("id"), "id", "left_anti")
            front = written(step.withColumn("depth", F.lit(depth)), "reach")
            if front.isEmpty():
                return seen
            seen, levels = seen.unionByName(front), levels + 1
            if levels % 16 == 0:  # few tables to look seen nodes up in, however deep the graph
                seen = written(seen, "reached")
    finally:
        held.unpersist()
    raise RuntimeError(f"nodes more than {max_rounds} steps away")


def shortest_path(edges: DataFrame, sources: Iterable[str], target: str, max_depth: int = 1_000_000) -> list[str] | None:
    """The path by which the first of the sources, in order, that reaches target does so in fewest steps.

    Of several parents on a level the one queued first counts, by edge order (first_seq). The
    result is one path; levels stay distributed. Sources that do not reach the target are told from those that do by one search from
    the target backwards. A path longer than ``max_depth`` raises.
    """
    edges = written(edges.select("src", "dst", "first_seq"), "path_edges")
    spark = edges.sparkSession
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    leads = written(reachable(back, spark.createDataFrame([(target,)], "id string")).select("id"), "leads")
    edges = written(edges.join(leads.withColumnRenamed("id", "src"), "src", "left_semi"), "useful_edges")
    for source in sources:
        if leads.filter(F.col("id") == source).isEmpty():
            continue
        if source == target:
            return [source]
        level = written(spark.createDataFrame([(source, None, 0)], "id string, parent string, rank long"), "level")
        levels, seen = [level], level.select("id")
        for _ in range(max_depth):
            by_parent = Window.partitionBy("dst").orderBy("rank", "first_seq")
            step = level.join(edges, level["id"] == edges["src"]).select("dst", F.col("id").alias("parent"), "rank", "first_seq")
            step = step.withColumnRenamed("dst", "id").join(seen, "id", "left_anti").withColumnRenamed("id", "dst")
            step = step.withColumn("n", F.row_number().over(by_parent)).filter("n = 1")
            # Ranks need to be ordered, not dense: a parent's rank and the edge's order make one.
            order = F.struct("rank", "first_seq")
            ranked = step.select(F.col("dst").alias("id"), "parent", order.alias("o"))
            level = written(_dense(ranked), "level")
            if level.isEmpty():
                break
            levels.append(level)
            seen = written(seen.unionByName(level.select("id")), "seen")
            if not level.filter(F.col("id") == target).isEmpty():
                path, at = [], target
                for found in reversed(levels):
                    path.append(at)
                    at = found.filter(F.col("id") == at).first()["parent"]
                return path[::-1]
        else:
            raise RuntimeError(f"a path of more than {max_depth} steps")
    return None


def _dense(level: DataFrame) -> DataFrame:
    """Ranks of a level's rows by their order column, by sorted ranges instead of one window."""
    sorted_rows = written(level.orderBy("o.rank", "o.first_seq").withColumn("p", F.spark_partition_id()), "ranked")
    counts = sorted_rows.groupBy("p").count()
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("p").orderBy("o.rank", "o.first_seq"))
    return sorted_rows.withColumn("k", own).join(starts, "p").select("id", "parent", (F.col("start") + F.col("k")).alias("rank"))


def preorder(edges: DataFrame, source: str) -> DataFrame:
    """Depth-first order of the nodes that source reaches (position, id), children in edge order.

    The order is inherently sequential: one task walks the edges among reached nodes. Use
    ``reachable`` where the set is enough.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(source,)], "id string")
    inside = reachable(edges, start).select("id")
    own = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "first_seq")

    def walk(frame):
        import pandas as pd

        children: dict[str, list[str]] = {}
        for src, dst in frame.sort_values("first_seq")[["src", "dst"]].itertuples(index=False):
            children.setdefault(src, []).append(dst)
        order, seen, stack = [], set(), [source]
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                order.append(node)
                stack.extend(reversed(children.get(node, ())))
        return pd.DataFrame({"position": range(len(order)), "id": order})

    marked = own.unionByName(spark.createDataFrame([(source, source, -1)], "src string, dst string, first_seq long"))
    return marked.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(walk, "position long, id string")
