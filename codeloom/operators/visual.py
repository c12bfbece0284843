"""Columns and filters of the graph picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import exprs as X


def visual_nodes(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """Nodes with is_dead, label, radius and colour."""
    flag = dead.select(F.col("path").alias("id"), F.lit(True).alias("is_dead"))
    joined = nodes.join(flag, "id", "left").withColumn("is_dead", F.coalesce("is_dead", F.lit(False)))
    radius = X.node_radius(F.col("type"), F.col("is_missing"), F.col("size"))
    colour = X.node_colour(F.col("type"), F.col("parse_error"), F.col("is_dead"), F.col("size"), F.col("dependent_count"), F.col("import_count"))
    return joined.withColumns({"label": X.last_segment("id"), "radius": radius, "colour": colour})


def bounds(points: DataFrame) -> DataFrame:
    """The least box that holds all points (x, y): min_x, max_x, min_y, max_y; nulls where there are none."""
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def visual_edges(edges: DataFrame) -> DataFrame:
    """Edges with their ends under the names of the drawing, source and target, too."""
    return edges.select("from", "to", "type", F.col("from").alias("source"), F.col("to").alias("target"))


def visible(nodes: DataFrame, edges: DataFrame, files: bool = True, external: bool = True, dead_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes that the switches leave, and edges between them; dead_only overrides the others."""
    if dead_only:
        kept = nodes.filter("is_dead")
    else:
        kept = nodes if files else nodes.filter("type <> 'file'")
        kept = kept if external else kept.filter("type <> 'external-module'")
    ids = kept.select("id")
    left = edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    return kept, left


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with ``matches``: the query occurs in id or label, whatever the case; an empty one matches all."""
    label = F.col("label") if "label" in nodes.columns else X.last_segment("id")
    q = query.lower()
    return nodes.withColumn("matches", F.lower("id").contains(q) | F.lower(label).contains(q) if q else F.lit(True))
