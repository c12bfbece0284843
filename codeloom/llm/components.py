"""Connected components by alternating star contraction, without collecting links.

Up to ONE_TASK links, whose size is known then, are joined by one task instead; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, materialize, rows_of, skew_join

ONE_TASK = 1_000_000  # links, 16 MB


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the least node of the component of each: roots are hooked to lesser ones and paths cut short."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        held = list(batches)  # ONE_TASK links at most
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[c].to_numpy() for x in held)]) for c in ("a", "b"))
        nodes, roots = joined(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])

    return links.repartition(1).mapInArrow(run, "node long, root long")


def _least(links: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours, and the number of neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, max_rounds: int = 60, write=materialize) -> DataFrame:
    """node and root (the least node of its component) for every node in links (columns a, b: longs).

    Each round links every node's greater neighbours, then every node's neighbours that are not
    greater, to the least of them. It ends when each node has one link and that leads to a root; a path halves each round.
    """
    links = links.select("a", "b").filter("a <> b")
    if rows_of(links) <= ONE_TASK:
        return write(_in_one_task(links), "joined")
    now = write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        total = rows_of(now)
        # Large star: at every node, link greater neighbours to the least neighbour.
        joined = skew_join(_both(now), _least(_both(now)), "u", "n", 2 * total, F.xxhash64("v"))
        large = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write(large, "large_star")
        # Small star: at every node, link itself and its lesser neighbours to the least of them.
        joined = skew_join(large, _least(large), "u", "n", total, F.xxhash64("v"))
        lesser = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = joined.select("u", F.col("m").alias("v"))
        small = write(lesser.unionByName(own).distinct(), "small_star")
        discard(now, large)
        now = small
        if _stars(now):
            break
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()
