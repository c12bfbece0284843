"""Dead files, unused exports and entry points."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import exprs as X
from codeloom.operators.reach import reachable


def configured_entries(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted entry points (id) that are scanned files."""
    return wanted.select("id").distinct().join(files.select(F.col("path").alias("id")), "id", "left_semi")


def unimported(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no edge leads to; an import of itself counts."""
    return files.join(edges.select(F.col("dst").alias("path")), "path", "left_anti")


def likely_entries(files: DataFrame, edges: DataFrame, exports: DataFrame, looks=None, more: tuple[str, ...] = ()) -> DataFrame:
    """id of files that nothing imports and that look like entry points or export nothing.

    ``looks`` is a condition on files in place of the patterns on paths.
    """
    free = unimported(files, edges)
    looks = X.looks_like_entry("path", more) if looks is None else looks
    has = exports.select(F.col("src").alias("path"), F.lit(True).alias("has_exports")).distinct()
    flagged = free.join(has, "path", "left").withColumn("has_exports", F.coalesce("has_exports", F.lit(False)))
    return flagged.filter(looks | ~F.col("has_exports")).select(F.col("path").alias("id"))


def matching_entries(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Files (id) whose path one of the regular expressions matches as a whole."""
    patterns = [f"(?:{p})" for p in patterns]
    hit = F.col("path").rlike(f"^(?:{'|'.join(patterns)})$") if patterns else F.lit(False)
    return files.filter(hit).select(F.col("path").alias("id"))


def entry_points(
    files: DataFrame, edges: DataFrame, exports: DataFrame, configured: DataFrame | None = None, patterns: Iterable[str] = (),
    inferred: DataFrame | None = None, **how,
) -> DataFrame:
    """Entry points (id), distinct, by the first of these rules that gives any.

    1. Configured: the named files (``configured``) and those of ``patterns``; likely ones are added. This rule holds wherever
       something is configured, found or not.
    2. ``inferred``: what a manifest names.
    3. Files that nothing imports and that look like entry points (``likely_entries``).
    4. All files.
    """
    patterns = list(patterns)
    if configured is not None or patterns:
        found = likely_entries(files, edges, exports, **how).unionByName(matching_entries(files, patterns))
        if configured is not None:
            found = found.unionByName(configured_entries(files, configured))
        return found.distinct()
    if inferred is not None:
        found = configured_entries(files, inferred)
        if not found.isEmpty():
            return found
    found = likely_entries(files, edges, exports, **how)
    return files.select(F.col("path").alias("id")) if found.isEmpty() else found


@dataclass
class DeadCode:
    """reachable_files and dead_files (path), unused_exports (src, name), stats (one row)."""

    reachable_files: DataFrame
    dead_files: DataFrame
    unused_exports: DataFrame | None
    stats: DataFrame


def unused_exports(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """Exports of files that no other file imports; the test is by file, not by name."""
    used = edges.filter("src <> dst").select(F.col("dst").alias("src")).distinct()
    return exports.join(used, "src", "left_anti")


def reach_stats(files: DataFrame, reached: DataFrame) -> DataFrame:
    """total_files, reachable_files, dead_files, reachability (percent, half up)."""
    flag = reached.select(F.col("id").alias("path"), F.lit(True).alias("hit")).distinct()
    counts = files.select("path").join(flag, "path", "left").agg(F.count("*").alias("total_files"), F.count("hit").alias("reachable_files"))
    share = F.when(F.col("total_files") > 0, X.rounded(F.col("reachable_files") / F.col("total_files") * 100)).otherwise(F.lit(0))
    dead = F.col("total_files") - F.col("reachable_files")
    return counts.select("total_files", "reachable_files", dead.alias("dead_files"), share.cast("long").alias("reachability"))


def dead_code(files: DataFrame, edges: DataFrame, exports: DataFrame, entries: DataFrame, externals: DataFrame) -> DeadCode:
    """All results of dead-code analysis; without entry points all counts are 0 and unused exports unknown."""
    if entries.isEmpty():
        none = files.select("path").limit(0)
        stats = files.sparkSession.createDataFrame([(0, 0, 0, 0, None)], "total_files long, reachable_files long, dead_files long, reachability long, unused_exports long")
        return DeadCode(none, none, None, stats)
    reached = reachable(edges, entries, externals)
    ids = reached.select(F.col("id").alias("path"))
    unused = unused_exports(exports, edges)
    count = unused.count()
    return DeadCode(
        files.select("path").join(ids, "path", "left_semi"),
        files.select("path").join(ids, "path", "left_anti"),
        unused,
        reach_stats(files, reached).withColumn("unused_exports", F.lit(count).cast("long")),
    )


def is_dead(result: DeadCode, path: str) -> bool:
    return not result.dead_files.filter(F.col("path") == path).isEmpty()
