"""Duplicate and similar function names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import exprs as X


def named_functions(functions: DataFrame, ignore_common: bool = True) -> DataFrame:
    """Functions with a name, with ``bare``: without class; common names left out if wanted."""
    kept = functions.filter("name IS NOT NULL AND name <> ''").withColumn("bare", X.bare_name("name"))
    return kept.filter(~X.is_common_name("bare")) if ignore_common else kept


def duplicate_groups(functions: DataFrame, threshold: int = 2, ignore_common: bool = True) -> DataFrame:
    """bare, count and category of names that occur at least ``threshold`` times.

    Counts of distinct classes and files and of plain functions are combined before the shuffle.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    classed = F.when(F.col("class_name") != "", F.col("class_name"))
    filed = F.when(F.col("file") != "", F.col("file"))
    groups = named_functions(functions, ignore_common).groupBy("bare").agg(
        F.count("*").alias("count"),
        F.count_distinct(classed).alias("classes"),
        F.count_distinct(filed).alias("files"),
        F.bool_or(classed.isNull()).alias("plain"),
        F.bool_or(classed.isNotNull()).alias("method"),
    )
    plain, method = F.col("plain"), F.col("method")
    category = (
        F.when((F.col("classes") == 1) & (F.col("count") > 1) & ~plain, "same-class-overload")
        .when((F.col("classes") > 1) & ~plain, "cross-class")
        .when((F.col("files") > 1) & plain & ~method, "cross-file")
        .when((F.col("files") == 1) & plain & ~method, "same-file")
        .otherwise("mixed")
    )
    return groups.filter(F.col("count") >= threshold).select("bare", "count", category.alias("category"))


def duplicate_occurrences(functions: DataFrame, groups: DataFrame, ignore_common: bool = True) -> DataFrame:
    """Each occurrence of a duplicate name with its location and qualifiers."""
    rows = named_functions(functions, ignore_common).join(groups.select("bare", "count", "category"), "bare")
    place = X.location(F.col("file"), F.col("line"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "bare", "count", "category", "name", "file", "line", F.coalesce("params", F.lit(0)).alias("params"), place.alias("location"),
        X.qualifiers(flag("is_async"), flag("is_static")).alias("qualifiers"),
    )


def duplicate_stats(functions: DataFrame, groups: DataFrame, ignore_common: bool = True) -> DataFrame:
    """One row: total_functions (all), unique_names (kept ones), duplicate_groups, total_duplicates, cross_class, cross_file, redundancy."""
    named = named_functions(functions, ignore_common)
    a = functions.agg(F.count("*").alias("total_functions"))
    b = named.agg(F.count_distinct("bare").alias("unique_names"))
    c = groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_duplicates"),
        F.count_if(F.col("category") == "cross-class").alias("cross_class"),
        F.count_if(F.col("category") == "cross-file").alias("cross_file"),
    )
    row = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    worth = (F.col("total_duplicates") + 2 * F.col("cross_class")) / (2 * F.col("total_functions"))
    return row.withColumn("redundancy", F.when(F.col("total_functions") > 0, F.least(worth, F.lit(1.0))).otherwise(0.0))


def similar_names(names: DataFrame, threshold: float = 0.8, q: int = 2) -> DataFrame:
    """a < b (column name) and similarity, of distinct names at least ``threshold`` alike but not equal.

    Pairs are found by shared character grams, not by comparing all names: d edits spoil at most q * d
    of a name's distinct grams, so of its q * d + 1 rarest a name alike enough has one among its own q * d + 1 rarest, and common
    grams meet nobody. Names with no more than q * d grams meet by length instead. The exact similarity decides.
    """
    distinct = names.select("name").filter("name IS NOT NULL").distinct().withColumn("n", F.length("name"))
    padded = F.concat(F.lit("\u0001" * (q - 1)), "name", F.lit("\u0001" * (q - 1)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q))))
    longest = F.ceil(F.col("n") / F.lit(threshold) + 1e-9)  # of a partner, and more
    spoilt = (q * F.floor(longest * (1 - F.lit(threshold)) + 1e-9)).cast("int")
    keyed = distinct.select("name", "n", grams.alias("grams"), spoilt.alias("spoilt")).withColumn("sure", F.size("grams") > F.col("spoilt"))
    each = keyed.filter("sure").select("name", "n", "spoilt", F.explode("grams").alias("gram"))
    ranked = each.join(each.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("df", "gram"))), F.lit(1), F.first("spoilt") + 1)
    listed = ranked.groupBy("name").agg(F.first("n").alias("n"), rarest.alias("rarest"))
    listed = listed.select("name", "n", F.explode("rarest").alias("r")).filter("r.df > 1").select("name", "n", "r.gram")
    limit = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9
    met = listed.alias("a").join(listed.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.name") < F.col("b.name")) & limit)
    met = met.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))
    short = keyed.filter("NOT sure").select("name", "n")
    lengths = F.explode(F.sequence(F.floor(F.col("n") * threshold).cast("int"), F.ceil(F.col("n") / threshold).cast("int")))
    by_length = short.select("name", "n", lengths.alias("m")).alias("a").join(distinct.alias("b"), F.col("a.m") == F.col("b.n"))
    by_length = by_length.filter((F.col("a.name") != F.col("b.name")) & limit).select(
        F.least("a.name", "b.name").alias("a"), F.greatest("a.name", "b.name").alias("b")
    )
    pairs = met.unionByName(by_length).distinct()
    # The distance is not computed beyond what the threshold allows.
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * (1 - threshold) + 1e-9).cast("int")
    pairs = pairs.withColumns({"most": most, "longest": F.greatest(F.length("a"), F.length("b"))})
    near = pairs.withColumn("distance", F.levenshtein("a", "b")).filter("distance <= most AND distance > 0")
    near = near.withColumn("similarity", (F.col("longest") - F.col("distance")) / F.col("longest"))
    return near.filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def similar_occurrences(functions: DataFrame, pairs: DataFrame, ignore_common: bool = True) -> DataFrame:
    """Occurrences of both names of each similar pair."""
    named = named_functions(functions, ignore_common).select("bare", "name", "file", "line")
    side = lambda name, k: pairs.select("a", "b", "similarity", F.col(name).alias("bare"), F.lit(k).alias("side"))
    place = X.location(F.col("file"), F.col("line"))
    return side("a", 1).unionByName(side("b", 2)).join(named, "bare").select("a", "b", "similarity", "side", "name", place.alias("location"))


def similar_stats(pairs: DataFrame) -> DataFrame:
    """One row: similar_groups, the number of similar pairs."""
    return pairs.agg(F.count("*").alias("similar_groups"))


def function_stats(functions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row of counts by kind of function, the share that is asynchronous and, given the files, functions a file."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    method = F.coalesce(F.col("type") == "method", F.lit(False))
    row = functions.agg(
        F.count("*").alias("total"), F.count_if(method).alias("methods"), F.count_if(~method).alias("regular"),
        flag("is_async").alias("async_functions"), flag("is_static").alias("static_methods"), flag("is_generator").alias("generators"),
    )
    share = F.when(F.col("total") > 0, F.col("async_functions") / F.col("total") * 100).otherwise(0.0)
    row = row.withColumn("async_percent", share)
    if files is None:
        return row
    counted = row.join(F.broadcast(files.agg(F.count("*").alias("files"))))  # one row each
    return counted.withColumn("per_file", F.when(F.col("files") > 0, F.col("total") / F.col("files")).otherwise(0.0)).drop("files")


def functions_per_file(functions: DataFrame, limit: int = 10) -> DataFrame:
    """Files of most functions, ties by file."""
    counts = functions.filter("file IS NOT NULL AND file <> ''").groupBy("file").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "file").limit(limit)
