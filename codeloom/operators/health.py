"""Health scores: five formulas over the same one-row statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.exprs import health_label, rounded


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(row: DataFrame) -> DataFrame:
    """report, cli, http and client scores, with labels, from files, imports, reachability, reachable_files, redundancy.

    report: 0.7 reachability + 0.3 connectivity - 10 redundancy, at least 0; connectivity is ten imports a file.
    cli: the same without redundancy. http: connectivity up to 30 in full. client: from counts of reachable files.
    """
    c = F.col
    connectivity = _ratio(c("imports"), c("files")) * 10
    capped = F.least(connectivity, F.lit(30.0))
    zero = F.lit(0).cast("long")
    report = F.greatest(zero, rounded(c("reachability") * 0.7 + connectivity * 0.3 - c("redundancy") * 10))
    cli = rounded(c("reachability") * 0.7 + connectivity * 0.3)
    http = F.greatest(zero, rounded(c("reachability") * 0.7 + capped - c("redundancy") * 10))
    client = F.when(c("files") > 0, rounded(c("reachable_files") / c("files") * 70 + capped)).otherwise(zero)
    out = row.select("*", report.alias("health_report"), cli.alias("health_cli"), http.alias("health_http"), client.alias("health_client"))
    return out.withColumn("label", health_label(c("health_report")))


def structure_score(metrics: DataFrame) -> DataFrame:
    """The fifth formula: connected files, imports and exports a file, and missing files, in one pass over node metrics."""
    c = F.col
    linked = (c("dependent_count") > 0) | (c("import_count") > 0)
    row = metrics.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("import_count"), F.lit(0)).alias("imports"),
        F.coalesce(F.sum("export_count"), F.lit(0)).alias("exports"),
        F.count_if(linked).alias("connected"),
        F.count_if(c("dependent_count") > 0).alias("with_dependents"),
        F.count_if(c("import_count") > 0).alias("with_imports"),
        F.count_if("is_missing").alias("missing"),
    )
    connectivity = rounded(_ratio(c("connected"), c("files")) * 50)
    structure = F.least(rounded((_ratio(c("imports"), c("files")) + _ratio(c("exports"), c("files"))) * 3), F.lit(30).cast("long"))
    quality = F.greatest(F.lit(20).cast("long") - c("missing") * 5, F.lit(0).cast("long"))
    out = row.select("*", connectivity.alias("connectivity"), structure.alias("structure"), quality.alias("quality"))
    total = c("connectivity") + c("structure") + c("quality")
    return out.withColumn("health", total).withColumn("label", health_label(total))


def passed(row: DataFrame) -> DataFrame:
    """Exit conditions of the commands: few dead files and enough reached, none dead, health, no duplicates."""
    c = F.col
    return row.select(
        (~((c("dead_files") > 10) | (c("reachability") < 70))).alias("report_passed"),
        (c("dead_files") == 0).alias("dead_code_passed"),
        (c("health_cli") >= 50).alias("health_passed"),
        (c("duplicate_groups") == 0).alias("duplicates_passed"),
    )
