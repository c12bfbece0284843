"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

Rows fill memtables of a bounded size as they arrive: a memtable is a stretch of the input's order. Each is flushed as a run:
one entry for each digest, sorted by digest. Compaction
merges the runs of a level by a fan-in until one level is left and keeps, per digest, the entry
of the best row. Digests of more than one row are hits. The index's filter is a bitmap of fixed size over the hits, which
every text's digest probes: texts that pass are compared byte for byte; a digest whose texts differ is
regrouped by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import FILTERS, discard, hash_filter, materialize, passes, skew_join, with_filter

#: The characters that normalisation deletes: space and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class MergeIndex:
    """Digest -> the row that stays and the number of rows; see the module's docstring."""

    def __init__(self, memtable_rows: int = 65536, fan_in: int = 64, filters: int = FILTERS, digest=sha256_digest):
        self.memtable_rows, self.fan_in, self.filters, self.digest = memtable_rows, fan_in, filters, digest

    def rows(self, docs: DataFrame) -> DataFrame:
        """doc_id, norm, digest, ``best``: an ordering key that is least for the row to stay, and ``arrival``: place in the input."""
        points = F.length(F.coalesce("text", F.lit(""))).cast("long")
        best = F.struct((-points).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"))
        keyed = docs.select("doc_id", normalised("text").alias("norm"), best.alias("best"), F.monotonically_increasing_id().alias("arrival"))
        return keyed.withColumn("digest", self.digest(F.col("norm")))

    def flush(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Runs, numbered as they arrived: per memtable and digest one entry with its best row and count, sorted by digest;
        and the number that follows the last run's."""
        task, place = F.shiftright("arrival", 33), F.col("arrival").bitwiseAND((1 << 33) - 1)
        memtable = F.floor(place / self.memtable_rows)
        most, tasks = rows.agg(F.max(memtable), F.max(task)).first()
        each = (most or 0) + 1
        runs = (
            rows.withColumn("run", task * each + memtable)
            .groupBy("run", "digest")
            .agg(F.min("best").alias("best"), F.count("*").alias("n"))
            .sortWithinPartitions("run", "digest")
        )
        return materialize(runs, "runs"), ((tasks or 0) + 1) * each

    def compact(self, runs: DataFrame, count: int) -> DataFrame:
        """Merge levels of runs by the fan-in until each digest has one entry."""
        level = runs
        while count > self.fan_in:
            count = -(-count // self.fan_in)
            level = (
                level.withColumn("run", F.floor(F.col("run") / self.fan_in))
                .groupBy("run", "digest")
                .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            )
        return level.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))

    def maybe_hits(self, docs: DataFrame, index: DataFrame) -> DataFrame:
        """Rows, with their texts, whose digest may be that of several rows; no hit is missed."""
        key = F.xxhash64("digest")
        bitmaps = hash_filter(index.filter("n > 1"), key, filters=self.filters)
        return with_filter(self.rows(docs), key, bitmaps, self.filters).filter(passes()).select("doc_id", "digest", "norm", "best")


def exact_dedup(docs: DataFrame, index: MergeIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents are equal when their texts are equal without white space. Of equal ones the
    longest original text stays, then the smallest doc_id.

    - A null text counts as empty; all empty texts are one group.
    - A null doc_id is kept as such and stays only if its group has no other of that length.
    - Rows that repeat a doc_id and are tied for staying: ``kept`` is true for each of them, as
      nothing tells them apart; ``group_size`` counts every row.
    - An empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    index = index or MergeIndex()
    docs = docs.select("doc_id", "text")
    rows = materialize(index.rows(docs).drop("norm"), "digests")
    total = rows.count()
    runs, count = index.flush(rows)
    merged = materialize(index.compact(runs, count), "index")
    discard(runs)

    hits = index.maybe_hits(docs, merged)
    compared = hits.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    clashes = materialize(compared.filter("least <> most").select("digest"), "clashes")

    spread = F.xxhash64("doc_id", "best")
    out = skew_join(rows.drop("arrival"), merged.withColumnRenamed("best", "keep"), "digest", "n", total, spread)
    if not clashes.isEmpty():
        out = out.join(clashes, "digest", "left_anti").unionByName(_by_text(hits.join(clashes, "digest", "left_semi")))
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_text(rows: DataFrame) -> DataFrame:
    """The exact way for texts whose digests clash: groups of equal texts themselves."""
    groups = rows.groupBy("digest", "norm").agg(F.min("best").alias("keep"), F.count("*").alias("n"))
    return rows.join(groups, ["digest", "norm"]).select("digest", "doc_id", "best", "keep", "n")
