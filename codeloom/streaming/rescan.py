"""Incremental re-analysis: parsed files arrive as a stream, the latest record of each path counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import last_wins
from codeloom.tables import written


class LatestFiles:
    """State of a re-scan: the newest row of each path, kept as a written table that each batch replaces.

    Rows have path and a version column; a row with null content stands for a deleted file.
    """

    def __init__(self, version: str = "version"):
        self.version = version
        self.table: DataFrame | None = None

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Fold a batch in; the same batch twice changes nothing, and older versions lose."""
        rows = batch if self.table is None else self.table.unionByName(batch)
        self.table = written(last_wins(rows, ["path"], self.version), "latest")
        return self.table

    def current(self) -> DataFrame:
        if self.table is None:
            raise ValueError("no batch has arrived yet")
        return self.table.filter(F.col("content").isNotNull())

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start a query that folds every micro-batch of a stream of files in."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.merge)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
