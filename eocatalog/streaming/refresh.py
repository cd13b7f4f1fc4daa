"""Refresh as a stream of dataset changes.

The change feed is a streaming DataFrame; each micro-batch is one run of the catalogue. A batch that died on its way
starts again from the tables before it, and one that had got through changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eocatalog.operators.catalogue import Catalogue


class StreamingRefresh:
    """A catalogue below a folder, kept current by a stream of changes, which may come in any order."""

    def __init__(self, spark: SparkSession, path: str, tz: str = "Australia/Darwin", listeners: tuple[Callable[[DataFrame], None], ...] = ()):
        """listeners are called with the month cells that a batch has made again."""
        self.catalogue, self.feed = Catalogue(spark, f"{path}/store", tz), "direct"
        self.listeners = listeners

    def extents(self) -> DataFrame | None:
        return self.catalogue.extents()

    def cells(self) -> DataFrame | None:
        return self.catalogue.month_cells()

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch. epoch is its number in its feed; the same number twice in a row is the same batch."""
        self.catalogue.listeners = self.listeners
        self.catalogue.apply(batch, f"{self.feed}-{epoch}")

    def start(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        self.feed = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
