"""The decision log as a stream: the latest decision of each page, kept as a table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leafmill.operators.store import Store, latest

KEYS = ["doc_id", "page_index"]


def latest_in_batch(rows: DataFrame) -> DataFrame:
    """The last decision of each page of some rows, by time and id."""
    return latest(rows, KEYS, [F.desc("created_at"), F.desc("id")])


def into_store(stream: DataFrame, store: Store, *, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each micro-batch of pages (table ``pages``) into ``store``, into the buckets of its books only.

    A batch that is run again after a failure writes the same rows of the same keys, so it leaves the same
    table; a row older than the one in the store does not replace it.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.merge("pages", batch, "updated_at")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window, field, n: decisions an hour of their own time; rows later than the watermark are left out."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", width), "field").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, *, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """session window, decided_by, n: runs of a reviewer's decisions with no pause longer than ``gap``."""
    return stream.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), "decided_by").agg(F.count("*").alias("n"))
