"""Streams that keep dimension tables up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leaguelens.operators.store import TableStore


def scd2_stream(stream: DataFrame, store: TableStore, table: str, keys: list[str], order: str, on: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into a slowly changing dimension; within a batch the last row of a key (by ``order``) counts."""
    from leaguelens.operators.dedup import first_by

    def merge(batch: DataFrame, _: int) -> None:
        src = first_by(batch, keys, F.desc(order))
        if not src.isEmpty():
            store.scd2(table, src, keys, F.lit(on))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema: str, archive: str | None = None) -> DataFrame:
    """New CSV files of a folder; read ones move to ``archive``."""
    reader = spark.readStream.schema(schema).option("header", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.csv(folder)


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per key and window, closed when the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")
