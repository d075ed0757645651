"""Content hashes of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(*cols: str) -> Column:
    """SHA-256 of the columns as text, nulls marked, joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")) for c in cols]), 256)


def queue_id(*cols: Column) -> Column:
    """SHA-256 of parts joined by bars; null parts are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def record_hash(df: DataFrame, dataset: str) -> DataFrame:
    """Adds ``_record_hash`` over the sorted columns as JSON, ``_dataset`` and ``_loaded_at``."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.withColumns({"_record_hash": F.sha2(body, 256), "_dataset": F.lit(dataset), "_loaded_at": F.current_timestamp()})


def frame_digest(df: DataFrame) -> tuple[int, int]:
    """Order-free digest of a frame: rows and the sum of row hashes."""
    total = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    n, s = df.agg(F.count(F.lit(1)), F.coalesce(total, F.lit(0))).first()
    return int(n), int(s)
