"""Frames made ready for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = ("game_id", "season", "week")


def for_display(df: DataFrame, keep: tuple[str, ...] = (), places: int = 2) -> DataFrame:
    """Key and id columns hidden unless kept (never all of them), floats and decimals rounded."""
    hidden = [c for c in df.columns if c.endswith(("_key", "_id")) and c not in keep and c not in SHOWN]
    shown = [c for c in df.columns if c not in hidden] or df.columns
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c) for c in shown])
