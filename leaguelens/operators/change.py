"""Slowly changing dimensions and upserts on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("ingestion_date", "end_date", "is_current")


#: The end of a row that holds.
OPEN_END = "9999-12-31"


def bootstrap(src: DataFrame, on: Column, open_end: str | None = OPEN_END) -> DataFrame:
    """First version of a table: every row current, up to ``open_end`` (None: no date)."""
    return src.withColumns({"ingestion_date": on.cast("date"), "end_date": F.lit(open_end).cast("date"), "is_current": F.lit(True)})


def classify(current: DataFrame, src: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """Keys with class: untouched (only in the table), unchanged, changed, new."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")) for c in tracked]), 256)
    a = current.select(*keys, digest.alias("__old"))
    b = src.select(*keys, digest.alias("__new"))
    kind = (
        F.when(F.col("__new").isNull(), "untouched")
        .when(F.col("__old").isNull(), "new")
        .when(F.col("__old") == F.col("__new"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("class"))


def scd2_merge(target: DataFrame, src: DataFrame, keys: list[str], on: Column, tracked: list[str] | None = None, open_end: str | None = OPEN_END) -> DataFrame:
    """Next version of a dimension table.

    Changed current rows end on ``on``, their new versions and new keys open; history
    and keys missing from ``src`` stay.  ``src`` must hold each key once.
    """
    body = [c for c in target.columns if c not in META]
    tracked = tracked or [c for c in body if c not in keys]
    current = target.where("is_current")
    classes = classify(current, src, keys, tracked)
    flagged = current.join(classes, keys, "left")
    hit = F.col("class") == "changed"
    kept = flagged.withColumns({"end_date": F.when(hit, on.cast("date")).otherwise(F.col("end_date")), "is_current": ~F.coalesce(hit, F.lit(False))})
    opened = bootstrap(src.join(classes.where("class in ('changed', 'new')").select(*keys), keys, "left_semi").select(*body), on, open_end)
    columns = target.columns
    return target.where("not is_current").unionByName(kept.select(*columns)).unionByName(opened.select(*columns))


def scd2_counts(classes: DataFrame) -> dict[str, int]:
    n = {r["class"]: r["count"] for r in classes.groupBy("class").count().collect()}
    return {"expired": n.get("changed", 0), "inserted": n.get("changed", 0) + n.get("new", 0), "unchanged": n.get("unchanged", 0)}


def upsert(target: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``src``, and those of ``target`` whose key it lacks."""
    return target.join(src.select(*keys), keys, "left_anti").unionByName(src, allowMissingColumns=True)


def relaxed_union(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null, types widen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
