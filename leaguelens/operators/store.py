"""A versioned table store on plain Parquet: each write is a new version, made current at once; appends write new rows only."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.functions.hashing import frame_digest
from leaguelens.operators.change import bootstrap, classify, scd2_counts, scd2_merge, upsert


@dataclass(frozen=True)
class WriteResult:
    table: str
    rows: int
    written: int


def _whole(parts: list[tuple[int, bool, str]]) -> int:
    """Index of the last folder that holds a whole version."""
    return max(i for i, (_, adds, _) in enumerate(parts) if not adds)


class TableStore:
    """Tables under ``root``; reading and writing data goes through Spark, version names through its file system."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self, table: str) -> list[tuple[int, bool, str]]:
        """Committed folders of a table in order: version, whether it only adds rows to the one before, path."""
        where = self._path(f"{self.root}/{table}")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        done = [n for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS"))]
        return sorted((int(n[2:].removesuffix(".add")), n.endswith(".add"), f"{self.root}/{table}/{n}") for n in done)

    def versions(self, table: str) -> list[int]:
        return [n for n, _, _ in self._parts(table)]

    def tables(self) -> list[str]:
        where = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where) if s.isDirectory()) if self._fs.exists(where) else []

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A version: the last whole one up to it and the rows appended since."""
        parts = [p for p in self._parts(table) if version is None or p[0] <= version]
        paths = [path for _, _, path in parts[_whole(parts) :]]
        return self.spark.read.option("mergeSchema", str(len(paths) > 1).lower()).parquet(*paths)

    def _write(self, table: str, df: DataFrame, have: list[tuple[int, bool, str]], adds: bool) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v={(have[-1][0] if have else 0) + 1:06d}{'.add' if adds else ''}")

    def overwrite(self, table: str, df: DataFrame) -> None:
        """Write the next version whole; a version counts once its commit marker is there."""
        have = self._parts(table)
        self._write(table, df, have, False)
        kept = len(have) - min(self.keep - 1, len(have)) if self.keep > 1 else len(have)
        # appended rows need the whole version before them
        for _, _, old in have[: _whole(have[: kept + 1]) if kept < len(have) else kept]:
            self._fs.delete(self._path(old), True)

    def append(self, table: str, df: DataFrame) -> None:
        """Write only the new rows, as a version that adds to the one before.

        The table is rewritten only where the type of one of its columns has to widen.
        """
        if not self.exists(table):
            return self.overwrite(table, df)
        now = self.read(table)
        both = now.unionByName(df, allowMissingColumns=True)
        if [f.dataType for f in both.schema][: len(now.columns)] != [f.dataType for f in now.schema]:
            return self.overwrite(table, both)
        types = {f.name.lower(): f for f in both.schema}
        fields = [(c, types[c.lower()]) for c in df.columns]
        self._write(table, df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in fields]), self._parts(table), True)

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        self.overwrite(table, upsert(self.read(table), df, keys) if self.exists(table) else df)

    def scd2(self, table: str, df: DataFrame, keys: list[str], on: Column, tracked: list[str] | None = None) -> dict[str, int]:
        if not self.exists(table):
            self.overwrite(table, bootstrap(df, on))
            return {"expired": 0, "inserted": self.read(table).count(), "unchanged": 0}
        now = self.read(table)
        body = tracked or [c for c in df.columns if c not in keys]
        counts = scd2_counts(classify(now.where("is_current"), df, keys, body))
        self.overwrite(table, scd2_merge(now, df, keys, on, body))
        return counts

    def write_once(self, table: str, df: DataFrame, keys: list[str]) -> bool:
        """Upsert unless the same content was written before; False if it was."""
        digest = json.dumps([table, *frame_digest(df)])
        log = "_digests"
        if self.exists(log) and not self.read(log).where(F.col("digest") == digest).isEmpty():
            return False
        self.upsert(table, df.dropDuplicates(keys), keys)
        self.append(log, self.spark.createDataFrame([(digest,)], "digest string"))
        return True

    def persist(self, tables: dict[str, DataFrame], mode: str = "overwrite", prefix: str = "", dry_run: bool = False) -> list[WriteResult]:
        """Write named frames; empty ones are skipped, a dry run only counts."""
        out = []
        for name, df in tables.items():
            rows = df.count()
            if rows and not dry_run:
                (self.overwrite if mode == "overwrite" else self.append)(prefix + name, df)
            out.append(WriteResult(prefix + name, rows, 0 if dry_run else rows))
        return out

    def inventory(self) -> list[tuple[str, int]]:
        return [(t, self.read(t).count()) for t in self.tables() if self.exists(t)]


def write_files(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Frames as parquet, csv or json files."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported file format {kind}")
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).option("header", "true").save(os.path.join(folder, name))
