"""A Python data source that loads seasons incrementally from files.

Options: ``path`` (folder with one ``season=<n>.json`` file of rows per season) and
``seasons`` (comma separated, optional).  The first read takes all seasons, later ones the
latest again, whose rows may have been corrected; the offset says so and counts the reads.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def _load(path: str, season: int) -> list[tuple]:
    with open(os.path.join(path, f"season={season}.json")) as f:
        return [(int(r["season"]), str(r["key"]), json.dumps(r, sort_keys=True)) for r in json.load(f)]


def _seasons(options: dict) -> list[int]:
    found = sorted(int(n[7:-5]) for n in os.listdir(options["path"]) if n.startswith("season=") and n.endswith(".json"))
    wanted = {int(s) for s in options.get("seasons", "").split(",") if s.strip()}
    return [s for s in found if not wanted or s in wanted]


class SeasonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seasons"

    def schema(self) -> str:
        return "season bigint, key string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(s) for s in _seasons(self.options)]

    def read(self, partition):
        yield from _load(self.options["path"], partition.value)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"initial_load_complete": False, "latest_season": 0, "reads": 0}

    def read(self, start: dict):
        seasons = _seasons(self.options)
        if start["initial_load_complete"]:
            # the latest season once more, and any that came since
            seasons = [s for s in seasons if s >= max(start["latest_season"], max(seasons))] if seasons else []
        rows = [r for s in seasons for r in _load(self.options["path"], s)]
        latest = max([start["latest_season"], *seasons])
        return iter(rows), {"initial_load_complete": True, "latest_season": latest, "reads": start["reads"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        found = _seasons(self.options)
        seasons = [s for s in found if s <= end["latest_season"]] if not start["initial_load_complete"] else [s for s in found if s == end["latest_season"]]
        return iter([r for s in seasons for r in _load(self.options["path"], s)])
