"""Paged REST reads: a polite client, pages until the last, and a data source that reads pages in tasks."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leaguelens.functions.casts import safe_float, safe_int

#: Answers that a wait may mend, and the one by which a service turns a client away.
RETRY, DENIED = (429, 500, 502, 503, 504), 999


class RequestDenied(RuntimeError):
    """The service turned the client away."""


@dataclass
class Client:
    """Reads JSON through ``send(path) -> (status, text)``: waits between requests, tries again after growing waits, keeps answers in files."""

    send: Callable[[str], tuple[int, str]]
    cache: str | None = None
    gap_seconds: float = 0.0
    tries: int = 4
    base_wait: float = 0.5
    sleep: Callable[[float], None] = time.sleep
    stats: dict[str, int] = field(default_factory=lambda: {"requests": 0, "cached": 0, "retries": 0, "denied": 0})
    _last: float = 0.0

    def _file(self, path: str) -> str:
        return os.path.join(self.cache or "", hashlib.md5(path.encode()).hexdigest() + ".json")

    def get(self, path: str, use_cache: bool = True) -> object:
        if self.cache and use_cache and os.path.exists(self._file(path)):
            self.stats["cached"] += 1
            with open(self._file(path), encoding="utf-8") as f:
                return json.load(f)
        for attempt in range(self.tries):
            if (wait := self._last + self.gap_seconds - time.monotonic()) > 0:
                self.sleep(wait)
            self._last = time.monotonic()
            self.stats["requests"] += 1
            status, text = self.send(path)
            if status == DENIED:
                self.stats["denied"] += 1
                raise RequestDenied(path)
            if status < 400:
                break
            if status not in RETRY or attempt + 1 == self.tries:
                raise RuntimeError(f"{path}: status {status}")
            self.stats["retries"] += 1
            self.sleep(self.base_wait * 2**attempt * (1 + random.random() / 4))
        found = json.loads(text)
        if self.cache:
            os.makedirs(self.cache, exist_ok=True)
            with open(self._file(path), "w", encoding="utf-8") as f:
                json.dump(found, f)
        return found


def pages(fetch: Callable[[int, int], list[dict]], size: int, most_pages: int = 200) -> Iterator[dict]:
    """Rows of page after page, until one is short or empty or ``most_pages`` were read."""
    for page in range(most_pages):
        rows = fetch(page * size, size)
        yield from rows
        if len(rows) < size:
            return


def last_by_key(rows: Iterator[dict], key: str) -> list[dict]:
    """One row of every key, the last read, in the order of keys."""
    found = {r[key]: r for r in rows}
    return [found[k] for k in sorted(found)]


def over_seasons(load: Callable[[int], list[dict]], seasons: range | list[int]) -> list[dict]:
    """The rows of all seasons that can be loaded; an error if none can."""
    out, any_found = [], False
    for season in seasons:
        try:
            out += load(season)
            any_found = True
        except LookupError:
            continue
    if not any_found:
        raise LookupError(f"no data for seasons {list(seasons)}")
    return out


class PagedSource(DataSource):
    """Data source ``paged``: files ``offset=<n>.json`` of a folder, or of any mirror of a service, one task a page.

    Options: ``path``, ``size`` (rows of a page), ``most`` (rows in all).  Reading stops at
    the first missing page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "offset bigint, row int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.most = options["path"], int(options.get("size", 1000)), int(options.get("most", 5000))

    def partitions(self):
        offsets = []
        for at in range(0, self.most, self.size):
            if not os.path.exists(os.path.join(self.path, f"offset={at}.json")):
                break
            offsets.append(InputPartition(at))
        return offsets

    def read(self, partition):
        with open(os.path.join(self.path, f"offset={partition.value}.json"), encoding="utf-8") as f:
            for n, row in enumerate(json.load(f)[: self.most - partition.value]):
                yield partition.value, n, json.dumps(row)


def espn_players(payloads: DataFrame, season: int, stat_names: dict[str, str], column: str = "payload") -> DataFrame:
    """Player rows of payloads: names, ownership, ranks by kind, and the season's projected stats under their names, rounded to two places."""
    kind = (
        "struct<id:bigint,player:struct<fullName:string,defaultPositionId:int,proTeamId:int,ownership:struct<averageDraftPosition:double,percentOwned:double>,"
        "draftRanksByRankType:map<string,struct<rank:int,auctionValue:double>>,stats:array<struct<seasonId:int,statSourceId:int,scoringPeriodId:int,appliedTotal:double,stats:map<string,double>>>>>"
    )
    p = payloads.select(F.from_json(column, kind).alias("p")).where("p.id is not null").select("p.id", "p.player.*")
    projected = F.try_element_at(F.filter("stats", lambda s: (s["seasonId"] == season) & (s["statSourceId"] == 1) & (s["scoringPeriodId"] == 0)), F.lit(1))
    rank = lambda r, f: F.try_element_at("draftRanksByRankType", F.lit(r))[f]
    two = lambda x: F.round(x, 2)
    return p.withColumn("s", projected).select(
        F.col("id").alias("espn_id"), F.col("fullName").alias("name"), "defaultPositionId", "proTeamId", two(F.col("ownership.averageDraftPosition")).alias("adp"), two(F.col("ownership.percentOwned")).alias("percent_owned"),
        rank("STANDARD", "rank").alias("standard_rank"), rank("PPR", "rank").alias("ppr_rank"), two(F.col("s.appliedTotal")).alias("projected_points"),
        *[two(F.try_element_at("s.stats", F.lit(k))).alias(v) for k, v in stat_names.items()],
    )


def adp_page(rows: DataFrame, season: int, on: Column, cells: str = "cells") -> DataFrame:
    """Draft positions of scraped table rows in either layout.

    Rows of ten cells or more hold rank, player, position, bye, sources and last the
    average; shorter ones rank, player, position and last the average.
    """
    c = F.col(cells)
    wide = F.size(c) >= 10
    at = lambda n: F.trim(F.try_element_at(c, F.lit(n)))
    out = rows.where(F.size(c) >= 4).select(
        F.lit(season).cast("bigint").alias("season"), on.cast("date").alias("effective_date"), safe_int(at(1)).alias("rank"), at(2).alias("player_raw"),
        F.regexp_extract(at(3), "^([A-Za-z]+)", 1).alias("position"), F.when(wide, safe_int(at(4))).alias("bye_week"), safe_float(at(-1)).alias("adp"), F.when(wide, "wide").otherwise("short").alias("layout"),
    )
    return out.where("rank is not null and player_raw <> ''")


def first_layout(page: object, *parsers: Callable[[object], DataFrame | None]) -> DataFrame:
    """The rows of the first parser that finds any on a page; an error if none does."""
    for parse in parsers:
        found = parse(page)
        if found is not None and not found.isEmpty():
            return found
    raise ValueError("no known layout on the page")
