"""Tables, links and embedded JSON of HTML pages, and nested payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Rows (key, pos, href, label) of the anchors in each page, in order."""
    every = F.regexp_extract_all(F.col(html), F.lit(r'(<a\s[^>]*href="[^"]*"[^>]*>[^<]*)'), F.lit(1))
    out = pages.select(F.col(key), F.posexplode(every).alias("pos", "a"))
    return out.select(key, F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", r">([^<]*)$", 1).alias("label"))


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"<title>([^<]*)</title>", 1), F.lit(""))


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Rows (key, row, cells) of all HTML tables of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["h"]):
                parser = _Rows()
                parser.feed(text or "")
                out += [(k, i, r) for i, r in enumerate(parser.rows) if r]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"`{key}` {kind}, row long, cells array<string>")


def embedded_json(text: str | None, marker: str) -> str | None:
    """The JSON object after ``marker`` in a script, or None."""
    at = (text or "").find(marker)
    at = text.find("{", at) if at >= 0 else -1
    if at < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text, at)[0])
    except ValueError:
        return None


def extract_json(pages: DataFrame, marker: str, html: str = "html") -> DataFrame:
    """``pages`` with the embedded object as text in ``payload``."""

    @F.pandas_udf("string")
    def pick(s: pd.Series) -> pd.Series:
        return s.map(lambda x: embedded_json(x, marker))

    return pages.withColumn("payload", pick(F.col(html)))


def walk(payload: object) -> Iterator[dict]:
    """Every dict in a nested payload, outer ones first."""
    if isinstance(payload, dict):
        yield payload
    for child in payload.values() if isinstance(payload, dict) else payload if isinstance(payload, list) else ():
        yield from walk(child)


def records(payloads: DataFrame, column: str, required: list[str], fields: list[str]) -> DataFrame:
    """Rows with ``fields`` (as text) of every dict, at any depth, that has all ``required`` names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        for pdf in batches:
            out = [[text(d.get(f)) for f in fields] for p in pdf["p"] if p for d in walk(json.loads(p)) if all(r in d for r in required)]
            yield pd.DataFrame(out, columns=fields)

    return payloads.select(F.col(column).alias("p")).mapInPandas(run, ", ".join(f"`{f}` string" for f in fields))


def mirrored_matchups(pairs: DataFrame) -> DataFrame:
    """Two rows per pairing, one from each side; ``left`` and ``right`` are structs (team_key, points)."""
    rest = [c for c in pairs.columns if c not in ("left", "right")]
    side = lambda a, b: F.struct(F.col(a)["team_key"].alias("team_key"), F.col(b)["team_key"].alias("opponent_team_key"), F.col(a)["points"].alias("points"), F.col(b)["points"].alias("opponent_points"))
    return pairs.select(*rest, F.inline(F.array(side("left", "right"), side("right", "left"))))
