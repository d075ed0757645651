"""Typed rows from league payloads: nested JSON documents, one per row, in load order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.functions.casts import dash_null, safe_float, safe_int
from leaguelens.functions.stats import row_stddev
from leaguelens.functions.text import slugify, title_of_slug
from leaguelens.operators.contracts import CONTRACTS, conform
from leaguelens.operators.dedup import first_by
from leaguelens.sources.pages import records

BENCH = ("BN", "IR", "IR+", "NA")

#: Entity: the names that mark its records in a payload.
MARKS = {
    "league": ["league_key", "league_type"],
    "team": ["team_key", "team_id", "name"],
    "player": ["player_key", "player_id", "display_position"],
    "draft_pick": ["pick", "round", "team_key", "player_key"],
    "transaction": ["transaction_key", "type", "status"],
    "stat_category": ["stat_id", "display_name", "name"],
    "scoring_rule": ["stat_id", "value"],
    "standings": ["team_key", "rank", "wins", "losses"],
}


def entity(payloads: DataFrame, name: str, column: str = "payload", renames: dict[str, str] | None = None, **literals) -> DataFrame:
    """Contract rows of an entity found at any depth; ``renames`` maps payload names, literals fill what the payload lacks."""
    contract, back = CONTRACTS[name], {v: k for k, v in (renames or {}).items()}
    fields = sorted({back.get(c, c) for c in contract.types} | set(MARKS[name]))
    out = records(payloads, column, MARKS[name], fields).withColumnsRenamed(renames or {})
    out = out.withColumns({k: F.lit(v) for k, v in literals.items()}) if literals else out
    return conform(out, contract).distinct()


def games(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Games by id: the last non-empty value of each field, in load order."""
    fields = ["game_id", "game_key", "code", "name", "season"]
    found = records(payloads, column, ["game_id"], fields).withColumn("__at", F.monotonically_increasing_id())
    last = [F.max_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("__at"))).alias(c) for c in fields[1:]]
    return found.groupBy("game_id").agg(*last).orderBy("season", "game_id")


def league_keys(payloads: DataFrame, column: str = "payload") -> DataFrame:
    keys = F.regexp_extract_all(F.col(column), F.lit(r'"(\d+\.l\.\d+)"'), F.lit(1))
    return payloads.select(F.explode(keys).alias("league_key")).distinct().orderBy("league_key")


def roster(entries: DataFrame) -> DataFrame:
    """Contract rows; bench and injury slots don't start."""
    return conform(entries.withColumn("is_starting", ~F.col("selected_position").isin(*BENCH)), CONTRACTS["roster_entries"])


def best_weekly_rows(rows: DataFrame) -> DataFrame:
    """One row per league, week and player: points before none, stat lines before none, then the most points."""
    nonzero = F.coalesce(F.col("fantasy_points"), F.lit(0.0)) != 0
    has = F.coalesce(F.size("stats"), F.lit(0)) > 0
    return first_by(rows, ["league_key", "week", "player_key"], F.desc(nonzero), F.desc(has), F.desc_nulls_last("fantasy_points"))


def ranked_standings(rows: DataFrame) -> DataFrame:
    """Standings whose ranks are all zero are ranked by points within league and season."""
    w = Window.partitionBy("league_key", "season")
    place = F.row_number().over(w.orderBy(F.desc("points_for"), "team_key")).cast("bigint")
    return rows.withColumn("rank", F.when(F.coalesce(F.max("rank").over(w), F.lit(0)) == 0, place).otherwise(F.col("rank")))


def projected_players(players: DataFrame, projections: DataFrame, positions: tuple[str, ...] = ("QB", "RB", "WR", "TE", "K", "DEF")) -> DataFrame:
    """Players with their projections; only listed positions with a half-point draft position, by it."""
    out = players.join(projections, "sleeper_id", "left").where(F.col("position").isin(*positions) & F.col("adp_half_ppr").isNotNull())
    return out.orderBy("adp_half_ppr")


def wide_stats(players: DataFrame, names: dict[str, str], column: str = "season_projection") -> DataFrame:
    """A stat map as one rounded column per known stat."""
    return players.select(*[c for c in players.columns if c != column], *[F.round(F.try_element_at(F.col(column), F.lit(k)), 2).alias(v) for k, v in names.items()])


def draft_analysis(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Average pick, round, cost and share drafted of each player; a dash is no value."""
    fields = ["player_key", "average_pick", "average_round", "average_cost", "percent_drafted"]
    found = records(payloads, column, fields[:2], fields)
    return found.select("player_key", *[dash_null(F.col(c)).alias(c) for c in fields[1:]])


def adp_export(spark: SparkSession, path: str, season: int) -> DataFrame:
    """A web export with a preamble: rows follow the line that starts with ``rank,``; ADP is the mean of Min and Max."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("v"))
    body = lines.select(F.regexp_extract("v", r"(?is)(?:^|\n)(rank,.*)", 1).alias("v")).select(F.split("v", "\n").alias("l"))
    head = F.split(F.lower(F.element_at("l", 1)), ",")
    rows = body.select(head.alias("h"), F.posexplode(F.slice("l", 2, 1_000_000)).alias("at", "row")).where("trim(row) <> ''")
    cells = F.regexp_extract_all("row", F.lit(r'("[^"]*"|[^,]*)(?:,|$)'), F.lit(1))
    cell = lambda name: F.trim(F.replace(F.try_element_at(F.col("c"), F.array_position("h", name).cast("int")), F.lit('"'), F.lit("")))
    rows = rows.withColumn("c", cells).where(F.array_position("h", "rank") > 0)
    low, high = safe_float(cell("min")), safe_float(cell("max"))
    return rows.select(safe_int(cell("rank")).alias("rank"), cell("player").alias("full_name"), cell("position").alias("position"), F.round((low + high) / 2, 1).alias("adp"), F.lit(season).cast("bigint").alias("season"))


def player_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Players linked in pages: id, slug and the name of the next image, else of the slug; the first of an id counts."""
    pattern = r'(?s)(href="/nfl/players/\d+/[^"]+"[^>]*data-player.{0,2000})'
    found = pages.select(F.col(key), F.posexplode(F.split(F.col(html), r'(?=href="/nfl/players/)')).alias("at", "part")).where(F.col("part").rlike(pattern))
    ident = r'^href="/nfl/players/(\d+)/([^"]+)"'
    alt = F.nullif(F.regexp_extract(F.substring("part", 1, 2000), r'<img[^>]*alt="([^"]*)"', 1), F.lit(""))
    out = found.select(key, "at", F.regexp_extract("part", ident, 1).alias("fl_id"), F.regexp_extract("part", ident, 2).alias("slug"), alt.alias("alt"))
    return first_by(out, ["fl_id"], F.col(key), F.col("at")).select("fl_id", "slug", F.coalesce("alt", title_of_slug(F.col("slug"))).alias("full_name"))


def players_of_adp(adp: DataFrame) -> DataFrame:
    """Player rows with slug ids from draft-position rows."""
    return adp.select(slugify(F.col("full_name"), F.col("team")).alias("fp_player_id"), "full_name", F.split("full_name", " ", 2)[0].alias("first_name"), F.try_element_at(F.split("full_name", " ", 2), F.lit(2)).alias("last_name"), "position", "team").distinct()


def rank_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = [F.col(c) for c in columns]
    return df.withColumns({"high": F.least(*cols).cast("bigint"), "low": F.greatest(*cols).cast("bigint"), "stdev": row_stddev(*cols)})


def canonical_registry(players: DataFrame, ids: DataFrame, schedules: DataFrame, version: str) -> dict[str, DataFrame]:
    """Players, teams, positions and the source map from league-wide feeds.

    The id is the first non-empty of several; every ``*_id`` column of ``ids`` becomes a
    source system; teams are all home and away codes.
    """
    first = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("gsis_id", "player_id", "nfl_id", "pfr_id") if c in players.columns])
    names = F.array_sort(F.array_distinct(F.filter(F.array("display_name", F.concat_ws(" ", "first_name", "last_name")), lambda x: F.trim(x) != "")))
    known = players.withColumn("canonical_player_id", first).where("canonical_player_id is not null")
    out = {"players": first_by(known, ["canonical_player_id"], F.col("display_name")).select("canonical_player_id", "display_name", "first_name", "last_name", F.col("team").alias("current_team"), F.col("position").alias("primary_position"), names.alias("aliases"), F.lit(version).alias("source_version"))}
    codes = schedules.select(F.col("home_team").alias("code")).union(schedules.select("away_team")).where("code is not null").distinct()
    out["teams"] = codes.select(F.col("code").alias("canonical_team_id"), F.col("code").alias("canonical_team_name"), F.col("code").alias("canonical_team_abbr"), F.array("code").alias("aliases"), F.lit(version).alias("source_version"))
    out["positions"] = known.select(F.col("position").alias("canonical_position_code")).where("canonical_position_code is not null").distinct().withColumn("canonical_position_id", F.col("canonical_position_code"))
    others = [c for c in ids.columns if c.endswith("_id") and c != "gsis_id"]
    long = ids.where("gsis_id is not null").select("gsis_id", *[F.col(c).cast("string").alias(c) for c in others]).unpivot(["gsis_id"], others, "source", "source_entity_id")
    out["source_map"] = long.where("trim(source_entity_id) <> ''").select(F.regexp_replace("source", "_id$", "").alias("source_system"), "source_entity_id", F.col("gsis_id").alias("canonical_player_id"), F.lit("registry").alias("provenance")).distinct()
    return out


_LEAGUE_FIELDS = ("season", "name", "game_code", "scoring_type", "league_type", "num_teams", "start_week", "end_week", "current_week")


def league_metadata(payloads: DataFrame, key: str = "league_key", column: str = "payload") -> DataFrame:
    """One row per league: of every field the first value in document order; ids come from the key.

    Text fields take the first text; numbers the first that is there, a season of 0 or
    nothing counts as none.
    """
    import json

    import pandas as pd

    from leaguelens.sources.pages import walk

    def first(payload: str | None, name: str) -> str | None:
        for item in walk(json.loads(payload)) if payload else ():
            v = item.get(name)
            if name in ("name", "game_code", "scoring_type", "league_type"):
                if isinstance(v, str) and v:
                    return v
            elif v is not None and (name != "season" or str(v).strip() not in ("", "0")):
                return str(v)
        return None

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([[k, *[first(p, n) for n in _LEAGUE_FIELDS]] for k, p in zip(pdf["k"], pdf["p"])], columns=["league_key", *_LEAGUE_FIELDS])

    found = payloads.select(F.col(key).alias("k"), F.col(column).alias("p")).mapInPandas(run, "league_key string, " + ", ".join(f"{n} string" for n in _LEAGUE_FIELDS))
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda n: safe_int(F.col(n)).alias(n)
    return found.select(
        "league_key", F.coalesce(F.try_element_at(F.split("league_key", r"\.l\."), F.lit(2)), F.lit("")).alias("league_id"), safe_int(F.element_at(F.split("league_key", r"\."), 1)).alias("game_id"),
        F.lower(text(F.col("game_code"))).alias("game_code"), F.coalesce(safe_int(F.col("season")), F.lit(0)).alias("season"), text(F.col("name")).alias("league_name"),
        text(F.col("scoring_type")).alias("scoring_type"), text(F.col("league_type")).alias("league_type"), *[number(n) for n in _LEAGUE_FIELDS[5:]],
    )


def team_entries(entries: DataFrame, league: str = "league_key", column: str = "payload") -> DataFrame:
    """Teams of payloads that hold one team's list of single-field objects each.

    The id follows ``.t.`` in the key, else 0; the owner is the nickname of the first
    manager; entries without a key go.
    """
    kind = "array<struct<team_key:string,name:string,draft_position:string,managers:array<struct<manager:struct<nickname:string>>>>>"
    parts = F.from_json(F.col(column), kind)
    one = lambda f: F.try_element_at(F.filter(F.transform(parts, f), lambda x: x.isNotNull() & (x != "")), F.lit(1))
    key = one(lambda p: p["team_key"])
    out = entries.select(
        key.alias("team_key"), F.col(league).alias("league_key"), F.coalesce(safe_int(F.try_element_at(F.split(key, r"\.t\."), F.lit(2))), F.lit(0)).alias("team_id"),
        F.coalesce(one(lambda p: p["name"]), F.lit("")).alias("team_name"), F.coalesce(one(lambda p: F.try_element_at(p["managers"], F.lit(1))["manager"]["nickname"]), F.lit("")).alias("owner_name"),
        safe_int(one(lambda p: p["draft_position"])).alias("draft_position"),
    )
    return out.where("team_key is not null")


def auth_code(raw: str) -> str:
    """The code in a pasted address, query or bare text."""
    from urllib.parse import parse_qs, urlparse

    text = (raw or "").strip()
    if text.startswith(("http://", "https://")):
        return parse_qs(urlparse(text).query).get("code", [""])[0].strip()
    if "code=" in text:
        return parse_qs(text.lstrip("?")).get("code", [""])[0].strip()
    return text.split("&state=", 1)[0].strip()
