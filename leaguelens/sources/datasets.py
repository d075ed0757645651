"""Typed season data sets and their registry: casts, metadata, keys, and how each is ingested."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.functions.casts import safe_float, safe_int, truthy
from leaguelens.functions.dates import lenient_date, lenient_utc
from leaguelens.functions.hashing import record_hash

# The columns of each data set that are not text.
INTEGERS = {
    "pbp": "season week qtr down yardline_100 yards_gained drive",
    "player_stats": "season week completions attempts carries receptions targets",
    "team_stats": "season week games wins losses ties",
    "schedules": "season week home_score away_score",
    "players": "entry_year rookie_year height weight",
    "rosters": "season",
    "rosters_weekly": "season week",
    "snap_counts": "season week offense_snaps defense_snaps special_teams_snaps",
    "nextgen_stats": "season week",
    "ftn_charting": "season week",
    "participation": "season week offense_snaps defense_snaps special_teams_snaps",
    "draft_picks": "season round pick overall",
    "injuries": "season week",
    "contracts": "year_signed year_expire years total_value guaranteed",
    "officials": "season week",
    "combine": "year height weight bench",
    "depth_charts": "season week depth_team",
    "trades": "season",
    "ff_playerids": "",
    "ff_rankings": "season week rank pos_rank tier",
    "ff_opportunity": "season week carries targets",
}
NUMBERS = {
    "pbp": "epa wp wpa air_yards yards_after_catch",
    "player_stats": "passing_yards rushing_yards receiving_yards fantasy_points_ppr",
    "team_stats": "points_for points_against epa_offense epa_defense",
    "snap_counts": "offense_pct defense_pct special_teams_pct",
    "nextgen_stats": "avg_time_to_throw avg_air_yards_to_sticks completion_percentage_above_expectation",
    "ftn_charting": "yac_over_expected air_yards_share target_share",
    "participation": "offense_pct defense_pct special_teams_pct",
    "combine": "forty vertical broad_jump cone",
    "ff_rankings": "points",
    "ff_opportunity": "xfp ra_xfp re_xfp",
}
FLAGS = {
    "pbp": "shotgun no_huddle qb_dropback rush_attempt pass_attempt two_point_attempt",
    "schedules": "div_game overtime",
    "players": "active",
    "injuries": "did_not_practice questionable doubtful out",
}
DATES = {"pbp": "game_date", "schedules": "gameday game_date", "players": "birth_date", "injuries": "report_date", "trades": "trade_date"}
TIMES = {"schedules": "gametime"}

#: Columns that identify a row of the connector's tables; all but play_by_play are snapshots.
KEYS = {
    "play_by_play": ("play_id", "game_id"),
    "player_stats_weekly": ("player_id", "season", "week", "season_type"),
    "player_stats_seasonal": ("player_id", "season", "season_type"),
    "schedules": ("game_id",),
    "rosters": ("player_id", "season", "week"),
    "teams": ("team_abbr",),
    "snap_counts": ("pfr_player_id", "season", "week"),
    "depth_charts": ("gsis_id", "season", "week", "position", "depth_position"),
}


@dataclass(frozen=True)
class Table:
    """What a connector says of a table."""

    name: str
    keys: tuple[str, ...]
    ingestion: str
    options: dict[str, str] = field(default_factory=dict)


def tables() -> list[Table]:
    return [Table(name, keys, "cdc" if name == "play_by_play" else "snapshot") for name, keys in KEYS.items()]


def read_deletes(name: str) -> DataFrame:
    """Deletes aren't reported by any table."""
    raise NotImplementedError(f"{name}: deletes are not supported")


def next_offset(table: str, start: dict, seasons: list[int], incremental: bool = False) -> tuple[list[int], dict]:
    """Seasons to load and the offset after them.

    Snapshots load every season each time and are complete then.  Play-by-play loads all
    once; with ``incremental`` only the latest season after that, again each time, so that
    its corrections arrive.
    """
    if not seasons:
        raise ValueError("no seasons")
    if table != "play_by_play":
        return sorted(seasons), {"completed": True}
    latest = max(seasons)
    load = [latest] if incremental and start.get("initial_load_complete") else sorted(seasons)
    return load, {"initial_load_complete": True, "latest_season": latest}


def casts(dataset: str, columns: list[str]) -> dict[str, Column]:
    """Lenient casts of the columns of a data set that are not text; an unknown data set has none."""
    kinds = ((INTEGERS, safe_int), (NUMBERS, safe_float), (FLAGS, truthy), (DATES, lenient_date), (TIMES, lenient_utc))
    out = {c: cast(F.col(c)) for table, cast in kinds for c in table.get(dataset, "").split() if c in columns}
    if "_loaded_at" in columns:
        out["_loaded_at"] = lenient_utc(F.col("_loaded_at"))
    return out


def typed(df: DataFrame, dataset: str) -> DataFrame:
    """``df`` with the types of its data set; what can't be read is null, other columns stay."""
    return df.withColumns(casts(dataset, df.columns)) if dataset in INTEGERS else df


def load(spark: SparkSession, path: str, dataset: str, seasons: list[int] | None = None) -> DataFrame:
    """A data set from files (csv by its suffix, else Parquet): its seasons, typed, with content hash, name and load time."""
    if dataset not in INTEGERS:
        raise KeyError(f"unknown data set '{dataset}'")
    raw = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)
    out = typed(raw, dataset)
    if seasons and "season" in out.columns:
        out = out.where(F.col("season").isin(*seasons))
    return record_hash(out, dataset)
