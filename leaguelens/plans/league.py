"""League queries over contract-shaped frames.

Sorting is part of a query's contract where it sorts.  Null placement follows the
results to match: nulls first in either direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.functions.stats import n_unique, share_pct, sum0
from leaguelens.functions.text import position_order
from leaguelens.operators.change import relaxed_union

WEEK = ["league_key", "season", "week"]


def _hide(df: DataFrame, include_keys: bool) -> DataFrame:
    return df if include_keys else df.drop(*[c for c in df.columns if c.endswith("_key")])


def _need(df: DataFrame, *names: str) -> DataFrame:
    missing = {n: F.lit(None).cast("string") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def league_team_info(league: DataFrame, team: DataFrame, include_keys: bool = False) -> DataFrame:
    names = league.select("league_key", "season", "league_name")
    out = team.join(names, "league_key", "left").select("season", "league_name", "team_name", "owner_name", "league_key", "team_key")
    return _hide(out.orderBy(F.asc_nulls_first("season"), F.asc_nulls_first("league_name"), F.asc_nulls_first("team_name")), include_keys)


def standings_summary(standings: DataFrame, league: DataFrame | None = None, team: DataFrame | None = None, include_keys: bool = False) -> DataFrame:
    out = standings
    if league is not None:
        out = out.join(league.select("league_key", "season", "league_name"), ["league_key", "season"], "left")
    if team is not None:
        out = out.join(team.select("league_key", "team_key", "team_name", "owner_name"), ["league_key", "team_key"], "left")
    out = _need(out, "league_name", "team_name", "owner_name").select(
        "season", "league_name", "team_name", "owner_name", "rank", "wins", "losses", "points_for", "points_against", "league_key", "team_key"
    )
    return _hide(out.orderBy(F.asc_nulls_first("season"), F.desc_nulls_first("wins"), F.desc_nulls_first("points_for")), include_keys)


def player_weekly_points(roster: DataFrame, stats: DataFrame) -> DataFrame:
    mine = roster.select(*WEEK, "team_key", "player_key", "selected_position", "is_starting", F.col("points").alias("roster_points"))
    out = mine.join(stats.select(*WEEK, "player_key", "fantasy_points"), [*WEEK, "player_key"], "left")
    return out.withColumn("player_points", F.coalesce("roster_points", "fantasy_points", F.lit(0.0)))


def matchup_points(matchups: DataFrame) -> DataFrame:
    out = matchups.select(*WEEK, "team_key", F.col("points").alias("team_points"))
    return out.orderBy(F.asc_nulls_first("season"), F.asc_nulls_first("week"), F.desc_nulls_first("team_points"))


def team_points_from_stats(stats: DataFrame, roster: DataFrame) -> DataFrame:
    """Sums by team and week; the roster joins without the season, players on no roster form a null team."""
    teams = roster.select("league_key", "week", "team_key", "player_key")
    out = stats.select(*WEEK, "player_key", "fantasy_points").join(teams, ["league_key", "week", "player_key"], "left")
    return out.groupBy(*WEEK, "team_key").agg(sum0(F.col("fantasy_points")).alias("team_points"), n_unique(F.col("player_key")).alias("players_counted"))


def weekly_team_points(stats: DataFrame | None, roster: DataFrame | None, matchups: DataFrame | None) -> tuple[DataFrame | None, str]:
    """Weekly points and where they come from: player stats if any are positive, else matchups, else nothing."""
    if stats is not None and roster is not None:
        top = stats.agg(F.max("fantasy_points").alias("m")).unionByName(roster.agg(F.max("points").alias("m")))
        if (top.agg(F.max("m")).first()[0] or 0) > 0:
            out = team_points_from_stats(stats, roster)
            return out.orderBy(F.asc_nulls_first("season"), F.asc_nulls_first("week"), F.desc_nulls_first("team_points")), "player_stats"
    if matchups is not None:
        return matchup_points(matchups), "matchups"
    known = stats if stats is not None else roster
    if known is None:
        return None, "unavailable"
    schema = "league_key string, season bigint, week bigint, team_key string, team_points double, players_counted bigint"
    return known.sparkSession.createDataFrame([], schema), "unavailable"


def weekly_team_points_resolved(stats: DataFrame | None, roster: DataFrame | None, matchups: DataFrame | None) -> tuple[DataFrame | None, str]:
    out, source = weekly_team_points(stats, roster, matchups)
    if source == "player_stats" and matchups is not None:
        rows, top = out.agg(F.count(F.lit(1)), F.max("team_points")).first()
        if rows and not top:
            return matchup_points(matchups), "matchups"
    return out, source


def enrich_weekly_points(points: DataFrame, league: DataFrame, team: DataFrame, include_keys: bool = True) -> DataFrame:
    out = points.join(league.select("league_key", "season", "league_name"), ["league_key", "season"], "left")
    out = out.join(team.select("league_key", "team_key", "team_name", "owner_name"), ["league_key", "team_key"], "left")
    return _hide(out.select("season", "week", "league_name", "team_name", "owner_name", "team_points", "league_key", "team_key"), include_keys)


def position_weekly_points(pwp: DataFrame) -> DataFrame:
    out = pwp.where("is_starting").groupBy(*WEEK, "selected_position")
    return out.agg(sum0(F.col("player_points")).alias("total_points"), F.avg("player_points").alias("avg_points"), n_unique(F.col("player_key")).alias("players"))


def team_position_weekly_points(pwp: DataFrame) -> DataFrame:
    out = pwp.where("is_starting").groupBy(*WEEK, "team_key", "selected_position")
    return out.agg(sum0(F.col("player_points")).alias("position_points"), n_unique(F.col("player_key")).alias("players"))


def position_usage(roster: DataFrame) -> DataFrame:
    return roster.groupBy(*WEEK, "team_key", "selected_position").agg(n_unique(F.col("player_key")).alias("players"))


def latest_roster(team_key: str, roster: DataFrame, stats: DataFrame, player: DataFrame) -> DataFrame:
    """The team's roster in the last week of all seasons taken together."""
    mine = roster.where(F.col("team_key") == team_key)
    last = mine.withColumn("__last", F.max("week").over(Window.partitionBy("team_key"))).where("week = __last").drop("__last")
    out = player_weekly_points(last, stats).join(player.select("player_key", "full_name", "display_position"), "player_key", "left")
    return out.select("season", "week", "full_name", "display_position", "selected_position", "is_starting", "player_points", "player_key")


def average_scoring_by_position(roster: DataFrame, stats: DataFrame, team: DataFrame, weekly: DataFrame | None = None) -> DataFrame:
    starters = player_weekly_points(roster, stats).where("is_starting")
    position = F.when(F.col("selected_position") == "W/R/T", "FLEX").otherwise(F.col("selected_position"))
    base = starters.withColumn("position", position).groupBy(*WEEK, "team_key", "position").agg(
        sum0(F.col("player_points")).alias("position_points"), n_unique(F.col("player_key")).alias("starters_count")
    )
    base = base.join(team.select("league_key", "team_key", "team_name"), ["league_key", "team_key"], "left")
    if weekly is not None:
        total = "team_points" if "team_points" in weekly.columns else "points"
        base = base.join(weekly.select(*WEEK, "team_key", F.col(total).alias("team_points")), [*WEEK, "team_key"], "left")
        base = base.withColumn("share", share_pct(F.col("position_points"), F.col("team_points")))
    else:
        base = base.withColumn("share", F.lit(None).cast("double"))
    out = base.groupBy("league_key", "season", "team_name", "position").agg(
        F.avg("position_points").alias("avg_points_per_week"),
        F.median("position_points").alias("median_points_per_week"),
        F.min("position_points").alias("min_week_points"),
        F.max("position_points").alias("max_week_points"),
        F.avg("starters_count").alias("avg_starters"),
        n_unique(F.col("week")).alias("weeks_counted"),
        F.avg("share").alias("avg_pct_of_team_points"),
    )
    return out.orderBy(F.asc_nulls_first("team_name"), position_order(F.col("position")))


def league_average_by_position(average: DataFrame) -> DataFrame:
    out = average.groupBy("position").agg(F.avg("avg_points_per_week").alias("league_avg_points"), F.avg("avg_pct_of_team_points").alias("league_avg_pct"))
    return out.orderBy(position_order(F.col("position")))


def points_health(stats: DataFrame, roster: DataFrame | None = None) -> dict[str, int]:
    """Counts of rows that carry points, from one aggregation per frame."""
    has = F.coalesce(F.size("stats"), F.lit(0)) > 0
    row = stats.agg(
        F.count_if(F.coalesce("fantasy_points", F.lit(0.0)) != 0).alias("non_zero_fantasy_points"), F.count_if(has).alias("rows_with_stats")
    ).first()
    out = row.asDict()
    if roster is not None:
        out["non_zero_roster_points"] = roster.agg(F.count_if(F.coalesce("points", F.lit(0.0)) != 0)).first()[0]
    return out


def scoring_quality_by_week(stats: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    out = stats.groupBy("season", "week").agg(
        F.count(F.lit(1)).alias("player_rows"),
        F.count_if(F.coalesce(F.size("stats"), F.lit(0)) > 0).alias("rows_with_stats_payload"),
        F.count("fantasy_points").alias("rows_with_fantasy_points"),
        F.count_if(F.coalesce("fantasy_points", F.lit(0.0)) != 0).alias("rows_with_non_zero_fantasy_points"),
    )
    out = out.withColumns({
        "missing_stats_payload_week": F.col("rows_with_stats_payload") == 0,
        "all_zero_fantasy_points_week": F.col("rows_with_non_zero_fantasy_points") == 0,
    })
    if roster is not None and "points" in roster.columns:
        mine = roster.groupBy("season", "week").agg(
            F.count(F.lit(1)).alias("roster_rows"),
            F.count("points").alias("roster_rows_with_points"),
            F.count_if(F.coalesce("points", F.lit(0.0)) != 0).alias("roster_rows_with_non_zero_points"),
        )
        out = out.join(mine, ["season", "week"], "left")
    return out.orderBy("season", "week")


PRICE_COLUMNS = (
    "season", "source_type", "league_key", "team_key", "player_key", "player_id", "player_name", "position", "draft_price",
    "pick_number", "round_number", "resolution_status", "resolution_confidence", "resolution_method",
)


def unified_draft_price(picks: DataFrame, player: DataFrame, historical: DataFrame | None = None, include_unresolved: bool = False) -> DataFrame:
    out = picks.join(player.select("player_key", "player_id", "full_name", "display_position"), "player_key", "left").withColumns({
        "source_type": F.lit("api_draft_pick"), "draft_price": F.col("cost").cast("double"), "resolution_status": F.lit("api"),
        "resolution_confidence": F.lit(1.0), "resolution_method": F.lit("api"), "player_name": F.col("full_name"), "position": F.col("display_position"),
    }).select(*PRICE_COLUMNS)
    if historical is not None:
        past = historical if include_unresolved or "resolution_status" not in historical.columns else historical.where("resolution_status = 'resolved'")
        past = past.withColumns({
            "source_type": F.lit("historical_web_ui"), "player_key": F.col("yahoo_player_key").cast("string"),
            "player_id": F.col("yahoo_player_id").try_cast("bigint"), "player_name": F.coalesce("resolved_player_name", "player_name_raw"),
            "position": F.coalesce("resolved_position", "position_raw"), "draft_price": F.col("auction_price").try_cast("double"),
        })
        gone = ("league_key", "team_key", "round_number")
        out = relaxed_union(out, past.select(*[c for c in PRICE_COLUMNS if c not in gone])).select(*PRICE_COLUMNS)
    return out.orderBy(F.asc_nulls_first("season"), F.desc_nulls_first("draft_price"))


def draft_results(picks: DataFrame, league: DataFrame, team: DataFrame, player: DataFrame) -> DataFrame:
    """Every pick with names and two dense ranks inside its season and position; a pick without cost has no cost rank."""
    d = picks.select("league_key", "season", "team_key", "player_key", F.col("round_number").alias("round"), F.col("pick_number").alias("pick"), "cost")
    d = d.join(league.select("league_key", "season", "league_name"), ["league_key", "season"])
    d = d.join(team.select("league_key", "team_key", "team_name", F.col("owner_name").alias("team_owner")), ["league_key", "team_key"])
    names = [F.col("full_name").alias("player_name"), F.col("display_position").alias("player_position"), F.col("editorial_team_abbr").alias("player_team")]
    d = d.join(player.select("player_key", *names), "player_key", "left")
    w = Window.partitionBy("season", "player_position")
    return d.select(
        "league_key", "season", "league_name", "team_key", "team_name", "team_owner", "player_key", "player_name", "player_position", "player_team",
        "round", "pick", "cost",
        F.dense_rank().over(w.orderBy("round", "pick")).cast("bigint").alias("position_pick"),
        F.when(F.col("cost").isNotNull(), F.dense_rank().over(w.orderBy(F.desc_nulls_last("cost")))).cast("bigint").alias("position_cost"),
    )


def player_scoring(stats: DataFrame, rules: DataFrame, league: DataFrame, categories: DataFrame, player: DataFrame) -> DataFrame:
    """One row per player, week and stat line; a bonus counts from its target on."""
    lines = stats.select("player_key", "league_key", "week", F.inline("stats")).withColumnRenamed("value", "raw_value")
    out = lines.join(rules.select("league_key", "stat_id", "points_per_unit", "bonus_target", F.col("bonus_points").alias("__bonus")), ["league_key", "stat_id"])
    out = out.join(league.select("league_key", "game_id"), "league_key")
    out = out.join(categories.select("game_id", "stat_id", F.col("display_name").alias("stat_name"), F.col("name").alias("stat_full_name")), ["game_id", "stat_id"])
    out = out.join(player.select("player_key", F.col("full_name").alias("player_name"), "display_position"), "player_key", "left")
    points = F.col("raw_value") * F.col("points_per_unit")
    bonus = F.when(F.col("raw_value") >= F.col("bonus_target"), F.coalesce("__bonus", F.lit(0.0))).otherwise(0.0)
    return out.select(
        "player_key", "league_key", "week", "player_name", "display_position", "stat_id", "stat_name", "stat_full_name", "raw_value",
        points.alias("stat_points"), bonus.alias("bonus_points"), (points + bonus).alias("total_stat_points"),
    )


def scoring_rollup(scoring: DataFrame) -> DataFrame:
    return scoring.groupBy("league_key", "week", "player_key").agg(F.sum("total_stat_points").alias("total_points"))
