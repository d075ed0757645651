import pytest

from leaguelens.plans import league as L

W = "league_key string, season bigint, week bigint"


@pytest.fixture()
def frames(spark):
    stats = spark.createDataFrame([("l", 2025, 1, "p1", 18.3, [("5", 457.5)]), ("l", 2025, 1, "p2", 0.0, []), ("l", 2025, 1, "p3", 5.0, None)], f"{W}, player_key string, fantasy_points double, stats array<struct<stat_id:string,value:double>>")
    roster = spark.createDataFrame([("l", 2025, 1, "t1", "p1", "WR", True, None), ("l", 2025, 1, "t1", "p2", "BN", False, 7.0)], f"{W}, team_key string, player_key string, selected_position string, is_starting boolean, points double")
    matchups = spark.createDataFrame([("l", 2025, 1, "t1", 101.7)], f"{W}, team_key string, points double")
    return stats, roster, matchups


def test_weekly_points(frames):
    stats, roster, matchups = frames
    out, source = L.weekly_team_points(stats, roster, matchups)
    assert source == "player_stats" and {(r.team_key, r.team_points, r.players_counted) for r in out.collect()} == {("t1", 18.3, 2), (None, 5.0, 1)}
    zero = stats.withColumn("fantasy_points", stats.fantasy_points * 0)
    assert L.weekly_team_points(zero, roster.withColumn("points", roster.points * 0), matchups)[1] == "matchups"
    out, source = L.weekly_team_points_resolved(zero, roster, matchups)
    assert source == "matchups" and out.first().team_points == 101.7 and len(out.columns) == 5
    assert L.weekly_team_points(stats, None, None)[1] == "unavailable"


def test_scoring_and_rollup(spark, frames):
    rules = spark.createDataFrame([("l", "5", 0.04, None, None)], "league_key string, stat_id string, points_per_unit double, bonus_target double, bonus_points double")
    league = spark.createDataFrame([("l", 461)], "league_key string, game_id bigint")
    cats = spark.createDataFrame([(461, "5", "Pass Yds", "Passing Yards")], "game_id bigint, stat_id string, display_name string, name string")
    players = spark.createDataFrame([("p1", "One", "WR")], "player_key string, full_name string, display_position string")
    out = L.player_scoring(frames[0], rules, league, cats, players)
    assert [round(r.total_stat_points, 6) for r in out.collect()] == [18.3]
    assert round(L.scoring_rollup(out).first().total_points, 6) == 18.3


def test_health_and_quality(frames):
    stats, roster, _ = frames
    assert L.points_health(stats, roster) == {"non_zero_fantasy_points": 2, "rows_with_stats": 1, "non_zero_roster_points": 1}
    r = L.scoring_quality_by_week(stats, roster).first()
    assert (r.player_rows, r.rows_with_stats_payload, r.roster_rows, r.roster_rows_with_points) == (3, 1, 2, 1)


def test_position_order_and_summary(spark):
    avg = spark.createDataFrame([("WR", 1.0, 1.0), ("QB", 2.0, 1.0), ("RB", 3.0, 1.0)], "position string, avg_points_per_week double, avg_pct_of_team_points double")
    assert [r.position for r in L.league_average_by_position(avg).collect()] == ["QB", "RB", "WR"]
    st = spark.createDataFrame([("l", 2025, "t", 1, 10, 3, 0, 1450.2, 1320.1)], "league_key string, season bigint, team_key string, rank bigint, wins bigint, losses bigint, ties bigint, points_for double, points_against double")
    out = L.standings_summary(st, include_keys=True)
    assert "ties" not in out.columns and len(out.columns) == 11


def test_draft_results_null_cost(spark):
    picks = spark.createDataFrame([("l", 2025, "t", "p", 2, 1, None), ("l", 2025, "t", "p", 1, 1, 5)], "league_key string, season bigint, team_key string, player_key string, pick_number bigint, round_number bigint, cost bigint")
    league = spark.createDataFrame([("l", 2025, "L")], "league_key string, season bigint, league_name string")
    team = spark.createDataFrame([("l", "t", "T", "O")], "league_key string, team_key string, team_name string, owner_name string")
    player = spark.createDataFrame([("p", "P", "WR", "LAC")], "player_key string, full_name string, display_position string, editorial_team_abbr string")
    got = {r.pick: (r.position_pick, r.position_cost) for r in L.draft_results(picks, league, team, player).collect()}
    assert got == {1: (1, 1), 2: (2, None)}


def test_unified_price(spark):
    picks = spark.createDataFrame([("l", 2025, "t", "p", 1, 1, 5)], "league_key string, season bigint, team_key string, player_key string, pick_number bigint, round_number bigint, cost bigint")
    player = spark.createDataFrame([("p", 1, "P", "WR")], "player_key string, player_id bigint, full_name string, display_position string")
    past = spark.createDataFrame([(2024, "p", "1", None, "Raw", None, "WR", 3.0, 1, "resolved", 0.9, "exact"), (2024, "q", "2", None, "Raw", None, "WR", 3.0, 1, "ambiguous", 0.9, "fuzzy")], "season bigint, yahoo_player_key string, yahoo_player_id string, resolved_player_name string, player_name_raw string, resolved_position string, position_raw string, auction_price double, pick_number bigint, resolution_status string, resolution_confidence double, resolution_method string")
    assert {r.source_type for r in L.unified_draft_price(picks, player, past).collect()} == {"api_draft_pick", "historical_web_ui"}
    assert L.unified_draft_price(picks, player, past).count() == 2 and L.unified_draft_price(picks, player, past, True).count() == 3
