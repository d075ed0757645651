"""Every registered query with its SQL.

A query applies a library function to league-shaped frames of the test tables, or SQL to
the tables themselves.  Where both engines read the same SQL, that SQL is the oracle too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.functions import casts, hashing, stats, text
from leaguelens.operators import change, dedup, resolve, tables
from leaguelens.plans import league as L
from leaguelens.plans import driver as D
from leaguelens.plans import models
from leaguelens.sources import pages as P
from leaguelens.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *frames: str):
    """Register a function under its name, with SQL over the named frames."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = D.oracle(sql, *frames)
        return f

    return add


def shared(name: str, sql: str, *frames: str) -> None:
    """Register SQL that runs on both engines."""
    QUERIES[name] = lambda spark, sf_dir: D.sql(spark, sf_dir, sql)
    ORACLE_SQL[name] = D.oracle(sql, *frames)


def _f(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [D.frame(spark, sf_dir, n) for n in names]


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


# ---- league queries

@query("""
    SELECT p.league_key, p.season, league_name, p.team_key, team_name, owner_name AS team_owner, p.player_key, full_name AS player_name,
           display_position AS player_position, editorial_team_abbr AS player_team, round_number AS round, pick_number AS pick, cost,
           CAST(dense_rank() OVER (PARTITION BY p.season, display_position ORDER BY round_number, pick_number) AS BIGINT) AS position_pick,
           CASE WHEN cost IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY p.season, display_position ORDER BY cost DESC NULLS LAST) AS BIGINT) END AS position_cost
    FROM picks p JOIN pick_league l ON p.league_key = l.league_key AND p.season = l.season
    JOIN pick_team t ON p.league_key = t.league_key AND p.team_key = t.team_key LEFT JOIN player y ON p.player_key = y.player_key
""", "picks", "pick_league", "pick_team", "player")
def draft_results(spark, d):
    return L.draft_results(*_f(spark, d, "picks", "pick_league", "pick_team", "player"))


@query("""
    SELECT season, league_name, team_name, owner_name, t.league_key, t.team_key FROM team t LEFT JOIN league l ON t.league_key = l.league_key
""", "team", "league")
def league_team_info(spark, d):
    return L.league_team_info(*_f(spark, d, "league", "team"), include_keys=True)


_STANDINGS = """
    SELECT league_key, season, team_key, CAST(1 AS BIGINT) AS rank, sum(CASE WHEN is_starting THEN 1 ELSE 0 END) AS wins,
           sum(CASE WHEN is_starting THEN 0 ELSE 1 END) AS losses, coalesce(sum(points), 0.0) AS points_for, CAST(count(*) AS DOUBLE) AS points_against
    FROM roster GROUP BY 1, 2, 3
"""


@query(f"""
    SELECT s.season, league_name, team_name, owner_name, rank, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, points_for, points_against, s.league_key, s.team_key
    FROM ({_STANDINGS}) s LEFT JOIN league l ON s.league_key = l.league_key AND s.season = l.season
    LEFT JOIN team t ON s.league_key = t.league_key AND s.team_key = t.team_key
""", "roster", "league", "team")
def standings_summary(spark, d):
    return L.standings_summary(D.sql(spark, d, _STANDINGS), *_f(spark, d, "league", "team"), include_keys=True)


_PWP = """
    SELECT r.league_key, r.season, r.week, r.team_key, r.player_key, selected_position, is_starting, points AS roster_points, fantasy_points,
           coalesce(points, fantasy_points, 0.0) AS player_points
    FROM roster r LEFT JOIN stats s ON r.league_key = s.league_key AND r.season = s.season AND r.week = s.week AND r.player_key = s.player_key
"""


@query(_PWP, "roster", "stats")
def player_weekly_points(spark, d):
    return L.player_weekly_points(*_f(spark, d, "roster", "stats"))


_TEAM_POINTS = """
    SELECT s.league_key, s.season, s.week, r.team_key, coalesce(sum(fantasy_points), 0.0) AS team_points, count(DISTINCT s.player_key) AS players_counted
    FROM stats s LEFT JOIN roster r ON s.league_key = r.league_key AND s.week = r.week AND s.player_key = r.player_key GROUP BY 1, 2, 3, 4
"""


@query(_TEAM_POINTS, "stats", "roster")
def weekly_team_points(spark, d):
    s, r = _f(spark, d, "stats", "roster")
    return L.weekly_team_points(s, r, None)[0]


_MATCHUPS = "SELECT league_key, season, week, team_key, CAST(sum(coalesce(points, 0.0)) AS DOUBLE) AS points FROM roster GROUP BY 1, 2, 3, 4"


@query("SELECT league_key, season, week, team_key, points AS team_points FROM (" + _MATCHUPS + ") m", "roster")
def weekly_team_points_resolved(spark, d):
    s, r = _f(spark, d, "stats", "roster")
    zero = s.withColumn("fantasy_points", F.lit(0.0))
    return L.weekly_team_points_resolved(zero, r, D.sql(spark, d, _MATCHUPS))[0]


@query(f"""
    SELECT w.season, w.week, league_name, team_name, owner_name, team_points, w.league_key, w.team_key FROM ({_TEAM_POINTS}) w
    LEFT JOIN league l ON w.league_key = l.league_key AND w.season = l.season LEFT JOIN team t ON w.league_key = t.league_key AND w.team_key = t.team_key
""", "stats", "roster", "league", "team")
def enrich_weekly_points(spark, d):
    s, r, l, t = _f(spark, d, "stats", "roster", "league", "team")
    return L.enrich_weekly_points(L.team_points_from_stats(s, r), l, t)


@query(f"""
    SELECT league_key, season, week, selected_position, sum(player_points) AS total_points, round(avg(player_points), 2) AS avg_points, count(DISTINCT player_key) AS players
    FROM ({_PWP}) p WHERE is_starting GROUP BY 1, 2, 3, 4
""", "roster", "stats")
def position_weekly_points(spark, d):
    out = L.position_weekly_points(L.player_weekly_points(*_f(spark, d, "roster", "stats")))
    return out.withColumn("avg_points", F.round("avg_points", 2))


@query(f"""
    SELECT league_key, season, week, team_key, selected_position, sum(player_points) AS position_points, count(DISTINCT player_key) AS players
    FROM ({_PWP}) p WHERE is_starting GROUP BY 1, 2, 3, 4, 5
""", "roster", "stats")
def team_position_weekly_points(spark, d):
    return L.team_position_weekly_points(L.player_weekly_points(*_f(spark, d, "roster", "stats")))


@query("SELECT league_key, season, week, team_key, selected_position, count(DISTINCT player_key) AS players FROM roster GROUP BY 1, 2, 3, 4, 5", "roster")
def position_usage(spark, d):
    return L.position_usage(*_f(spark, d, "roster"))


@query(f"""
    SELECT p.season, p.week, full_name, display_position, selected_position, is_starting, player_points, p.player_key
    FROM ({_PWP}) p LEFT JOIN player y ON p.player_key = y.player_key
    WHERE p.team_key = 't3' AND p.week = (SELECT max(week) FROM roster WHERE team_key = 't3')
""", "roster", "stats", "player")
def latest_roster(spark, d):
    return L.latest_roster("t3", *_f(spark, d, "roster", "stats", "player"))


_BASE = f"""
    SELECT p.league_key, p.season, p.week, p.team_key, CASE WHEN selected_position = 'W/R/T' THEN 'FLEX' ELSE selected_position END AS position,
           sum(player_points) AS position_points, count(DISTINCT player_key) AS starters_count
    FROM ({_PWP}) p WHERE is_starting GROUP BY 1, 2, 3, 4, 5
"""
_AVERAGE = f"""
    SELECT b.league_key, b.season, team_name, position, avg(position_points) AS avg_points_per_week, median(position_points) AS median_points_per_week,
           min(position_points) AS min_week_points, max(position_points) AS max_week_points, avg(starters_count) AS avg_starters,
           count(DISTINCT b.week) AS weeks_counted, avg(CASE WHEN w.team_points > 0 THEN position_points / w.team_points * 100.0 END) AS avg_pct_of_team_points
    FROM ({_BASE}) b LEFT JOIN team t ON b.league_key = t.league_key AND b.team_key = t.team_key
    LEFT JOIN ({_TEAM_POINTS}) w ON b.league_key = w.league_key AND b.season = w.season AND b.week = w.week AND b.team_key = w.team_key
    GROUP BY 1, 2, 3, 4
"""


def _rounded(df: DataFrame, *cols: str, places: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(f"""
    SELECT league_key, season, team_name, position, round(avg_points_per_week, 2) AS avg_points_per_week, median_points_per_week, min_week_points, max_week_points,
           round(avg_starters, 2) AS avg_starters, weeks_counted, round(avg_pct_of_team_points, 2) AS avg_pct_of_team_points FROM ({_AVERAGE}) a
""", "roster", "stats", "team")
def avg_scoring_by_position(spark, d):
    r, s, t = _f(spark, d, "roster", "stats", "team")
    out = L.average_scoring_by_position(r, s, t, L.team_points_from_stats(s, r))
    return _rounded(out, "avg_points_per_week", "avg_starters", "avg_pct_of_team_points")


@query(f"""
    SELECT position, round(avg(avg_points_per_week), 1) AS league_avg_points, round(avg(avg_pct_of_team_points), 1) AS league_avg_pct FROM ({_AVERAGE}) a GROUP BY 1
""", "roster", "stats", "team")
def league_avg_by_position(spark, d):
    r, s, t = _f(spark, d, "roster", "stats", "team")
    out = L.league_average_by_position(L.average_scoring_by_position(r, s, t, L.team_points_from_stats(s, r)))
    return _rounded(out, "league_avg_points", "league_avg_pct", places=1)


def _with_lines(spark, d) -> DataFrame:
    """Weekly stats with a list of stat lines: one per event type, none for every seventh player."""
    lines = D.sql(spark, d, """
        SELECT concat('l', CAST(user_id % 3 AS VARCHAR(9))) AS league_key, CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) + 1 AS week,
               concat('p', CAST(user_id AS VARCHAR(9))) AS player_key, user_id, event_type AS stat_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS value
        FROM events GROUP BY 1, 2, 3, 4, 5
    """)
    line = F.when(F.col("user_id") % 7 != 0, F.struct("stat_id", "value"))
    return lines.groupBy("league_key", "week", "player_key").agg(F.array_compact(F.collect_list(line)).alias("stats"), F.sum("value").alias("fantasy_points")).withColumn("season", F.lit(2024).cast("bigint"))


_RULES = """
    SELECT concat('l', CAST(k AS VARCHAR(9))) AS league_key, s AS stat_id, p AS points_per_unit, t AS bonus_target, b AS bonus_points
    FROM (VALUES (0), (1), (2)) a(k) CROSS JOIN (VALUES ('view', 0.5, 100.0, 3.0), ('click', 0.25, CAST(NULL AS DOUBLE), 2.0), ('purchase', 2.0, 80.0, CAST(NULL AS DOUBLE)), ('signup', 1.0, 60.0, 5.0)) r(s, p, t, b)
"""
_CATEGORIES = "SELECT CAST(7 AS BIGINT) AS game_id, s AS stat_id, upper(s) AS display_name, concat('stat ', s) AS name FROM (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error')) c(s)"
_SCORING = f"""
    SELECT e.player_key, e.league_key, e.week, full_name AS player_name, display_position, e.stat_id, c.display_name AS stat_name, c.name AS stat_full_name, value AS raw_value,
           CAST(value * points_per_unit AS DOUBLE) AS stat_points, CAST(CASE WHEN value >= bonus_target THEN coalesce(bonus_points, 0.0) ELSE 0.0 END AS DOUBLE) AS bonus_points,
           CAST(value * points_per_unit + CASE WHEN value >= bonus_target THEN coalesce(bonus_points, 0.0) ELSE 0.0 END AS DOUBLE) AS total_stat_points
    FROM (SELECT concat('l', CAST(user_id % 3 AS VARCHAR(9))) AS league_key, CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) + 1 AS week, concat('p', CAST(user_id AS VARCHAR(9))) AS player_key,
          event_type AS stat_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS value FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2, 3, 4) e
    JOIN ({_RULES}) r ON e.league_key = r.league_key AND e.stat_id = r.stat_id JOIN league l ON e.league_key = l.league_key
    JOIN ({_CATEGORIES}) c ON l.game_id = c.game_id AND e.stat_id = c.stat_id LEFT JOIN player y ON e.player_key = y.player_key
"""


def _scoring(spark, d) -> DataFrame:
    rules = spark.sql(_RULES)
    rules = rules.withColumns({c: F.col(c).cast("double") for c in ("points_per_unit", "bonus_target", "bonus_points")})
    league, player = _f(spark, d, "league", "player")
    return L.player_scoring(_with_lines(spark, d), rules, league, spark.sql(_CATEGORIES), player)


@query(_SCORING, "league", "player")
def player_scoring(spark, d):
    return _scoring(spark, d)


@query(f"SELECT league_key, week, player_key, sum(total_stat_points) AS total_points FROM ({_SCORING}) s GROUP BY 1, 2, 3", "league", "player")
def scoring_rollup(spark, d):
    return L.scoring_rollup(_scoring(spark, d))


@query("""
    SELECT s.season, s.week, s.player_rows, s.rows_with_stats_payload, s.rows_with_fantasy_points, s.rows_with_non_zero_fantasy_points,
           s.rows_with_stats_payload = 0 AS missing_stats_payload_week, s.rows_with_non_zero_fantasy_points = 0 AS all_zero_fantasy_points_week,
           roster_rows, roster_rows_with_points, roster_rows_with_non_zero_points
    FROM (SELECT CAST(2024 AS BIGINT) AS season, week, count(*) AS player_rows, count(CASE WHEN user_id % 7 <> 0 THEN 1 END) AS rows_with_stats_payload,
          count(points) AS rows_with_fantasy_points, count(CASE WHEN points <> 0 THEN 1 END) AS rows_with_non_zero_fantasy_points FROM event_weeks GROUP BY 2) s
    LEFT JOIN (SELECT season, week, count(*) AS roster_rows, count(points) AS roster_rows_with_points, count(CASE WHEN points <> 0 THEN 1 END) AS roster_rows_with_non_zero_points FROM roster GROUP BY 1, 2) r
    ON s.season = r.season AND s.week = r.week
""", "event_weeks", "roster")
def quality_by_week(spark, d):
    return L.scoring_quality_by_week(_with_lines(spark, d), D.frame(spark, d, "roster"))


@query("""
    SELECT season, 'api_draft_pick' AS source_type, p.league_key, p.team_key, p.player_key, player_id, full_name AS player_name, display_position AS position,
           CAST(cost AS DOUBLE) AS draft_price, pick_number, round_number, 'api' AS resolution_status, CAST(1.0 AS DOUBLE) AS resolution_confidence, 'api' AS resolution_method
    FROM picks p LEFT JOIN player y ON p.player_key = y.player_key
    UNION ALL
    SELECT CAST(year(l_shipdate) AS BIGINT), 'historical_web_ui', NULL, NULL, concat('p', CAST(l_partkey AS VARCHAR(9))), CAST(l_partkey AS BIGINT), p_name, p_type,
           floor(l_extendedprice), CAST(l_linenumber AS BIGINT), NULL, 'resolved', CAST(0.98 AS DOUBLE), 'exact'
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'
""", "picks", "player")
def unified_draft_price(spark, d):
    past = D.sql(spark, d, """
        SELECT CAST(year(l_shipdate) AS BIGINT) AS season, concat('p', CAST(l_partkey AS VARCHAR(9))) AS yahoo_player_key, CAST(l_partkey AS BIGINT) AS yahoo_player_id,
               CAST(NULL AS VARCHAR(9)) AS resolved_player_name, p_name AS player_name_raw, p_type AS resolved_position, CAST(NULL AS VARCHAR(9)) AS position_raw,
               CAST(floor(l_extendedprice) AS DOUBLE) AS auction_price, CAST(l_linenumber AS BIGINT) AS pick_number,
               CASE WHEN l_returnflag = 'R' THEN 'resolved' ELSE 'unresolved' END AS resolution_status, CAST(0.98 AS DOUBLE) AS resolution_confidence, 'exact' AS resolution_method
        FROM lineitem JOIN part ON l_partkey = p_partkey
    """)
    return L.unified_draft_price(*_f(spark, d, "picks", "player"), past)


shared("top_scorers", """
    SELECT c_name, CAST(count(*) AS BIGINT) AS picks, sum(CAST(floor(o_totalprice) AS BIGINT)) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_name ORDER BY total DESC, c_name LIMIT 20
""")
ORACLE_SQL["top_scorers"] = ORACLE_SQL["top_scorers"].replace("sum(CAST(floor(o_totalprice) AS BIGINT)) AS total", "CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total")
shared("adp_value_gap", """
    SELECT o_orderkey, c_name, n_name, CAST(o_orderkey % 100 AS BIGINT) - CAST(c_custkey % 100 AS BIGINT) AS gap FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY gap DESC, o_orderkey LIMIT 100
""")
shared("scoring_by_team", """
    SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
shared("coverage_gap", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
shared("anti_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT nullif(l_orderkey, 0) FROM lineitem)")
def anti_not_in_null(spark, d):
    o, l = _t(spark, d, "orders", "lineitem")
    return tables.not_in(o.select("o_orderkey"), "o_orderkey", l.select(F.nullif("l_orderkey", F.lit(0)).alias("k")), "k")


shared("semi_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
shared("case_insensitive_join", "SELECT o_orderkey, s.label FROM orders JOIN (SELECT 'f' AS code, 'final' AS label UNION ALL SELECT 'o', 'open') s ON upper(s.code) = upper(o_orderstatus)")
shared("cast_key_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON CAST(CAST(o_custkey AS VARCHAR(20)) AS BIGINT) = c_custkey WHERE o_totalprice > 400000")
shared("coverage_by_method", """
    SELECT o_orderpriority AS method, count(*) AS n, count(DISTINCT o_custkey) AS players FROM orders GROUP BY 1
""")
shared("having_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
shared("latest_snapshot_join", """
    SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) AS last FROM orders GROUP BY 1) m ON o_custkey = m.k AND o_orderdate = m.last
""")
shared("adp_by_year", """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 2) AS mean,
           round(stddev_pop(o_totalprice), 2) AS spread FROM orders GROUP BY 1, 2
""")


# ---- windows and deduplication

@query("""
    SELECT user_id, event_id, CAST(r AS BIGINT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) x WHERE r <= 7
""")
def top_k_per_group(spark, d):
    (e,) = _t(spark, d, "events")
    out = dedup.top_k(e, ["user_id"], 7, F.desc("value"), F.col("event_id"), rank="place")
    return out.select("user_id", "event_id", F.col("place").cast("bigint").alias("place"))


_PAIRS = """
    SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, abs(a.p_size - b.p_size) AS gap
    FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
"""


@query(f"""
    SELECT left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, left_id, right_id) AS r FROM
        (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY gap, left_id, right_id) AS q FROM ({_PAIRS}) p) x WHERE q = 1) y) z WHERE r = 1
""")
def greedy_one_to_one(spark, d):
    (p,) = _t(spark, d, "part")
    # the best pair of every right part, which is all that the choice takes from all pairs
    pairs = dedup.nearest_pairs(p, ["p_name", "p_brand"], "p_partkey", "p_size")
    return dedup.greedy_one_to_one(pairs, "left_id", "right_id", F.asc_nulls_last("gap"), F.col("left_id"), F.col("right_id")).select("left_id", "right_id")


def _pairs(spark, d) -> DataFrame:
    (p,) = _t(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("left_id"), F.col("p_size").alias("s1"), "p_name", "p_brand")
    b = p.select(F.col("p_partkey").alias("right_id"), F.col("p_size").alias("s2"), "p_name", "p_brand")
    return a.join(b, ["p_name", "p_brand"]).where("left_id <> right_id").select("left_id", "right_id", F.abs(F.col("s1") - F.col("s2")).alias("gap"))


@query(f"""
    SELECT left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, left_id, right_id) AS a,
        row_number() OVER (PARTITION BY right_id ORDER BY gap, left_id, right_id) AS b FROM ({_PAIRS}) p) x WHERE a = 1 AND b = 1
""")
def mutual_best(spark, d):
    return dedup.mutual_best(_pairs(spark, d), "left_id", "right_id", F.col("gap"), F.col("left_id"), F.col("right_id")).select("left_id", "right_id")


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) x WHERE r = 1
""")
def row_number_dedupe(spark, d):
    (l,) = _t(spark, d, "lineitem")
    out = dedup.first_by(l, ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""
    SELECT season, o_orderkey FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) x WHERE r <= 50
""")
def balanced_sample(spark, d):
    (o,) = _t(spark, d, "orders")
    return dedup.balanced_sample(o.select(F.year("o_orderdate").cast("bigint").alias("season"), "o_orderkey"), "season", "o_orderkey", 50)


shared("rank_of_avg_rank", """
    SELECT p_partkey, CAST(row_number() OVER (ORDER BY (a + b) / 2.0, p_partkey) AS BIGINT) AS place FROM (
        SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS b FROM part) x
""")
shared("position_ranks", """
    SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS price_rank,
           CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS BIGINT) AS season_rank FROM orders
""")
shared("densify_grid", """
    SELECT g.user_id, g.week, coalesce(CAST(e.points AS DOUBLE), round(avg(CAST(e.points AS DOUBLE)) OVER (PARTITION BY g.user_id), 2)) AS points
    FROM (SELECT u.user_id, w.week FROM (SELECT DISTINCT user_id FROM event_weeks) u CROSS JOIN (SELECT DISTINCT week FROM event_weeks) w) g
    LEFT JOIN event_weeks e ON g.user_id = e.user_id AND g.week = e.week
""", "event_weeks")


# ---- aggregates

shared("group_statistics", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(avg(l_extendedprice), 2) AS mean, median(l_quantity) AS mid,
           min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2
""")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 3) AS q90, round(quantile_cont(p_retailprice, 0.1), 3) AS q10 FROM part GROUP BY 1")
def quantile_by_tier(spark, d):
    (p,) = _t(spark, d, "part")
    return p.groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.9), 3).alias("q90"), F.round(F.percentile("p_retailprice", 0.1), 3).alias("q10"))


@query("""
    SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS weighted, round(corr(l_quantity, l_extendedprice), 6) AS r,
           round(avg(abs(l_discount - l_tax)), 4) AS mae FROM lineitem GROUP BY 1
""")
def weighted_avg_corr(spark, d):
    (l,) = _t(spark, d, "lineitem")
    return l.groupBy("l_returnflag").agg(
        F.round(stats.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 2).alias("weighted"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 4).alias("mae"),
    )


@query("SELECT c_mktsegment, count(DISTINCT nullif(c_nationkey, 3)) + max(CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END) AS nations FROM customer GROUP BY 1")
def n_unique_with_null(spark, d):
    (c,) = _t(spark, d, "customer")
    return c.withColumn("k", F.nullif("c_nationkey", F.lit(3))).groupBy("c_mktsegment").agg(stats.n_unique(F.col("k")).alias("nations"))


# ---- scalar functions

@query("""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(p_name, ' Jr.'))), '\\s+(?:jr|sr|ii|iii|iv|v)\\.?$', ''), '[^a-z\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS name,
           split_part(p_name, ' ', 1) AS first_word, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part
""")
def normalize_names(spark, d):
    (p,) = _t(spark, d, "part")
    n = F.col("p_name")
    return p.select(
        "p_partkey", text.normalize_name(F.concat(n, F.lit(" Jr.")), fold=False).alias("name"), text.first_last(n)["first"].alias("first_word"),
        text.slugify(n).alias("slug"), text.compact(n).alias("key"),
    )


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def accent_fold(spark, d):
    (x,) = _t(spark, d, "documents")
    return x.select("doc_id", F.md5(text.strip_accents("text")).alias("folded"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    (e,) = _t(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS whole, CAST(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE CAST(o_orderkey AS VARCHAR) END, '-') AS DOUBLE) AS dashed,
           CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag, CAST(o_orderkey * 1000 AS DOUBLE) AS price FROM orders
""")
def safe_casts(spark, d):
    (o,) = _t(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select(
        "o_orderkey",
        casts.safe_int(F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise(F.concat(k, F.lit(".0")))).alias("whole"),
        casts.dash_null(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(k)).alias("dashed"),
        casts.truthy(F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "f").otherwise("?")).alias("flag"),
        casts.dollars(F.concat(F.lit("$"), k, F.when(F.col("o_orderkey") > 0, ",000").otherwise(""))).alias("price"),
    )


@query("""
    SELECT l_orderkey, l_partkey, l_linenumber, round(abs(l_discount - l_tax) / 2, 6) AS spread, concat(CAST(floor((l_quantity - 1) / 12) + 1 AS INTEGER), '.', lpad(CAST(CAST((l_quantity - 1) % 12 + 1 AS INTEGER) AS VARCHAR), 2, '0')) AS pick,
           least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high FROM lineitem
""")
def row_math(spark, d):
    (l,) = _t(spark, d, "lineitem")
    return l.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(stats.row_stddev(F.col("l_discount"), F.col("l_tax")), 6).alias("spread"), stats.snake_pick(F.col("l_quantity")).alias("pick"),
        F.least("l_discount", "l_tax").alias("low"), F.greatest("l_discount", "l_tax").alias("high"),
    )


@query("""
    SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '__NULL__'))) AS row_hash,
           sha256(concat_ws('|', c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), ''))) AS queue_id FROM customer
""")
def row_hashes(spark, d):
    (c,) = _t(spark, d, "customer")
    c = c.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.select("c_custkey", hashing.row_hash("c_custkey", "c_name", "seg").alias("row_hash"), hashing.queue_id(F.col("c_name"), F.col("seg")).alias("queue_id"))


@query("""
    SELECT page_id, CAST(u.pos - 1 AS BIGINT) AS pos, regexp_extract(u.a, 'href="([^"]*)"', 1) AS href, regexp_extract(u.a, '>([^<]*)$', 1) AS label
    FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>[^<]*') AS l FROM pages) p) u
""")
def html_links(spark, d):
    return P.links(*_t(spark, d, "pages"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, regexp_extract(url, '^https?://([^/]*)', 1) AS host FROM pages""")
def html_titles(spark, d):
    (p,) = _t(spark, d, "pages")
    return p.select("page_id", P.title(F.col("html")).alias("title"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"))


@query(r"""
    SELECT CAST(-c_custkey AS BIGINT) AS page_id, CAST(r AS BIGINT) AS row, CASE r WHEN 0 THEN 'name|segment' ELSE c_name || '|' || c_mktsegment END AS cells
    FROM customer CROSS JOIN (VALUES (0), (1)) AS v(r)
    UNION ALL SELECT page_id, row, array_to_string(cells, '|') FROM (
        SELECT page_id, CAST(pos - 1 AS BIGINT) AS row, list_transform(regexp_extract_all(tr, '(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), E' \t\r\n')) AS cells
        FROM (SELECT page_id, unnest(rows) AS tr, generate_subscripts(rows, 1) AS pos FROM (SELECT page_id, string_split_regex(html, '(?i)<tr(?:\s[^>]*)?>')[2:] AS rows FROM pages) p) t
    ) c WHERE len(cells) > 0
""")
def html_tables(spark, d):
    """Tables of the pages, and of one card for each customer, as the pages at hand may hold none."""
    pages, customer = _t(spark, d, "pages", "customer")
    line = lambda tag, *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
    body = line("td", F.col("c_name"), F.concat(F.lit(' <b class="s">'), F.col("c_mktsegment"), F.lit("</b>\n")))
    card = F.concat(F.lit('<table id="card">'), line("th", F.lit("name"), F.lit("segment")), body, F.lit("</table>"))
    cards = customer.select((-F.col("c_custkey")).cast("long").alias("page_id"), card.alias("html"))
    rows = P.table_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "html").unionByName(cards))
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


# ---- change data and checks

_NEW = """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey + 1000000, c_mktsegment FROM customer WHERE c_custkey % 7 = 0
"""
_OLD = "SELECT c_custkey, c_mktsegment AS segment FROM customer"


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    return D.sql(spark, d, _OLD), D.sql(spark, d, _NEW)


@query(f"""
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'untouched' WHEN o.c_custkey IS NULL THEN 'new' WHEN o.segment = n.segment THEN 'unchanged' ELSE 'changed' END AS class
    FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey
""")
def scd2_classify(spark, d):
    old, new = _versions(spark, d)
    return change.classify(old, new, ["c_custkey"], ["segment"])


@query(f"""
    SELECT o.c_custkey, o.segment, DATE '2024-01-01' AS ingestion_date, CASE WHEN o.segment <> n.segment THEN DATE '2024-02-01' ELSE DATE '9999-12-31' END AS end_date, coalesce(o.segment = n.segment, true) AS is_current
    FROM ({_OLD}) o LEFT JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey
    UNION ALL SELECT n.c_custkey, n.segment, DATE '2024-02-01', DATE '9999-12-31', true FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR o.segment <> n.segment
""")
def scd2_full(spark, d):
    old, new = _versions(spark, d)
    return change.scd2_merge(change.bootstrap(old, F.lit("2024-01-01")), new, ["c_custkey"], F.lit("2024-02-01"))


@query(f"SELECT o.c_custkey, o.segment FROM ({_OLD}) o WHERE o.c_custkey NOT IN (SELECT c_custkey FROM ({_NEW}) x) UNION ALL SELECT * FROM ({_NEW}) n")
def upsert(spark, d):
    old, new = _versions(spark, d)
    return change.upsert(old, new, ["c_custkey"])


# ---- models

_BETA, _GAMMA = [0.4, 3.0, -2.0, 0.5, 1.5, -0.5, 0.75], [1.0, 0.8, 1.2, 0.1, 0.2, -0.1, 0.05]


def _model_sql(c: list[float]) -> str:
    return " + ".join(f"({v}) * {x}" for v, x in zip(c, ("1.0", "(adp / 216.0)", "(ln(greatest(adp, 1.0)) / ln(216.0))", "(rk / 50.0)", "qb", "rb", "te")))


@query(f"""
    SELECT p_partkey, pick, round(CASE WHEN pick <= 0 THEN 1.0 WHEN pick > 216 THEN 0.0 ELSE greatest(0.0, least(1.0, (fu - ft) / (fu - fl))) END, 6) AS p FROM (
        SELECT p_partkey, pick, 1 / (1 + exp(-(216.0 - adp - mu) / s)) AS fu, 1 / (1 + exp(-(1.0 - adp - mu) / s)) AS fl, 1 / (1 + exp(-(pick - adp - mu) / s)) AS ft FROM (
            SELECT p_partkey, pick, adp, {_model_sql(_BETA)} AS mu, exp({_model_sql(_GAMMA)}) AS s FROM (
                SELECT p_partkey, CAST(pick AS DOUBLE) AS pick, CAST(p_partkey % 216 + 1 AS DOUBLE) AS adp, CAST(p_size AS DOUBLE) AS rk, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.0 END AS qb,
                       CASE WHEN p_partkey % 4 = 1 THEN 1.0 ELSE 0.0 END AS rb, CASE WHEN p_partkey % 4 = 2 THEN 1.0 ELSE 0.0 END AS te
                FROM part CROSS JOIN (VALUES (0), (10), (60), (150), (216), (300)) v(pick)) a) b) c
""")
def availability(spark, d):
    (p,) = _t(spark, d, "part")
    picks = spark.createDataFrame([(float(x),) for x in (0, 10, 60, 150, 216, 300)], "pick double")
    position = F.element_at(F.array(*map(F.lit, ("QB", "RB", "TE", "WR"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    adp = (F.col("p_partkey") % 216 + 1).cast("double")
    out = stats.p_available(adp, position, F.col("p_size").cast("double"), F.col("pick"), _BETA, _GAMMA)
    return p.crossJoin(F.broadcast(picks)).select("p_partkey", "pick", F.round(out, 6).alias("p"))


# ---- resolution, incremental loads, simulations

@query("""
    SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3
""")
def windowed_counts(spark, d):
    (e,) = _t(spark, d, "events")
    out = incremental.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


def _registry(spark, d) -> DataFrame:
    (p,) = _t(spark, d, "part")
    return dedup.first_by(p, ["p_name"], F.col("p_partkey")).select(
        F.col("p_partkey").cast("string").alias("canonical_player_id"), F.col("p_name").alias("display_name"), F.lit("RB").alias("primary_position"), F.array().cast("array<string>").alias("aliases")
    )


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS record_id, CAST(first AS VARCHAR) AS canonical_player_id, 'exact' AS method, 0.98 AS confidence
    FROM part JOIN (SELECT p_name AS n, min(p_partkey) AS first FROM part GROUP BY 1) k ON p_name = n
""")
def resolve_players(spark, d):
    (p,) = _t(spark, d, "part")
    asked = p.select(F.col("p_partkey").cast("string").alias("record_id"), F.upper("p_name").alias("raw_player_name"), F.lit("RB").alias("position"))
    best = resolve.match_players(asked, _registry(spark, d)).where("rank = 1")
    return best.select("record_id", "canonical_player_id", "method", F.round("confidence", 4).alias("confidence"))


@query(None)
def fuzzy_players(spark, d):
    (p,) = _t(spark, d, "part")
    asked = p.select(F.col("p_partkey").cast("string").alias("record_id"), F.concat("p_name", F.lit("s")).alias("raw_player_name"), F.lit("RB").alias("position"))
    return resolve.match_players(asked, _registry(spark, d))


@query(None)
def bye_simulation(spark, d):
    (c,) = _t(spark, d, "customer")
    # a nation's score in each of 16 weeks is the mean of its customers of that week: 25 rosters of 16 numbers
    weeks = c.groupBy("c_nationkey", (F.col("c_custkey") % 16).alias("week")).agg(F.avg("c_acctbal").alias("score"))
    rows = weeks.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("score")).alias("list")).where("size(list) = 16").collect()
    return models.bye_simulation(spark, {str(r.c_nationkey): r.list for r in rows}, 200, 50)


@query(None)
def price_intervals(spark, d):
    (p,) = _t(spark, d, "part")
    position = F.element_at(F.array(*map(F.lit, ("QB", "RB", "WR", "TE"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").cast("string").alias("player_id"), position.alias("position"), F.col("p_size").cast("double").alias("rank"), F.col("p_retailprice").alias("price"))
    return models.price_intervals(rows, rows, ["rank"])
