"""League-shaped frames over the star-schema test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


#: Users stand for players, their remainders for teams and leagues, event types for slots.
EVENT_WEEKS = """
    SELECT user_id, CAST(floor((dayofyear(ts) - 1) / 7) AS BIGINT) + 1 AS week, min(event_type) AS et,
           CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS points, count(*) AS n
    FROM events GROUP BY 1, 2
"""
ROSTER = """
    SELECT concat('l', CAST(user_id % 3 AS VARCHAR(9))) AS league_key, CAST(2024 AS BIGINT) AS season, week,
           concat('t', CAST(user_id % 12 AS VARCHAR(9))) AS team_key, concat('p', CAST(user_id AS VARCHAR(9))) AS player_key,
           CASE n % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'RB' WHEN 2 THEN 'WR' WHEN 3 THEN 'TE' WHEN 4 THEN 'W/R/T' ELSE 'BN' END AS selected_position,
           n % 6 <> 5 AS is_starting, CASE WHEN n % 4 = 0 THEN NULL ELSE points END AS points
    FROM event_weeks WHERE user_id % 10 <> 9
"""
STATS = """
    SELECT concat('l', CAST(user_id % 3 AS VARCHAR(9))) AS league_key, CAST(2024 AS BIGINT) AS season, week,
           concat('p', CAST(user_id AS VARCHAR(9))) AS player_key, CASE WHEN n % 5 = 0 THEN 0.0 ELSE points * 2 END AS fantasy_points
    FROM event_weeks
"""
LEAGUE = """
    SELECT concat('l', CAST(r_regionkey AS VARCHAR(9))) AS league_key, CAST(2024 AS BIGINT) AS season, r_name AS league_name,
           CAST(7 AS BIGINT) AS game_id FROM region WHERE r_regionkey < 3
"""
TEAM = """
    SELECT concat('l', CAST(a.k AS VARCHAR(9))) AS league_key, concat('t', CAST(n_nationkey AS VARCHAR(9))) AS team_key,
           n_name AS team_name, concat('owner ', CAST(n_regionkey AS VARCHAR(9))) AS owner_name
    FROM nation CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3) a WHERE n_nationkey < 11
"""
PLAYER = """
    SELECT concat('p', CAST(c_custkey AS VARCHAR(9))) AS player_key, CAST(c_custkey AS BIGINT) AS player_id, c_name AS full_name,
           c_mktsegment AS display_position, concat('N', CAST(c_nationkey AS VARCHAR(9))) AS editorial_team_abbr FROM customer
"""
#: Orders stand for draft picks; regions of customers for leagues, nations for teams.
PICKS = """
    SELECT concat('g', CAST(n_regionkey AS VARCHAR(9))) AS league_key, CAST(year(o_orderdate) AS BIGINT) AS season,
           concat('n', CAST(c_nationkey AS VARCHAR(9))) AS team_key, concat('p', CAST(o_custkey AS VARCHAR(9))) AS player_key,
           CAST(o_orderkey AS BIGINT) AS pick_number, CAST(o_orderkey % 16 AS BIGINT) + 1 AS round_number,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS cost
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
PICK_LEAGUE = """
    SELECT concat('g', CAST(r_regionkey AS VARCHAR(9))) AS league_key, y.season AS season, r_name AS league_name
    FROM region CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS season FROM orders) y
"""
PICK_TEAM = """
    SELECT concat('g', CAST(n_regionkey AS VARCHAR(9))) AS league_key, concat('n', CAST(n_nationkey AS VARCHAR(9))) AS team_key,
           n_name AS team_name, concat('owner ', CAST(n_nationkey AS VARCHAR(9))) AS owner_name FROM nation
"""
FRAMES = {
    "event_weeks": EVENT_WEEKS, "roster": ROSTER, "stats": STATS, "league": LEAGUE, "team": TEAM, "player": PLAYER,
    "picks": PICKS, "pick_league": PICK_LEAGUE, "pick_team": PICK_TEAM,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A league-shaped frame; its SQL runs with every table it names as a parameter, so nothing is registered."""
    return sql(spark, sf_dir, FRAMES[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the test tables and league-shaped frames; only those named are planned."""
    import re

    words = set(re.findall(r"\w+", text))
    # tables are parameters in braces, so other braces are doubled
    args, out = {}, text.replace("{", "{{").replace("}", "}}")
    for t in TABLES:
        if t in words:
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for n in FRAMES:
        if n in words:
            args[n] = frame(spark, sf_dir, n)
    for n in args:
        out = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}} {n}" if not re.search(rf"\b(?:FROM|JOIN)\s+{n}\s+(?!JOIN|WHERE|GROUP|ORDER|ON|CROSS|LEFT|INNER|UNION|USING|LIMIT)\w", out) else rf"\1 {{{n}}}", out)
    return spark.sql(out, **args) if args else spark.sql(text)


def oracle(body: str, *names: str) -> str:
    """``body`` with the named frames as common table expressions."""
    need: list[str] = []
    for n in names:
        for dep in (["event_weeks"] if n in ("roster", "stats") else []) + [n]:
            if dep not in need:
                need.append(dep)
    head = ", ".join(f"{n} AS ({FRAMES[n]})" for n in need)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
