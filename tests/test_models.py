from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.operators import maps
from leaguelens.operators.store import TableStore
from leaguelens.plans import models
from leaguelens.plans.pipeline import PipelineError, run_pipeline
from leaguelens.plans.presentation import for_display
from leaguelens.sources import payloads


def test_availability_fit(spark):
    rng = np.random.default_rng(1)
    adp = rng.integers(20, 180, 800)
    rows = [(float(a), "RB", float(a) / 4, float(np.clip(round(a + 6 + rng.logistic(0, 8)), 1, 216))) for a in adp]
    df = spark.createDataFrame(rows, "adp double, position string, rank double, pick double")
    beta, gamma = models.fit_availability(df)

    def loss(w):
        x = np.array([[1.0, r[0] / 216, np.log(r[0]) / np.log(216), r[2] / 50, 0.0, 1.0, 0.0] for r in rows])
        z = (np.array([r[3] - r[0] for r in rows]) - x @ w[:7]) * np.exp(-x @ w[7:])
        return float(np.mean(x @ w[7:] + z + 2 * np.log1p(np.exp(-z))))

    best = np.array(beta + gamma)
    assert loss(best) < loss(np.array([6.0] + [0.0] * 6 + [np.log(8)] + [0.0] * 6))  # the law the rows were drawn from
    slopes = [(loss(best + d) - loss(best - d)) / 2e-4 for d in np.eye(14) * 1e-4]
    assert np.abs(slopes).max() < 1e-3
    with_nulls = df.unionByName(spark.createDataFrame([(None, "RB", 1.0, 2.0), (3.0, None, None, 2.0)], df.schema))
    np.testing.assert_allclose(np.concatenate(models.fit_availability(with_nulls)), best, atol=1e-2)
    assert models.fit_availability(df.where("false")) == ([0.0] * 7, [float(np.log(4.5))] + [0.0] * 6)
    board = df.withColumn("target", F.col("adp") + 5).withColumn("available", F.col("pick") > F.col("target"))
    start = models.availability_scores(board, [0.0] * 7, [2.0] + [0.0] * 6)
    assert models.availability_scores(board, beta, gamma)["log_loss"] < start["log_loss"]
    a, b = models.split_by_hash(df.withColumn("g", F.lit(1)).withColumn("k", F.monotonically_increasing_id()), "g", "k")
    assert a.count() == 640 and b.count() == 160


def test_auction_roster_is_optimal():
    rng = np.random.default_rng(0)
    board = [{"player": i, "position": p, "cost": int(rng.integers(1, 12)), "overall_tier": int(rng.integers(1, 9)), "position_tier": int(rng.integers(1, 8))} for i, p in enumerate(["RB"] * 5 + ["WR"] * 5 + ["QB"] * 3)]
    limits, starters = {"RB": (2, 3), "WR": (2, 3), "QB": (1, 1)}, {"RB": 1, "WR": 1, "QB": 1}

    def ok(rows):
        n = {p: [r for r in rows if r["position"] == p] for p in limits}
        start = sum(sum(sorted((r["cost"] for r in n[p]), reverse=True)[: starters[p]]) for p in limits)
        return (all(lo <= len(n[p]) <= hi for p, (lo, hi) in limits.items()) and sum(r["cost"] for r in rows) <= 30 and start >= 0.5 * 30
                and any(r["position_tier"] <= 4 for r in n["RB"]) and sum(r["position_tier"] <= 6 for r in n["RB"]) >= 2)

    good = [c for c in combinations(board, 6) if ok(c)]
    least = min(sum(r["overall_tier"] for r in c) for c in good)
    second = lambda c: sum(r["position_tier"] for r in c if r["position"] in ("WR", "TE"))
    want = min(second(c) for c in good if sum(r["overall_tier"] for r in c) <= least + 1)
    got = models.best_auction_roster(board, 30, limits, 6, starters, 0.5)
    assert ok(got) and second(got) == want and sum(r["overall_tier"] for r in got) <= least + 1


def test_snake_frontier():
    rng = np.random.default_rng(0)
    options = [{"turn": t, "full_name": f"p{i}", "position": "RB" if i % 2 else "WR", "overall_tier": int(rng.integers(1, 9)), "position_tier": int(rng.integers(1, 9))} for i in range(6) for t in ("1", "2") if rng.random() < 0.8]
    got = models.snake_frontier(options, {"1": 1, "2": 2}, {"RB": 1, "WR": 2})
    sums = set()
    for c in combinations(options, 3):
        if len({r["full_name"] for r in c}) == 3 and sum(r["turn"] == "1" for r in c) == 1 and sum(r["position"] == "RB" for r in c) == 1:
            sums.add((sum(r["overall_tier"] for r in c), sum(r["position_tier"] for r in c)))
    front = {x for x in sums if not any(y != x and y[0] <= x[0] and y[1] <= x[1] for y in sums)}
    assert {(a, b) for a, b, _ in got} == front


def test_simulations(spark):
    scores = {k: list(range(i, i + 16)) for i, k in enumerate("abcd")}
    rows = models.bye_simulation(spark, scores, 20, 10).collect()
    assert len(rows) == 20 and all(r.apart >= r.same for r in rows)
    a = spark.createDataFrame([("x", 1, 5.0), ("y", 1, 7.0), ("x", 2, 1.0)], "player_id string, week int, fantasy_pts double")
    assert {r.week: r.difference for r in models.composition_difference(a, a, (1, 2)).collect()} == {1: 5.0, 2: 0.0}
    assert models.composition_difference(a, a, (1, 1), seed=3).count() == 2


def test_price_intervals(spark):
    rng = np.random.default_rng(0)
    rows = [(p, float(r), float(60 - r + rng.normal())) for p in ("QB", "RB", "TE") for r in range(1, 40)]
    past = spark.createDataFrame(rows, "position string, rank double, price double")
    board = spark.createDataFrame([("a", "QB", 5.0), ("b", "RB", 5.0), ("c", "TE", 5.0), ("d", "K", 5.0)], "player_id string, position string, rank double")
    got = {r.player_id: r for r in models.price_intervals(past, board, ["rank"]).collect()}
    assert all(abs(got[k].median - 55) <= 4 and got[k].low <= got[k].median <= got[k].high for k in "abc") and got["d"].median == 1
    costs = models.sampled_costs(spark.createDataFrame([("a", 10, 12, 20)], "player_id string, low long, median long, high long")).first()
    assert 10 <= costs.conservative_cost <= 22


def test_maps(spark):
    ranks = spark.createDataFrame([("1", "Patrick Mahomes II", "QB", 1), ("2", "Bears", "DST", 2), ("3", "Nobody", "RB", 3), ("4", "Late Guy", "RB", 180)], "fl_id string, player string, position string, consensus_rank int")
    cw = spark.createDataFrame([("m1", "Patrick Mahomes", "QB"), ("m2", "Late Guy", "RB")], "mfl_id string, name string, position string")
    got = {r.fl_id: r.match_method for r in maps.rankings_map(ranks, cw).collect()}
    assert got == {"1": "name_position", "2": "dst_skipped", "3": "unmatched"}
    assert {r.fl_id for r in maps.rankings_map(ranks, cw, inclusive=True).collect()} == {"1", "2", "3", "4"}
    assert {r.match_method: r.n for r in maps.matching_summary(maps.rankings_map(ranks, cw)).collect()}["unmatched"] == 1
    sl = spark.createDataFrame([("s1", "Pat Mahomes", "QB")], "sleeper_id string, name string, position string")
    assert maps.name_or_prefix_map(sl, cw).first().method == "prefix_position"
    src = spark.createDataFrame([("e1", "late guy", "rb", "X"), ("e2", "other", "RB", "Y")], "etr_id string, name string, position string, team string")
    done, left = maps.incremental_map(src, cw.withColumn("team", F.lit("Z")), spark.createDataFrame([], "etr_id string, mfl_id string, method string"), "etr_id")
    assert [r.mfl_id for r in done.collect()] == ["m2"] and [r.etr_id for r in left.collect()] == ["e2"]


def test_history(spark):
    raw = spark.createDataFrame([("h1", "JUSTIN JEFFERSON", "WR"), ("h2", "Amon Ra St Brown", "WR"), ("h3", "Kenny Gainwell", "RB"), ("h4", "Bears", "DEF"), ("h5", "Zzz Qqq", "RB")], "source_row_hash string, player_name_raw string, position_raw string")
    players = spark.createDataFrame([("p1", "Justin Jefferson", "WR", "MIN"), ("p2", "Amon-Ra St. Brown", "WR", "DET"), ("p3", "Kenneth Gainwell", "RB", "PHI"), ("p4", "Bears Chicago", "DEF", "CHI")], "player_key string, full_name string, display_position string, editorial_team_abbr string")
    got = {r.source_row_hash: (r.yahoo_player_key, r.resolution_method, r.resolution_status) for r in maps.resolve_history(raw, players).collect()}
    assert got["h1"] == ("p1", "exact", "resolved") and got["h2"] == ("p2", "exact", "resolved") and got["h3"] == ("p3", "nickname_heuristic", "resolved")
    assert got["h4"] == ("p4", "dst_team_phrase", "resolved") and got["h5"][2] == "unresolved"
    # an earlier step wins over a later one with another player, and the last key within a step
    raw = spark.createDataFrame([("h6", "Chicago", "DEF"), ("h7", "Kenneth Gainwell", "RB"), ("h8", "Justin Jeferson", "WR")], raw.schema)
    more = players.union(spark.createDataFrame([("p5", "Chicago", "DEF", "XXX"), ("p6", "Kenneth Gainwell", "RB", "TB")], players.schema))
    got = {r.source_row_hash: (r.yahoo_player_key, r.resolution_method) for r in maps.resolve_history(raw, more).collect()}
    assert got == {"h6": ("p5", "exact"), "h7": ("p6", "exact"), "h8": ("p1", "fuzzy")}


def test_payloads(spark, tmp_path):
    import json

    body = {"x": [{"team_key": "461.l.1.t.2", "team_id": "2", "name": "Two", "league_key": "461.l.1", "owner_name": "O"}, {"game_id": "461", "season": "2025", "code": "nfl"}], "l": "461.l.1"}
    df = spark.createDataFrame([(json.dumps(body),)], "payload string")
    t = payloads.entity(df, "team", renames={"name": "team_name"}).first()
    assert (t.team_id, t.team_name, t.league_key) == (2, "Two", "461.l.1")
    assert payloads.games(df).first().code == "nfl" and payloads.league_keys(df).first().league_key == "461.l.1"
    p = tmp_path / "x.csv"
    p.write_text('Title\n\nRank,Player,Position,Min,Max\n1,"A, B",RB,1,4\n')
    r = payloads.adp_export(spark, str(p), 2025).first()
    assert (r.full_name, r.position, r.adp, r["rank"]) == ("A, B", "RB", 2.5, 1)
    page = spark.createDataFrame([(1, '<a href="/nfl/players/7/jo-doe" data-player="x"><img alt="Joe Doe"></a><a href="/nfl/players/8/al-bo" data-player></a>')], "page_id long, html string")
    assert {(r.fl_id, r.full_name) for r in payloads.player_links(page).collect()} == {("7", "Joe Doe"), ("8", "Al Bo")}
    feed = spark.createDataFrame([("G1", "A B", "A", "B", "LAC", "RB")], "gsis_id string, display_name string, first_name string, last_name string, team string, position string")
    ids = spark.createDataFrame([("G1", "11", None)], "gsis_id string, yahoo_id string, espn_id string")
    games = spark.createDataFrame([("LAC", "KC")], "home_team string, away_team string")
    reg = payloads.canonical_registry(feed, ids, games, "v1")
    assert reg["teams"].count() == 2 and [tuple(r)[:3] for r in reg["source_map"].collect()] == [("yahoo", "11", "G1")]
    st = spark.createDataFrame([("l", 1, "a", 0, 5.0), ("l", 1, "b", 0, 9.0)], "league_key string, season int, team_key string, rank bigint, points_for double")
    assert {r.team_key: r["rank"] for r in payloads.ranked_standings(st).collect()} == {"a": 2, "b": 1}


def test_pipeline_and_display(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    league = spark.createDataFrame([("k", "1", 461, "nfl", 2025, "L", "head", "private")], "league_key string, league_id string, game_id int, game_code string, season int, league_name string, scoring_type string, league_type string")
    report = run_pipeline(lambda: {"league": league}, store, "nfl")
    assert report.ok and store.read("nfl_league").count() == 1
    with pytest.raises(PipelineError, match="missing columns") as e:
        run_pipeline(lambda: {"league": league.drop("season")}, store)
    assert [s.status for s in e.value.report.stages] == ["ok", "failed"]
    assert for_display(league).columns == ["game_id", "game_code", "season", "league_name", "scoring_type", "league_type"]
    assert for_display(league.select("league_key")).columns == ["league_key"]
