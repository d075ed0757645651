import difflib

import numpy as np

from leaguelens.operators import resolve
from leaguelens.plans import models


def test_fuzzy_search_meets_the_whole_registry(spark):
    rng = np.random.default_rng(0)
    names = ["CHRIS", "ANNA BELL", *{"".join(rng.choice(list("ABCDEF"), 4)) + " " + "".join(rng.choice(list("GHIJ"), 5)) for _ in range(80)}]
    ids = [f"P{i:03}" for i in range(len(names))]
    players = spark.createDataFrame([(i, n, "RB" if k % 2 else "WR", []) for k, (i, n) in enumerate(zip(ids, names))], "canonical_player_id string, display_name string, primary_position string, aliases array<string>")
    asked = ["KRIS", "HANNA PELL", "XYZW QQQ", "BAD GIG", "FEE HIJ"]
    records = spark.createDataFrame([(a, a, None if k == 3 else "RB") for k, a in enumerate(asked)], "record_id string, raw_player_name string, position string")
    got = {(r.record_id, r["rank"]): (r.canonical_player_id, r.confidence) for r in resolve.match_players(records, players).collect()}
    want = {}
    for k, a in enumerate(asked):
        rows = [(i, min(1.0, difflib.SequenceMatcher(None, a, n).ratio() + (0.02 if k != 3 and j % 2 else 0.0))) for j, (i, n) in enumerate(zip(ids, names))]
        rows = sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0]))[:5]
        want |= {(a, r + 1): v for r, v in enumerate(rows)}
    assert got == want


def test_price_fit_takes_every_row(spark):
    # the many rows of one price must outweigh the few of another
    rows = [("RB", float(r % 10), 10.0 + k % 7) for k, r in enumerate(range(4000))]
    past = spark.createDataFrame(rows, "position string, rank double, price double")
    board = spark.createDataFrame([("a", "RB", 3.0)], "player_id string, position string, rank double")
    got = models.price_intervals(past, board, ["rank"]).first()
    x, y = np.array([[r[1]] for r in rows]), np.array([r[2] for r in rows])
    z = (x - x.mean()) / x.std()
    kernel = models._kernel(z, z, 1.0, True)
    cross = models._kernel((np.array([[3.0]]) - x.mean()) / x.std(), z, 1.0, True)
    mid = (cross @ np.linalg.solve(kernel + 0.1 * np.eye(len(z)), (y - y.mean()) / y.std())) * y.std() + y.mean()
    mean, _ = models.gaussian_process(x, y, np.array([[3.0]]), 1.0, True)
    assert np.allclose(mean, mid) and got.median == round(float(mid[0]))


def test_price_of_one_rank_is_the_mean_of_all(spark):
    past = spark.createDataFrame([("RB", 3.0, float(k)) for k in range(1, 3002)], "position string, rank double, price double")
    board = spark.createDataFrame([("a", "RB", 3.0)], "player_id string, position string, rank double")
    assert models.price_intervals(past, board, ["rank"]).first().median == 1501
