import pytest
from pyspark.sql import functions as F

from leaguelens.operators import change, contracts, dedup, resolve
from leaguelens.operators.store import TableStore


def test_scd2(spark):
    first = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string")
    t1 = change.bootstrap(first, F.lit("2024-01-01"))
    second = spark.createDataFrame([("a", "z"), ("c", None)], "id string, name string")
    t2 = change.scd2_merge(t1, second, ["id"], F.lit("2024-02-01"))
    rows = {(r.id, r.name, str(r.end_date), r.is_current) for r in t2.collect()}
    assert rows == {("a", "x", "2024-02-01", False), ("a", "z", "9999-12-31", True), ("b", "y", "9999-12-31", True), ("c", None, "9999-12-31", True)}
    assert change.bootstrap(first, F.lit("2024-01-01"), None).where("end_date is null").count() == 2
    t3 = change.scd2_merge(t2, second, ["id"], F.lit("2024-03-01"))
    assert sorted(map(str, t3.collect())) == sorted(map(str, t2.collect()))


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    assert store.scd2("p", src, ["id"], F.lit("2024-01-01")) == {"expired": 0, "inserted": 3, "unchanged": 0}
    new = spark.createDataFrame([(1, "a"), (2, "B")], "id long, name string")
    assert store.scd2("p", new, ["id"], F.lit("2024-01-02")) == {"expired": 1, "inserted": 1, "unchanged": 1}
    assert store.read("p").count() == 4
    assert store.write_once("m", src, ["id"]) and not store.write_once("m", src, ["id"])
    assert [r.written for r in store.persist({"x": src, "y": src.limit(0)}, prefix="stg_")] == [3, 0]
    assert [r.written for r in store.persist({"z": src}, dry_run=True)] == [0] and not store.exists("z")
    assert dict(store.inventory())["stg_x"] == 3


def test_store_appends(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    row = lambda i, **more: spark.createDataFrame([(i, *more.values())], ["id", *more])
    for i in range(3):
        store.append("t", row(i))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=000001", "v=000002.add", "v=000003.add"]
    assert [store.read("t", v).count() for v in store.versions("t")] == [1, 2, 3]
    store.append("t", row(3, name="x"))
    store.append("t", spark.createDataFrame([(4,)], "ID int"))
    assert {tuple(r) for r in store.read("t").collect()} == {(0, None), (1, None), (2, None), (3, "x"), (4, None)}
    store.overwrite("t", store.read("t").where("id > 2"))  # the version before it stays readable
    assert store.versions("t") == [1, 2, 3, 4, 5, 6] and store.read("t", 5).count() == 5 and store.read("t").count() == 2
    store.overwrite("t", row(9))
    assert store.versions("t") == [6, 7] and [r.id for r in store.read("t").collect()] == [9]
    narrow = spark.createDataFrame([(1,)], "n int")
    store.append("w", narrow)
    store.append("w", spark.createDataFrame([(2**40,)], "n long"))
    assert sorted(r.n for r in store.read("w").collect()) == [1, 2**40] and dict(store.read("w").dtypes) == {"n": "bigint"}
    store.append("w", narrow.limit(0))
    assert store.read("w").count() == 2


def test_upsert_and_union(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert {tuple(r) for r in change.upsert(a, b, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert change.relaxed_union(a, b.select("id")).where("v is null").count() == 2


def test_dedup(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "y", 3)], "l string, r string, s int")
    assert {r.r for r in dedup.first_by(df, ["l"], F.col("s")).collect()} == {"y"}
    assert {(r.l, r.r) for r in dedup.greedy_one_to_one(df, "l", "r", F.col("s")).collect()} == {("a", "y")}
    assert {(r.l, r.r) for r in dedup.mutual_best(df, "l", "r", F.col("s")).collect()} == {("a", "y")}


def test_contracts(spark):
    c = contracts.CONTRACTS["player"]
    row = spark.createDataFrame([("k", "7.0", 461, "N", "WR")], "player_key string, player_id string, game_id int, full_name string, display_position string")
    got = contracts.validated(row, c).first()
    assert got.player_id == 7 and got.editorial_team_abbr is None
    with pytest.raises(contracts.ContractError, match="missing columns"):
        contracts.validated(row.drop("full_name"), c)
    with pytest.raises(contracts.ContractError, match="unexpected columns"):
        contracts.validated(row.withColumn("more", F.lit(1)), c)
    with pytest.raises(contracts.ContractError, match="duplicate keys"):
        contracts.validated(row.union(row), c)
    with pytest.raises(contracts.ContractError, match="null values"):
        contracts.validated(row.withColumn("game_id", F.lit(None).cast("int")), c)
    assert contracts.empty(spark, c).columns == list(c.types)


@pytest.fixture()
def registry(spark):
    players = spark.createDataFrame(
        [("P1", "Austin Ekeler", "RB", ["A Ekeler"]), ("P2", "Kenneth Gainwell", "RB", []), ("P3", "Jonathan Taylor", "RB", [])],
        "canonical_player_id string, display_name string, primary_position string, aliases array<string>",
    )
    teams = spark.createDataFrame([("T1", "Los Angeles Chargers", "LAC", ["San Diego"])], "canonical_team_id string, canonical_team_name string, canonical_team_abbr string, aliases array<string>")
    source_map = spark.createDataFrame([("yahoo", "1001", "P1", "seed", None)], "source_system string, source_entity_id string, canonical_player_id string, provenance string, valid_from date")
    overrides = spark.createDataFrame([("yahoo", "9", "P3", "2024")], "source_system string, source_entity_id string, canonical_player_id string, approved_at string")
    return players, teams, source_map, overrides


def test_standardize(spark, registry):
    records = spark.createDataFrame(
        [
            ("Yahoo", "1001", "whoever", "SD", "RB", 2024), ("yahoo", "2", "Kenny Gainwell", "LAC", "RB", 2024), ("yahoo", "3", "austin ekeler", "LAC", "HB", 2024),
            ("yahoo", "4", "Nobody Known", "LAC", "RB", 2024), ("yahoo", "9", "x", "?", "?", 2024), ("yahoo", "5", "Austin Ekeler", "LAC", "WR", 2024),
        ],
        "source_system string, source_entity_id string, raw_player_name string, raw_team_name string, raw_position string, season bigint",
    )
    out = {r.source_entity_id: r for r in resolve.standardize(records, *registry).collect()}
    assert (out["1001"].match_method, out["1001"].canonical_player_id, out["1001"].needs_review) == ("source_map", "P1", False)
    assert (out["2"].match_method, out["2"].canonical_player_id, out["2"].match_confidence) == ("nickname_heuristic", "P2", 0.985)
    assert (out["3"].match_method, out["3"].canonical_player_id) == ("exact", "P1")
    assert out["4"].match_method == "unresolved" and out["4"].needs_review and out["4"].canonical_player_id == ""
    assert (out["9"].match_method, out["9"].needs_review) == ("override", False)
    assert out["5"].match_method == "unresolved"  # the name alone scores 0.96
    done = resolve.standardize(records, *registry)
    assert resolve.review_queue(done, F.lit("2024-01-01")).count() == 2
    assert resolve.learned_mappings(done, registry[2]).count() == 4


def test_ambiguous_nickname(spark, registry):
    players, teams, source_map, overrides = registry
    two = players.union(spark.createDataFrame([("P9", "Kendall Gainwell", "RB", [])], players.schema))
    records = spark.createDataFrame([("yahoo", "2", "Kenny Gainwell", "LAC", "RB", 2024)], "source_system string, source_entity_id string, raw_player_name string, raw_team_name string, raw_position string, season bigint")
    r = resolve.standardize(records, two, teams, source_map, overrides).first()
    assert r.match_method == "unresolved" and r.canonical_player_id == ""


def test_crosswalk(spark):
    left = spark.createDataFrame([("aj-brown", "A.J. Brown", "WR"), ("jt", "Jonathan Taylor", "RB")], "left_id string, name string, position string")
    right = spark.createDataFrame([(101, "AJ Brown", "WR"), (102, "Jon Taylor", "RB")], "right_id long, name string, position string")
    ranks = spark.createDataFrame([("jt", 3)], "left_id string, rank int")
    got = {(r.left_id, r.right_id, r.method) for r in resolve.crosswalk(left, right, ranks).collect()}
    assert ("jt", 102, "fuzzy") in got


def test_nearest_pairs_equal_all_pairs(spark):
    import random

    draw = random.Random(4)
    rows = [(draw.choice("abc"), draw.choice("xy") if draw.random() > 0.1 else None, draw.randrange(14), draw.randrange(9) if draw.random() > 0.2 else None) for _ in range(90)]
    rows += [("d", "x", k, v) for k, v in ((1, 1), (1, 2), (1, 3), (2, 9), (3, None))]
    df = spark.createDataFrame(rows, "g string, h string, k long, v int")
    got = {}
    for r in dedup.nearest_pairs(df, ["g", "h"], "k", "v").collect():
        order = (r.gap is None, r.gap or 0, r.left_id)
        got[r.right_id] = min(order, got.get(r.right_id, order))
    want = {}
    for g, h, k, v in rows:
        for g2, h2, k2, v2 in rows:
            if h is not None and (g, h) == (g2, h2) and k != k2:
                none = v is None or v2 is None
                order = (none, 0 if none else abs(v - v2), k2)
                want[k] = min(order, want.get(k, order))
    assert got == want


def test_pairs_are_not_expanded(spark):
    df = spark.range(200).selectExpr("'a' AS g", "id AS k", "CAST(id % 7 AS int) AS v")
    assert dedup.nearest_pairs(df, ["g"], "k", "v").count() == 200
