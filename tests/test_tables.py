import json

import pytest
from pyspark.sql import functions as F

from leaguelens.functions import dates, stats, text
from leaguelens.operators import resolve, tables
from leaguelens.operators.contracts import CONTRACTS, Contract, ContractError, check_in_order, check_record, get_contract, row_problems
from leaguelens.sources import datasets, files, payloads, rest


def test_records_become_a_typed_table(spark):
    df = tables.from_records(spark, [{"league_key": "k", "season": "2024", "more": 1}], CONTRACTS["league"])
    row = df.first()
    assert df.columns == list(CONTRACTS["league"].types) and (row.league_key, row.season, row.num_teams) == ("k", 2024, None)


def test_record_checks():
    c = Contract("c", {"a": "bigint", "b": "bigint"}, ("b",), ("a",))
    check_record({"a": 1, "x": 2}, c)
    for bad, allow in (({}, True), ({"a": None}, True), ({"a": 1, "x": 2}, False)):
        with pytest.raises(ContractError):
            check_record(bad, c, allow)


def test_sport_contracts():
    assert "games_back" in get_contract("standings", "nba").types and "games_back" not in get_contract("standings", "nfl").types
    assert get_contract("league", "nba") is CONTRACTS["league"]
    with pytest.raises(KeyError):
        get_contract("nothing", "nfl")


def test_first_problem_names_its_row(spark):
    c = Contract("c", {"i": "int", "a": "bigint", "b": "bigint"}, ("b",), ("a", "b"))
    rows = [(i, i // 2, i % 2) for i in range(100)] + [(100, 3, 1), (101, None, 0), (102, 7, None)]
    df = spark.createDataFrame(rows, "i int, a bigint, b bigint").repartition(7)
    found = {(r.row, r.problem) for r in row_problems(df, c, ["i"]).collect()}
    assert found == {(100, "duplicate key"), (101, "null: a"), (102, "null key: b")}
    with pytest.raises(ContractError, match="row 100: duplicate key"):
        check_in_order(df, c, ["i"])
    check_in_order(df.where("i < 100"), c, ["i"])


def test_rows_are_numbered_alike_whatever_the_partitions(spark):
    # more rows a partition than Spark samples for its range bounds
    c = Contract("c", {"i": "bigint", "a": "bigint"}, ("i",), ())
    n = 100_000
    df = spark.range(0, n, 1, 6).select(F.when(F.col("id") < n - 3, F.pmod(F.col("id") * 7919, F.lit(n - 3))).alias("i"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("a"))
    wide = F.concat(*[F.sha2(F.concat("i", F.lit(k)), 256) for k in "abcdefgh"])
    found = row_problems(df.withColumn("text", wide), c, ["i"])
    got = found.agg(F.count(F.lit(1)), F.count_if(F.col("i") != F.col("row")), F.countDistinct("row"), F.min(F.when(F.col("i").isNull(), F.col("row")))).first()
    want = df.where("a is null").count()
    assert tuple(got) == (want, 0, want, n - 3)


def test_contract_problems_of_odd_orders(spark, tmp_path):
    from leaguelens.plans.registry_tables import contract_problems

    rows = [(1, 5, "O", None), (2, 5, "F", None), (None, 5, "P", "2024-01-01"), (4, 11, "O", "2024-01-01"), (None, 5, "O", None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    # the name of a column, too, is read as a table
    spark.range(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in contract_problems(spark, str(tmp_path)).where("o_orderkey is not null").collect()}
    assert got == {(1, "duplicate key", 2), (2, "null key: customer", 4)}


def test_key_violations_count_null_keys(spark, tmp_path):
    from leaguelens.plans.registry_tables import key_violations

    lines = [(1, "A"), (1, "A"), (1, "B"), (None, "A"), (None, "A"), (None, "A"), (2, None), (2, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string").selectExpr("*", "1 l_linenumber", "2L l_partkey", "3L l_suppkey", "4D l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in key_violations(spark, str(tmp_path)).collect()} == {(1, "A", 1), (None, "A", 2), (2, None, 1)}


def test_null_required_keeps_null_keys(spark, tmp_path):
    from leaguelens.plans.registry_tables import null_required

    rows = [(1, "BUILDING"), (None, "BUILDING"), (None, "OTHER"), (2, "OTHER"), (1, "BUILDING")]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted((r.c_custkey is None, r.c_custkey) for r in null_required(spark, str(tmp_path)).collect()) == [(False, 1), (False, 1), (True, None)]


def test_not_in_without_a_broadcast_of_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    for others, want in (([(2,)], [1]), ([(2,), (None,)], []), ([], [1, 2, None])):
        out = tables.not_in(df, "k", spark.createDataFrame(others, "o long"), "o")
        assert sorted((r.k for r in out.collect()), key=str) == sorted(want, key=str)
        assert "HashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_fill_crosses_groups_only_forwards(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None), ("b", 2, None), ("c", 1, "y")]
    got = tables.fill_back_then_on(spark.createDataFrame(rows, "g string, i int, v string"), ["g"], ["i"], ["v"]).orderBy("g", "i").collect()
    assert [r.v for r in got] == ["x", "x", "x", "x", "x", "y"]


def test_joins_and_views(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, n string")
    right = spark.createDataFrame([(1, "z", 9)], "k int, n string, v int")
    assert {tuple(r) for r in tables.suffix_join(left, right, ["k"]).collect()} == {(1, "a", "z", 9), (2, "b", None, None)}
    facts = left.withColumn("is_current", F.col("k") == 1)
    tables.current_view(facts, right, ["k"], "vw_current")
    assert spark.table("vw_current").count() == 1
    assert [r.k for r in tables.by_key(left.orderBy(F.desc("k")), Contract("c", {"k": "int"}, (), ("k", "gone"))).collect()] == [1, 2]


def test_ddl(spark, tmp_path):
    c = Contract("c", {"a": "bigint", "b": "string"}, ("b",), ("a",))
    assert tables.create_table_sql("t", c, {"b": "it's"}) == "CREATE TABLE IF NOT EXISTS t (`a` bigint NOT NULL, `b` string COMMENT 'it\\'s') USING parquet TBLPROPERTIES ('primary_key' = 'a')"


def test_dates_and_rounding(spark):
    df = spark.createDataFrame([("2024-01-02", 2.675), ("13:00", 0.125), ("2024-01-03T03:04:05+02:00", None), (None, 1.0)], "t string, x double")
    got = df.select(dates.lenient_date(F.col("t")).cast("string").alias("d"), dates.iso_utc(dates.lenient_utc(F.col("t"))).alias("u"), stats.exact_round(F.col("x"), 2).alias("r")).collect()
    assert [(r.d, r.u) for r in got] == [("2024-01-02", "2024-01-02T00:00:00+00:00"), (None, None), ("2024-01-03", "2024-01-03T01:04:05+00:00"), (None, None)]
    assert [r.r for r in got] == [2.67, 0.12, None, 1.0]


def test_team_names(spark):
    names = ["Green Bay", "sdg", "NY Jets", "New York", "Kansas City Chiefs", None]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r[0] for r in df.select(text.team_code_of_name(F.col("t"))).collect()] == ["GB", "LAC", "NYJ", "New York", "KC", None]


def test_data_sets(spark, tmp_path):
    assert len(datasets.INTEGERS) == 21
    path = tmp_path / "injuries.csv"
    path.write_text("season,week,out,report_date,player\n2023,1,yes,2023-09-01,a\n2024,x,2,bad,b\n")
    rows = {r.player: r for r in datasets.load(spark, str(path), "injuries").collect()}
    assert (rows["a"].season, rows["a"].out, str(rows["a"].report_date)) == (2023, True, "2023-09-01")
    assert (rows["b"].week, rows["b"].out, rows["b"].report_date, rows["b"]._dataset) == (None, None, None, "injuries")
    assert datasets.load(spark, str(path), "injuries", [2024]).count() == 1
    assert datasets.next_offset("schedules", {}, [2, 1]) == ([1, 2], {"completed": True})
    first, after = datasets.next_offset("play_by_play", {}, [2023, 2024], True)
    assert first == [2023, 2024] and datasets.next_offset("play_by_play", after, [2023, 2024], True)[0] == [2024]
    with pytest.raises(NotImplementedError):
        datasets.read_deletes("teams")
    assert {t.ingestion for t in datasets.tables()} == {"cdc", "snapshot"}


def test_sheets(spark, tmp_path):
    a = tmp_path / "points.csv"
    a.write_text("﻿NAME,Position,Team,BYE,OVERALL,$,EXODIA\nOne,rb,sf,9,1,$60,1\n ,wr,x,1,2,$5,0\nTwo,wr,gb,,2,,0\n", encoding="utf-8")
    got = files.read_fantasy_sheet(spark, str(a)).orderBy("overall_rank").collect()
    assert [(r.player, r.position, r.bye, r.auction_value, r.exodia) for r in got] == [("One", "RB", 9, 60, True), ("Two", "WR", None, None, False)]
    b = tmp_path / "Rankings – Full PPR.csv"
    b.write_text("Player,Rank\nx,1\n")
    c = tmp_path / "Rankings - Half PPR.csv"
    c.write_text("Player,Tier\ny,2\n")
    many = files.read_many(spark, {str(b): {"season": 2024}, str(c): {"season": 2023}}).withColumn("format", files.dashed_format("source_file"))
    assert {(r.player, r["rank"], r.tier, r.season, r.format) for r in many.collect()} == {("x", "1", None, 2024, "Full PPR"), ("y", None, "2", 2023, "Half PPR")}


def test_client(tmp_path):
    answers = [(500, ""), (200, '{"a": 1}'), (200, "[]"), (999, "")]
    waits = []
    client = rest.Client(lambda path: answers.pop(0), cache=str(tmp_path / "cache"), sleep=waits.append)
    assert client.get("/x") == {"a": 1} and client.get("/x") == {"a": 1} and client.get("/y") == []
    assert client.stats == {"requests": 3, "cached": 1, "retries": 1, "denied": 0} and len(waits) == 1
    with pytest.raises(rest.RequestDenied):
        client.get("/z")
    with pytest.raises(RuntimeError):
        rest.Client(lambda path: (404, "")).get("/x")


def test_pages(spark, tmp_path):
    rows = [{"k": i % 30, "n": i} for i in range(55)]
    read = list(rest.pages(lambda at, n: rows[at : at + n], 10))
    assert read == rows and [r["n"] for r in rest.last_by_key(iter(read), "k")][:3] == [30, 31, 32]
    assert len(list(rest.pages(lambda at, n: [{}] * n, 10, 3))) == 30

    def season(s):
        if s == 2:
            raise LookupError(s)
        return [s]

    assert rest.over_seasons(season, range(1, 4)) == [1, 3]
    with pytest.raises(LookupError):
        rest.over_seasons(season, [2])
    for at in (0, 10, 30):
        (tmp_path / f"offset={at}.json").write_text(json.dumps(rows[at : at + 10]))
    spark.dataSource.register(rest.PagedSource)
    got = spark.read.format("paged").option("path", str(tmp_path)).option("size", 10).load()
    assert sorted(json.loads(r.payload)["n"] for r in got.collect()) == list(range(20))


def test_layouts(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert rest.first_layout("p", lambda p: None, lambda p: df.limit(0), lambda p: df) is df
    with pytest.raises(ValueError):
        rest.first_layout("p", lambda p: None)


def test_auth_code():
    assert [payloads.auth_code(x) for x in ("https://x.y/?code=ab&state=1", "?code=cd", "ef&state=2", " gh ", "", "https://x.y/")] == ["ab", "cd", "ef", "gh", "", ""]


def test_correlation_ignores_rows_with_a_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 99.0), (50.0, None)], "a double, b double")
    got = {(r.a, r.b): r.corr for r in tables.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "a"] == 1.0 and abs(got["a", "b"] - 1) < 1e-12 and got["a", "b"] == got["b", "a"]


def test_closed_reviews_stay_closed(spark):
    queue = spark.createDataFrame([("1", "s", "e", "new"), ("2", "s", "e", "resolved"), ("3", "s", "e", None)], "queue_id string, source_system string, source_entity_id string, queue_status string")
    opened, closed = resolve.split_queue(queue)
    assert [r.queue_id for r in opened.collect()] == ["1"] and sorted(r.queue_id for r in closed.collect()) == ["2", "3"]
