import json

from pyspark.sql import functions as F

from leaguelens.operators.store import TableStore
from leaguelens.sources import files, pages
from leaguelens.sources.offsets import SeasonSource
from leaguelens.streaming.incremental import scd2_stream, windowed_counts


def test_adp_and_rankings(spark, tmp_path):
    a = tmp_path / "adp.csv"
    a.write_text('Rank,Player (Bye),POS,ESPN,Sleeper,AVG\n1,"Christian McCaffrey   SF (9)",RB1,1,2,1.5\n2,Nobody,WR1,—,—,—\n', encoding="utf-8")
    r = files.read_adp(spark, str(a)).orderBy("rank").collect()
    assert (r[0].full_name, r[0].team, r[0].bye_week, r[0].position, r[0].adp, r[0].adp_formatted) == ("Christian McCaffrey", "SF", 9, "RB", 1.5, "1.01")
    assert r[1].adp is None and r[1].espn is None
    b = tmp_path / "half_ppr_rankings.csv"
    b.write_text("Rank,Player,Position,Ann,Bob\n1,One,WR,1,3\n2, ,WR,1,1\n")
    r = files.read_rankings(spark, str(b)).collect()
    assert len(r) == 1 and r[0].rank_stddev == 1.0 and r[0].scoring_format == "Half PPR"
    c = tmp_path / "auction.csv"
    c.write_text("histi,Pick,Salary,Team,Player,Position,Dollar_Rank,Pos_Dollar_Rank\n2024,1,$60,MIN,JUSTIN JEFFERSON,WR,1,1\n")
    r = files.read_auction_values(spark, str(c)).first()
    assert (r.auction_price, r.player_name_normalized, r.position_normalized) == (60.0, "justin jefferson", "WR")


def test_pages(spark):
    html = '<title>T</title><table id="data"><tr><th>A</th></tr><tr><td> x </td><td>y</td></tr></table><a href="/p/1">One</a><script>window.c = {"t": {"rows": [{"id": 1, "n": "a}"}]}};</script>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [r.cells for r in pages.table_rows(df).orderBy("row").collect()] == [["A"], ["x", "y"]]
    assert [(r.href, r.label) for r in pages.links(df).collect()] == [("/p/1", "One")]
    got = pages.extract_json(df, "window.c =").orderBy("page_id").collect()
    assert json.loads(got[0].payload)["t"]["rows"][0]["n"] == "a}" and got[1].payload is None
    rows = pages.records(pages.extract_json(df, "window.c ="), "payload", ["id"], ["id", "n"]).collect()
    assert [(r.id, r.n) for r in rows] == [("1", "a}")]
    m = spark.createDataFrame([(1, ("a", 1.0), ("b", 2.0))], "week int, left struct<team_key:string,points:double>, right struct<team_key:string,points:double>")
    assert {(r.team_key, r.opponent_points) for r in pages.mirrored_matchups(m).collect()} == {("a", 2.0), ("b", 1.0)}


def test_offset_source_and_stream(spark, tmp_path):
    data, out = tmp_path / "in", tmp_path / "out"
    data.mkdir()
    for s in (2023, 2024):
        (data / f"season={s}.json").write_text(json.dumps([{"season": s, "key": "a", "v": s}, {"season": s, "key": f"k{s}", "v": 1}]))
    spark.dataSource.register(SeasonSource)
    assert spark.read.format("seasons").option("path", str(data)).load().count() == 4
    store = TableStore(spark, str(out))

    def run():
        stream = spark.readStream.format("seasons").option("path", str(data)).load()
        scd2_stream(stream, store, "t", ["key"], "season", "2024-01-01", str(tmp_path / "cp")).awaitTermination()

    run()
    assert {r.key: r.season for r in store.read("t").where("is_current").collect()} == {"a": 2024, "k2023": 2023, "k2024": 2024}
    (data / "season=2025.json").write_text(json.dumps([{"season": 2025, "key": "a", "v": 1}]))
    run()
    assert store.read("t").where("key = 'a'").count() == 2


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 01:20:00", "y")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in windowed_counts(df, "ts", "k").collect()) == [1, 2]
