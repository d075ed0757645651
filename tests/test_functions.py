import difflib
import statistics

from pyspark.sql import functions as F

from leaguelens.functions import casts, hashing, stats, text


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_names(spark):
    cases = {
        "Ja'Marr Chase": "jamarr chase", "Amon-Ra St. Brown": "amon-ra st brown", "Patrick Mahomes III": "patrick mahomes",
        "   ": "", "Davantê": "davante", "Odell Beckham Jr.": "odell beckham",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", text.normalize_name(F.col("raw")))
    assert all(r.got == r.want for r in df.collect())


def test_player_team_position(spark):
    r = one(
        spark, text.normalize_player_name(F.col("n")), text.normalize_team_code(F.col("t")), text.normalize_position(F.col("p")), text.normalize_team_code(F.col("u")),
        n="José Ramírez II Jr", t="Oakland Raiders", p="fb", u="KC",
    )
    assert list(r) == ["JOSE RAMIREZ", "LV", "RB", "KC"]


def test_slug_split_prefix(spark):
    parts = text.split_player_field(F.col("a"))
    r = one(spark, text.slugify(F.col("n"), F.lit("LAC")), parts["name"], parts["team"], parts["bye"], text.same_prefix(F.col("n"), F.lit("ken")), text.starts_with_phrase(F.col("n"), F.lit("ke")), n="ken Gainwell", a="Christian McCaffrey   SF (9)")
    assert list(r) == ["ken-gainwell_lac", "Christian McCaffrey", "SF", 9, True, False]


def test_similarity_matches_difflib(spark):
    a, b = "KENNY GAINWELL", "KENNETH GAINWELL"
    assert one(spark, text.sequence_ratio(F.col("a"), F.col("b")), a=a, b=b)[0] == difflib.SequenceMatcher(None, a, b).ratio()


def test_casts(spark):
    r = one(
        spark, casts.safe_int(F.col("a")), casts.dollars(F.col("b")), casts.truthy(F.col("c")), casts.dash_null(F.col("d")), casts.safe_int(F.col("e")), casts.truthy(F.col("e")),
        a="28.0", b="$1,060", c=" Yes", d="-", e="x",
    )
    assert list(r) == [28, 1060.0, True, None, None, None]


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, 4.0, None), (1.0, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(stats.row_stddev(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [statistics.pstdev([1, 4]), None]
    assert [r[0] for r in spark.createDataFrame([(1.4,), (13.0,), (24.0,)], "x double").select(stats.snake_pick(F.col("x"))).collect()] == ["1.01", "2.01", "2.12"]
    nulls = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "k string, v int").groupBy("k").agg(stats.sum0(F.col("v")).alias("s"), stats.n_unique(F.col("v")).alias("n"))
    assert {r.k: (r.s, r.n) for r in nulls.collect()} == {"a": (1.0, 2), "b": (0.0, 1)}


def test_availability_bounds(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (100.0,), (216.0,), (217.0,)], "y double")
    p = [r[0] for r in df.select(stats.p_available(F.lit(50.0), F.lit("RB"), F.lit(20.0), F.col("y"), [0.0] * 7, [2.0] + [0.0] * 6)).collect()]
    assert p[0] == 1.0 and p[1] == 1.0 and 0 < p[2] < 1 and p[3] == 0.0 and p[4] == 0.0


def test_hashes(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    a = df.select(hashing.row_hash("a", "b")).collect()
    assert a[0][0] == __import__("hashlib").sha256(b"1|__NULL__").hexdigest()
    assert hashing.frame_digest(df) == hashing.frame_digest(df.orderBy(F.desc("a")))
    assert set(hashing.record_hash(df, "d").columns) == {"a", "b", "_record_hash", "_dataset", "_loaded_at"}
