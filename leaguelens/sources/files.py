"""Rankings and auction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.functions.casts import dollars, safe_float, safe_int
from leaguelens.functions.hashing import row_hash
from leaguelens.functions.stats import row_stddev, snake_pick
from leaguelens.functions.text import normalize_name, normalize_position, split_player_field


def snake_case(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores; unnamed ones go."""
    import re

    names = [re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", c.strip().lower().lstrip("﻿"))) for c in df.columns]
    keep = [(c, n) for c, n in zip(df.columns, names) if n and not n.startswith(("unnamed", "_c"))]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in keep])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under snake-case names, the file's name in ``source_file``."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=False, mode="PERMISSIVE")
    # names come percent-encoded
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return snake_case(raw.withColumn("source file", name))


def scoring_format(file_name: str) -> Column:
    """Half PPR, Standard, or else PPR, by the file's name."""
    name = F.lower(F.col(file_name))
    return F.when(name.contains("half_ppr") | name.contains("half-ppr"), "Half PPR").when(name.contains("standard"), "Standard").otherwise("PPR")


def dashed_format(file_name: str) -> Column:
    """What stands after a dash at the end of a csv file's name, as in ``Rankings - Full PPR.csv``; null without one."""
    return F.nullif(F.trim(F.regexp_extract(file_name, r"(?i)[\u2013\u2014-]\s*(.+?)\s*\.csv$", 1)), F.lit(""))


def read_rankings(spark: SparkSession, path: str, known: tuple[str, ...] = ("rank", "player", "team", "position", "pos", "bye", "adp", "consensus_rank", "source_file")) -> DataFrame:
    """A rankings sheet: every column that isn't known is a ranker; adds their deviation and the scoring format."""
    df = read_csv(spark, path)
    rankers = [c for c in df.columns if c not in known]
    df = df.where("trim(player) <> ''").withColumns({c: safe_float(F.col(c)) for c in rankers})
    return df.withColumns({"rank_stddev": F.round(row_stddev(*[F.col(c) for c in rankers]), 2) if rankers else F.lit(None).cast("double"), "scoring_format": scoring_format("source_file")})


def read_adp(spark: SparkSession, path: str) -> DataFrame:
    """A draft-position sheet whose player cell also holds team and bye week."""
    df = read_csv(spark, path)
    df = df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("—")) for c in df.columns})
    cell = "player_bye" if "player_bye" in df.columns else "player"
    parts = split_player_field(F.col(cell))
    df = df.withColumns({"full_name": parts["name"], "team": parts["team"], "bye_week": parts["bye"], "adp": safe_float(F.col("avg")), "rank": safe_int(F.col("rank"))})
    return df.withColumns({"position": F.regexp_extract("pos", "^([A-Z]+)", 1), "adp_formatted": F.when(F.col("adp").isNotNull(), snake_pick(F.col("adp")))})


def read_auction_values(spark: SparkSession, path: str) -> DataFrame:
    """Past auction prices with normalized names and a content hash."""
    df = read_csv(spark, path)
    need = {"histi", "pick", "salary", "team", "player", "position", "dollar_rank", "pos_dollar_rank"}
    if missing := sorted(need - set(df.columns)):
        raise ValueError(f"missing columns {missing}")
    out = df.select(
        safe_int(F.col("histi")).alias("season"), safe_int(F.col("pick")).alias("pick_number"), dollars(F.col("salary")).alias("auction_price"),
        F.col("team").alias("team_raw"), F.col("player").alias("player_name_raw"), F.col("position").alias("position_raw"),
        safe_int(F.col("dollar_rank")).alias("dollar_rank"), safe_int(F.col("pos_dollar_rank")).alias("position_dollar_rank"),
    )
    names = {"player_name_normalized": normalize_name(F.col("player_name_raw")), "position_normalized": normalize_position(F.col("position_raw"))}
    return out.withColumns(names).withColumn("source_row_hash", row_hash("season", "pick_number", "auction_price", "team_raw", "player_name_raw", "position_raw"))


def read_fantasy_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A ranked sheet with prices in dollars and a 0/1 flag; rows without a name go."""
    df = read_csv(spark, path)
    dollar = next((c for c in df.columns if c in ("price", "value", "auction", "")), None)
    if dollar is None:
        # the price column may be headed by a dollar sign alone, which leaves no name
        raw = spark.read.csv(path, header=True, encoding="UTF-8")
        signs = [c for c in raw.columns if c.lstrip("\ufeff").strip().startswith("$")]
        df = snake_case(raw.withColumnsRenamed({c: "price" for c in signs[:1]}))
        dollar = "price" if signs else None
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    whole = lambda c: safe_int(F.col(c)) if c in df.columns else F.lit(None).cast("bigint")
    flag = F.coalesce(text("exodia") == "1", F.lit(False))
    out = df.select(
        text("name").alias("player"), F.upper(text("position")).alias("position"), F.upper(text("team")).alias("team"), whole("bye").alias("bye"), whole("overall").alias("overall_rank"),
        (safe_int(F.regexp_replace(F.col(dollar), r"^\s*\$", "")) if dollar else F.lit(None).cast("bigint")).alias("auction_value"), flag.alias("exodia"), F.lit("Redraft PPR").alias("scoring_format"),
    )
    return out.where("player <> ''")


def read_many(spark: SparkSession, paths: dict[str, dict[str, object]]) -> DataFrame:
    """Several sheets as one, each with its own literal columns; columns that a sheet lacks are null."""
    frames = [read_csv(spark, path).withColumns({k: F.lit(v) for k, v in literals.items()}) for path, literals in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
