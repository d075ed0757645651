"""Entity contracts: typed columns, required ones, keys, and checks against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.functions.casts import lenient

#: Bounds of the ranges in which rows are numbered.
RANGES = 256


class ContractError(ValueError):
    """A frame does not meet its contract."""


@dataclass(frozen=True)
class Contract:
    name: str
    types: dict[str, str]
    optional: tuple[str, ...] = ()
    key: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(c for c in self.types if c not in self.optional)


def _types(spec: str) -> dict[str, str]:
    return {name: kind for name, kind in (part.split(":") for part in spec.split())}


CONTRACTS = {
    c.name: c
    for c in (
        Contract("league", _types("league_key:string league_id:string game_id:bigint game_code:string season:bigint league_name:string scoring_type:string league_type:string num_teams:bigint"), ("num_teams",), ("league_key",)),
        Contract("team", _types("team_key:string league_key:string team_id:bigint team_name:string owner_name:string draft_position:bigint"), ("draft_position",), ("team_key",)),
        Contract("player", _types("player_key:string player_id:bigint game_id:bigint full_name:string display_position:string editorial_team_abbr:string"), ("editorial_team_abbr",), ("player_key",)),
        Contract("draft_pick", _types("league_key:string season:bigint team_key:string player_key:string pick_number:bigint round_number:bigint cost:bigint"), ("cost",), ("league_key", "season", "pick_number")),
        Contract("transaction", _types("transaction_key:string league_key:string season:bigint transaction_type:string status:string player_key:string source_team_key:string destination_team_key:string"), ("player_key", "source_team_key", "destination_team_key"), ()),
        Contract("stat_category", _types("game_id:bigint stat_id:string display_name:string name:string"), (), ("game_id", "stat_id")),
        Contract("scoring_rule", _types("league_key:string season:bigint stat_id:string points_per_unit:double bonus_target:double bonus_points:double"), ("bonus_target", "bonus_points"), ()),
        Contract("standings", _types("league_key:string season:bigint team_key:string rank:bigint wins:bigint losses:bigint ties:bigint points_for:double points_against:double"), ("ties",), ("league_key", "season", "team_key")),
        Contract("matchups", _types("league_key:string season:bigint week:bigint team_key:string opponent_team_key:string points:double opponent_points:double is_playoff:boolean is_consolation:boolean"), ("is_playoff", "is_consolation"), ("league_key", "season", "week", "team_key")),
        Contract("roster_entries", _types("league_key:string season:bigint week:bigint team_key:string player_key:string selected_position:string is_starting:boolean points:double"), ("points",), ("league_key", "season", "week", "team_key", "player_key")),
        Contract("player_stats_weekly", _types("league_key:string season:bigint week:bigint player_key:string fantasy_points:double status:string bye_week:bigint") | {"stats": "array<struct<stat_id:string,value:double>>"}, ("fantasy_points", "status", "bye_week", "stats"), ("league_key", "season", "week", "player_key")),
    )
}


#: Contracts that only one sport has, or that differ there.
SPORT_CONTRACTS: dict[str, dict[str, Contract]] = {
    "nfl": {c: CONTRACTS[c] for c in ("roster_entries", "player_stats_weekly", "standings", "matchups")},
    "nba": {
        "standings": Contract("standings", CONTRACTS["standings"].types | {"games_back": "double"}, ("ties", "games_back"), ("league_key", "season", "team_key")),
        "player_stats_weekly": CONTRACTS["player_stats_weekly"],
    },
}


def get_contract(entity: str, sport: str | None = None) -> Contract:
    """The sport's contract of an entity, else the common one."""
    scoped = SPORT_CONTRACTS.get(sport or "", {})
    if entity in scoped:
        return scoped[entity]
    if entity in CONTRACTS:
        return CONTRACTS[entity]
    raise KeyError(f"Unknown entity '{entity}'")


def empty(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in contract.types.items()))


def conform(df: DataFrame, contract: Contract, keep_extra: bool = False) -> DataFrame:
    """Contract columns in order, leniently cast; missing ones null; extras only on request."""
    cols = []
    for c, t in contract.types.items():
        if c not in df.columns:
            cols.append(F.lit(None).cast(t).alias(c))
        elif dict(df.dtypes)[c] == t or t.startswith("array"):
            cols.append(F.col(c))
        else:
            cols.append(lenient(F.col(c), t).alias(c))
    return df.select(*cols, *[c for c in df.columns if keep_extra and c not in contract.types])


def check_columns(df: DataFrame, contract: Contract, allow_extra: bool = False) -> list[str]:
    """Messages on missing and unexpected columns; no job runs."""
    missing = [c for c in contract.required if c not in df.columns]
    extra = [] if allow_extra else sorted(set(df.columns) - set(contract.types))
    return [f"{contract.name}: missing columns {missing}"] * bool(missing) + [f"{contract.name}: unexpected columns {extra}"] * bool(extra)


def key_repeats(df: DataFrame, contract: Contract) -> DataFrame:
    """Keys of more than one row, with the number of ``extra`` rows; nulls are equal, as in pandas."""
    return df.groupBy(*contract.key).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def check_rows(df: DataFrame, contract: Contract, allow_empty: bool = False) -> list[str]:
    """Messages on emptiness, nulls in required columns and repeated keys, from two aggregations."""
    required = [c for c in contract.required if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]).first()
    out = [f"{contract.name}: table is empty"] * (row.n == 0 and not allow_empty)
    out += [f"{contract.name}: {row[f'null_{c}']} null values in {c}" for c in required if row[f"null_{c}"]]
    if contract.key and set(contract.key) <= set(df.columns):
        distinct = key_repeats(df, contract).agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]
        out += [f"{contract.name}: {distinct} duplicate keys on {list(contract.key)}"] * bool(distinct)
    return out


def validated(df: DataFrame, contract: Contract, keep_extra: bool = False, allow_empty: bool = True) -> DataFrame:
    """The conformed frame; raises ``ContractError`` with all messages."""
    problems = check_columns(df, contract, keep_extra)
    out = conform(df, contract, keep_extra)
    problems += check_rows(out, contract, allow_empty)
    if problems:
        raise ContractError("; ".join(problems))
    return out


def check_record(record: dict, contract: Contract, allow_extra: bool = True) -> None:
    """Raise on the first kind of problem of one record: missing fields, nulls in required ones, unexpected fields."""
    missing = [c for c in contract.required if c not in record]
    nulls = [c for c in contract.required if record.get(c) is None]
    extra = [] if allow_extra else sorted(set(record) - set(contract.types))
    for what, names in (("missing required fields", missing), ("required fields cannot be null", nulls), ("unexpected fields", extra)):
        if names:
            raise ContractError(f"{contract.name}: {what}: {', '.join(names)}")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``row``, the place in ``order`` (nulls last) from 0.

    Rows are numbered within ranges of the order and the ranges follow each other, so no
    task holds the whole table.  A row's range depends on its values and on bounds drawn by
    a hash alone, as partitions and their ids may differ between two reads of one plan.
    """
    place = F.col(order[0]) if len(order) == 1 else F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])
    # all values may bound ranges; the hash only draws some
    drawn = df.select(place.alias("p")).where("p is not null").orderBy(F.xxhash64("p"), "p").limit(8 * RANGES)
    bounds = drawn.agg(F.sort_array(F.collect_list("p")).alias("p")).select(F.filter("p", lambda _, i: i % 8 == 7).alias("__bounds"))
    # the number of bounds up to the row, by halving
    steps = F.array(*[F.lit(RANGES >> i) for i in range(RANGES.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__bounds", at + step - 1) <= F.col("__place"), at + step).otherwise(at))
    ranged = df.withColumn("__place", place).crossJoin(F.broadcast(bounds))
    ranged = ranged.withColumn("__range", F.when(F.col("__place").isNull(), F.lit(RANGES + 1)).otherwise(found)).drop("__bounds", "__place")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.asc_nulls_last(c) for c in order]))
    return ranged.withColumn("__at", within).join(F.broadcast(first), "__range").withColumn("row", F.col("__first") + F.col("__at") - 1).drop("__range", "__first", "__at")


def row_problems(df: DataFrame, contract: Contract, order: list[str]) -> DataFrame:
    """Rows that break the contract, each with its ``row`` (from 0, in ``order``) and ``problem``.

    A row is named for the null fields of the required ones, else for null key fields, else
    as a repeat of an earlier row with its key.  Nulls come last in ``order``, which should
    be unique.
    """
    def nulls(names: tuple[str, ...]) -> Column:
        found = [F.when(F.col(c).isNull(), F.lit(c)) for c in names if c in df.columns]
        return F.nullif(F.concat_ws(", ", *found), F.lit("")) if found else F.lit(None).cast("string")

    numbered = _numbered(df, order)
    repeat = F.lit(False)
    if contract.key and set(contract.key) <= set(df.columns):
        repeat = F.row_number().over(Window.partitionBy(*contract.key).orderBy("row")) > 1
    required, key = nulls(contract.required), nulls(contract.key)
    problem = F.when(required.isNotNull(), F.concat(F.lit("null: "), required)).when(key.isNotNull(), F.concat(F.lit("null key: "), key)).when(repeat, F.lit("duplicate key"))
    return numbered.withColumn("problem", problem).where("problem is not null").select("row", "problem", *df.columns)


def check_in_order(df: DataFrame, contract: Contract, order: list[str]) -> None:
    """Raise on the first row, in ``order``, that breaks the contract."""
    worst = row_problems(df, contract, order).orderBy("row").select("row", "problem").first()
    if worst:
        raise ContractError(f"{contract.name}: row {worst['row']}: {worst['problem']}")
