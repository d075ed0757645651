"""Links between rankings sources and the shared crosswalk, and the auction history resolver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.text import compact, first_last, normalize_name, normalize_position, normalize_team_code, same_prefix, sequence_ratio
from leaguelens.operators.change import upsert
from leaguelens.operators.dedup import first_by, greedy_one_to_one, mutual_best


def attach_ids(ranks: DataFrame, pages: DataFrame, name: str = "player", id_col: str = "fl_id", order: str = "load_order") -> DataFrame:
    """Ids of page players on rankings rows: exact name, else normalized name; the last record of a name wins."""
    exact = first_by(pages, [name], F.desc(order)).select(F.col(name).alias("__n"), F.col(id_col).alias("__exact"))
    near = first_by(pages.withColumn("__k", normalize_name(F.col(name))), ["__k"], F.desc(order)).select("__k", F.col(id_col).alias("__near"))
    out = ranks.withColumn("__key", normalize_name(F.col(name))).join(exact, F.col(name) == F.col("__n"), "left").join(near, F.col("__key") == F.col("__k"), "left")
    return out.withColumn(id_col, F.coalesce("__exact", "__near")).drop("__n", "__k", "__key", "__exact", "__near")


def rankings_map(ranks: DataFrame, crosswalk: DataFrame, aliases: dict[str, str] | None = None, limit: int = 180, inclusive: bool = False, skip_defence: bool = True, rank: str = "consensus_rank", id_col: str = "fl_id") -> DataFrame:
    """Rankings players to the crosswalk (mfl_id, name, position): name and position, then name.

    Method says how: name_position, name_only, the same with alias_ in front, dst_skipped
    or unmatched.  Only ranks below ``limit`` (``inclusive``: and at it) take part; the
    first row of an id counts.
    """
    rows = ranks.where(F.col(rank) <= limit if inclusive else F.col(rank) < limit)
    plain = normalize_name(F.col("player"))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        alias = F.try_element_at(table, plain)
    else:
        alias = F.lit(None).cast("string")
    rows = rows.withColumns({"__a": alias, "__n": F.coalesce(alias, plain), "__p": normalize_position(F.col("position"))})
    known = crosswalk.select("mfl_id", normalize_name(F.col("name")).alias("__kn"), normalize_position(F.col("position")).alias("__kp"))
    both = first_by(known, ["__kn", "__kp"], F.desc("mfl_id")).select("__kn", "__kp", F.col("mfl_id").alias("__both"))
    only = first_by(known, ["__kn"], F.col("mfl_id")).select(F.col("__kn").alias("__on"), F.col("mfl_id").alias("__only"))
    out = rows.join(both, (F.col("__n") == F.col("__kn")) & (F.col("__p") == F.col("__kp")), "left").join(only, F.col("__n") == F.col("__on"), "left")
    defence = F.lit(skip_defence) & (F.col("__p") == "DST")
    prefix = F.when(F.col("__a").isNotNull(), "alias_").otherwise("")
    method = F.when(defence, "dst_skipped").when(F.col("__both").isNotNull(), F.concat(prefix, F.lit("name_position"))).when(F.col("__only").isNotNull(), F.concat(prefix, F.lit("name_only"))).otherwise("unmatched")
    out = out.withColumns({"match_method": method, "mfl_id": F.when(~defence, F.coalesce("__both", "__only"))})
    return first_by(out, [id_col], F.col(rank)).select(id_col, "player", "position", rank, "mfl_id", "match_method")


def matching_summary(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


def name_or_prefix_map(source: DataFrame, crosswalk: DataFrame, id_col: str = "sleeper_id") -> DataFrame:
    """Name and position, else last name, first three letters and position; one link per source id."""
    shape = lambda df, p: df.withColumns({p + "n": normalize_name(F.col("name")), p + "p": normalize_position(F.col("position"))}).withColumns({p + "f": first_last(F.col(p + "n"))["first"], p + "l": first_last(F.col(p + "n"))["last"]})
    a, b = shape(source, "a").select(id_col, "an", "ap", "af", "al"), shape(crosswalk, "b").select("mfl_id", "bn", "bp", "bf", "bl")
    full = a.join(b, (F.col("an") == F.col("bn")) & (F.col("ap") == F.col("bp"))).select(id_col, "mfl_id", F.lit("name_position").alias("method"), F.lit(1).alias("priority"))
    rest = a.join(full.select(id_col).distinct(), id_col, "left_anti")
    near = rest.join(b, (F.col("al") == F.col("bl")) & (F.col("ap") == F.col("bp")) & (F.col("al") != "")).where(same_prefix(F.col("af"), F.col("bf")))
    near = near.select(id_col, "mfl_id", F.lit("prefix_position").alias("method"), F.lit(2).alias("priority"))
    return first_by(full.unionByName(near), [id_col], F.col("priority"), F.col("mfl_id"))


def incremental_map(source: DataFrame, crosswalk: DataFrame, mapped: DataFrame, id_col: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """New links of ids not mapped yet, merged into ``mapped``, and the ids left over.

    Name and position, then name and team, ignoring case; one to one, by mutual first
    choice if ``strict``, else greedily.
    """
    todo = source.join(mapped.select(id_col), id_col, "left_anti")
    key = lambda c: F.upper(F.trim(F.col(c)))
    a = todo.select(id_col, normalize_name(F.col("name"), keep_digits=True).alias("n"), key("position").alias("p"), key("team").alias("t"))
    b = crosswalk.select("mfl_id", normalize_name(F.col("name"), keep_digits=True).alias("n"), key("position").alias("p"), key("team").alias("t"))
    one = a.join(b.drop("t"), ["n", "p"]).select(id_col, "mfl_id", F.lit("name_position").alias("method"), F.lit(1).alias("priority"))
    two = a.join(b.drop("p"), ["n", "t"]).select(id_col, "mfl_id", F.lit("name_team").alias("method"), F.lit(2).alias("priority"))
    pairs = first_by(one.unionByName(two), [id_col, "mfl_id"], F.col("priority"))
    order = (F.col("priority"), F.col("mfl_id"), F.col(id_col))
    links = mutual_best(pairs, id_col, "mfl_id", *order) if strict else greedy_one_to_one(pairs, id_col, "mfl_id", *order)
    done = upsert(mapped, links.select(id_col, "mfl_id", "method"), [id_col])
    return done, todo.join(links.select(id_col), id_col, "left_anti")


def resolve_history(raw: DataFrame, players: DataFrame, resolved: float = 0.97, ambiguous: float = 0.90) -> DataFrame:
    """Past auction rows to players.

    ``raw`` (source_row_hash, player_name_raw, position_raw, ...), ``players``
    (player_key, full_name, display_position, editorial_team_abbr).  Within a position:
    equal name or letters 1.0; a defence by team code 0.99 or unique team phrase 0.985;
    nickname with a name unique in last name and position 0.985; else similarity and 0.02.
    Each step takes only rows that the ones before left over.
    """
    key = "source_row_hash"
    rows = raw.withColumns({"__n": normalize_name(F.col("player_name_raw")), "__p": normalize_position(F.col("position_raw"))}).withColumn("__c", compact(F.col("__n")))
    pool = players.withColumns({"kn": normalize_name(F.col("full_name")), "kp": normalize_position(F.col("display_position"))})
    pool = pool.withColumns({"kc": compact(F.col("kn")), "kf": first_last(F.col("kn"))["first"], "kl": first_last(F.col("kn"))["last"], "kt": normalize_team_code(F.col("editorial_team_abbr"))})
    asked = rows.select(key, "__n", "__p", "__c", F.col("player_name_raw").alias("__raw"))
    same = F.col("__p") == F.col("kp")

    def found(df: DataFrame, method: str, step: int, confidence: float) -> DataFrame:
        return df.select(key, "player_key", "full_name", "display_position", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(step).alias("step"))

    exact = asked.join(pool, same & (F.col("__n") == F.col("kn"))).unionByName(asked.join(pool, same & (F.col("__c") == F.col("kc")) & (F.col("__n") != F.col("kn"))))
    defence = asked.where("__p = 'DST'")
    coded = defence.join(pool, same & (normalize_team_code(F.col("__raw")) == F.col("kt")))
    phrase = defence.where("__n <> ''").join(pool, same).where((F.col("kn") == F.col("__n")) | F.startswith("kn", F.concat(F.col("__n"), F.lit(" "))))
    sole = phrase.groupBy(key).agg(F.count_distinct("kn").alias("c")).where("c = 1").select(key)
    unique = pool.groupBy("kl", "kp").agg(F.count_distinct("kn").alias("c")).where("c = 1 and kl <> ''").select("kl", "kp")
    ends = asked.withColumns({"__f": first_last(F.col("__n"))["first"], "__l": first_last(F.col("__n"))["last"]})
    nick = ends.join(pool.join(unique, ["kl", "kp"], "left_semi"), same & (F.col("__l") == F.col("kl"))).where(same_prefix(F.col("__f"), F.col("kf")))
    # the keyed steps are one union, of which the earliest step of a row counts
    steps = found(exact, "exact", 0, 1.0).unionByName(found(coded, "dst_team_code", 1, 0.99)).unionByName(found(phrase.join(sole, key, "left_semi"), "dst_team_phrase", 2, 0.985)).unionByName(found(nick, "nickname_heuristic", 3, 0.985))
    keyed = first_by(steps, [key], F.col("step"), F.desc("player_key")).drop("step")
    near = asked.join(keyed.select(key), key, "left_anti").where("__n <> ''").join(pool, same)
    score = F.greatest(sequence_ratio(F.col("__n"), F.col("kn")), sequence_ratio(F.col("__c"), F.col("kc"))) + 0.02
    fuzzy = first_by(near.withColumn("__conf", score), [key], F.desc("__conf"), F.desc("player_key"))
    done = keyed.unionByName(fuzzy.select(key, "player_key", "full_name", "display_position", F.lit("fuzzy").alias("method"), F.col("__conf").alias("confidence")))
    status = F.when(F.col("confidence") >= resolved, "resolved").when(F.col("confidence") >= ambiguous, "ambiguous").otherwise("unresolved")
    out = raw.join(done, key, "left").withColumn("resolution_status", F.coalesce(status, F.lit("unresolved")))
    return out.withColumns({"resolution_confidence": F.round(F.coalesce("confidence", F.lit(0.0)), 4), "resolution_method": F.coalesce("method", F.lit("none"))}).withColumnsRenamed(
        {"player_key": "yahoo_player_key", "full_name": "resolved_player_name", "display_position": "resolved_position"}
    ).drop("confidence", "method")


def backfill(primary: DataFrame, history: DataFrame, id_col: str) -> DataFrame:
    """The latest season of each id that the primary list lacks."""
    return first_by(history.join(primary.select(id_col), id_col, "left_anti"), [id_col], F.desc("season"))
