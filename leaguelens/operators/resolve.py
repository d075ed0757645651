"""Cross-source entity resolution.

Exact and nickname matches are equi joins; only what they leave unmatched meets the
whole registry in a similarity search.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.functions.hashing import queue_id
from leaguelens.functions.text import ALLOWED_POSITIONS, first_last, normalize_player_name, normalize_position, normalize_team_code, same_prefix, sequence_ratio
from leaguelens.operators.dedup import first_by, greedy_one_to_one, top_k

THRESHOLDS = {"player": 0.97, "team": 0.995, "position": 1.0}
#: Names of a block in the similarity search, and tasks that share a block.
NAMES, SPLIT = 16_384, 16


def match_positions(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``position`` (null if unknown) and ``position_confidence``."""
    code = normalize_position(F.col(raw))
    known = code.isin(*ALLOWED_POSITIONS)
    return df.withColumns({"position": F.when(known, code), "position_confidence": F.when(known, 1.0).otherwise(0.0)})


def match_teams(df: DataFrame, raw: str, teams: DataFrame, least: float = 0.90) -> DataFrame:
    """Adds ``canonical_team_id`` and ``team_confidence``: alias or exact 1.0, else the best similarity from ``least`` on.

    ``teams`` (canonical_team_id, canonical_team_name, canonical_team_abbr, aliases) is a
    registry of some dozens of rows.
    """
    names = teams.select("canonical_team_id", F.explode(F.array_union(F.array("canonical_team_name", "canonical_team_abbr"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("canonical_team_id", normalize_team_code(F.col("name")).alias("__code")).where("__code <> ''").distinct()
    asked = df.select(F.col(raw).alias("__raw")).distinct().withColumn("__key", normalize_team_code(F.col("__raw")))
    exact = first_by(asked.join(names, F.col("__key") == F.col("__code")), ["__raw"], F.col("canonical_team_id")).select("__raw", "canonical_team_id", F.lit(1.0).alias("team_confidence"))
    left = asked.join(exact, "__raw", "left_anti").where("__key <> ''")
    pairs = left.join(F.broadcast(names)).withColumn("team_confidence", sequence_ratio(F.col("__key"), F.col("__code")))
    near = first_by(pairs.where(F.col("team_confidence") >= least), ["__raw"], F.desc("team_confidence"), F.col("canonical_team_id"))
    found = exact.unionByName(near.select("__raw", "canonical_team_id", "team_confidence"))
    out = df.join(found, F.col(raw) == F.col("__raw"), "left").drop("__raw")
    return out.withColumn("team_confidence", F.coalesce("team_confidence", F.lit(0.0)))


def _nearest(asked: DataFrame, reg: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best players of every (__raw, __want) over the whole registry: with canonical_player_id, confidence.

    Names meet in blocks.  Common characters bound the similarity from above, so each
    name is compared in the order of that bound until no other can be among the best.
    """
    n, m = (max(1, -(-df.count() // NAMES)) for df in (asked, reg))
    a = asked.withColumns({"i": F.pmod(F.xxhash64("__raw"), F.lit(n)), "j": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    b = reg.withColumns({"j": F.pmod(F.xxhash64("__name"), F.lit(m)), "i": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    # several tasks share the names of a block
    a = a.withColumn("k", F.pmod(F.xxhash64("__raw", F.lit(1)), F.lit(SPLIT))).select((((F.col("i") * m) + F.col("j")) * SPLIT + F.col("k")).alias("cell"), "__raw", "__want")
    b = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))).select((((F.col("i") * m) + F.col("j")) * SPLIT + F.col("k")).alias("cell"), "__name", "__pos", "canonical_player_id")

    def letters(names: pd.Series) -> np.ndarray:
        out = np.zeros((len(names), 128), np.int16)
        for row, name in zip(out, names):
            np.add.at(row, np.frombuffer(name.encode("ascii", "replace"), np.uint8), 1)
        return out

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out, names, places, ids = [], y["__name"].to_numpy(), y["__pos"].to_numpy(), y["canonical_player_id"].to_numpy()
        if len(x) and len(y):
            have, length = letters(y["__name"]), y["__name"].str.len().to_numpy()
            for raw, want, mine in zip(x["__raw"], x["__want"], letters(x["__raw"])):
                used = np.flatnonzero(mine)
                bonus = np.where(places == want, 0.02, 0.0)
                most = np.minimum(1.0, 2.0 * np.minimum(have[:, used], mine[used]).sum(1, dtype=int) / (length + len(raw)) + bonus)
                best: dict = {}
                least = 0.0
                for i in np.argsort(-most, kind="stable"):
                    if most[i] <= 0 or most[i] < least:
                        break
                    got = min(1.0, difflib.SequenceMatcher(None, raw, names[i]).ratio() + bonus[i])
                    if got > best.get(ids[i], 0.0):
                        best[ids[i]] = got
                        if len(best) >= keep:
                            least = heapq.nlargest(keep, best.values())[-1]
                out += [(raw, want, *r) for r in sorted(best.items(), key=lambda r: (-r[1], r[0]))[:keep]]
        return pd.DataFrame(out, columns=["__raw", "__want", "canonical_player_id", "confidence"])

    kind = dict(reg.dtypes)["canonical_player_id"]
    return a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(solve, f"__raw string, __want string, canonical_player_id {kind}, confidence double")


def match_players(records: DataFrame, players: DataFrame, key: str = "record_id", name: str = "raw_player_name", position: str = "position", keep: int = 5) -> DataFrame:
    """Ranked candidates (key, canonical_player_id, method, confidence, rank).

    Exact name or alias 0.96 and 0.02 more for the same position; nickname 0.985 (same
    last name, first three letters and position, last name unique in the registry); else
    similarity and 0.02 for the position.  The similarity search only takes records
    without another match.
    """
    alias = F.array_union(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    reg = players.select("canonical_player_id", "display_name", normalize_position(F.col("primary_position")).alias("__pos"), F.explode(alias).alias("__alias"))
    reg = reg.withColumn("__name", normalize_player_name(F.col("__alias"))).where("__name <> ''").drop("__alias").distinct()
    asked = records.select(F.col(key), normalize_player_name(F.col(name)).alias("__raw"), F.col(position).alias("__want")).where("__raw <> ''")
    bonus = F.when(F.col("__want") == F.col("__pos"), 0.02).otherwise(0.0)
    cols = [F.col(key), F.col("canonical_player_id")]
    exact = asked.join(reg, F.col("__raw") == F.col("__name")).select(*cols, F.lit("exact").alias("method"), F.lit(1).alias("__m"), (F.lit(0.96) + bonus).alias("confidence"))

    main = players.select("canonical_player_id", normalize_player_name(F.col("display_name")).alias("__name"), normalize_position(F.col("primary_position")).alias("__pos"))
    main = main.withColumns({"__f": first_last(F.col("__name"))["first"], "__l": first_last(F.col("__name"))["last"]}).where("__l <> ''")
    unique = main.groupBy("__l").agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("__l")
    mine = asked.withColumns({"__rf": first_last(F.col("__raw"))["first"], "__l": first_last(F.col("__raw"))["last"]}).where("__l <> ''")
    nick = mine.join(main.join(unique, "__l", "left_semi"), "__l").where((F.col("__want") == F.col("__pos")) & same_prefix(F.col("__rf"), F.col("__f")) & (F.col("__raw") != F.col("__name")))
    nick = nick.select(*cols, F.lit("nickname_heuristic").alias("method"), F.lit(2).alias("__m"), F.lit(0.985).alias("confidence"))

    sure = exact.unionByName(nick)
    left = asked.join(sure.select(key).distinct(), key, "left_anti")
    wanted = left.select("__raw", "__want").distinct()
    # a null position equals none
    found = _nearest(wanted.withColumn("__want", F.coalesce("__want", F.lit(""))), reg.withColumn("__pos", F.coalesce("__pos", F.lit("\0"))), keep)
    near = left.withColumn("__want", F.coalesce("__want", F.lit(""))).join(found, ["__raw", "__want"]).select(*cols, F.lit("fuzzy").alias("method"), F.lit(3).alias("__m"), "confidence")
    best = first_by(sure.unionByName(near), [key, "canonical_player_id"], F.desc("confidence"), F.col("__m"))
    return top_k(best, [key], keep, F.desc("confidence"), F.col("__m"), F.col("canonical_player_id"), rank="rank").drop("__m")


def standardize(records: DataFrame, players: DataFrame, teams: DataFrame, source_map: DataFrame, overrides: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per record: ids, method, confidence and whether it needs review.

    An override wins over the source map, and that over matching; team and position are
    judged on their own.  Of several overrides for an id the last (by ``approved_at``) holds.
    """
    limit = THRESHOLDS | (thresholds or {})
    keys = ["source_system", "source_entity_id"]
    rows = records.withColumn("record_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(records.columns)]), 256))
    rows = match_teams(match_positions(rows, "raw_position"), "raw_team_name", teams)
    over = overrides.where("trim(source_system) <> '' and trim(source_entity_id) <> ''").withColumn("source_system", F.lower("source_system"))
    over = first_by(over, keys, F.desc_nulls_last("approved_at")).select(*keys, F.col("canonical_player_id").alias("__over"))
    mapped = first_by(source_map.withColumn("source_system", F.lower("source_system")), keys, F.asc_nulls_last("valid_from"), F.col("canonical_player_id"))
    mapped = mapped.select(*keys, F.col("canonical_player_id").alias("__mapped"))
    best = match_players(rows, players).where("rank = 1").select("record_id", F.col("canonical_player_id").alias("__best"), "method", "confidence")
    out = rows.withColumn("source_system", F.lower("source_system")).join(over, keys, "left").join(mapped, keys, "left").join(best, "record_id", "left")
    known = F.coalesce(F.nullif("__over", F.lit("")), "__mapped")
    strong = F.col("confidence") >= limit["player"]
    method = F.when(F.col("__over").isNotNull(), "override").when(F.col("__mapped").isNotNull(), "source_map").when(strong, F.col("method")).otherwise("unresolved")
    player = F.coalesce(known, F.when(strong, F.col("__best")), F.lit(""))
    team = F.when(F.col("team_confidence") >= limit["team"], F.col("canonical_team_id")).otherwise("")
    place = F.when(F.col("position_confidence") >= limit["position"], F.col("position")).otherwise("")
    out = out.withColumns({"canonical_player_id": player, "canonical_team_id": team, "canonical_position_code": place, "match_method": method})
    confident = F.when(known.isNotNull(), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0)))
    forced = F.col("__over").isNotNull()
    review = ~forced & ((F.col("canonical_player_id") == "") | (F.col("canonical_team_id") == "") | (F.col("canonical_position_code") == ""))
    out = out.withColumns({"match_confidence": confident, "needs_review": review})
    return out.drop("__over", "__mapped", "__best", "method", "confidence", "position", "record_id", "team_confidence", "position_confidence")


def review_queue(standardized: DataFrame, at: Column) -> DataFrame:
    """Open review rows, with a stable id."""
    ident = queue_id(F.col("source_system"), F.col("source_entity_id"), F.col("raw_player_name"), F.col("raw_team_name"), F.col("raw_position"))
    return standardized.where("needs_review").withColumns({"queue_id": ident, "status": F.lit("new"), "created_at": at})


def learned_mappings(standardized: DataFrame, source_map: DataFrame) -> DataFrame:
    """The source map with the new ids that need no review; the first mapping of a key wins."""
    new = standardized.where("not needs_review and canonical_player_id <> '' and source_entity_id <> ''")
    keys = ["source_system", "source_entity_id"]
    new = first_by(new, keys, F.col("canonical_player_id")).select(*keys, "canonical_player_id", F.col("match_method").alias("provenance"))
    return source_map.unionByName(new.join(source_map.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def crosswalk(left: DataFrame, right: DataFrame, ranks: DataFrame) -> DataFrame:
    """One-to-one links of two player sources.

    Exact normalized name first; else same last name, position and first three letters,
    for ids without an exact link.  ``left`` (left_id, name, position), ``right``
    (right_id, name, position), ``ranks`` (left_id, rank).
    """
    shape = lambda df, p: df.select(F.col(p + "id"), normalize_player_name(F.col("name")).alias(p + "n"), normalize_position(F.col("position")).alias(p + "p"))
    a, b = shape(left, "left_"), shape(right, "right_")
    exact = a.join(b, F.col("left_n") == F.col("right_n")).select("left_id", "right_id", F.lit("exact").alias("method"), F.lit(1).alias("priority"))
    ends = lambda df, p: df.withColumns({p + "f": first_last(F.col(p + "n"))["first"], p + "l": first_last(F.col(p + "n"))["last"]})
    close = ends(a, "left_").join(ends(b, "right_"), (F.col("left_l") == F.col("right_l")) & (F.col("left_p") == F.col("right_p")) & (F.col("left_l") != ""))
    close = close.where(same_prefix(F.col("left_f"), F.col("right_f"))).select("left_id", "right_id", F.lit("fuzzy").alias("method"), F.lit(2).alias("priority"))
    close = close.join(exact.select("left_id").distinct(), "left_id", "left_anti")
    best_rank = ranks.groupBy("left_id").agg(F.min("rank").alias("adp_rank"))
    pairs = exact.unionByName(close).distinct().join(best_rank, "left_id", "left").withColumn("adp_rank", F.coalesce("adp_rank", F.lit(9999)))
    one = greedy_one_to_one(pairs, "left_id", "right_id", F.col("priority"), F.col("adp_rank"), F.col("left_id"), F.col("right_id"))
    return one.select("left_id", "right_id", "method", "priority")


def map_by_id_then_name(source: DataFrame, target: DataFrame, id_col: str, target_id: str) -> DataFrame:
    """Links by a shared id, else by normalized name and position; one per source id.

    ``source`` (id_col, name, position), ``target`` (target_id, id_col as text, name, position).
    """
    direct = source.join(target.select(target_id, F.col(id_col).try_cast(dict(source.dtypes)[id_col]).alias(id_col)), id_col)
    direct = direct.select(id_col, target_id, F.lit("id").alias("method"), F.lit(1).alias("priority"))
    rest = source.join(direct.select(id_col), id_col, "left_anti")
    shape = lambda df, i: df.select(i, normalize_player_name(F.col("name")).alias("n"), normalize_position(F.col("position")).alias("p"))
    named = shape(rest, id_col).join(shape(target, target_id), ["n", "p"]).select(id_col, target_id, F.lit("name_position").alias("method"), F.lit(2).alias("priority"))
    return first_by(direct.unionByName(named), [id_col], F.col("priority"), F.col(target_id))


OPEN_STATUS = ("new", "in_review")


def split_queue(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The open rows of a review queue and its history; a null status is history."""
    is_open = F.coalesce(F.col("queue_status").isin(*OPEN_STATUS), F.lit(False))
    ident = ["queue_id", "source_system", "source_entity_id", "queue_status"]
    have = lambda c: F.col(c) if c in queue.columns else F.lit(None).cast("string").alias(c)
    opened = queue.where(is_open).select(*ident, have("priority"), have("created_at"), have("assigned_to"))
    blank = lambda c: F.coalesce(have(c), F.lit("")).alias(c)
    closed = queue.where(~is_open).select(*ident, have("created_at"), blank("resolved_at"), blank("resolution_action"), have("resolved_by"), have("review_notes"))
    return opened, closed


def rescued(records: DataFrame, needed: tuple[str, ...] = ("source_system", "source_entity_id", "raw_player_name"), at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records that can be matched, and those set aside with the reason: blank or missing needed fields."""
    blank = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) if c in records.columns else F.lit(c) for c in needed]
    marked = records.withColumn("__why", F.concat_ws(", ", *blank))
    body = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    aside = marked.where("__why <> ''").select(
        F.sha2(body, 256).alias("rescue_id"), F.concat(F.lit("missing: "), F.col("__why")).alias("reason"), body.alias("payload"), (at if at is not None else F.current_timestamp()).alias("rescued_at")
    )
    return marked.where("__why = ''").drop("__why"), aside


def standardize_batch(
    records: DataFrame, players: DataFrame, teams: DataFrame, source_map: DataFrame, overrides: DataFrame, queue: DataFrame | None = None, at: Column | None = None, thresholds: dict[str, float] | None = None
) -> dict[str, DataFrame]:
    """All tables of one run, by name: registry, map, queue (open, history), rescued, outputs, overrides and counts.

    ``queue`` holds earlier reviews: a row that was closed stays closed, others are replaced.
    """
    at = at if at is not None else F.current_timestamp()
    good, aside = rescued(records, at=at)
    out = standardize(good, players, teams, source_map, overrides, thresholds)
    fresh = review_queue(out, at).withColumnRenamed("status", "queue_status").withColumn("priority", F.lit("normal"))
    if queue is not None:
        done = queue.where(~F.coalesce(F.col("queue_status").isin(*OPEN_STATUS), F.lit(False)))
        fresh = done.unionByName(fresh.join(done.select("queue_id"), "queue_id", "left_anti"), allowMissingColumns=True)
    opened, closed = split_queue(fresh)
    counts = out.groupBy("source_system", "match_method").agg(F.count(F.lit(1)).alias("records"), F.count_if("needs_review").alias("to_review"))
    positions = players.select(normalize_position(F.col("primary_position")).alias("canonical_position_code")).distinct()
    return {
        "std_canonical_players": players, "std_canonical_teams": teams, "std_canonical_positions": positions, "std_source_to_canonical_map": learned_mappings(out, source_map),
        "std_match_queue": fresh, "std_match_queue_open": opened, "std_match_queue_history": closed, "std_rescued_records": aside, "std_standardized_outputs": out, "std_match_summary": counts,
    }
