"""Availability and price models, roster optimisation, and simulations.

Data stays in Spark; what is optimised on the driver is a few dozen parameters or a
draft board of some hundred rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaguelens.functions.stats import p_available

FEATURES = 7


def fit_availability(picks: DataFrame, rounds: int = 500, last: int = 216) -> tuple[list[float], list[float]]:
    """Location and log-scale coefficients of pick minus adp, a logistic law, by maximum likelihood.

    ``picks`` (adp, position, rank, pick); rows with a null number take no part, and a null
    position is none of the named ones.  Quasi-Newton steps (BFGS): each evaluation is one
    aggregation that returns the likelihood and its gradient, so the table is never
    collected.  Raises if ``rounds`` steps don't reach the optimum; an empty table gives the start.
    """
    positions = [F.coalesce((F.col("position") == p).cast("double"), F.lit(0.0)) for p in ("QB", "RB", "TE")]
    x = [F.lit(1.0), F.col("adp") / last, F.log(F.greatest("adp", F.lit(1.0))) / math.log(last), F.col("rank") / 50.0, *positions]
    known = picks.select("position", *[F.col(c).cast("double").alias(c) for c in ("adp", "rank", "pick")]).dropna(subset=["adp", "rank", "pick"])
    data = known.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (F.col("pick") - F.col("adp")).alias("y")).persist()

    def mean_loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        mu, log_s = (sum((F.col(f"x{i}") * float(w) for i, w in enumerate(c)), F.lit(0.0)) for c in (at[:FEATURES], at[FEATURES:]))
        d = data.withColumns({"log_s": log_s, "z": (F.col("y") - mu) / F.exp(log_s)})
        z, slope = F.col("z"), F.tanh(F.col("z") / 2)
        loss = F.col("log_s") + F.abs(z) + 2 * F.log1p(F.exp(-F.abs(z)))
        sides = (-slope / F.exp("log_s"), 1 - z * slope)
        row = d.agg(F.avg(loss), *[F.avg(F.col(f"x{i}") * g) for g in sides for i in range(FEATURES)]).first()
        return (math.nan, np.zeros(2 * FEATURES)) if row[0] is None else (row[0], np.array(row[1:], float))

    at = np.zeros(2 * FEATURES)
    at[FEATURES] = math.log(4.5)
    try:
        loss, grad = mean_loss(at)
        curve, done = np.eye(len(at)) / max(1.0, float(np.linalg.norm(grad))), math.isnan(loss)
        for _ in range(rounds):
            done = done or float(np.abs(grad).max()) < 1e-5
            if done:
                break
            step = -curve @ grad
            slope, size = float(grad @ step), 1.0
            while True:
                new_loss, new_grad = mean_loss(at + size * step)
                if new_loss <= loss + 1e-4 * size * slope or size < 1e-8:
                    break
                size /= 2
            if not new_loss < loss:
                done = -slope < 1e-6 * max(1.0, abs(loss))  # what the step could gain is rounding
                break
            moved, turned = size * step, new_grad - grad
            if moved @ turned > 1e-12:
                rho, one = 1 / (moved @ turned), np.eye(len(at))
                curve = (one - rho * np.outer(moved, turned)) @ curve @ (one - rho * np.outer(turned, moved)) + rho * np.outer(moved, moved)
            done = loss - new_loss < 1e-10 * max(1.0, abs(loss))
            at, loss, grad = at + moved, new_loss, new_grad
    finally:
        data.unpersist()
    if not done and float(np.abs(grad).max()) >= 1e-5:
        raise RuntimeError(f"no optimum after {rounds} steps")
    return at[:FEATURES].tolist(), at[FEATURES:].tolist()


def split_by_hash(df: DataFrame, group: str, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Reproducible split of each group in the order of a hash of the key."""
    w = Window.partitionBy(group)
    ranked = df.withColumns({"__r": F.row_number().over(w.orderBy(F.xxhash64(key), key)), "__n": F.count(F.lit(1)).over(w)})
    inside = F.col("__r") <= F.col("__n") * share
    return ranked.where(inside).drop("__r", "__n"), ranked.where(~inside).drop("__r", "__n")


def availability_scores(board: DataFrame, beta: list[float], gamma: list[float]) -> dict[str, float]:
    """Log loss and accuracy on rows (adp, position, rank, target, available)."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p_available(F.col("adp"), F.col("position"), F.col("rank"), F.col("target"), beta, gamma)))
    hit = F.col("available").cast("double")
    row = board.agg(F.avg(-(hit * F.log(p) + (1 - hit) * F.log(1 - p))).alias("log_loss"), F.avg(((p >= 0.5) == (hit == 1)).cast("double")).alias("accuracy")).first()
    return row.asDict()


def turn_targets(board: DataFrame, turns: DataFrame, beta: list[float], gamma: list[float], least: float = 0.10, n: int = 7) -> DataFrame:
    """Players likely enough to be there at each turn, the best ``n`` per turn and position by rank."""
    p = p_available(F.col("adp"), F.col("position"), F.col("rank"), F.col("pick"), beta, gamma)
    out = board.crossJoin(F.broadcast(turns)).withColumn("p_avail", p).where(F.col("p_avail") >= least)
    w = Window.partitionBy("turn", "position").orderBy(F.asc_nulls_last("consensus_rank"), "full_name")
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


# ---- price intervals

def _kernel(a: np.ndarray, b: np.ndarray, length: float, matern: bool) -> np.ndarray:
    d = np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(2), 0)) / length
    return (1 + math.sqrt(3) * d) * np.exp(-math.sqrt(3) * d) if matern else np.exp(-(d**2) / 2)


def gaussian_process(x: np.ndarray, y: np.ndarray, at: np.ndarray, length: float, matern: bool, noise: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of a process on standardised data."""
    mu, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    x, at, shift, scale = (x - mu) / sd, (at - mu) / sd, y.mean(), y.std() or 1.0
    # equal rows are one with their average and a share of the noise, which gives the same process
    x, group, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    mean = np.bincount(group.ravel(), (y - shift) / scale) / n
    chol = np.linalg.cholesky(_kernel(x, x, length, matern) + np.diag(noise / n))
    alpha = np.linalg.solve(chol.T, np.linalg.solve(chol, mean))
    mid, dev = [], []
    for k in range(0, len(at), 4096):
        cross = _kernel(at[k : k + 4096], x, length, matern)
        inner = np.linalg.solve(chol, cross.T)
        mid.append(cross @ alpha * scale + shift)
        dev.append(np.sqrt(np.maximum(1 + noise - (inner**2).sum(0), 1e-9)) * scale)
    return np.concatenate([[], *mid]), np.concatenate([[], *dev])


def price_intervals(history: DataFrame, board: DataFrame, features: list[str], fit_rows: int | None = None) -> DataFrame:
    """Low, median and high price of every row on the board, by position.

    Quarterbacks: a ridge fit with conformal residual quantiles for starters and the tail;
    others a Gaussian process and 1.65 deviations.  A position's fit takes all
    past rows, in the order of a hash, or the first ``fit_rows`` of them; prices are whole and at least 1.
    """
    w = Window.partitionBy("position").orderBy(F.xxhash64(*features, "price"))
    sample = history.withColumn("__r", F.row_number().over(w)).where(F.lit(True) if fit_rows is None else F.col("__r") <= fit_rows).select("__r", "position", *features, "price", F.lit(True).alias("past"), F.lit(None).cast("string").alias("player_id"))
    rows = sample.unionByName(board.select(F.lit(0).alias("__r"), "position", *features, F.lit(None).cast("double").alias("price"), F.lit(False).alias("past"), "player_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        position = pdf["position"].iloc[0]
        past, new = pdf[pdf["past"]].sort_values("__r"), pdf[~pdf["past"]]
        x, y, at = past[features].to_numpy(float), past["price"].to_numpy(float), new[features].to_numpy(float)
        if len(past) < 3:
            mid = np.full(len(new), y.mean() if len(y) else 1.0)
            spread = np.zeros(len(new))
        elif position == "QB":
            cut = max(2, int(len(x) * 0.7))
            a = np.c_[np.ones(cut), x[:cut]]
            w = np.linalg.solve(a.T @ a + 1e-3 * np.eye(a.shape[1]), a.T @ y[:cut])
            mid, fitted = np.c_[np.ones(len(at)), at] @ w, np.c_[np.ones(len(x)), x] @ w
            rest, line = np.abs(y[cut:] - fitted[cut:]), np.median(fitted)
            part = lambda m: np.quantile(rest[m], 0.9) if m.sum() > 2 else (np.quantile(rest, 0.9) if len(rest) else 0.0)
            spread = np.where(mid >= line, part(fitted[cut:] >= line), part(fitted[cut:] < line))
        else:
            mid, sd = gaussian_process(x, y, at, 1.0, matern=position != "TE")
            spread = 1.65 * sd
        whole = lambda v: np.maximum(1, np.rint(v)).astype(int)
        return pd.DataFrame({"player_id": new["player_id"], "position": position, "low": whole(mid - spread), "median": whole(mid), "high": whole(mid + spread)})

    return rows.groupBy("position").applyInPandas(run, "player_id string, position string, low long, median long, high long")


def interval_quality(df: DataFrame) -> dict[str, float]:
    """Coverage, width and absolute error of intervals against ``price``."""
    row = df.agg(F.avg(F.col("price").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"), F.avg(F.abs(F.col("price") - F.col("median"))).alias("mae")).first()
    return row.asDict()


def sampled_costs(df: DataFrame, seed: int = 1) -> DataFrame:
    """Conservative costs: a draw around the upper half of each interval, rounded up; cheap players keep their median."""
    draw = F.randn(seed) * (F.col("high") - F.col("low")) / 4 + (F.col("median") + F.col("high")) / 2
    cost = F.ceil(F.greatest(F.col("low").cast("double"), F.least(F.col("high") + 2.0, draw)))
    return df.withColumn("conservative_cost", F.when(F.col("median") >= 3, cost).otherwise(F.col("median")).cast("bigint"))


# ---- rosters

def best_auction_roster(board: list[dict], budget: int, limits: dict[str, tuple[int, int]], size: int, starters: dict[str, int], starter_share: float = 0.85) -> list[dict]:
    """Roster of least overall tier, then least position tier of receivers and tight ends within one tier of it.

    Rows: position, cost, overall_tier, position_tier.  Exact: players of a position are
    combined over (number, cost) keeping the best tier sums, then positions are joined;
    starters are the costliest of their position and must cost ``starter_share`` of the
    budget; one back must be of position tier 4 or better, and two of 6.
    """
    board = [r | {"__i": i} for i, r in enumerate(board)]

    def states(rows: list[dict], position: str) -> dict[tuple, list[tuple]]:
        lo, hi = limits[position]
        rows = sorted(rows, key=lambda r: -r["cost"])
        found = {(0, 0, 0, 0, 0): [(0, 0, ())]}
        for r in rows:
            more = dict(found)
            for (n, cost, start, top4, top6), best in found.items():
                if n < hi and cost + r["cost"] <= budget:
                    back = position == "RB"
                    key = (n + 1, cost + r["cost"], start + (r["cost"] if n < starters.get(position, 0) else 0), min(1, top4 + (back and r["position_tier"] <= 4)), min(2, top6 + (back and r["position_tier"] <= 6)))
                    extra = r["position_tier"] if position in ("WR", "TE") else 0
                    more[key] = front(more.get(key, []) + [(a + r["overall_tier"], b + extra, p + (r["__i"],)) for a, b, p in best])
            found = more
        return {k: v for k, v in found.items() if k[0] >= lo}

    def front(items: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for it in sorted(items):
            if not out or it[1] < out[-1][1]:
                out.append(it)
        return out

    total = {(0, 0, 0, 0, 0): [(0, 0, ())]}
    for position in limits:
        part = states([r for r in board if r["position"] == position], position)
        joined: dict[tuple, list[tuple]] = {}
        for k, a in total.items():
            for q, b in part.items():
                key = (k[0] + q[0], k[1] + q[1], k[2] + q[2], min(1, k[3] + q[3]), min(2, k[4] + q[4]))
                if key[0] <= size and key[1] <= budget:
                    joined.setdefault(key, []).extend((x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x in a for y in b)
        total = {k: front(v) for k, v in joined.items()}
    good = [x for k, v in total.items() if k[0] == size and k[2] >= starter_share * budget and ("RB" not in limits or (k[3] >= 1 and k[4] >= 2)) for x in v]
    if not good:
        return []
    least = min(x[0] for x in good)
    pick = min((x for x in good if x[0] <= least + 1), key=lambda x: (x[1], x[0], x[2]))
    return [{k: v for k, v in board[i].items() if k != "__i"} for i in sorted(pick[2])]


def snake_frontier(options: list[dict], capacity: dict[str, int], need: dict[str, int]) -> list[tuple[int, int, list[dict]]]:
    """Non-dominated rosters by overall tier sum and position tier sum of backs and receivers.

    Options: turn, full_name, position, overall_tier, position_tier.  Each turn fills its
    capacity, positions meet ``need``, a player is taken once.  Players are taken one at a
    time over states (open places by turn, open needs), keeping each state's frontier.
    """
    turns, places = list(capacity), list(need)
    by_player: dict[str, list[dict]] = {}
    for o in options:
        by_player.setdefault(o["full_name"], []).append(o)
    state = {(tuple(capacity.values()), tuple(need.values())): [(0, 0, ())]}
    for rows in by_player.values():
        grown = {k: list(v) for k, v in state.items()}
        for (t, p), best in state.items():
            for r in rows:
                i, j = turns.index(r["turn"]), places.index(r["position"]) if r["position"] in need else -1
                if j >= 0 and t[i] and p[j]:
                    key = (t[:i] + (t[i] - 1,) + t[i + 1 :], p[:j] + (p[j] - 1,) + p[j + 1 :])
                    extra = r["position_tier"] if r["position"] in ("WR", "RB") else 0
                    grown.setdefault(key, []).extend((a + r["overall_tier"], b + extra, c + (id(r),)) for a, b, c in best)
        state = {}
        for k, v in grown.items():
            kept: list[tuple] = []
            for x in sorted(v):
                if not kept or x[1] < kept[-1][1]:
                    kept.append(x)
            state[k] = kept
    rows = {id(o): o for o in options}
    done = state.get((tuple(0 for _ in turns), tuple(0 for _ in places)), [])
    return [(a, b, [rows[i] for i in c]) for a, b, c in done]


# ---- simulations

def bye_simulation(spark: SparkSession, scores: dict[str, list[float]], runs: int = 1000, permutations: int = 100, seed: int = 1, n: int = 2) -> DataFrame:
    """Season totals of the best weekly score of ``n`` players with one shared bye week or separate ones, per run."""
    names = sorted(scores)
    table = np.array([scores[k] for k in names], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                mine = table[rng.choice(len(names), n, replace=False)]
                order = rng.permuted(np.tile(np.arange(table.shape[1]), (permutations, 1)), axis=1)
                weeks = mine[:, order]
                zero = np.zeros((permutations, 1))
                same = np.max([np.concatenate([zero, x], 1) for x in weeks], 0)
                apart = np.max([np.concatenate([x[:, :k], zero, x[:, k:]], 1) for k, x in enumerate(weeks)], 0)
                out.append((int(i), same.sum(1).mean(), apart.sum(1).mean()))
            yield pd.DataFrame(out, columns=["id", "same", "apart"])

    return spark.range(runs).mapInPandas(run, "id long, same double, apart double")


def composition_difference(first: DataFrame, second: DataFrame, n: tuple[int, int], seed: int | None = None) -> DataFrame:
    """Weekly difference of the best ``n`` scores of two groups (player_id, week, fantasy_pts); with a seed each player's weeks are shuffled."""

    def totals(df: DataFrame, k: int, name: str) -> DataFrame:
        if seed is not None:
            w = Window.partitionBy("player_id")
            a = df.withColumn("__i", F.row_number().over(w.orderBy("week"))).select("player_id", "week", "__i")
            b = df.withColumn("__i", F.row_number().over(w.orderBy(F.xxhash64("player_id", "week", F.lit(seed))))).select("player_id", "__i", "fantasy_pts")
            df = a.join(b, ["player_id", "__i"])
        best = F.aggregate(F.slice(F.sort_array(F.collect_list("fantasy_pts"), False), 1, k), F.lit(0.0), lambda s, x: s + x)
        return df.groupBy("week").agg(F.round(best, 2).alias(name))

    return totals(first, n[0], "a").join(totals(second, n[1], "b"), "week", "full_outer").select("week", (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("difference"))
