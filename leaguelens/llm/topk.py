"""Exact top-k inner products by a Voronoi join.

Rows are grouped by their nearest pivot.  Every query first meets the rows of its own
group, which gives it a k-th score to beat.  The summary of each other group (its radius
around the pivot) bounds what the group can score against the query; the query is sent
only to the groups that may beat its k-th score, and there only rows far enough from the
pivot are scored.  Groups are cut into blocks of bounded size, solved locally, and the
blocks' best rows are merged.  Rows move once, queries as often as they have groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.llm.common import hash_sample, materialize

#: Most pivots; queries and rows of a block.
PIVOTS, QUERY_BLOCK, DATA_BLOCK = 1024, 4096, 8192


def quantized(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """Rows (id, v): floor(scale * x) of every component as long; rows with a null id or vector or a component that is null or not finite are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.col(vec_col).isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(~bad & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _stack(series: pd.Series, dim: int) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, dim), np.int64)


def best_rows(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ``ids`` ascend, and rows of id ``own`` don't count."""
    other = np.flatnonzero(ids != own)
    s = scores[other]
    if len(s) > k:
        other = other[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[other]
    return other[np.argsort(-s, kind="stable")[:k]]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS
) -> DataFrame:
    """The k rows of highest integer inner product for every query row, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``.  A row is no candidate for queries
    with its own id.  Vectors of a length other than the most common one take no part,
    like null ones and those with a null or non-finite component; fewer than k
    candidates are all returned; repeated rows are candidates as often as they occur
    and give a query's rows once; an empty table gives an empty result.  Returns
    query_id, rank, <id_col>, score.  Components must keep scores inside a long.
    """
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, `{id_col}` long, score long"
    rows = materialize(quantized(vectors, id_col, vec_col, scale), "topk-rows")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes or sizes[0].d <= 0:
        return spark.createDataFrame([], schema)
    dim, total = sizes[0].d, sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    # pivots: a sample by hash that grows with the root of the rows, so that groups and pivots do
    sample = hash_sample(rows, "id", min(pivots, max(1, math.isqrt(total) // 4)), total).collect()
    centre = np.array([r.v for r in sample], float)
    sent = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for pdf in batches:
            x = _stack(pdf["v"], dim).astype(float)
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pd.DataFrame({"id": pdf["id"], "v": list(x.astype("<i8")), "cell": cell, "far": d[np.arange(len(d)), cell]})

    placed = materialize(rows.mapInPandas(assign, "id long, v array<long>, cell int, far double"), "topk-cells")
    queries = placed.where(is_query).groupBy("id").agg(F.min_by(F.struct("v", "cell"), F.struct("cell", "v")).alias("s")).select("id", "s.*")
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    # one number of each kind for every pivot
    blocks, radius = np.zeros(len(centre), np.int64), np.full(len(centre), -1.0)
    for r in held:
        blocks[r.cell], radius[r.cell] = -(-r.n // DATA_BLOCK), r.far
    norm = float(np.sqrt((centre**2).sum(1)).max()) + max(radius, default=0.0)
    slack = 1e-6 * (1 + norm * norm)

    def sent_to(qid: int, v: np.ndarray, cells: np.ndarray, least: np.ndarray) -> pd.DataFrame:
        """A query once for every block of ``cells``."""
        n = blocks[cells]
        block = np.concatenate([np.arange(i) for i in n])
        return pd.DataFrame({"cell": np.repeat(cells, n), "block": block, "id": qid, "v": pd.Series([v] * len(block), dtype=object), "least": np.repeat(least, n)})

    def joined(frames: Iterator[pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
        """The frames, put together to some thousand rows."""
        held, n = [], 0
        for f in frames:
            if f is not None:
                held.append(f)
                n += len(f)
            if n >= 4096:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the blocks of its own group."""
        for pdf in batches:
            yield from joined(sent_to(qid, v, np.array([cell]), np.zeros(1)) for qid, v, cell in zip(pdf["id"], pdf["v"], pdf["cell"]))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the blocks of other groups that may beat its k-th score: p.q + |q| far is the most at distance far from pivot p."""

        def needed(qid: int, v: np.ndarray, cell: int, floor: float) -> pd.DataFrame | None:
            q = np.asarray(v, float)
            size = max(float(np.sqrt(q @ q)), 1e-9)
            least = np.maximum(0.0, (floor - slack - sent.value @ q) / size)
            need = np.flatnonzero((least <= radius) & (np.arange(len(radius)) != cell))
            return sent_to(qid, v, need, least[need]) if len(need) else None

        for pdf in batches:
            yield from joined(map(needed, pdf["id"], pdf["v"], pdf["cell"], pdf["floor"]))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf["q"]].sort_values("id"), pdf[~pdf["q"]].sort_values("id")
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec": [], "score": []}).astype("int64")
        x, y = _stack(q["v"], dim), _stack(d["v"], dim)
        exact = dim * float(np.abs(x).max()) * float(np.abs(y).max()) < 2**53
        left, right = (x.astype(float), y.T.astype(float)) if exact else (x, y.T)
        ids, far, out = d["id"].to_numpy(), d["far"].to_numpy(), []
        for at in range(0, len(q), 256):
            scores = left[at : at + 256] @ right
            for qid, least, row in zip(q["id"].to_numpy()[at : at + 256], q["far"].to_numpy()[at : at + 256], scores):
                near = far >= least
                best = np.flatnonzero(near)[best_rows(ids[near], row[near], qid, k)]
                out.append(pd.DataFrame({"query_id": qid, "vec": ids[best], "score": row[best].astype(np.int64)}))
        return pd.concat(out)

    parts = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    data = placed.select("cell", F.pmod(F.xxhash64("id", "v"), parts).cast("int").alias("block"), "id", "v", "far")
    ask = "cell int, block int, id long, v array<long>, least double"

    def meet(asked: DataFrame) -> DataFrame:
        """The best rows of every block for each query that comes to it."""
        asked = materialize(asked, "topk-asked")
        parts = asked.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        dealt = data.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        mine = asked.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        cols = ["cell", "block", "part", "id", "v", "far"]
        both = mine.withColumnRenamed("least", "far").select(*cols, F.lit(True).alias("q")).unionByName(dealt.select(*cols, F.lit(False).alias("q")))
        return both.groupBy("cell", "block", "part").applyInPandas(solve, "query_id long, vec long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    first = meet(queries.mapInPandas(own, ask)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = materialize(first.select("query_id", "vec", "score"), "topk-first")
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    known = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "cell", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor"))
    ranked = first.unionByName(meet(known.mapInPandas(others, ask))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec").alias(id_col), "score")
