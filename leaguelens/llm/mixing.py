"""Mixing sources to target weights, by blocks.

Each source's words form one stream, cut into blocks of fixed length.  Output shards get
multinomial source counts, drawn without going over what a source still owes; the n-th
slot of a source maps through a pseudorandom permutation of that source's block numbers
(a new one each epoch), and slots meet blocks in a join on the block number.  Texts are
never shuffled: only ids, sizes and block numbers move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.llm.common import WORD, materialize

_MASK = (1 << 64) - 1


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int, rounds: int = 16) -> np.ndarray:
    """A keyed permutation of 0..n-1 (swap-or-not rounds), applied to ``x``."""
    x = x.astype(np.int64)
    for r in range(rounds):
        salt = _mix64(np.array([(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & _MASK], "u8"))
        shift = int(salt[0] % np.uint64(n))
        other = (shift - x) % n
        coin = _mix64(np.maximum(x, other).astype("u8") ^ salt) & np.uint64(1)
        x = np.where(coin == 1, other, x)
    return x


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of sources from ``sizes`` (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share the total
    by weight; a target stops at ``cap`` times its source's size and the excess is shared
    again.  Closed form: in order of cap over weight, the first source that its share
    doesn't fill fixes the share of one unit of weight.  One row per source throughout.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("sid", F.row_number().over(every).cast("long")).withColumn("w", turn.cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    at = ranked.withColumns({"share": (total - before) / left, "place": F.row_number().over(order)})
    fits = F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("place"))
    unit = F.min_by("share", fits).over(Window.partitionBy())
    return at.withColumn("unit", unit).select(
        "sid", "source", "source_size", F.least("cap", F.col("unit") * F.col("w")).alias("target")
    )


def draw_slots(sources: DataFrame, block_words: int, seed: int, cap: float = 3.0, shards: int = 1024, least_slots: int = 4096) -> DataFrame:
    """Rows (sid, block): one for each slot of the mix.

    ``sources`` (sid, source_size, target) has one row per source; its counts per shard
    are drawn in one small task, the slots themselves in many.  A block has ``cap`` slots
    at most.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("sid")
        rows = rows[rows["source_size"] > 0]
        n = -(-rows["source_size"].to_numpy() // block_words)
        owed = np.minimum(np.rint(rows["target"].to_numpy() * n / rows["source_size"].to_numpy()).astype(np.int64), np.floor(cap * n).astype(np.int64))
        done, sid = np.zeros(len(n), np.int64), rows["sid"].to_numpy()
        each = max(least_slots, -(-int(owed.sum()) // shards))
        shard = 0
        while owed.sum():
            rng = np.random.default_rng([seed, shard])
            if owed.sum() <= each:
                got = owed.copy()
            else:
                got = np.zeros_like(owed)
                while (need := each - int(got.sum())) > 0:
                    free = (owed - got).astype(float)
                    got = np.minimum(got + rng.multinomial(need, free / free.sum()), owed)
            used = got > 0
            yield pd.DataFrame({"shard": shard, "sid": sid[used], "first": done[used], "n": got[used], "blocks": n[used]})
            done, owed, shard = done + got, owed - got, shard + 1

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for start in range(r.first, r.first + r.n, 1_000_000):
                    k = np.arange(start, min(start + 1_000_000, r.first + r.n))
                    block = np.empty_like(k)
                    for epoch in np.unique(k // r.blocks):
                        part = k // r.blocks == epoch
                        block[part] = permute(k[part] % r.blocks, r.blocks, (seed * 1_000_003 + r.sid) * 64 + int(epoch))
                    yield pd.DataFrame({"sid": r.sid, "block": block})

    drawn = sources.coalesce(1).mapInPandas(counts, "shard long, sid long, first long, n long, blocks long")
    # a stated number of partitions, as the few rows that the slots come from would be put together
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(tasks, F.col("shard"), F.col("sid")).mapInPandas(slots, "sid long, block long")


def _drawn(base: DataFrame, weights: tuple[int, ...], cap: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``base`` (id, source, size, ...) with sid, source_size, target and place in their stream; their blocks with overlap and times drawn."""
    extra = [c for c in base.columns if c not in ("id", "source", "size")]
    chunks = max(1, math.isqrt(base.count()))
    base = base.withColumn("chunk", F.pmod(F.xxhash64("id", "size"), F.lit(chunks)))
    per_chunk = base.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    per_chunk = materialize(per_chunk, "mix-chunks")
    sizes = per_chunk.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = materialize(source_targets(sizes, weights, cap), "mix-sources")

    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    offsets = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "offset", "sid", "source_size", "target")
    within = Window.partitionBy("sid", "chunk").orderBy("id", "size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    placed = placed.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    b = F.lit(block_words)
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    keep = ["id", "sid", "start", "size", "source_size", "target", *extra]
    pieces = placed.where("size > 0").select(*keep, F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest("start", F.col("block") * b)
    times = draw_slots(sources.select("sid", "source_size", "target"), block_words, seed, cap).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # the planner takes the slots for as small as the sources that they come from: no broadcast
    drawn = pieces.withColumn("overlap", overlap).join(times.hint("merge"), ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return placed, drawn


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 64,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns id, size (words; null text: 0), source_size, target (of the source), taken.
    A block is used ``cap`` times at most, so no document exceeds ``cap`` times its size;
    a source's taken words differ from its target by about half a block.  The order of a
    stream and all draws follow from ids, sizes and ``seed``, so reruns agree.  An empty
    table gives an empty result; repeated rows count and return as often as they occur;
    a null source is a source of its own; other columns are ignored.
    """
    base = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size")), "mix-sizes")
    placed, drawn = _drawn(base, weights, cap, block_words, seed)
    taken = drawn.groupBy("id", "sid", "start", "size", "source_size", "target").agg(F.sum(F.col("overlap") * F.col("times")).cast("long").alias("taken"))
    cols = [F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), "taken"]
    return taken.select(*cols).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))


def mixed_texts(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 64,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: the words of the drawn blocks, by document.

    A document comes as often as its most used block; its n-th row holds the words, in
    their order, of the blocks used n times or more, and the whole text, as it is, where
    these are all.  Texts without a word are in no block and go.  Rows that repeat an id
    and text all take the blocks of the first of them; null ids and sources, repeats of an
    id with other texts, and columns of any name stay as they are.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), F.xxhash64(text_col).alias("hash")
    )
    base = materialize(packed.select("id", "source", "size", "hash"), "mix-sizes")
    _, drawn = _drawn(base, weights, cap, block_words, seed)
    # as many blocks as a document has
    used = drawn.groupBy("id", "hash", "sid", "start").agg(F.array_sort(F.collect_list(F.struct("block", "times"))).alias("blocks"))
    used = used.groupBy("id", "hash").agg(F.min_by(F.struct("start", F.transform("blocks", lambda b: b["times"]).alias("times")), F.struct("sid", "start")).alias("used"))
    used = used.select(F.col("id").alias("i"), F.col("hash").alias("h"), "used.*").withColumn("most", F.array_max("times")).where("most > 0")
    met = packed.select("doc", "id", "hash").join(used, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    met = met.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))))
    text, space = F.col("doc")[text_col], r"[\x20\x09-\x0D]"
    words = F.regexp_extract_all(text, F.lit(f"{space}*{WORD}"), F.lit(0))
    place = lambda i: F.floor((F.col("start") + i) / block_words) - F.floor(F.col("start") / block_words) + 1
    chosen = F.filter(words, lambda w, i: F.element_at("times", place(i).cast("int")) >= F.col("turn"))
    part = F.regexp_replace(F.array_join(chosen, ""), f"^{space}+", "")
    mixed = met.withColumn("mixed", F.when(F.array_min("times") >= F.col("turn"), text).otherwise(part))
    return mixed.select(*[F.col("mixed" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns])
