"""Shared plumbing: table access, durable intermediate tables, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on
    one machine (tests) a temporary folder is chosen and remembered for the session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("leaguelens.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="leaguelens-")
        spark.conf.set("leaguelens.shared.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage durably: lost executors re-read files instead of recomputing the
    branch, and a frame used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leaguelens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Links of a node above which its label is broadcast instead of joined; nodes broadcast at most.
HUB_LINKS, HUBS = 64, 50_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every node of an undirected edge list.

    ``edges`` has long columns ``u`` and ``v``.  Alternates the large-star and small-star
    steps until the edge set stops changing; every round is one aggregation and one
    join, written to the shared folder in place of the one before, and no edge or label
    reaches the driver (only a count and a checksum).  Labels of hubs are broadcast, so
    that no task joins all links of one: a hub has more than ``HUB_LINKS`` links, or as
    many more as keep hubs to ``HUBS``.  Returns ``node``, ``component_id``; nodes without
    an edge are absent.  Self loops, repeated and null edges are ignored.  Raises if
    ``max_rounds`` rounds do not converge.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    cur = materialize(edges.where("u is not null and v is not null and u <> v").select(*pair).distinct(), "cc")

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, large: bool, links: int) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        most = max(HUB_LINKS, 2 * links // HUBS)
        hubs = low.where(F.col("n") > most).select(F.col("u").alias("h"), F.col("m").alias("hm"))
        marked = both.join(F.broadcast(hubs), F.col("u") == F.col("h"), "left")
        met = marked.where("h is null").select("u", "v").join(low.where(F.col("n") <= most).select("u", "m"), "u").select("u", "v", "m")
        joined = met.unionByName(marked.where("h is not null").select("u", "v", F.col("hm").alias("m")))
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    before = stamp(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # the large star's links are written, as the small star reads them several times
        wide = materialize(star(cur, True, before[0]), "cc")
        new = materialize(star(wide, False, before[0]), "cc")
        discard(cur)
        discard(wide)
        cur, after = new, stamp(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component_id"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots).groupBy("node").agg(
        F.min("component_id").alias("component_id")
    )


def release(spark: SparkSession) -> None:
    """Let the driver collect frames that nothing holds any more, so that their shuffle files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def runs(batches: Iterator[pd.DataFrame], key: str, least: int, solve: Callable) -> Iterator[pd.DataFrame]:
    """Give ``solve`` whole runs of equal ``key`` from sorted batches, at least ``least`` rows at a time."""
    held, n = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        keys = pdf[key].to_numpy()
        if n >= least and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield solve(pd.concat([*held[:-1], pdf.iloc[:cut]], ignore_index=True))
            held = [pdf.iloc[cut:]]
            n = len(held[0])
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def hash_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` of ``total`` rows, in the order of a hash of ``key``.

    A threshold on the hash goes first, so that tasks pass on about ``rows`` rows in all,
    however many tasks there are.
    """
    share = min(1.0, (1.5 * rows + 100) / max(total, 1))
    place = F.xxhash64(key)
    near = df.where(place <= F.lit(int(-(2**63) + share * (2**64 - 2)))) if share < 1 else df
    return near.orderBy(place, key).limit(rows)
