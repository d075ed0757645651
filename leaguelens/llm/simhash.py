"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Distinct fingerprints meet where the pigeonhole principle says that similar ones must:
of m blocks of bits, fingerprints with at most d differing bits agree on m - d.  Inside
such a bucket the table of Hamming distances to many reference fingerprints is computed
once; a pair whose distances to any reference differ by more than d is discarded, and
the survivors are verified.  Every bucket returns the links of a spanning forest only,
so its output is linear in its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import connected_components, materialize

#: Fragments of a large bucket; every two of them meet in a task of their own.
FRAGMENT_ROWS = 2048
#: Rows of a bucket that the block scheme aims at.
BUCKET_ROWS = 512
N_PIVOTS = 32


def fingerprint(text: str | None, shingle_words: int, seed: int = 42) -> int:
    """Majority bits over the XXH64 of word shingles, repeats included; no words: 0.

    Fewer words than a shingle make one shingle of all of them.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    digest, n = partial(xxhash.xxh64_intdigest, seed=seed), len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        part = words[at : min(at + 100_000, n) + k - 1]
        hashes = np.fromiter(map(digest, map(b" ".join, zip(*(part[i:] for i in range(k))))), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": np.array([fingerprint(t, shingle_words, seed) for t in pdf["t"]], np.uint64).astype(np.int64)})

    # ids travel as text, as pandas would turn longs with nulls into floats
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id string, fp long")
    return found.withColumn("id", F.col("id").cast("long"))


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints from a fixed rule."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def block_masks(rows: int, max_bits: int) -> list[int]:
    """Bit masks of which two fingerprints within ``max_bits`` agree on one at least.

    The finer the scheme the more masks; it is the coarsest whose buckets would hold
    about BUCKET_ROWS rows if bits were even.
    """
    for m in range(max_bits + 1, max_bits + 5):
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(blocks, m - max_bits)]
        if rows <= BUCKET_ROWS << min(bin(x).count("1") for x in masks):
            break
    return masks


def link_cells(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Label of each row: the smallest row number linked to it within its cell.

    Rows of a cell are taken in the order of their distance to the first reference, so a
    row meets only those within ``max_bits`` of it; the other references follow.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], cell))
    cell, fp, table = cell[order], fp[order], table[order]
    label, live, shift = np.arange(len(fp)), np.arange(len(fp)), 0
    while len(live):
        shift += 1
        live = live[live + shift < len(fp)]
        live = live[(cell[live] == cell[live + shift]) & (table[live + shift, 0] - table[live, 0] <= max_bits)]
        i = live
        for p in range(1, table.shape[1]):
            if len(i) == 0:
                break
            i = i[np.abs(table[i + shift, p] - table[i, p]) <= max_bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= max_bits]
        j = i + shift
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            apart = a != b
            i, j, a, b, low = i[apart], j[apart], a[apart], b[apart], low[apart]
            np.minimum.at(label, np.maximum(a, b), low)
            while not np.array_equal(label[label], label):
                label = label[label]
    out = np.empty(len(fp), np.int64)
    out[order] = order[label]
    return out


def fingerprint_links(classes: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints within ``max_bits`` of each other.

    ``classes`` has one row (fp, rep) per distinct fingerprint.
    """
    masks = block_masks(classes.count(), max_bits)
    # a mask as a signed long
    keys = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for k, m in enumerate(masks)]
    rows = classes.where("rep is not null").select("fp", "rep", F.explode(F.array(*keys)).alias("key")).select("fp", "rep", "key.*")
    large = rows.groupBy("kind", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = rows.join(large, ["kind", "bits"]).withColumn("parts", F.ceil(F.col("n") / FRAGMENT_ROWS).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("kind", "bits", F.least("mine", "other"), F.greatest("mine", "other"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cut = int(np.searchsorted(held["cell"].to_numpy(), held["cell"].iloc[-1]))
            if cut >= 20_000:
                yield solve(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = pdf["rep"].to_numpy()
        label = link_cells(pdf["cell"].to_numpy(), pdf["fp"].to_numpy().astype(np.uint64), max_bits)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"u": rep[linked], "v": rep[label[linked]]})

    dealt = rows.select(cell.alias("cell"), "fp", "rep").repartition(F.col("cell")).sortWithinPartitions("cell")
    return dealt.mapInPandas(run, "u long, v long")


def simhash_components(
    docs: DataFrame, shingle_words: int = 5, max_bits: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint and near-duplicate group of every document.

    Returns id, fingerprint (16 lower-case hex digits) and component_id, the smallest id
    reachable over links of at most ``max_bits`` differing bits.  Null and empty texts
    have fingerprint zero and link like any other; repeated rows return as often as they
    occur; a null id takes part in no link; an empty table gives an empty result; other
    columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle_words, seed, id_col, text_col), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    parts = connected_components(fingerprint_links(classes, max_bits))
    named = classes.join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
