"""Near-duplicates by SimHash over word shingles, with verified links.

A text's distinct shingles give a SimHash fingerprint of 256 bits and bands of MinHash
values; texts meet where a band agrees, which at a similarity of 0.8 fails for one pair in
100,000.  Inside such a bucket a pivot distance table, the Hamming distances of all rows to
reference fingerprints of the bucket, discards the pairs whose coordinates differ too
much; survivors within ``gate_bits`` are verified on the shingles themselves.  The nearest
partner of every row is verified first.  Only where rows of a bucket are then still in
different components, and close, do all of them meet, with their shingles, in small cells;
a cell returns the links of a spanning forest only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import connected_components, discard, materialize, runs

BANDS, BAND_ROWS = 30, 5
#: 64-bit parts of a fingerprint; reference fingerprints of a bucket.
PARTS, REFERENCES = 4, 16
#: Rows of a fragment of a bucket: of fingerprints, and with their shingles.
LIGHT, HEAVY = 2048, 256


def shingles(text: str | None, shingle_words: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words than a shingle make one of all of them."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle_words, len(words))
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*(words[i:] for i in range(k)))))
    return np.unique(np.fromiter(hashes, "<u8", len(words) - k + 1))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values, as 32-bit numbers."""
    import xxhash

    rng = np.random.default_rng(11)
    odd, add = rng.integers(0, 2**63, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 10_000):
        x = (found[None, at : at + 10_000] ^ add) * (odd | np.uint64(1))
        low = np.minimum(low, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(1))
    return np.array([xxhash.xxh32_intdigest(r.tobytes()) for r in low.reshape(BANDS, -1)], np.uint32).astype(np.int32)


def wide_fingerprint(found: np.ndarray) -> bytes:
    """SimHash of distinct shingles: PARTS parts of 64 majority bits, each from hashes that follow from the one before."""
    ones, hashes = np.zeros((PARTS, 64), np.int64), found.astype("<u8")
    for p in range(PARTS):
        for at in range(0, len(hashes), 100_000):
            ones[p] += np.unpackbits(hashes[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.packbits(2 * ones > len(found), axis=1, bitorder="little").tobytes()


def gate_bits(similarity: float, deviations: float = 3.7) -> int:
    """Differing bits that texts of this similarity exceed by chance only: the mean and ``deviations`` deviations of it."""
    n, p = 64 * PARTS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n * p + deviations * math.sqrt(n * p * (1 - p)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def close_pairs(cell: np.ndarray, wide: np.ndarray, max_bits: int, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers i, j and differing bits of all pairs of a cell within ``max_bits`` whose ``apart`` differs.

    ``cell`` is sorted.  Rows of a cell are taken in the order of their distance to its
    first reference, so a row meets only those within ``max_bits`` of it in this
    coordinate; the others follow.  In each triple of arrays no i and no j occurs twice.
    """
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(first, len(cell)))
    begin, many = np.repeat(first, size), np.repeat(size, size)
    table = np.empty((len(cell), REFERENCES), np.int16)
    for p in range(REFERENCES):
        table[:, p] = np.bitwise_count(wide ^ wide[begin + many * p // REFERENCES]).sum(1, dtype=np.int16)
    order = np.lexsort((table[:, 0], begin))
    begin, wide, table, apart = begin[order], wide[order], table[order], apart[order]
    live, shift = np.arange(len(cell)), 0
    while len(live):
        shift += 1
        live = live[live + shift < len(begin)]
        live = live[(begin[live] == begin[live + shift]) & (table[live + shift, 0] - table[live, 0] <= max_bits)]
        i = live[apart[live] != apart[live + shift]]
        for p in range(1, REFERENCES):
            if not len(i):
                break
            i = i[np.abs(table[i + shift, p] - table[i, p]) <= max_bits]
        bits = np.bitwise_count(wide[i] ^ wide[i + shift]).sum(1, dtype=np.int64)
        near = bits <= max_bits
        if near.any():
            yield order[i[near]], order[i[near] + shift], bits[near]


def _dealt(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``rows`` of each key in cells: every two fragments of at most about ``most`` rows meet in one."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    cut = rows.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return cut.withColumn(name, cell).drop("parts", "mine", "other").repartition(F.col(name)).sortWithinPartitions(name)


def _wide(series: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(series), "<u8").reshape(len(series), PARTS)


def similar_components(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate group of every row with an id: (id, text_hash, component_id, leads).

    A link is a Jaccard similarity of distinct shingles of at least ``similarity``;
    ``component_id`` is the smallest id reachable over links.  Rows are told apart by id
    and xxhash64 of the text, so ids that come with several texts keep their texts apart;
    ``leads`` marks the row of smallest id, then text hash, of each group.  Null and empty
    texts are equal; repeated rows return as often as they occur; rows with a null id take
    part in no link and are left out.
    """
    import xxhash

    # ids travel as text, as pandas would turn longs with nulls into floats
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, shingle_words) for t in pdf["t"]]
            yield pd.DataFrame({
                "id": pdf["id"], "text_hash": pdf["text_hash"], "node": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64),
                "wide": [wide_fingerprint(s) for s in sets], "bands": [bands(s) for s in sets],
            })

    rows = slim.mapInPandas(sketch, "id string, text_hash long, node long, wide binary, bands array<int>").withColumn("id", F.col("id").cast("long"))
    rows = materialize(rows, "shingle-rows")
    classes = rows.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.min("wide").alias("wide"), F.min("bands").alias("bands"))
    classes = materialize(classes, "shingle-classes")

    keyed = classes.select("node", F.posexplode("bands").alias("kind", "band")).select("node", F.xxhash64("kind", "band").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = materialize(keyed.join(shared, "key").join(classes.select("node", "wide"), "node"), "shingle-buckets")
    wanted = materialize(met.select("node").distinct(), "shingle-wanted")
    some = rows.join(classes.join(wanted, "node", "left_semi").select("node", "first"), "node").where("id = first.id and text_hash = first.text_hash")
    some = some.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "node").distinct()

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "set": [shingles(t, shingle_words).tobytes() for t in pdf["t"]]})

    texts = slim.join(some, (F.col("id").cast("long") == F.col("i")) & (F.col("text_hash") == F.col("h"))).select("node", "t")
    sets = materialize(texts.mapInPandas(sets_of, "node long, set binary").dropDuplicates(["node"]), "shingle-sets")
    discard(wanted)
    gate = gate_bits(similarity)

    def same(a: np.ndarray, b: np.ndarray) -> bool:
        return min(len(a), len(b)) >= (similarity - 1e-9) * max(len(a), len(b)) and jaccard(a, b) >= similarity - 1e-9

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [same(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf.loc[np.array(good, bool), ["u", "v"]]

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, node, c = (pdf[k].to_numpy() for k in ("cell", "node", "c"))
        bits, who = np.full(len(pdf), 1 << 10), np.zeros(len(pdf), np.int64)
        for i, j, d in close_pairs(cell, _wide(pdf["wide"]), gate, c):
            for a, b in ((i, j), (j, i)):
                better = d < bits[a]
                bits[a[better]], who[a[better]] = d[better], node[b[better]]
        found = bits <= gate
        return pd.DataFrame({"key": pdf["key"][found], "node": node[found], "bits": bits[found], "who": who[found]})

    def verified(pdf: pd.DataFrame) -> pd.DataFrame:
        node, c = pdf["node"].to_numpy(), pdf["c"].to_numpy()
        label = np.unique(c, return_inverse=True)[1]
        owned = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        got = list(close_pairs(pdf["cell"].to_numpy(), _wide(pdf["wide"]), gate, c))
        out = []
        if got:
            i, j, bits = (np.concatenate(x) for x in zip(*got))
            root = list(range(int(label.max()) + 1))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            closest = np.argsort(bits, kind="stable")
            for a, b in zip(i[closest].tolist(), j[closest].tolist()):
                x, y = find(label[a]), find(label[b])
                if x != y and same(owned[a], owned[b]):
                    root[y] = x
                    out.append((node[a], node[b]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    def solved(rows: DataFrame, solve: Callable, least: int, schema: str) -> DataFrame:
        return rows.mapInPandas(lambda it: runs(it, "cell", least, solve), schema)

    def mixed(links: DataFrame | None) -> DataFrame:
        """Rows of the buckets that hold several components, with their component c."""
        placed = met.withColumn("c", F.col("node"))
        if links is not None:
            parts = connected_components(links).withColumnRenamed("node", "k")
            placed = met.join(parts, F.col("node") == F.col("k"), "left").withColumn("c", F.coalesce("component_id", "node")).drop("k", "component_id")
        placed = materialize(placed, "shingle-placed")
        several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        left = materialize(placed.join(several, "key"), "shingle-mixed")
        discard(placed)
        return left

    def closest(rest: DataFrame) -> DataFrame:
        dealt = _dealt(rest.select("key", "node", "c", "wide"), LIGHT, "cell")
        return materialize(solved(dealt, nearest, 20_000, "key long, node long, bits long, who long"), "shingle-near")

    rest = mixed(None)
    near = closest(rest)
    discard(rest)
    pairs = near.groupBy("node").agg(F.min_by("who", F.struct("bits", "who")).alias("who"))
    pairs = pairs.select(F.least("node", "who").alias("u"), F.greatest("node", "who").alias("v")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    links = materialize(pairs.select("u", "v", "a", "b").mapInPandas(check, "u long, v long"), "shingle-links")
    discard(near)
    rest = mixed(links)
    discard(met)
    # the rows that still have a close one in another component
    near = closest(rest)
    open_rows = near.select("key", "node").distinct()
    heavy = materialize(rest.join(open_rows, ["key", "node"]).join(sets, "node").select("key", "node", "c", "wide", "set"), "shingle-open")
    for done in (rest, near, sets):
        discard(done)
    more = materialize(solved(_dealt(heavy, HEAVY, "cell"), verified, 512, "u long, v long"), "shingle-links")
    discard(heavy)
    final = connected_components(links.unionByName(more)).withColumnRenamed("node", "k")
    named = classes.select("node", "first").join(final, F.col("node") == F.col("k"), "left").select("node", F.coalesce("component_id", "node").alias("c"), "first")
    named = materialize(named, "shingle-named")
    leaders = named.groupBy("c").agg(F.min("first").alias("lead"))
    out = rows.select("id", "text_hash", "node").join(named.join(leaders, "c").select("node", "lead"), "node")
    leads = (F.col("id") == F.col("lead.id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("lead.id").alias("component_id"), leads.alias("leads"))
