"""Embedding near-duplicates by NN-descent.

Neighbour lists start from rows that sort together under random projections and improve by
rounds of neighbours-of-neighbours joins: the members around each row meet in one small
block, chunked so that hubs stay bounded.  Lists keep the K nearest; one that is saturated,
its K-th neighbour still at the threshold, doubles each round, and all candidates that reach
the threshold stay as links.  Rows of one component are then as good as linked:
a further pass looks only for neighbours in other components, so that a list full of its
own clump can't hide a link across.  Links inside components are counted exactly.  A
brute-force audit of sampled rows measures recall; while it is too low, passes with more
projections and reach follow, and at last a comparison of all rows in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.llm.common import connected_components, discard, hash_sample, materialize, release

#: Neighbours kept, random projections per start, sort neighbours compared, members of a local join, rows of a block.
K, PROJECTIONS, REACH, CHUNK, BLOCK = 12, 6, 6, 32, 1024
#: Rows of a block where all rows meet; rows that the projections and reach above are meant for.
WIDE, SMALL = 8192, 10_000
#: Candidates of a row that one projection keeps besides those at the threshold; projections of a
#: step, rows of a slice of a round and slices at most: tables beyond a slice go by steps and slices, to bound the disk.
KEPT, STEP, SLICE, SLICES = 4, 3, 200_000, 16
#: Slack of the one-byte vectors used while searching.
SLACK = 0.03


def _unit(series: pd.Series) -> np.ndarray:
    x = np.stack(series.to_numpy()).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(unit: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.rint(unit * (127 / np.abs(unit).max(1, keepdims=True))).astype(np.int8)]


def _unpack(series: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(series), np.int8).reshape(len(series), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _runs(batches: Iterator[pd.DataFrame], key: str, least: int, solve) -> Iterator[pd.DataFrame]:
    """Give ``solve`` whole runs of equal ``key`` from sorted batches, at least ``least`` rows at a time."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        keys = held[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut >= least:
            yield solve(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield solve(held)


def _start(nodes: DataFrame, dim: int, seed: int, near: float, projections: range = range(PROJECTIONS), reach: int = REACH) -> DataFrame:
    """First candidates (u, v, sim): rows of different components ``c`` close in the order of random sign codes.

    A projection keeps those that are among the ``KEPT`` best of one of their rows, and all from ``near`` on.
    """

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = [np.random.default_rng([seed, t]).standard_normal((dim, 17)).astype(np.float32) for t in projections]
        for pdf in batches:
            x = _unpack(pdf["q"])
            for t, plane in zip(projections, planes):
                y = x @ plane
                code = (y[:, :16] > 0) @ (1 << np.arange(16))
                yield pd.DataFrame({"t": t, "code": code, "pos": y[:, 16], "id": pdf["id"], "c": pdf["c"], "q": pdf["q"]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in batches:
            new = 0 if tail is None else len(tail)
            rows = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            if not len(rows):
                continue
            x, ids, t, c = _unpack(rows["q"]), rows["id"].to_numpy(), rows["t"].to_numpy(), rows["c"].to_numpy()
            # the end of each row's run of its own component, beyond which others begin
            ends = np.append(np.flatnonzero(c[1:] != c[:-1]) + 1, len(c))
            end = ends[np.searchsorted(ends, np.arange(len(c)), side="right")]
            # similarity by row and place of the next ones, of those before, and of those beyond the run
            after, before, beyond = (np.full((len(c), reach), -2, np.float32) for _ in range(3))
            for s in range(1, reach + 1):
                i = np.arange(max(0, new - s), len(ids) - s)
                i = i[(t[i] == t[i + s]) & (c[i] != c[i + s])]
                after[i, s - 1] = before[i + s, s - 1] = np.einsum("ij,ij->i", x[i], x[i + s])
                far = np.flatnonzero(end + s - 1 < len(ids))
                far = far[(end[far] + s - 1 >= new) & (end[far] - far > 1)]
                j = end[far] + s - 1
                ok = (t[far] == t[j]) & (c[far] != c[j])
                beyond[far[ok], s - 1] = np.einsum("ij,ij->i", x[far[ok]], x[j[ok]])
            kept = min(KEPT, 3 * reach)
            least = np.minimum(np.partition(np.concatenate([after, before, beyond], 1), -kept, 1)[:, -kept], np.float32(near))
            for sims, first in ((after, np.arange(len(c)) + 1), (beyond, end)):
                i, s = np.nonzero(sims > -2)
                j, sim = first[i] + s, sims[i, s]
                ok = (sim >= least[i]) | (sim >= least[j])
                yield pd.DataFrame({"u": ids[i[ok]], "v": ids[j[ok]], "sim": sim[ok]})
            tail = rows.iloc[-reach:].reset_index(drop=True)

    coded = nodes.select("id", "c", "q").mapInPandas(codes, "t int, code long, pos float, id long, c long, q binary")
    dealt = coded.repartitionByRange("t", "code", "pos", "id").sortWithinPartitions("t", "code", "pos", "id")
    return dealt.mapInPandas(meet, "u long, v long, sim float")


def _best(pairs: DataFrame, k: int, near: float) -> DataFrame:
    """The k nearest of every row (r <= k) and all candidates from ``near`` on, both directions of each counted."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).where("u <> v")
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    # dealt by row once, which serves both the groups and the order
    once = both.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return once.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) | (F.col("sim") >= near))


def _descend(lists: DataFrame, nodes: DataFrame, most: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Candidates of different components among the neighbours and reverse neighbours of each row of a ``part`` of ``parts``.

    Lists go beyond K only while their last neighbour reaches the threshold, so ``most``
    above K enlarges the saturated lists and no others.
    """
    lists = lists.where(F.col("r") <= most)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, ids, c, x = pdf["cell"].to_numpy(), pdf["id"].to_numpy(), pdf["c"].to_numpy(), _unpack(pdf["q"])
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(begin, len(cell)))
        out = []
        for width in np.unique(size[size > 1]):
            starts = begin[size == width]
            for at in range(0, len(starts), max(1, 400_000 // int(width) ** 2)):
                rows = starts[at : at + max(1, 400_000 // int(width) ** 2)][:, None] + np.arange(width)
                sims = x[rows] @ x[rows].transpose(0, 2, 1)
                sims[c[rows][:, :, None] == c[rows][:, None, :]] = -2
                n = min(4, int(width) - 1)
                best = np.argpartition(-sims, n - 1, axis=2)[:, :, :n] if n < width - 1 else np.argsort(-sims, axis=2)[:, :, :n]
                u = np.repeat(ids[rows][:, :, None], n, 2)
                v = np.take_along_axis(np.repeat(ids[rows][:, None, :], width, 1), best, 2)
                out.append(pd.DataFrame({"u": u.ravel(), "v": v.ravel(), "sim": np.take_along_axis(sims, best, 2).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"u": [], "v": [], "sim": []}).astype({"u": "int64", "v": "int64", "sim": "float32"})

    around = lists.select(F.col("u").alias("w"), F.col("v").alias("id")).unionByName(lists.select(F.col("v").alias("w"), F.col("u").alias("id")))
    around = around.where(F.pmod(F.xxhash64("w", F.lit(7)), F.lit(parts)) == part).distinct()
    degree = around.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cell = F.xxhash64("w", F.pmod(F.xxhash64("id", "w"), F.col("chunks")))
    members = around.join(degree, "w").select(cell.alias("cell"), "id").join(nodes.select("id", "c", "q"), "id")
    dealt = members.repartition(F.col("cell")).sortWithinPartitions("cell")
    found = dealt.mapInPandas(lambda it: _runs(it, "cell", 20_000, join), "u long, v long, sim float")
    return found.where("sim > -2").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim")


def _cosine(a: str, b: str):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links of every member of a component: (id, n), own copies included.

    ``members`` (component, id, m, v).  Rows within half the threshold angle of the
    component's smallest id are linked to each other for certain and only counted; the
    rest meet all rows of the component in blocks, which return counts, not pairs.
    """
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    lead = members.where("id = component").select("component", F.col("v").alias("lead"))
    placed = members.join(lead, "component").withColumn("core", _cosine("v", "lead") >= half).drop("lead")
    placed = materialize(placed, "nn-members")
    sums = placed.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("m")).otherwise(0)).alias("core_m"),
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"),
        F.ceil(F.count_if(~F.col("core")) / BLOCK).cast("int").alias("fringe"),
    )
    joined = placed.join(sums, "component")
    certain = joined.where("core").select("id", F.col("core_m").alias("n"))
    loose = joined.where("fringe > 0")
    left = loose.where("not core").withColumn("i", F.pmod(F.xxhash64("id"), F.col("fringe"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = loose.withColumn("j", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fringe") - 1)))
    cols = lambda side: ["component", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "id", "m", "v", "core", F.lit(side).alias("left")]
    cells = left.select(*cols(True)).unionByName(right.select(*cols(False)))
    cells = cells.withColumn("cell", F.xxhash64("component", "i", "j")).drop("component", "i", "j")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "n": []}).astype("int64")]
        for _, g in pdf.groupby("cell", sort=False):
            a, b = g[g["left"]], g[~g["left"]]
            if len(a) and len(b):
                near = _unit(a["v"]) @ _unit(b["v"]).T >= threshold
                near |= a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]
                core = b["core"].to_numpy()
                out.append(pd.DataFrame({"id": a["id"], "n": near @ b["m"].to_numpy()}))
                out.append(pd.DataFrame({"id": b["id"][core], "n": (a["m"].to_numpy() @ near)[core]}))
        return pd.concat(out)

    dealt = cells.repartition(F.col("cell")).sortWithinPartitions("cell")
    counted = dealt.mapInPandas(lambda it: _runs(it, "cell", 4096, block), "id long, n long")
    out = materialize(certain.unionByName(counted).groupBy("id").agg(F.sum("n").alias("n")), "nn-counts")
    discard(placed)
    return out


def _missed(nodes: DataFrame, threshold: float, rows: int) -> DataFrame:
    """A link (u, v), the nearest of a block, for every two components with one; all rows meet in blocks."""
    parts = max(1, -(-rows // WIDE))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "c": pdf["c"], "x": [r.tobytes() for r in _unit(pdf["v"]).astype(np.float32)] if len(pdf) else []})

    packed = nodes.select("id", "c", "v").mapInPandas(pack, "id long, c long, x binary")
    packed = packed.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = packed.select((F.least("mine", "other") * parts + F.greatest("mine", "other")).cast("long").alias("cell"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "id", "c", "x")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"u": [], "v": [], "a": [], "b": [], "sim": []}).astype({"u": "int64", "v": "int64", "a": "int64", "b": "int64", "sim": "float32"})]
        for _, g in pdf.groupby("cell", sort=False):
            x, ids, c = np.frombuffer(b"".join(g["x"]), np.float32).reshape(len(g), -1), g["id"].to_numpy(), g["c"].to_numpy()
            left, right = np.flatnonzero(g["left"].to_numpy()), np.flatnonzero(g["right"].to_numpy())
            for at in range(0, len(left), 512):
                i = left[at : at + 512]
                sims = x[i] @ x[right].T
                p, q = np.nonzero((sims >= threshold - 1e-5) & (c[i][:, None] != c[right][None, :]))
                u, v = i[p], right[q]
                out.append(pd.DataFrame({"u": ids[u], "v": ids[v], "a": np.minimum(c[u], c[v]), "b": np.maximum(c[u], c[v]), "sim": sims[p, q]}).sort_values("sim", ascending=False).drop_duplicates(["a", "b"]))
        return pd.concat(out).sort_values("sim", ascending=False).drop_duplicates(["a", "b"])[["u", "v"]]

    dealt = cells.repartition(F.col("cell")).sortWithinPartitions("cell")
    return dealt.mapInPandas(lambda it: _runs(it, "cell", 1, block), "u long, v long")


def near_groups(
    vectors: DataFrame, threshold: float = 0.9, rounds: int = 3, starts: int = 3, audit_rows: int = 4096, recall: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Groups of vectors linked by a cosine of at least ``threshold``.

    Returns id, n_links (other rows linked directly), component_id (smallest id
    reachable) and kept (id = component_id).  Rows whose vector is null, zero, of another
    length than the most common one, or holds a null or non-finite component link with
    nothing.  Equal vectors are one class in the graph and all counted.  An empty table
    gives an empty result; a null id takes no part and gets null for component and kept;
    repeated rows return as often as they occur and count as other rows.
    """
    d = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(good & F.exists(d, lambda x: x != 0), F.lit(False))
    # single precision is stored as such, and widened where it is read
    stored = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    wide = F.col("v").cast("array<double>")
    narrow = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(ok, F.col(vec_col).cast(stored)).alias("v")), "nn-rows")
    base = narrow.withColumn("v", wide)
    valid = base.where("v is not null")
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "m": pdf["m"], "v": pdf["v"], "q": _pack(_unit(pdf["v"])) if len(pdf) else []})

    classes = narrow.where(F.col("v").isNotNull() & (F.size("v") == dim)).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
    nodes = materialize(classes.select("id", "m", "v").mapInPandas(pack, f"id long, m long, v {stored}, q binary"), "nn-nodes").withColumn("v", wide)
    counts = links = parts = None
    rows = nodes.count() if dim else 0
    ends = [nodes.select(F.col("id").alias(i), F.col("v").alias(x)) for i, x in (("u", "a"), ("v", "b"))]
    near, slices = threshold - SLACK, max(1, min(SLICES, rows // SLICE))

    def improved(lists: DataFrame | None, found: DataFrame) -> DataFrame:
        out = materialize(_best(found if lists is None else found.unionByName(lists.drop("r")), K, near), "nn-lists")
        if lists is not None:
            discard(lists)
        release(nodes.sparkSession)
        return out

    for attempt in range(starts + 1 if dim else 0):
        known = nodes.withColumn("c", F.col("id"))
        if parts is not None:
            known = materialize(nodes.select("id", "q", *["v"] * (attempt == starts)).join(parts, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component_id", "id")).drop("node", "component_id"), "nn-known")
        lists = None
        if attempt == starts:
            close = _missed(known, threshold, rows)
        else:
            # the chance that two near rows sort together falls slowly with the number of rows
            grown = 2**attempt * max(1.0, rows / SMALL) ** 0.25
            projections, reach = math.ceil(PROJECTIONS * grown), math.ceil(REACH * grown)
            step = projections if slices == 1 else STEP
            for t in range(0, projections, step):
                lists = improved(lists, _start(known, dim, 100 + attempt, near, range(t, min(t + step, projections)), reach))
            for number in range(rounds):
                for part in range(slices):
                    lists = improved(lists, _descend(lists, known, K << number, part, slices))
            close = lists.where(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = materialize(close.join(ends[0], "u").join(ends[1], "v").where(_cosine("a", "b") >= threshold).select("u", "v"), "nn-links")
        found = new.count()
        if found or counts is None:
            links = new if links is None else links.unionByName(new)
            parts = materialize(connected_components(links), "nn-parts")
            members = nodes.join(parts, F.col("id") == F.col("node")).select(F.col("component_id").alias("component"), "id", "m", "v")
            counts = _count_links(members, threshold)
        # full lists may hide links to other components; the next pass looks there
        full = lists is not None and found and not lists.where((F.col("r") >= K) & (F.col("sim") >= threshold - SLACK)).isEmpty()
        if lists is not None:
            discard(lists)
        if parts is not None and attempt and attempt < starts:
            discard(known)
        if not full and _audit(nodes, counts, threshold, audit_rows) >= recall:
            break
    if counts is None:
        named = valid.where("false").select("v", F.col("id").alias("rep"), F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    else:
        named = nodes.join(counts.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").join(parts, F.col("id") == F.col("node"), "left")
        named = named.select("v", F.col("id").alias("rep"), F.coalesce("n", "m").alias("n"), F.coalesce("component_id", "id").alias("component"))
    out = base.join(named, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _audit(nodes: DataFrame, counts: DataFrame, threshold: float, rows: int) -> float:
    """Average share of the links of a row, its own copies left out, that were found.

    The rows are drawn by a hash, whether or not links were found, and compared with all
    others by brute force; those without a link say nothing.
    """
    drawn = hash_sample(nodes.select("id", "m", "v"), "id", rows, nodes.count())
    picked = drawn.join(counts.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").select("v", "m", F.coalesce("n", "m").alias("n")).collect()
    if not picked:
        return 1.0
    sent = nodes.sparkSession.sparkContext.broadcast(_unit(pd.Series([np.array(r.v) for r in picked])))

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(sent.value), np.int64)
        for pdf in batches:
            if len(pdf):
                x, m = _unit(pdf["v"]).T, pdf["m"].to_numpy()
                for at in range(0, len(total), 256):
                    total[at : at + 256] += (sent.value[at : at + 256] @ x >= threshold) @ m
        yield pd.DataFrame({"i": np.flatnonzero(total), "n": total[total > 0]})

    true = {r.i: r.n for r in nodes.select("m", "v").mapInPandas(brute, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    shares = [(r.n - r.m) / (true[i] - r.m) for i, r in enumerate(picked) if true.get(i, 0) > r.m]
    return float(np.mean(shares)) if shares else 1.0
