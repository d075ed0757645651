"""Suffix-array dedup: bytes covered by a string of fixed length that also starts earlier.

Every window of that length has one anchor, the smallest hashed gram inside it, so equal
windows share the anchor's gram.  Consecutive windows with one anchor form a context.
Contexts of equal content are repeats of their first one.  Where a gram has different
contexts, only the first of each is left to compare; their bytes are gathered, and a
suffix array by linear grouping construction (``suffix_groups``) orders the windows, so
that equal ones stand together.  Copies are merged inside each task before anything is
shuffled; a gram with very many contexts is compared window by window instead, by digests,
and where one task already sees that it is crowded its contexts are spread over all tasks.

Windows and contexts are told apart by 128 bits of hash; the suffix array compares bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import materialize, release, runs
from leaguelens.llm.suffix_groups import suffix_array

GRAM = 24
#: Bytes hashed at once; contexts above which a gram is compared by window digests, in all and
#: among CHUNK contexts of one task; bytes of a suffix array.
BATCH, MANY, CROWD, CHUNK, SORTED = 1 << 21, 2000, 64, 400_000, 16_000
#: Marks in x: a context of a crowded gram; the notice that a gram is crowded somewhere.
_CROWDED, _NOTICE = 1 << 61, 1 << 62
_U = np.uint64
_P = 0x9E3779B97F4A7C15


def _powers(n: int, p: int) -> np.ndarray:
    out, m = np.ones(n, _U), 1
    while m < n:
        s = min(m, n - m)
        out[m : m + s] = out[:s] * _U(pow(p, m, 1 << 64))
        m += s
    return out


class Anchors:
    """Contexts of texts: arrays gram, content, doc, first window and (windows - 1) * 256 + anchor offset."""

    def __init__(self, window: int, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.code = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=_U) | _U(1)
        self.up, self.down = _powers(BATCH + 2, _P), _powers(BATCH + 2, pow(_P, -1, 1 << 64))

    def __call__(self, texts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """``texts``: (doc, offset of the first byte, bytes), BATCH bytes in all at most."""
        w, k = self.window, self.gram
        b = np.frombuffer(b"".join(t[2] for t in texts), np.uint8)
        n, none = len(b), np.zeros(0, np.int64)
        if n < w:
            return none.astype(_U), none.astype(_U), none, none, none
        lengths = np.array([len(t[2]) for t in texts])
        ends = np.cumsum(lengths)
        total = np.zeros(n + 1, _U)
        np.cumsum(self.code[b] * self.up[:n], out=total[1:])

        def hashed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            h = (total[j] - total[i]) * self.down[i]
            h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
            return h ^ (h >> _U(29))

        at = np.arange(n - k + 1)
        g = hashed(at, at + k)
        key = (g & ~_U((1 << 24) - 1)) | at.astype(_U)
        low, width, span = key, 1, w - k + 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        m = n - w + 1
        low = np.minimum(low[:m], low[span - width :][:m])
        anchor = (low & _U((1 << 24) - 1)).astype(np.int64)
        text = np.searchsorted(ends, np.arange(m), side="right")
        start = np.flatnonzero(np.arange(m) + w <= ends[text])
        if not len(start):
            return none.astype(_U), none.astype(_U), none, none, none
        anchor, text = anchor[start], text[start]
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
        lo, hi, p, text = start[new], start[np.append(new[1:], len(start)) - 1], anchor[new], text[new]
        shape = (hi - lo) * 256 + (p - lo)
        content = hashed(lo, hi + w) ^ (shape.astype(_U) * _U(0x94D049BB133111EB))
        base = np.array([t[1] for t in texts]) - np.concatenate(([0], ends[:-1]))
        return g[p], content, np.array([t[0] for t in texts], np.int64)[text], lo + base[text], shape


def _flags(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Rows for repeated windows lo .. lo + n - 1 of a document: x below zero."""
    spread = doc * 1_000_003 + lo
    return pd.DataFrame({"g": spread, "c": 0, "d": doc, "x": ~(lo << 24 | n)})


def _later(keys: list[np.ndarray], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first occurrence of each key, and of those at another place than the first."""
    order = np.lexsort((lo, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    away = (doc[order] != doc[first]) | (lo[order] != lo[first])
    return order[new], order[away]


def repeated_windows(contexts: list[tuple[int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """Ranges (doc, first window, windows) that repeat, among contexts with one gram each.

    A context is (doc, first window, windows, anchor offset, bytes); contexts of different
    grams may be mixed.  All texts are sorted in one suffix array.
    """
    flat: list[int] = []
    begins = []
    for c in contexts:
        begins.append(len(flat))
        flat += c[4]
        flat.append(-1)
    flat.append(-2)
    order = np.array(suffix_array(flat))
    counts = np.array([c[2] for c in contexts])
    which = np.repeat(np.arange(len(contexts)), counts)
    off = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.full(len(flat), -1)
    owner[np.array(begins)[which] + off] = np.arange(len(which))
    owner = owner[order]
    at = order[owner >= 0]
    owner = owner[owner >= 0]
    data = np.array(flat, np.int16)
    same = np.zeros(len(at), bool)
    r = np.arange(window)
    for s in range(1, len(at), 20_000):
        e = min(s + 20_000, len(at))
        same[s:e] = (data[at[s:e, None] + r] == data[at[s - 1 : e - 1, None] + r]).all(1)
    label = np.empty(len(which), np.int64)
    label[owner] = np.cumsum(~same)
    doc = np.array([c[0] for c in contexts])[which]
    pos = np.array([c[1] for c in contexts])[which] + off
    _, later = _later([label], doc, pos)
    later = np.sort(later)
    if not len(later):
        return []
    cut = np.flatnonzero(np.concatenate(([True], (later[1:] != later[:-1] + 1) | (which[later][1:] != which[later][:-1]))))
    size = np.diff(np.append(cut, len(later)))
    return list(zip(doc[later[cut]].tolist(), pos[later[cut]].tolist(), size.tolist()))


def _sharing(group: list[tuple], window: int) -> list[tuple]:
    """The contexts of a gram that can share a window with another: every window holds the
    gram with a third of a window before it, or with two thirds from it on."""
    left = window // 3

    def keys(c: tuple) -> tuple:
        a, raw = c[3], c[4]
        return (0, raw[a - left : a + GRAM]) if a >= left else None, (1, raw[a : a + window - left]) if a - (c[2] - 1) < left else None

    seen = Counter(k for c in group for k in keys(c) if k)
    return [c for c in group if any(k and seen[k] > 1 for k in keys(c))]


def _anchored(docs: DataFrame, window: int, crowd: int) -> DataFrame:
    """Contexts (x >= 0) and, for copies inside a task, flags (x < 0).

    Contexts of a gram crowded in this task go by gram and content; a notice goes by gram.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, texts, size, found, n = Anchors(window), [], 0, [], 0
        step = BATCH - window + 1
        for pdf in batches:
            for doc, text in zip(pdf["d"], pdf["t"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for at in range(0, max(len(raw) - window + 1, 0), step):
                    part = raw[at : at + BATCH]
                    if size + len(part) > BATCH:
                        found.append(find(texts))
                        n, texts, size = n + len(found[-1][0]), [], 0
                        if n > CHUNK:
                            yield from merged(found)
                            found, n = [], 0
                    texts.append((doc, at, part))
                    size += len(part)
        if texts:
            found.append(find(texts))
        if found:
            yield from merged(found)

    def merged(found: list) -> Iterator[pd.DataFrame]:
        g, c, d, lo, shape = (np.concatenate(x) for x in zip(*found))
        first, later = _later([g, c], d, lo)
        several, place, count = np.unique(g[first], return_inverse=True, return_counts=True)
        crowded = count[place] > crowd
        key = np.where(crowded, (g[first] ^ (c[first] >> _U(7))) * _U(0xD6E8FEB86659FD93), g[first])
        x = lo[first] << 16 | shape[first] | np.where(crowded, _CROWDED, 0)
        yield pd.DataFrame({"g": key.astype(np.int64), "c": c[first].astype(np.int64), "d": d[first], "x": x})
        yield pd.DataFrame({"g": several[count > crowd].astype(np.int64), "c": 0, "d": 0, "x": _NOTICE})
        yield _flags(d[later], lo[later], (shape[later] >> 8) + 1)

    return docs.mapInPandas(run, "g long, c long, d long, x long")


def _compared(anchored: DataFrame, many: int) -> DataFrame:
    """Flags, and the first of each context where a gram has several (c = 1 if it has very many)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = pdf[pdf["x"] < 0]
        notices = pdf["g"][pdf["x"] == _NOTICE].unique()
        rows = pdf[(pdf["x"] >= 0) & (pdf["x"] != _NOTICE)]
        g, c, d, x = (rows[k].to_numpy() for k in "gcdx")
        crowded = (x & _CROWDED != 0) | np.isin(g, notices)
        x = x & (_CROWDED - 1)
        lo = x >> 16
        first, later = _later([g, c], d, lo)
        _, place, n = np.unique(g[first], return_inverse=True, return_counts=True)
        n = n[place]
        keep = (n > 1) | crowded[first]
        by_window = (crowded[first] | (n > many))[keep]
        keep = first[keep]
        left = pd.DataFrame({"g": g[keep], "c": by_window.astype(np.int64), "d": d[keep], "x": x[keep]})
        return pd.concat([flags, left, _flags(d[later], lo[later], ((x[later] >> 8) & 255) + 1)])

    dealt = anchored.repartition(F.col("g")).sortWithinPartitions("g")
    return dealt.mapInPandas(lambda it: runs(it, "g", 50_000, solve), "g long, c long, d long, x long")


def _resolved(docs: DataFrame, left: DataFrame, window: int) -> DataFrame:
    """Flags (d, x) among the remaining contexts, whose bytes are fetched from their documents."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, parts in zip(pdf["d"], pdf["t"], pdf["parts"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for r in parts:
                    lo, n = r["x"] >> 16, (r["x"] >> 8 & 255) + 1
                    part = raw[lo : lo + n - 1 + window]
                    if len(part) < n - 1 + window:
                        continue
                    if not r["c"]:
                        out.append((r["g"], 0, doc, r["x"], part))
                        continue
                    for o in range(n):
                        digest = hashlib.blake2b(part[o : o + window], digest_size=16).digest()
                        out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc, (lo + o) << 16, b""))
            got = pd.DataFrame(out, columns=list("gcdx") + ["raw"])
            single = (got["raw"].str.len() == 0).to_numpy()
            if single.any():
                one = got[single]
                lo = one["x"].to_numpy() >> 16
                first, later = _later([one["g"].to_numpy(), one["c"].to_numpy()], one["d"].to_numpy(), lo)
                yield _flags(one["d"].to_numpy()[later], lo[later], np.ones(len(later), np.int64)).assign(raw=b"")
                got = pd.concat([got[~single], one.iloc[first]])
            yield got

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = pdf[pdf["x"] < 0]
        rows = pdf[pdf["x"] >= 0]
        single = (rows["raw"].str.len() == 0).to_numpy()
        one = rows[single]
        lo = one["x"].to_numpy() >> 16
        _, later = _later([one["g"].to_numpy(), one["c"].to_numpy()], one["d"].to_numpy(), lo)
        out = [flags[["d", "x"]], _flags(one["d"].to_numpy()[later], lo[later], np.ones(len(later), np.int64))[["d", "x"]]]
        batch, size, found = [], 0, []
        for _, group in rows[~single].groupby("g", sort=False):
            contexts = [(d, x >> 16, (x >> 8 & 255) + 1, x & 255, raw) for d, x, raw in zip(group["d"].tolist(), group["x"].tolist(), group["raw"])]
            contexts = _sharing(contexts, window)
            batch += contexts
            size += sum(len(c[4]) for c in contexts)
            if size >= SORTED:
                found += repeated_windows(batch, window)
                batch, size = [], 0
        if batch:
            found += repeated_windows(batch, window)
        if found:
            d, lo, n = (np.array(v, np.int64) for v in zip(*found))
            out.append(_flags(d, lo, n)[["d", "x"]])
        return pd.concat(out)

    parts = left.groupBy("d").agg(F.collect_list(F.struct("g", "c", "x")).alias("parts"))
    fetched = docs.join(parts, "d").mapInPandas(fetch, "g long, c long, d long, x long, raw binary")
    dealt = fetched.repartition(F.col("g")).sortWithinPartitions("g")
    return dealt.mapInPandas(lambda it: runs(it, "g", 2_000, solve), "d long, x long")


def covered(flags: list[int], window: int, size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by flagged windows."""
    out: list[list[int]] = []
    for lo, n in sorted((~x >> 24, ~x & 0xFFFFFF) for x in flags):
        end = min(lo + n - 1 + window, size)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif lo < end:
            out.append([lo, end])
    return [tuple(x) for x in out]


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (id, d, t) with a new d: one number for each id and text, in the order of ids, null last, then text hashes."""
    keyed = rows.withColumn("h", F.xxhash64("t"))
    order = keyed.select("d", "h").distinct().orderBy(F.col("d").asc_nulls_last(), "h")
    order = materialize(order.select(F.col("d").alias("k"), F.col("h").alias("kh"), F.monotonically_increasing_id().alias("n")), "repeats-order")
    return keyed.join(order, F.col("d").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh"))).select("id", F.col("n").alias("d"), "t")


def remove_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, many: int = MANY, crowd: int = CROWD) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts earlier.

    Earlier: in a smaller id, or at a smaller place of the same document; strings are
    judged on the input.  Returns id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``keep_text``, kept (binary).  Null texts are empty; texts shorter than ``window``
    keep all.  Every distinct (id, text) is a document of its own: null ids stand last,
    texts of one id in the order of their xxhash64, and rows that repeat both are one
    document and return as often as they occur.  An empty table gives an empty result;
    other columns are ignored.
    """
    if not GRAM < window <= 255:
        raise ValueError("window must be between the gram's length and 255")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    if not rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or d is null").isEmpty():
        rows = _told_apart(rows)
    texts = rows.select("d", "t")
    compared = materialize(_compared(_anchored(texts, window, crowd), many), "repeats-contexts")
    release(spark)
    more = materialize(_resolved(texts, compared.where("x >= 0"), window), "repeats-windows")
    release(spark)
    flags = compared.where("x < 0").select("d", "x").unionByName(more).groupBy("d").agg(F.collect_list("x").alias("flags"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, found in zip(pdf["id"], pdf["t"], pdf["flags"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans = covered(found.tolist(), window, len(raw)) if found is not None else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                row = [key, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                out.append([*row, kept] if keep_text else row)
            yield pd.DataFrame(out, columns=names)

    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    # ids travel as text, as pandas would turn longs with nulls into floats
    schema = "k string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    done = rows.join(flags, "d", "left").select("id", "t", "flags").mapInPandas(cut, schema)
    return done.select(F.col("k").cast("long").alias(id_col), *names[1:])
