"""Document log-likelihood under a gated recurrent language model.

Counts cover all training documents.  The most frequent words form the model's vocabulary
(all others are one rare word, spelt by the smoothed counts), arranged in classes of equal
size by frequency: the softmax first picks the class, then the word in it.  Biases start
at the corpus's frequencies.  The recurrent weights are trained in numpy by truncated
backpropagation on all training documents: in every round copies of the model learn from
parts of a quarter of them in as many groups, and their parameters are averaged, by blocks,
in the cluster.  Scoring runs many documents in lockstep and carries
each state from window to window to the end of its document.

A bounded head of the counts is broadcast; rarer words meet their counts in a join.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import materialize

#: Words in the recurrent model; words whose counts are broadcast.
VOCABULARY, HEAD = 4096, 200_000
HIDDEN, CLASS_WORDS, WINDOW, LANES, TRAIN_LANES = 24, 64, 32, 512, 256
#: Share of the training documents that the recurrent weights are fitted on; rounds; words of a
#: model copy in all rounds, at least, where the corpus allows several; numbers of a parameter block.
FIT_SHARE, ROUNDS, COPY_WORDS, BLOCK = 1.0, 4, 3_000_000, 16_384
ALPHA = 0.1
#: Rows of states whose scores are worked on at a time.
CHUNK = 2048


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text or b""
    return (raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw).lower().split()


class GatedModel:
    """GRU with a class-factored softmax; word numbers are ranks by frequency."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, class_words: int = CLASS_WORDS, seed: int = 3):
        n = len(counts)
        c, m = max(1, -(-n // class_words)), class_words
        rng = np.random.default_rng(seed)
        freq = np.full(c * m, -np.inf)
        freq[:n] = np.log(np.maximum(counts, 0.5))
        freq = freq.reshape(c, m)
        top = freq.max(1)
        mass = top + np.log(np.exp(freq - top[:, None]).sum(1))
        f = np.float32
        self.size, self.m = n, m
        self.p = {
            "x": (rng.standard_normal((n + 1, 3 * hidden)) * 0.1).astype(f),  # the last row starts a document
            "u": (rng.standard_normal((hidden, 3 * hidden)) / hidden**0.5).astype(f),
            "c": np.zeros((hidden, c), f),
            "cb": (mass - mass.max()).astype(f),
            "w": np.zeros((c, hidden, m), f),
            "wb": np.where(np.isfinite(freq), freq - mass[:, None], -1e9).astype(f),
        }

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = h.shape[1]
        a, b = self.p["x"].take(x, 0), h @ self.p["u"]
        zr = a[:, : 2 * k] + b[:, : 2 * k]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, b = zr[:, :k], zr[:, k:], b[:, 2 * k :]
        n = r * b
        n += a[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, b

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each ``y`` after state ``h``; with ``grads``, adds gradients and returns that of h."""
        p, cls, pos, k = self.p, y // self.m, y % self.m, h.shape[1]
        out = np.empty(len(y))
        dh = None if grads is None else np.empty_like(h)
        # biases as weights of a last input of ones
        c = np.concatenate([p["c"], p["cb"][None]])
        w = np.concatenate([p["w"], p["wb"][:, None]], 1)
        top = float(np.abs(h).max(initial=0))

        def bounded(weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
            # whether the scores can be raised as they are, without taking off their largest
            reach, most = top * np.abs(weights).sum(-2).max(-1), biases.max(-1)
            return (most + reach < 60) & (most - reach > -60)

        def softmax(hk: np.ndarray, weights: np.ndarray, safe: bool, at: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
            rows = np.arange(len(at))
            e = hk @ weights
            if not safe:
                e -= e.max(1, keepdims=True)
            chosen = e[rows, at]
            np.exp(e, out=e)
            t = e @ ones
            if g is None:
                return chosen - np.log(t), None
            # t times the gradient of the scores, and back
            e[rows, at] -= t
            less = (-1 / t)[:, None]
            g += (hk * less).T @ e
            back = e @ weights[:k].T
            back *= less
            return chosen - np.log(t), back

        # words by class: each class is one run of rows; some rows at a time, so that their scores stay in the cache
        order = np.argsort(cls.astype(np.int16) if len(c[0]) < 1 << 15 else cls, kind="stable")
        ks, ps, hs = cls[order], pos[order], np.empty((len(y), k + 1), h.dtype)
        hs[:, :k], hs[:, k] = h[order], 1
        got, more = np.empty(len(y)), None if grads is None else np.empty_like(h)
        gc, gw = (None, [None] * len(w)) if grads is None else (np.zeros_like(c), np.zeros_like(w))
        ones, safe = np.ones(c.shape[1], h.dtype), bool(bounded(p["c"], p["cb"]))
        for a in range(0, len(y), CHUNK):
            rows = slice(a, a + CHUNK)
            got[rows], back = softmax(hs[rows], c, safe, ks[rows], gc)
            if grads is not None:
                more[rows] = back
        ones, safes = np.ones(self.m, h.dtype), bounded(p["w"], p["wb"])
        cuts = np.flatnonzero(np.diff(ks, prepend=-1))
        for start, end in zip(cuts, np.append(cuts[1:], len(y))):
            one = ks[start]
            for a in range(start, end, CHUNK):
                rows = slice(a, min(a + CHUNK, end))
                logs, back = softmax(hs[rows], w[one], safes[one], ps[rows], gw[one])
                got[rows] += logs
                if grads is not None:
                    more[rows] += back
        out[order] = got
        if grads is not None:
            grads["c"] += gc[:k]
            grads["cb"] += gc[k]
            grads["w"] += gw[:, :k]
            grads["wb"] += gw[:, k]
            dh[order] = more
        return out, dh

    def train(self, docs: list[np.ndarray], begin: float = 0.0, end: float = 1.0, lanes: int = TRAIN_LANES, window: int = WINDOW, rate: float = 0.02, seed: int = 5) -> None:
        """One pass of truncated backpropagation with Adam, state kept across windows and reset by document.

        ``begin`` and ``end`` say which part of the whole training the pass is; the rate falls over it.
        Few words use fewer lanes, so that the pass has some steps.
        """
        docs = [d for d in docs if len(d)]
        if not docs:
            return
        rng = np.random.default_rng(seed)
        # all parameters, their gradients and moments in one block each
        flat, self.p = self._flat(self.p)
        slope, grads = self._flat({k: np.zeros_like(v) for k, v in self.p.items()})
        mean, square = np.zeros_like(flat), np.zeros_like(flat)
        docs = [docs[i] for i in rng.permutation(len(docs))]
        y = np.concatenate(docs)
        first = np.zeros(len(y), bool)
        first[np.cumsum([0] + [len(d) for d in docs[:-1]])] = True
        x = np.where(first, self.size, np.concatenate(([self.size], y[:-1])))
        lanes = max(1, min(lanes, len(y) // (window * 32)))
        length = -(-len(y) // lanes)
        # the last lane is filled up with the first words
        fill = np.arange(lanes * length) % len(y)
        x, y, first = (v[fill].reshape(lanes, length) for v in (x, y, first))
        h = np.zeros((lanes, self.p["u"].shape[0]), np.float32)
        for number, at in enumerate(range(0, length, window), 1):
            done = begin + (end - begin) * at / length
            part = slice(at, at + window)
            _, h, _ = self.gradients(x[:, part].T, y[:, part].T, first[:, part].T, h, grads)
            self._learn(flat, slope, mean, square, 1 / y[:, part].size, number, rate / (1 + 3 * done))

    @staticmethod
    def _flat(arrays: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """One block with a copy of all ``arrays``, and their views in it."""
        flat, views, at = np.concatenate([v.ravel() for v in arrays.values()]), {}, 0
        for k, v in arrays.items():
            views[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return flat, views

    def gradients(
        self, x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray, grads: dict[str, np.ndarray] | None = None
    ) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the log-likelihood of ``y`` (step, lane) from state ``h``, the last state, and the log-likelihood.

        They are added to ``grads``, if given.
        """
        p, k = self.p, h.shape[1]
        if grads is None:
            grads = {name: np.zeros_like(v) for name, v in p.items()}
        starts_any, kept = first.any(1), (~first).astype(h.dtype)[:, :, None]
        before, z, r, n, b, states = np.empty((6, *x.shape, k), h.dtype)
        for t, xt in enumerate(x):
            before[t] = h * kept[t] if starts_any[t] else h
            states[t], z[t], r[t], n[t], b[t] = self.step(xt, before[t])
            h = states[t]
        logs, dh = self.log_probs(states.reshape(-1, k), y.ravel(), grads)
        dh = dh.reshape(*x.shape, k)
        # what a gradient of a state gives for its gates, for all steps at once
        to_n = (1 - z) * (1 - n * n)
        gates = np.empty((*x.shape, 3, k), h.dtype)
        np.multiply(before - n, z * (1 - z), out=gates[:, :, 0])
        np.multiply(to_n * b, r * (1 - r), out=gates[:, :, 1])
        np.multiply(to_n, r, out=gates[:, :, 2])
        back, turned = np.zeros_like(h), np.ascontiguousarray(p["u"].T)
        for t in range(len(x) - 1, -1, -1):
            d = dh[t]
            d += back
            gates[t] *= d[:, None]
            back = gates[t].reshape(-1, 3 * k) @ turned
            back += d * z[t]
            if starts_any[t]:
                back *= kept[t]
        grads["u"] += before.reshape(-1, k).T @ gates.reshape(-1, 3 * k)
        np.multiply(to_n, dh, out=gates[:, :, 2])
        # gradients of a word's inputs: one sum over all its places, of frequent words by a product with ones
        order = np.argsort(x.astype(np.uint16) if self.size < 1 << 16 else x, axis=None, kind="stable")
        words, starts, counts = np.unique(x.ravel()[order], return_index=True, return_counts=True)
        found = gates.reshape(-1, 3 * k)[order]
        sums, ones, few = found[starts], np.ones(len(found), h.dtype), counts <= 8
        for w in np.flatnonzero(~few):
            np.dot(ones[: counts[w]], found[starts[w] : starts[w] + counts[w]], out=sums[w])
        for more in range(1, 8):
            some = np.flatnonzero(few & (counts > more))
            sums[some] += found[starts[some] + more]
        grads["x"][words] += sums
        return grads, h, float(logs.sum())

    def _learn(self, flat: np.ndarray, slope: np.ndarray, mean: np.ndarray, square: np.ndarray, scale: float, number: int, rate: float) -> None:
        """One step of Adam along ``slope``, which becomes zero; in blocks that stay in the cache."""
        norm = math.sqrt(float(slope @ slope)) * scale
        scale *= min(1.0, 1.0 / max(norm, 1e-9))
        late = math.sqrt(1 - 0.99**number)
        rate *= late / (1 - 0.9**number)
        room = np.empty(BLOCK, flat.dtype)
        for at in range(0, len(flat), BLOCK):
            p, g, m, s = (v[at : at + BLOCK] for v in (flat, slope, mean, square))
            t = room[: len(p)]
            g *= scale
            np.multiply(g, 0.1, out=t)
            m *= 0.9
            m += t
            g *= g
            g *= 0.01
            s *= 0.99
            s += g
            np.sqrt(s, out=t)
            t += 1e-6 * late
            np.divide(m, t, out=t)
            t *= rate
            p += t
            g[:] = 0

    def score(self, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each whole document."""
        out = np.zeros(len(docs))
        size = np.array([len(d) for d in docs], int)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), lanes):
            group = order[at : at + lanes]
            group = group[size[group] > 0]
            h = np.zeros((len(group), self.p["u"].shape[0]), np.float32)
            last = np.full(len(group), self.size)
            for t in range(0, int(size[group].max(initial=0)), window):
                live = int((size[group] > t).sum())
                h, last, y, lanes_of, states = h[:live], last[:live], [], [], []
                parts = [docs[i][t : t + window] for i in group[:live]]
                block = np.full((window, live), -1)
                for j, q in enumerate(parts):
                    block[: len(q), j] = q
                for row in block:
                    n = int((row >= 0).sum())
                    if n == 0:
                        break
                    h, last = h[:n], last[:n]
                    h = self.step(last, h)[0]
                    last = row[:n]
                    states.append(h)
                    y.append(last)
                    lanes_of.append(np.arange(n))
                logs, _ = self.log_probs(np.concatenate(states), np.concatenate(y))
                out[group[:live]] += np.bincount(np.concatenate(lanes_of), logs, minlength=live)
        return out


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) over all of ``docs``; the end of a document is the empty word."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("t").to_pylist():
                seen.update(words_of(text))
            seen[b""] += len(batch)
            if len(seen) > 400_000:
                yield rows(seen)
                seen.clear()
        if seen:
            yield rows(seen)

    found = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words with their counts, all of a frequency or none, most frequent first.

    A histogram over sixteenths of powers of two gives the frequency to start from, so
    that no more rows than that reach the driver, from however many tasks.  None if the
    words of the highest frequencies alone are more; all words are rare ones then.
    """
    step = F.floor(F.log2("n") * 16)
    bins = {r.b: r.c for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    total, least = 0, None
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > most:
            break
        least = b
    if least is None:
        return []
    found = counts.where(step >= least).select("word", "n").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist()), key=lambda r: (-r[1], r[0]))


def packed(model: GatedModel) -> str:
    """How the numbers of a text's words travel."""
    return "<u2" if model.size <= 1 << 16 else "<i4"


def fit_model(model: GatedModel, train: DataFrame, words: int, number: dict[bytes, int], rare: int, share: float = FIT_SHARE, rounds: int = ROUNDS, copy_words: int = COPY_WORDS) -> None:
    """Train ``model`` on the texts t of ``train``, or of a ``share`` of it drawn by a hash of id and text.

    Each round takes its own part of them.  Copies of the model learn from a group
    of texts each and are averaged by their words; the driver sees one set of parameters
    a round.  ``words`` is the number of words of ``train``.  Instead of id and t, rows may
    have their hash h and the numbers of their words, packed.
    """
    spark = train.sparkSession
    names = sorted(model.p)
    copies = max(1, int(words * share) // copy_words)
    kind = packed(model)
    if "numbers" not in train.columns:

        def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [np.array([number.get(w, rare) for w in [*words_of(t), b""]], kind).tobytes() for t in pdf["t"]]
                yield pd.DataFrame({"h": pdf["h"], "numbers": found})

        train = train.select(F.xxhash64("id", "t").alias("h"), "t").mapInPandas(numbered, "h long, numbers binary")
    place = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)

    for turn in range(rounds):
        part = train.where((place >= share * turn / rounds) & (place < share * (turn + 1) / rounds))
        sent = spark.sparkContext.broadcast(model)

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            # one order of the texts, so that reruns agree
            pdf = pdf.sort_values(["h", "numbers"])
            texts = [np.frombuffer(y, kind).astype(np.int32) for y in pdf["numbers"]]
            mine = copy.deepcopy(sent.value)  # noqa: B023
            mine.train(texts, turn / rounds, (turn + 1) / rounds)  # noqa: B023
            weight = float(sum(map(len, texts)))
            flat = np.concatenate([mine.p[k].ravel() for k in names])
            parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            return pd.DataFrame({"block": range(len(parts)), "weight": weight, "values": parts})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, list] = {}
            for pdf in batches:
                for block, weight, values in zip(pdf["block"], pdf["weight"], pdf["values"]):
                    held = total.setdefault(block, [0.0, 0.0])
                    held[0], held[1] = held[0] + weight, held[1] + weight * np.frombuffer(values, "<f4").astype(np.float64)
            yield pd.DataFrame([(b, (v / w).astype("<f4").tobytes()) for b, (w, v) in total.items()], columns=["block", "values"])

        # a group is a copy's words, about copy_words over rounds
        dealt = part.select("numbers", "h").withColumn("copy", F.pmod(F.xxhash64("h"), F.lit(copies)))
        learnt = dealt.groupBy("copy").applyInPandas(learn, "block int, weight double, values binary")
        blocks = learnt.repartition(F.col("block")).sortWithinPartitions("block", "weight", "values").mapInPandas(add, "block int, values binary")
        # as many rows as the model has blocks of parameters
        found = sorted(blocks.collect(), key=lambda r: r.block)
        sent.unpersist()
        if not found:
            continue
        flat, at = np.concatenate([np.frombuffer(r["values"], "<f4") for r in found]), 0
        for k in names:
            model.p[k] = flat[at : at + model.p[k].size].reshape(model.p[k].shape).copy()
            at += model.p[k].size


def score_documents(
    docs: DataFrame, usable: Column, fit_share: float = FIT_SHARE, head: int = HEAD, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Log10 probabilities of all documents, learnt from those for which ``usable`` (a condition on the id column) holds.

    Returns id, n_tokens (words and one end), n_known, train_tokens, base_score (the
    smoothed counts alone) and score (the recurrent model).  Counts cover every usable
    document; the recurrent weights are fitted on all of these too, unless ``fit_share``
    is less than 1, which draws a share by a hash.  Null and empty texts are their end alone; a null id is no training document;
    repeated rows count and return as often as they occur; an empty table gives an empty
    result; other columns are ignored.
    """
    usable = F.coalesce(usable, F.lit(False))
    # ids travel as text, as pandas would turn longs with nulls into floats
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(id_col, text_col).alias("h"), (usable & F.col(id_col).isNotNull()).alias("fits"))
    train = docs.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    counts = materialize(count_words(train, "t"), "lm-counts")
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent_words(counts, head)
    kept = top[: vocabulary - 1]
    oov_mass = n_all + ALPHA * (n_distinct + 1) - sum(n + ALPHA for _, n in kept)
    # ranks in the model: kept words and the rare word, by frequency
    ranked = sorted([*kept, (None, n_all - sum(n for _, n in kept))], key=lambda r: -r[1])
    rare = next(i for i, r in enumerate(ranked) if r[0] is None)
    model = GatedModel(np.array([r[1] for r in ranked], float))
    number = {w: i for i, (w, _) in enumerate(ranked) if w is not None}

    known = {w: (i, n, number.get(w, rare)) for i, (w, n) in enumerate(top)}
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(known)
    log_all = math.log10(n_all + ALPHA * (n_distinct + 1))
    log_oov = math.log10(max(oov_mass, ALPHA))
    packing = packed(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = sent.value
        rank = np.array([r for _, _, r in known.values()] + [rare])
        # other words add nothing here; their counts come later
        logs = np.append(np.log10(np.array([n for _, n, _ in known.values()], float) + ALPHA), 0.0)
        index = {w: i for w, (i, _, _) in known.items()}
        none, task, at = len(index), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, tails, times, ends = [], [], [], [0]
            for text in batch.column("t").to_pylist():
                words = words_of(text)
                words.append(b"")
                found = np.fromiter(map(index.get, words, repeat(none)), np.int32, len(words))
                out = np.flatnonzero(found == none)
                y = rank[found]
                oov = found[y == rare]
                base = float(logs[found].sum()) - len(words) * log_all
                spelt = float(logs[oov].sum()) - len(oov) * log_oov
                rows.append((task << 40 | at, len(words), len(words) - len(out), base, spelt, y.astype(packing).tobytes()))
                at += 1
                tail = Counter([words[i] for i in out])
                tails += tail.keys()
                times += tail.values()
                ends.append(len(tails))
            if rows:
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary()])]
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(tails, pa.binary())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "fits")), *made, *lists], names)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = final.value.score([np.frombuffer(y, packing).astype(np.int32) for y in pdf["numbers"]]) / math.log(10)
            yield pdf.drop(columns="numbers").assign(score=found + pdf["spelt"]).drop(columns="spelt")

    kind = dict(docs.dtypes)[id_col]
    names = ["id", "h", "fits", "row", "n_tokens", "known", "base", "spelt", "numbers", "words", "times"]
    # texts are read once; training and scoring take the numbers of their words
    passed = slim.mapInArrow(
        read, "id string, h long, fits boolean, row long, n_tokens long, known long, base double, spelt double, numbers binary, words array<binary>, times array<long>"
    )
    passed = materialize(passed, "lm-passed")
    sent.unpersist()
    fit_model(model, passed.where("fits").select("h", "numbers"), int(n_all), number, rare, fit_share)
    final = spark.sparkContext.broadcast(model)
    main = passed.select("row", "id", "n_tokens", "known", "base", "spelt", "numbers").mapInPandas(score, "row long, id string, n_tokens long, known long, base double, score double")
    main = materialize(main, "lm-scored")
    met = passed.select("row", F.explode(F.arrays_zip("words", "times")).alias("tail")).select("row", F.col("tail.words").alias("word"), F.col("tail.times").alias("tf")).join(counts.hint("shuffle_hash"), "word", "left")
    logged = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))
    # the end token, if no document was usable, is an unknown word like any other
    tails = met.groupBy("row").agg(F.sum(F.col("tf") * logged).alias("extra"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more"))
    zero = F.lit(0.0)
    return main.join(tails, "row", "left").select(
        F.col("id").cast(kind).alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("extra", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("extra", zero)).alias("score"),
    )
