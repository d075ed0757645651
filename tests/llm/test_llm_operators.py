"""Each operator against brute force, on rows that include nulls, empties, repeats and ties."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leaguelens.llm import lm_score, mixing, nn_descent, packing, pii, quality, repeats, simhash, topk
from leaguelens.llm.common import connected_components
from leaguelens.llm.sp_encode import PieceEncoder, default_model, encode_documents
from leaguelens.llm.suffix_groups import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, v string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_texts():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(40)]
    texts += [None, "", " ", "\n\t", "x", texts[0], texts[0], texts[1] + " tail", texts[2][5:], texts[3].upper()]
    texts += [" ".join(["same"] * 400), "a" * 3000, "梦😀 " * 50, texts[4] + texts[5], "  two  spaces \n\n line"]
    return texts


TEXTS = base_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4] if i % 3 else "hot", 1, 9.5, 7, "x") for i, t in enumerate(TEXTS)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_null_and_large_ids(spark):
    big = (1 << 60) + 1
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    df = spark.createDataFrame([(big, text, "s"), (None, text, "s"), (big + 1, None, None)], "doc_id long, text string, source string").coalesce(1)
    cond = F.col("doc_id") > 0
    for out in (
        encode_documents(df), mixing.mix_documents(df), simhash.simhash_components(df), repeats.remove_repeats(df), pii.find_personal_data(df),
        lm_score.score_documents(df, cond, fit_share=1.0),
    ):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, big, big + 1]
    packed = [k for r in packing.pack_documents(df, 64).collect() for k in r.doc_ids]
    assert sorted(k or 0 for k in packed) == [0, big, big + 1]
    removed = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).collect()}
    assert removed[big] == 0 and removed[None] == len(text)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 91), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component_id for r in connected_components(edges).collect()}
    assert set(got) == set(range(51)) | {90, 91, 100}
    assert all(got[i] == 0 for i in range(51)) and got[100] == got[91] == 90


# ---- op1

def test_quality(spark, nothing):
    good, bad = "the cat sat on a mat number %d and went home", "buy!! now!! ### %d %d"
    rows = [(i, good % i if i % 3 else bad % (i, i), int(i % 3 != 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") < 80)
    out = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert all((out[i] >= 0.5) == bool(y) for i, _, y in rows) and all(0 <= s <= 1 for s in out.values())
    assert out[500] == out[501]
    one = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert 0.9 < quality.score_documents(docs, one).first().score < 1
    none = quality.train(nothing.select("doc_id", "text"), labels, F.lit(True))
    assert quality.score_documents(docs, none).first().score == 0.5
    assert quality.score_documents(nothing, none).count() == 0


def test_dual_descent_reaches_the_margin():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    w, b = quality.descend(rows, np.array([1.0, 1, -1, -1]), np.ones(3), 10.0, 200, 1)
    assert all(s * (w[r].sum() / len(r) ** 0.5 + b) > 0.98 for r, s in zip(rows, (1, 1, -1, -1)))


def test_descent_holds_no_values_of_all_rows():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(4000, 1000, replace=False)).astype(np.int32) for _ in range(400)]
    tracemalloc.start()
    quality.descend(rows, np.where(np.arange(400) % 2, 1.0, -1.0), rng.standard_normal(4000), 1.0, 2, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # less than the lists themselves take
    assert peak < sum(r.nbytes for r in rows) / 2


# ---- op2

def test_encoder_equals_library(docs, nothing):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=default_model()), PieceEncoder(default_model())
    rng = np.random.default_rng(1)
    parts = ["the", " ", "  ", "\n", "é", "ing", "\x01", "▁", "<s>", "<0x0A>", "ﬁ", "😀", "aaa", "0", "\t", "="]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(500)]
    texts += [c * n for c in " a\n=▁é" for n in range(20)]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == sp.decode(ids), t
    got = encode_documents(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = sp.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert encode_documents(nothing).count() == 0


# ---- op3

def targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        unit = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(w[s] for s in open_))
        over = {s for s in open_ if unit * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else unit * w[s] for s in names}
        full |= over


def test_mix(docs, nothing):
    got = mixing.mix_documents(docs, block_words=8).collect()
    rows = docs.collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r.source] += size[r.doc_id]
    want = targets(by)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        source = rows[[x.doc_id for x in rows].index(r.doc_id)].source
        assert r["size"] == size[r.doc_id] and r.source_size == by[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 8 for s in want)
    again = mixing.mix_documents(docs.repartition(5), block_words=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix_documents(nothing).count() == 0


def test_mix_uses_its_cap(spark):
    docs = spark.createDataFrame([(i, "w " * 640, "a" if i == 0 else "b") for i in range(12)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_documents(docs, weights=(50, 1), cap=5).collect()}
    assert got[0].target == 3200 and got[0].taken == 3200


def test_mixed_texts_hold_the_taken_words(docs):
    taken = mixing.mix_documents(docs, block_words=8).groupBy("doc_id").agg(F.max("taken").alias("n"), F.count("*").alias("rows")).collect()
    mixed = defaultdict(list)
    out = mixing.mixed_texts(docs, block_words=8)
    assert out.columns == docs.columns
    for r in out.collect():
        mixed[r.doc_id].append(r.text)
        words = WORD.findall(TEXTS[r.doc_id] or "")
        # its words, in their order
        at = iter(words)
        assert words and all(any(w == x for x in at) for w in WORD.findall(r.text))
    for r in taken:
        if r.rows == 1:
            assert sum(len(WORD.findall(t)) for t in mixed[r.doc_id]) == r.n


def test_permutation():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 12345)) == list(range(n))


# ---- op4

def test_simhash(docs, nothing):
    import xxhash

    def plain(text, k=4):
        w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        if not w:
            return 0
        k = min(k, len(w))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [plain(t) for t in TEXTS]
    label = list(range(len(TEXTS)))
    for _ in TEXTS:
        label = [min(label[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(fp))]
    got = simhash.simhash_components(docs, 4).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == label[r.doc_id] for r in got)
    assert simhash.simhash_components(nothing).count() == 0


def test_simhash_links_all_close_fingerprints():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.concatenate([b ^ np.array([0] + [sum(1 << int(x) for x in rng.choice(64, n, replace=False)) for n in (1, 3, 4, 6)], np.uint64) for b in base])
    for bits in (4, 10):
        masks = simhash.block_masks(len(fp), bits)
        close = [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= bits]
        assert all(any(int(fp[i]) & m == int(fp[j]) & m for m in masks) for i, j in close)
        label = simhash.link_cells(np.zeros(len(fp), int), fp, bits)
        want = list(range(len(fp)))
        for _ in range(8):
            for i, j in close:
                want[i] = want[j] = min(want[i], want[j])
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(fp)) for j in range(i))


# ---- op5, op9

def vectors(spark, rng, n=150, dim=8):
    x = rng.standard_normal((n, dim))
    for i in range(20, 40):
        x[i] = x[20] + 0.05 * rng.standard_normal(dim)
    x[50] = x[51]
    x[60] = 2 * x[61]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[70], rows[71], rows[72], rows[73] = (70, None), (71, [0.0] * dim), (72, [float("nan")] + [1.0] * (dim - 1)), (73, [None] + [1.0] * (dim - 1))
    rows += [(200, []), (201, [1.0, 2.0]), rows[5]]
    return rows, spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int").repartition(3)


def usable(v, dim=8):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(spark):
    rows, df = vectors(spark, np.random.default_rng(2))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if usable(v)]
    want = set()
    for q, x in {i: x for i, x in good if i % 10 == 0}.items():
        best = sorted((-int(x @ y), j) for j, y in good if j != q)[:5]
        want |= {(q, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    for pivots in (1, 8):
        got = topk.top_k(df, F.col("id") % 10 == 0, pivots=pivots)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), F.col("id") % 10 == 0).count() == 0
    two = topk.top_k(df.where("vec_id in (0, 1)"), F.col("id") % 10 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 1)]


def test_near_vectors(spark):
    rows, df = vectors(spark, np.random.default_rng(2))
    ok = [usable(v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    link = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    label = [r[0] for r in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in link[i])]) for i in range(len(rows))]
    want = sorted((rows[i][0], len(link[i]), label[i], label[i] == rows[i][0]) for i in range(len(rows)))
    assert sorted(map(tuple, nn_descent.near_groups(df).collect())) == want
    assert nn_descent.near_groups(df.limit(0)).count() == 0
    assert nn_descent.near_groups(df.where("vec_id in (70, 71)")).count() == 2


def test_top_k_of_repeated_queries(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 7
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = np.floor(256 * x).astype(int)
    want = sorted((-int(q[0] @ q[j]), j) for j in range(1, 600))[:5]
    for pivots in (1, 3, 64):
        got = topk.top_k(df, F.col("id") == 0, pivots=pivots).collect()
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n, j, -s) for n, (s, j) in enumerate(want, 1)]


# ---- op6

def brute_repeats(rows, window):
    """Removed bytes by (id, text) of rows in their order."""
    seen, out = set(), {}
    for key in rows:
        raw = (key[1] or "").encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            if raw[k : k + window] in seen:
                hit[k : k + window] = True
            seen.add(raw[k : k + window])
        out[key] = int(hit.sum())
    return out


def test_repeats_of_null_and_reused_ids(spark):
    rng = np.random.default_rng(9)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (2, c), (2, d), (3, c), (3, "x" + d), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    ordered = [(r.doc_id, r.text) for r in df.dropDuplicates().orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()]
    want = brute_repeats(ordered, 100)
    got = repeats.remove_repeats(df.drop("h"), keep_text=True).collect()
    assert len(got) == len(rows)
    sizes = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    assert sizes == sorted((i or 0, len(t), want[i, t]) for i, t in rows)


def test_repeats_in_long_texts(spark):
    rng = np.random.default_rng(10)
    part = rng.integers(97, 123, 700).astype(np.uint8).tobytes().decode()
    filler = rng.integers(97, 123, 2_300_000).astype(np.uint8).tobytes().decode()
    # repeats on both sides of the place where a long text is cut
    long = filler[: repeats.BATCH - 300] + part + filler[repeats.BATCH - 300 :]
    line = "the same line of words that stands in very many documents of this corpus, " * 2
    many = [(i, f"{rng.integers(10**9)} {line}{rng.integers(10**9)}") for i in range(2, 300)]
    rows = [(0, long), (1, "z" + part), *many, (400, filler[-5000:])]
    want = brute_repeats(rows, 100)
    for crowd in (64, 8):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd=crowd).collect()
        assert {r.doc_id: r.n_removed for r in got} == {i: n for (i, _), n in want.items()}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(500):
        t = rng.integers(1, rng.integers(2, 5), rng.integers(0, 40)).tolist() + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize(("many", "crowd"), [(2000, 64), (1, 64), (2000, 1)])
def test_repeats(docs, nothing, many, crowd):
    window, seen, want = 40, set(), {}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            if raw[k : k + window] in seen:
                hit[k : k + window] = True
            seen.add(raw[k : k + window])
        kept = bytes(np.frombuffer(raw, np.uint8)[~hit])
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        want[i] = (i, len(raw), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest())
    got = repeats.remove_repeats(docs, window, many=many, crowd=crowd).collect()
    assert len(got) == len(TEXTS) + 1 and all(tuple(r) == want[r.doc_id] for r in got)
    assert repeats.remove_repeats(nothing).count() == 0


# ---- op7

def test_packing(docs, nothing):
    encode, length = packing.tokenizer(), 64
    parts = defaultdict(dict)
    for r in packing.pack_documents(docs, length).collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, o, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[k][o] = ids[a:b].tolist()
    for i, t in enumerate(TEXTS):
        assert sum((parts[i][o] for o in sorted(parts[i])), []) == [*encode(t or ""), 50256]
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 33, rng.integers(1, 200))
        rows = packing.best_fit_decreasing(sizes, 32)
        assert sorted(sum(rows, [])) == list(range(len(sizes)))
        room = []
        for n in sorted(sizes, reverse=True):
            fit = [i for i, x in enumerate(room) if x >= n]
            if fit:
                room[min(fit, key=lambda i: room[i])] -= n
            else:
                room.append(32 - n)
        assert sorted(32 - sizes[r].sum() for r in rows) == sorted(room)


# ---- op8

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def test_personal_data(spark, nothing):
    texts = [
        None, "", "a@b.c@d.e", "a@b.com_x@y.z q@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3", "é 4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 12345678901234567890",
        "+1 (555) 123-4567 +12 +1((((5 +1 555 1234567890123456", "😀é x@y.zz 10.0.0.1 +49 30 1234567", "1" * 5000, "a.b@" * 300, "x@" + "a." * 3000 + "b", "a@b.c.@d.e.f", "plain words only",
        "jane (at) mail (dot) org", "he sat at home. Then he left.",
    ]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)] + [(7, texts[7], "s", 1)], "doc_id long, text string, spans string, id long")
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if passes(k, m[0])] for k, p in PLAIN.items()}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in spans.values()]
        flat = sum(spans.values(), [])
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r.spans.split(","))
        if r.doc_id in (12, 14):
            assert r.spans == ""
    masked = {r.doc_id: r.text for r in pii.mask_personal_data(df).collect()}
    assert masked[7] == "😀é <email> <ip> <phone>" and masked[12] == texts[12] and masked[0] is None
    assert pii.find_personal_data(nothing).count() == 0


def test_span_model_takes_one_aggregation(spark):
    texts = [f"mail me at user{i}@site.com or +1 555 123 4{i:03d}, host 10.0.0.{i}; 555-123-{i:04d} jane (at) mail (dot) org" for i in range(40)]
    found = pii.candidates(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    found.count()
    sc = spark.sparkContext
    sc.setJobGroup("span-model", "")
    model = pii.fit(found)
    sc.setLocalProperty("spark.jobGroup.id", None)
    # the driver plans few jobs, however many rounds there are: each one leaves plans and classes in its memory
    assert 1 <= len(sc.statusTracker().getJobIdsForGroup("span-model")) <= 4
    # the same by spans instead of counts
    spans = [(k, s.votes, s.votes + s.features) for r in found.collect() for k in pii.KINDS for s in r[f"pii_{k}"]]
    p = [0.9 if sum(v) >= 2 else 0.6 if sum(v) > 0 else 0.1 for _, v, _ in spans]
    for turn in range(10):
        weight, prior = {}, {}
        for k in {s[0] for s in spans}:
            mine = [(x, w) for (kind, _, x), w in zip(spans, p) if kind == k]
            a, b = sum(w for _, w in mine), sum(1 - w for _, w in mine)
            prior[k] = np.log((a + 1) / (b + 1))
            for j in range(len(mine[0][0]) if turn == 9 else 4):
                values = {x[j] for x, _ in mine}
                for v in values:
                    yes, no = sum(w for x, w in mine if x[j] == v), sum(1 - w for x, w in mine if x[j] == v)
                    weight[k, j, v] = np.log((yes + 1) / (a + len(values) + 1)) - np.log((no + 1) / (b + len(values) + 1))
        p = [1 / (1 + np.exp(-prior[k] - sum(weight[k, j, x] for j, x in enumerate(v)))) for k, v, _ in spans]
    assert model.weight.keys() == weight.keys() and model.prior.keys() == prior.keys()
    assert np.allclose([model.weight[k] for k in weight], list(weight.values())) and np.allclose([model.prior[k] for k in prior], list(prior.values()))
    found.unpersist()


# ---- op10

def test_language_model(docs, nothing, spark):
    usable_ids = {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 10}
    counts = Counter()
    for r in docs.collect():
        if r.doc_id in usable_ids:
            counts.update([*(r.text or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    cond = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = lm_score.score_documents(docs, cond, fit_share=1.0, head=30, vocabulary=20).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        w = [*(TEXTS[r.doc_id] or "").encode().lower().split(), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6
        assert np.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.score_documents(nothing, cond).count() == 0
    assert lm_score.score_documents(docs, F.lit(False)).count() == len(TEXTS) + 1


def test_gated_model_is_a_distribution_and_its_gradient_holds():
    rng = np.random.default_rng(0)
    m = lm_score.GatedModel(np.arange(10, 0, -1).astype(float), hidden=4, class_words=4)
    m.p = {k: v.astype(float) + rng.normal(size=v.shape) * 0.3 * (v > -1e8) for k, v in m.p.items()}
    h = rng.normal(size=(1, 4))
    assert abs(sum(np.exp(m.log_probs(h, np.array([i]))[0][0]) for i in range(10)) - 1) < 1e-9
    y = np.array([3, 7, 3])
    hs = rng.normal(size=(3, 4))
    grads = {k: np.zeros_like(v) for k, v in m.p.items()}
    _, dh = m.log_probs(hs, y, grads)
    for name, at in (("c", (1, 2)), ("w", (1, 2, 3)), ("cb", (0,)), ("wb", (0, 3))):
        old = m.p[name][at]
        f = []
        for e in (1e-5, -1e-5):
            m.p[name][at] = old + e
            f.append(m.log_probs(hs, y)[0].sum())
        m.p[name][at] = old
        assert abs((f[0] - f[1]) / 2e-5 - grads[name][at]) < 1e-5
    up = hs.copy()
    up[1, 2] += 1e-6
    assert abs((m.log_probs(up, y)[0].sum() - m.log_probs(hs, y)[0].sum()) / 1e-6 - dh[1, 2]) < 1e-4


def test_gradient_through_time_holds():
    rng = np.random.default_rng(1)
    m = lm_score.GatedModel(np.arange(10, 0, -1).astype(float), hidden=4, class_words=4)
    m.p = {k: v.astype(float) + rng.normal(size=v.shape) * 0.4 * (v > -1e8) for k, v in m.p.items()}
    x, y = rng.integers(0, 11, (6, 3)), rng.integers(0, 10, (6, 3))
    first, h = rng.random((6, 3)) < 0.2, rng.normal(size=(3, 4))
    grads, _, _ = m.gradients(x, y, first, h)
    for name, value in m.p.items():
        for flat in rng.choice(value.size, min(value.size, 25), replace=False):
            at = np.unravel_index(flat, value.shape)
            old, f = value[at], []
            for e in (1e-5, -1e-5):
                value[at] = old + e
                f.append(m.gradients(x, y, first, h)[2])
            value[at] = old
            assert abs((f[0] - f[1]) / 2e-5 - grads[name][at]) < 1e-5, (name, at)


def test_training_in_many_copies_agrees_and_learns(spark, monkeypatch):
    rng = np.random.default_rng(6)
    order = {f"w{i}": f"w{(i * 7 + 3) % 50}" for i in range(50)}
    rows = []
    for i in range(600):
        w = [f"w{rng.integers(50)}"]
        for _ in range(60):
            w.append(order[w[-1]] if rng.random() < 0.8 else f"w{rng.integers(50)}")
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(lm_score.fit_model, "__defaults__", (1.0, 4, 8000))
    runs = [{r.doc_id: r for r in lm_score.score_documents(df, F.col("doc_id") % 10 != 0, fit_share=1.0).collect()} for _ in range(2)]
    assert all(abs(runs[0][i].score - runs[1][i].score) < 1e-6 for i in runs[0])
    held = [r for r in runs[0].values() if r.doc_id % 10 == 0]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_lockstep_scores_equal_single_ones():
    rng = np.random.default_rng(0)
    m = lm_score.GatedModel(np.arange(50, 0, -1).astype(float), hidden=6, class_words=8)
    m.p["w"] = rng.normal(size=m.p["w"].shape).astype(np.float32)
    docs = [rng.integers(0, 50, n) for n in (1, 5, 70, 33, 32, 64, 0, 9)]
    together = m.score(docs)
    assert np.allclose(together, [m.score([d])[0] for d in docs], atol=1e-3)


def test_recurrent_weights_learn_from_every_document(spark):
    words = [b"w%d" % i for i in range(40)]
    train = spark.createDataFrame([(i, " ".join(["w%d" % i] * 50)) for i in range(40)], "id long, t string")
    number = {b"": 0} | {w: i + 1 for i, w in enumerate(words)}
    model = lm_score.GatedModel(np.full(42, 50.0))
    before = model.p["x"].copy()
    lm_score.fit_model(model, train, 40 * 51, number, 41)
    # only words that were read change their inputs
    assert (model.p["x"] != before).any(1)[1:41].all()


def test_training_takes_numbers_of_words(spark):
    words = [b"w%d" % i for i in range(40)]
    number = {b"": 0} | {w: i + 1 for i, w in enumerate(words)}
    rng = np.random.default_rng(2)
    texts = [" ".join("w%d" % k for k in rng.integers(0, 45, 60)) for _ in range(40)]
    train = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    packed = {t: np.array([number.get(w, 41) for w in [*t.encode().split(), b""]], "<u2").tobytes() for t in texts}
    hashes = train.select("t", F.xxhash64("id", "t").alias("h")).collect()
    numbered = spark.createDataFrame([(r.h, packed[r.t]) for r in hashes], "h long, numbers binary")
    # texts need not be read again in every round
    models = [lm_score.GatedModel(np.full(42, 50.0)) for _ in range(2)]
    for model, rows in zip(models, (train, numbered)):
        lm_score.fit_model(model, rows, 40 * 61, number, 41)
    assert all(np.array_equal(models[0].p[k], models[1].p[k]) for k in models[0].p)


def test_scores_of_any_size_are_a_distribution():
    rng = np.random.default_rng(4)
    for spread in (0.1, 3.0, 300.0):
        m = lm_score.GatedModel(np.arange(10, 0, -1).astype(float), hidden=4, class_words=4)
        m.p = {k: v if k == "wb" else (spread * rng.standard_normal(v.shape)).astype(np.float32) for k, v in m.p.items()}
        h = rng.uniform(-1, 1, (300, 4)).astype(np.float32)
        logs = np.array([m.log_probs(h, np.full(300, y))[0] for y in range(10)])
        assert np.isfinite(logs).all() and np.allclose(np.exp(logs).sum(0), 1, atol=1e-4)


def test_one_step_of_adam():
    rng = np.random.default_rng(5)
    m = lm_score.GatedModel(np.ones(5), hidden=2, class_words=2)
    p, mean, square = np.zeros(40_000), np.zeros(40_000), np.zeros(40_000)
    q, qm, qs = p.copy(), p.copy(), p.copy()
    for number in (1, 2, 3):
        g = rng.standard_normal(40_000)
        g[::7] = 0
        slope = g.copy()
        m._learn(p, slope, mean, square, 1 / 50, number, 0.02)
        assert not slope.any()
        g /= 50
        g *= min(1, 1 / np.sqrt(g @ g))
        qm, qs = qm + 0.1 * (g - qm), qs + 0.01 * (g * g - qs)
        q = q + 0.02 * (qm / (1 - 0.9**number)) / (np.sqrt(qs / (1 - 0.99**number)) + 1e-6)
        assert np.allclose(p, q, rtol=1e-9, atol=1e-12)
