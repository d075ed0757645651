import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(150, 500))]
        texts.append(" ".join(words))
        for changes in rng.integers(1, 12, 3):
            near = list(words)
            for at in rng.integers(0, len(words), changes):
                near[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(near))
    texts += [None, "", "a b", "A  b", "a c"]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    like = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    label = np.arange(len(texts))
    for _ in texts:
        label = np.where(like >= 0.8, label[None, :], len(texts)).min(1)
    assert ((like > 0.7) & (like < 0.8)).sum() > 20 and ((like >= 0.8) & (like < 0.9)).sum() > 20
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, "").collect()}
    assert got == set(label.tolist())


def test_null_ids_stay(spark):
    rows = [(None, f"nameless text number {i} of some words", "en", "web", 1) for i in range(3)] + [(i, f"text {i} " * 30, "en", "web", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    distinct = corpus_pipeline.keep_distinct(spark, docs, "")
    assert sorted(r.text for r in distinct.where("doc_id is null").collect()) == [r[1] for r in rows[:3]]
    # the mix takes all of a lone source
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in mixed) >= 1
    assert sum(len(r.text.split()) for r in mixed) == sum(len(r[1].split()) for r in rows)


def test_reused_ids_and_repeated_rows(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(1, texts[0], "en", "web", 1), (1, texts[1], "en", "web", 2), (2, texts[1], "en", "web", 3), (3, texts[2], "en", "web", 4), (3, texts[2], "en", "web", 4)]
    got = corpus_pipeline.keep_distinct(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, texts[0]), (1, texts[1]), (3, texts[2])]


def test_columns_of_any_name_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = ["score", "copies", "copy", "pii_email", "pii_all", "id", "node", "text_hash", "doc", "masked", "mixed", "turn", "times", "start"]
    docs = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.where(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0 and out.count() > 0, name
