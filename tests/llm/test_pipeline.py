import corpus_pipeline
from leaguelens.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == columns
    raw, good, distinct, masked, mixed, done = (df.toPandas() for df in kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    clean = [k for k in raw.doc_id if labels.get(k) == 1]
    assert set(clean) <= set(good.doc_id) and len(good) < len(raw)
    assert distinct.doc_id.is_unique and not distinct.text.duplicated().any()
    assert set(masked.doc_id) == set(distinct.doc_id)
    assert not masked.text.str.contains(r"@mail\d+\.example\.com").any()
    assert mixed.groupby("doc_id").size().max() <= 3 and len(done) == len(mixed)


def test_stages_on_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
