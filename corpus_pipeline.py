"""The corpus pipeline: stages that each apply one training-data operator.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.llm import quality
from leaguelens.llm.common import materialize, remainder, table
from leaguelens.llm.mixing import mixed_texts
from leaguelens.llm.pii import mask_personal_data
from leaguelens.llm.shingles import similar_components
from leaguelens.llm.sp_encode import encode_documents


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are.

    Null and empty texts get the score of the model's bias; null ids and repeated rows
    are judged by their text like any other; own columns of any name stay.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return quality.score_documents(packed, model).where(F.col("score") >= 0.3).select("doc.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, Jaccard similarity 0.8 or more.

    The row of smallest id stays (of an id with several texts, that of the smallest text
    hash; of equal ids and texts, that of the smallest hash of all columns).  A row with a
    null id takes part in no link and stays; null and empty texts are one group.
    """
    nameless = docs.where("doc_id is null")
    groups = materialize(similar_components(docs, 5, 0.8), "pipeline-groups")
    leads = groups.where("leads").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    leads = materialize(leads, "pipeline-leads")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    single = packed.join(leads.where("n = 1"), ["doc_id", "text_hash"], "left_semi")
    repeated = packed.join(leads.where("n > 1"), ["doc_id", "text_hash"], "left_semi")
    one = repeated.groupBy("doc_id", "text_hash").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    return single.select("doc.*").unionByName(one.select("doc.*")).unionByName(nameless)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, if they have it, following the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null, null ids and repeated rows stay as often as they occur.
    """
    return _counted(mask_personal_data(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn blocks of the mix, by document, as often as they are drawn; n_chars follows the text.

    Texts without a word are in no block and go; rows with a null id are mixed like any other.
    """
    return _counted(mixed_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every row of the mix: one row for each, null ids included."""
    return encode_documents(docs, full=False)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_distinct),
    ("PII", mask_private),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: The stages learn models and draw samples, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
