"""A corpus pipeline: documents in, packed training sequences out.

Stages, in order: the quality classifier drops what it rejects; of every group
of near duplicates one document stays; secrets are cut out of the texts;
sources are mixed to target weights; what is left is packed.  Each stage is
written as Parquet and reread as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import common, mixing, near_dup, packing, quality_mil, secrets
from sheafwork.llm.queries import MIX_WEIGHTS, domain, held_out

#: Share of the tokens that the mixing stage takes; once each at most.
MIX_SHARE = 0.8
SEQUENCE = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.  It learns from the table of
    labels; with no label of either kind nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    model = quality_mil.fit_labelled(docs.where(~held_out()), labels, label_col="_quality")
    scored = quality_mil.score(docs, model, F.struct(*docs.columns).alias("row"))
    return scored.where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id; of rows
    that share an id the one with the least hash.  Rows without an id stay."""
    stays = near_dup.near_duplicates(docs, n=5, threshold=0.8).where("doc_id = class_id").select("doc_id")
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        first = known.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("row"))
        known = first.select("row.*")
    return known.join(stays, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a marker; ``n_chars``
    is counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that domains, languages and sources meet their
    target weights; each at most once."""
    mixed = mixing.mix(docs, {"domain": domain(), "language": F.col("lang"), "source": F.col("source")}, budget_share=MIX_SHARE, weights=MIX_WEIGHTS, max_epochs=1)
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_to_weights),
    ("packing", pack),
]
#: SQL cannot express these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
