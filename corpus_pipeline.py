"""The corpus pipeline: documents to packed training sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again for the next one:

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: of each component of near copies the document of the smallest id stays.
3. secrets: secret values are replaced by a mark.
4. mixing: documents are repeated or left out so that each source meets its target.
5. packing: token ids in windows of 1024.

Rows count each for itself, by a number that a stage writes beside them: ids may be null or repeat. A null text is an
empty one and stays null. Documents of equal score, copies and ties are decided by id, then by the text's hash. Every
stage takes empty tables, texts of any length, and further columns, which stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, quality, secrets
from tessera.llm.common import stage, unstage


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents, written with a number for each row (__row), so that whatever reads them again sees the same numbers."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, co-trained on all of them and the labels of sf_dir, doesn't reject.

    Equal documents share a score and stay or go together; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = stage(quality.described(docs), "views")
    return quality.kept(rows, quality.train(rows, labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of the smallest id (a null one last; then by the text's hash).

    Documents without words are no copies of one another: all stay.
    """
    rows = _numbered(docs, "near-rows")
    classes = ngram_join.near_duplicates(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    ranked = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("h"), "__row").alias("rank"))
    first = classes.join(ranked, "__row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.__row")
    return rows.join(first, "__row", "left_semi").select(docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced by a mark and n_chars counted anew; each row for itself."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); the one taken in part is rounded.

    Rows of one id, or of none, are taken each for itself. Documents without words aren't taken.
    """
    rows = _numbered(docs, "mixing-rows")
    key = F.xxhash64("doc_id", "text", "source", "lang")
    mixed = mixing.mix(rows, id_col="__row", key=key).select(F.col("doc_id").alias("__row"), (F.col("whole") + F.round("x")).cast("int").alias("__copies"))
    taken = rows.join(mixed.where("__copies > 0"), "__row")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), "__copies"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in windows of 1024 ids; repeated rows are packed each for itself."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: A trained classifier and library tokens aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            unstage(before)
        before = docs
    return docs
