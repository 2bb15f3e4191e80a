"""The queries op1 to op10 over the corpus tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, piececount, quality, secrets, tokenfile, toxicity, transport, winnowing
from tessera.llm.common import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark, sf_dir):
    """Pieces of all documents packed into windows of 1024 ids."""
    pieces = packing.pack(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_token_files(spark, sf_dir):
    """All documents written to token files and read back through their Elias-Fano boundaries."""
    return tokenfile.round_trip(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_ngram_join(spark, sf_dir):
    """Near-duplicate components of all documents: five-word shingles, Jaccard 0.75 and more."""
    return ngram_join.near_duplicates(table(spark, sf_dir))


@query
def op4_link_counts(spark, sf_dir):
    """Each document's number of links in the join of op4_ngram_join."""
    return ngram_join.link_counts(table(spark, sf_dir))


@query
def op6_secret_scan(spark, sf_dir):
    """Secrets of all documents: pattern spans and novel strings."""
    found = secrets.scan(table(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op7_token_counts(spark, sf_dir):
    """Words and greedy word pieces of all documents."""
    return piececount.count_tokens(table(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_media_columns(spark, sf_dir):
    """All texts stored as transport streams, read back and described."""
    read = transport.round_trip(table(spark, sf_dir))
    payload, media = F.col("payload"), F.col("media")
    return read.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length(media).cast("long").alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), transport.features().alias("feature"))


@query
def op9_mixing(spark, sf_dir):
    """All documents mixed to their sources' targets."""
    mixed = mixing.mix(table(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken(mixed).alias("taken"))


@query
def op10_fingerprints(spark, sf_dir):
    """Winnowing fingerprints of all documents and of their edited texts."""
    return winnowing.fingerprints(table(spark, sf_dir))


@query
def op5_toxicity(spark, sf_dir):
    """Toxicity scores of all documents, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_quality(spark, sf_dir):
    """Quality of all documents by two co-trained views; keep: whether the pipeline keeps it."""
    docs = stage(quality.described(table(spark, sf_dir)).select("doc_id", "__key", "__views"), "views")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("keep", (F.col("quality") >= 0.5).cast("int"))
