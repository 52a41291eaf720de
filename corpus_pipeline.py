"""Documents to packed sequences: language, near-duplicates, secrets, mix, packing.

Every stage takes and gives whole tables and is written before the next one starts. Each row is the digest of one piece of a
document in its sequence.
"""
from pyspark.sql import functions as F

from curbloop.llm import language, mixing, neardup, packing, queries, secret_scan
from curbloop.operators.scratch import stage

MIN_SCORE = 0.5
REDACTED = "[SECRET]"


def known_language(spark, docs, sf_dir):
    """Documents whose language can be told."""
    model = language.fit(docs)
    told = language.identify(docs, model)
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def one_of_each(spark, docs, sf_dir):
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs).select(*docs.columns)


def without_secrets(spark, docs, sf_dir):
    """All documents, their secrets replaced."""
    out = secret_scan.find_secrets(docs, redact=REDACTED)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed(spark, docs, sf_dir):
    """Documents as often as the target weights take them."""
    return mixing.mix(docs, queries.weights(spark), queries.domain_of(), max_epochs=queries.EPOCHS, seed=queries.SEED).select(*docs.columns)


def packed(spark, docs, sf_dir):
    """Pieces of at most 1024 ids and their places in sequences."""
    pieces = stage(packing.cut(docs), "pieces")
    digests = pieces.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", known_language), ("near_dedup", one_of_each), ("secrets", without_secrets), ("mix", mixed), ("packing", packed)]
#: A model, an alignment and a packing plan have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
