"""Corpus pipeline: from raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on
all rows that the stage before kept.  All but the last return the columns of
documents.  ``run`` writes each stage's result as Parquet in the shared folder
and reads it back for the next.  Null ids, null or empty texts, repeated rows
and extra columns are handled as each operator's docstring says; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampart.llm import bpe, jaccard, langid, mixing, quality
from rampart.llm.common import bounded_broadcast, prepare, table
from rampart.session import write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# The mixture keeps at most this share of the tokens that reach it.
MIX_SHARE = 0.8


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject (predicted 1)."""
    scored = quality.score(plain(docs), table(spark, sf_dir, "labels"), keep=COLUMNS)
    return plain(scored.where("predicted = 1"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified without ambiguity."""
    prepare(spark)
    named = langid.identify(plain(docs), keep=COLUMNS)
    return plain(named.where(~F.col("ambiguous")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of
    0.8 over 5-word shingles): the one of smallest id.  Documents without an
    id, or without words, stay; of repeated rows one stays (ids are expected to
    be unique: rows that share one stand or fall together)."""
    prepare(spark)
    rows = plain(docs)
    groups = jaccard.join(rows, words=5, num=80, den=100)
    lose = write_table(groups.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    kept = rows.join(bounded_broadcast(lose), "doc_id", "left_anti")
    again = write_table(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    again = bounded_broadcast(again)
    one = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return plain(kept.join(again, "doc_id", "left_anti").unionByName(one))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with probabilities raked to tempered source, language
    and topic marginals."""
    prepare(spark)
    mixed = mixing.mix(plain(docs).withColumn("topic", mixing.form(F.col("text"))), topic=F.col("topic"),
                       share=MIX_SHARE, keep=COLUMNS)
    return plain(mixed.where("sampled"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) and decoded text of
    each document, with their count and digests."""
    prepare(spark)
    got = bpe.encode(plain(docs), keep=("doc_id", "lang", "source"))
    return got.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing sources to target weights", mixture_stage),
    ("BPE encoding and decoding", encoding_stage),
]

# The trained classifiers and the tokenizer are beyond SQL; tests/llm checks
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
