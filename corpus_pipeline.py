"""Corpus pipeline: classify quality, keep one of each near-duplicate group, mask secrets, mix sources, pack sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; each result is written as Parquet and read again before the next stage, and its predecessor deleted.

Defined results: a null text is an empty one throughout. Rows alike in all columns are one row after near_duplicates; a
document without words is linked with nothing there and takes no part in the mix. Ties between copies go by id, nulls
last, then by a hash of the text. Other columns than those of documents are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import curriculum, mil_quality, packing, secrets, token_join
from quern.llm.words import n_words, words
from quern.session import discard, share_package, shared_dir, small_batches, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words whose ids a worker remembers: workers live through all stages, so less than the operator's default.
REMEMBERED = 150_000
#: Documents that score less are rejected.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of these documents, accepts. Repeated rows are judged
    alike; without any label that counts, all scores are a half and all documents stay."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = mil_quality.train(docs, labels)
    scored = mil_quality.score(docs.select(*COLUMNS), net, keep=COLUMNS)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id, and of rows alike, one."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = token_join.jaccard_components(docs, keep=True)
    firsts = staged(found.filter("first").select(F.col("doc_id").alias("_id"), F.col("_row").alias("_first")).distinct())
    rows = docs.withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    kept = rows.join(firsts, (F.col("_row") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_row"]).select(*COLUMNS)  # identity: the id, and a hash of id and text


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text replaced by a mark."""
    small_batches(spark)
    scanned = secrets.scan(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"))
    masked = F.col("_masked").alias("text"), F.length("_masked").cast("long").alias("n_chars")
    return scanned.select("doc_id", masked[0], "lang", "source", masked[1])


def row_key(*columns: str) -> Column:
    """An MD5 of the values, nulls and lengths of columns: rows are told apart by 128 bits."""
    values = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("\n", *(F.coalesce(F.length(v).cast("string"), F.lit("-")) for v in values), *values))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: each document as often as the mix takes it, sorted by range of position; the last document
    that a source's target reaches is cut to the words taken."""
    small_batches(spark)
    docs = docs.select(*COLUMNS).withColumn("_key", row_key(*COLUMNS[:4]))
    mixed = curriculum.curriculum_mix(docs.select(F.col("_key").alias("doc_id"), "source", n_words(F.col("text")).alias("size")))
    times = staged(mixed.select(F.col("doc_id").alias("_key"), F.explode("occurrences").alias("o")))
    rows = docs.dropDuplicates(["_key"]).withColumn("_size", n_words(F.col("text"))).join(times, "_key")  # each of rows alike has its own times
    text = F.when(F.col("o.take") < F.col("_size"), F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("o.take").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.select("doc_id", text.alias("text"), "lang", "source", F.col("o.position").alias("_position"))
    rows = rows.orderBy("_position", "doc_id")
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def in_written_order(docs: DataFrame) -> DataFrame:
    """docs with `_position`: where each row stands in the table that it was read from, by file and row. The mix writes its
    rows sorted by training position, so this is their order; rows that no longer know where they were read have one place."""
    if docs.inputFiles():
        number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        file = F.when(number != "", number.cast("long")).otherwise(F.lit(0).cast("long"))
        try:
            return docs.select("*", (F.shiftleft(file, 32) + F.col("_metadata.row_index")).alias("_position"))
        except AnalysisException:  # made of tables read, as by an aggregate
            pass
    return docs.withColumn("_position", F.lit(0).cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document; an empty text is one end token. Sequences
    come in the order of the mix: by the mean position of their pieces."""
    small_batches(spark)
    pieces = packing.token_pieces(in_written_order(docs), public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED, forget=True, position="_position")
    return packing.pack(pieces)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
#: No SQL expresses the trained classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    share_package(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = os.path.join(shared_dir(spark), f"quern-pipeline-{uuid.uuid4().hex}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(*before)
        docs = spark.read.parquet(path)
        before = [docs]
    return docs
