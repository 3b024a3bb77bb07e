"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
judges only what its predecessor kept. Null texts pass the filters; rows with a null id can't be told apart as documents,
so they are never dropped as duplicates. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm import bpe, lines, mixing, nearcopies, toxicity
from spelunka.llm.common import ensure_checkpoint_dir
from spelunka.llm.warc import remove_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled ones among docs."""
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.with_scores(docs, model).where("__predicted = 0").select(*COLUMNS)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the last that holds them; n_chars follows the text."""
    found = lines.dedup_lines(docs, carry=["lang", "source", "n_chars"])
    chars = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", chars.alias("n_chars"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) one row stays: that of the smallest id, of several by hash.

    op10's Gray-order index and MinHash bands propose, whole shingle sets decide (nearcopies.py says why both)."""
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("__h"))
    keyed = nearcopies.with_key(rows.select("doc_id", "text", "__h")).select("doc_id", "__h", F.col("__key").alias("key"))
    found = keyed.join(nearcopies.classes(docs), "key", "left").where("doc_id is not null").select(F.coalesce("root", "key").alias("root"), F.struct("doc_id", "__h").alias("row"))
    kept = found.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.__h")
    one = rows.join(kept, ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"])
    return one.unionByName(rows.where("doc_id is null")).select(*COLUMNS)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights follow the raked targets."""
    return mixing.mixed(docs.select(*COLUMNS)).where("__kept").select(*COLUMNS)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests and counts."""
    return bpe.digests(bpe.encode_texts(docs, *bpe.public_vocabulary()))


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_lines),
    ("simhash_near_dedup", stage_near_duplicates),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: SQL can express neither compression distances nor merge replay; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; a stage's folder goes once
    the next one is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
