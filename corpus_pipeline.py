"""From raw documents to packed training windows: five stages, each written as Parquet and read again.

toxicity: documents that the lexicon rejects go.  line_dedup: later copies of passages go; a document all of
whose lines went goes with them.  near_dedup: one document of each group stays (five words, 0.8).  mixture:
sources are cut to target weights.  packing: windows of 1024 ids.

Every stage but the last gives the columns of its documents, whatever others there are beside doc_id, text, lang,
source and n_chars.  Null and empty texts pass the filters and are packed as an end alone; a null doc_id stays null
and is compared with nothing; rows that share doc_id and text are one document that is there twice; texts are read
whole; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lines import drop_repeated_lines
from tidemark.llm.minhash import Likeness, keep_one
from tidemark.llm.mixing import Mixture, mix
from tidemark.llm.packing import pack
from tidemark.llm.shared import free_name, shared_dir
from tidemark.llm.toxicity import drop_toxic, learn

NEAR = Likeness(percent=80)
#: Every source may give its whole text once; a source is cut only where its share is far above its weight.
TARGETS = Mixture(share=0.9, epochs=1, seed=20_240_607)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, learn(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = F.col(free_name(docs, "n_removed"))
    clean = drop_repeated_lines(docs)
    emptied = (removed > 0) & (F.btrim("text", F.lit(" \t\r\n")) == "")
    clean = clean.filter(~emptied | F.col("text").isNull())
    length = F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return clean.withColumn("n_chars", length).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, TARGETS).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packing)]
#: A learnt lexicon and MinHash aren't SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
