"""A training-data pipeline over ``documents``: five stages, each a whole-corpus operator.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; every stage but
the last returns the columns of ``documents``. ``run`` writes each stage's result
as Parquet under the shared checkpoint folder and rereads it for the next, so a
stage that is run again after a loss starts from files. The intermediate tables of a
stage, and the stage before it, go once its result is written.

Null texts: not toxic unless the prior says so, one empty line, no words, no
tokens. ``n_chars`` follows the text when lines go.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitline.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from baitline.llm.common import Scratch, materialise, table
from baitline.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled rows, does not predict toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that other documents keep."""
    return (line_dedup.drop_lines(docs)
            .withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each SimHash component."""
    return simhash.keep_first(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contamination(docs, items).where(~F.col("contaminated")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded bytes of every document."""
    return (bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
            .select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: Trained models, SimHash and BPE are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    with Scratch() as scratch:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
            scratch.keep_last(spark)
    return docs
