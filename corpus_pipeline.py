"""From raw documents to packed sequences: language, near copies, repeats, leaks, packing.

Every stage takes all rows its predecessor kept and leaves out, or cuts, what its operator
finds; all but the last return the columns of documents. Null ids pass the filters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, language, minhash, packing, repeats
from tilewright.llm.common import scratch_path, texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids``; rows with a null id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept."""
    return _without(docs, language.identify(docs).where("rejected"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return _without(docs, minhash.near_duplicates(docs).where("not kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that earlier documents repeat; texts of which nothing is left go."""
    return repeats.without_repeats(docs.select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of at most 1024 tokens."""
    return packing.pack(texts(docs), public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("language_id", keep_identified),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no tokenizer and no trained model. Near-dedup, repeats and leaks are each tested against brute force as stages;
#: the language and packing stages and the run as a whole are not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
