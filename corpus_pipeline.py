"""Corpus pipeline: five stages from raw documents to shards, each an operator of codeloom.llm.

Every stage gets the session, the documents that the stage before kept and the tables' folder. All but
the last return the columns of ``documents``; other columns are dropped, whatever their names, and meet no column of a stage's own, as
operators pack rows while they join them. Stages run over whole tables and whole texts, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import materialize
from codeloom.llm.decontaminate import clean_documents
from codeloom.llm.langid import keep_identified
from codeloom.llm.mixing import label_domains, take_mixed
from codeloom.llm.near_groups import keep_one_of_group
from codeloom.llm.queries import MIX_TARGETS
from codeloom.llm.sharding import kd_shards

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts, and texts without a letter.

    Null ids, languages and sources are values like others. Rows that repeat go or stay together. Ambiguous texts stay. Where no row has a
    language to learn from, nothing can be told and every document goes.
    """
    return keep_identified(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that links of a five-word shingle similarity of 0.8 and more make: that of smallest doc_id.

    Texts without a word are copies of each other. A null doc_id comes last; of null ids the least hash of the row stays. Rows that repeat
    doc_id and text are one.
    """
    return keep_one_of_group(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item with a shingle similarity of 0.8 and more go.

    Null and wordless texts and items match nothing. A null doc_id is judged by its own text; rows that repeat go or stay together. Without
    items every document stays.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out so that domains have their target weights.

    Null and empty texts have no tokens and stay as often as their rate says, by a hash. Rows that repeat are each taken as often. Without
    labels every document stays once.
    """
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return take_mixed(docs, labels, MIX_TARGETS).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; groups of equal texts, null and empty ones among them, stay together.

    Rows that repeat have slots of their own; null ids are numbered like others. Of fewer groups than shards some shards stay empty.
    """
    return kd_shards(docs, SHARDS)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Language codes, SimHash components, fitted rates and k-d cuts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage_{k}")
    return docs
