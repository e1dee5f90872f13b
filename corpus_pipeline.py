"""The training-data pipeline: five stages, each written as Parquet and reread by the next.

Quality rules drop what they reject, exact dedup and the n-gram join keep one document of each
group, mixing repeats or drops documents by source, packing lays out the rest in sequences.
All stages but the last return the columns of documents and leave out others.

Null and empty texts are documents without words: the first stage rejects them, as it does all
with fewer than 50 words. Null identifiers, sources and languages stay as they are. Of rows that
repeat in full one stays; of rows of one identifier with different texts each counts. An empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opalgrid.llm.common import stash
from opalgrid.llm.exact_dedup import kept_rows
from opalgrid.llm.mixing import mix
from opalgrid.llm.ngram_join import one_of_each
from opalgrid.llm.packing import pack
from opalgrid.llm.quality_rules import quality_rules
from opalgrid.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rejected = quality_rules(docs, table(spark, sf_dir, "labels")).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(rejected, same, "left_anti").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs.select(COLUMNS), keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.select(COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as they are taken. Identifiers are unique after the stages before."""
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text", "source", "lang") == F.col("__key"))
    return docs.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mixing), ("packing", packing)]

#: Learned rules, random rounding and tokenizer ids are beyond SQL; tests/llm holds each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
