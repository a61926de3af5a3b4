"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Quality rules drop what they reject, one document of each group of near-duplicates stays, personal data is replaced by
the names of its kinds, sources are mixed to their targets, and what is left is packed into windows. All stages but the
last return the columns of documents. A random mixture has no SQL: tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm import mixing, near_dup, packing, pii, quality, queries
from tapewright.llm.common import cut_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass all quality rules; null and empty texts don't."""
    return quality.keep(quality.apply_rules(docs.select(COLUMNS))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: of its least doc_id, the first by text if that is repeated.

    Rows without id are only rid of equal texts among themselves.
    """
    stay = near_dup.near_duplicates(docs).where("representative").select(F.col("doc_id").alias("stays")).distinct()
    kept = docs.select(COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    first = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.sha2(F.col("text").cast("binary"), 256))).orderBy("text")
    return kept.withColumn("place", F.row_number().over(first)).where("place = 1").select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the names of its kinds."""
    return _sized(pii.redact(docs.select(COLUMNS), pii.fit(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, each of a whole document."""
    return _sized(mixing.expand(mixing.mix(docs.select(COLUMNS), whole=True)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    packed = packing.pack(docs.select("doc_id", "text"), queries.tokenizer("word_bpe_49k.json"), window=4096, end_id=2, keep_ids=False, drop_text=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
