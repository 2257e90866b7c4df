"""Documents to training sequences: quality, rules, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs.
So a stage begins by deleting the tables that the stages before it have written on their way.

Every stage takes null and empty texts (the first gives them scores like any other text, the second rejects them for having too few
words, the others leave them alone), repeated rows, null and shared ids, empty tables, and columns beside COLUMNS, which it ignores.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm.jaccard_join import jaccard_components
from nodeloom.llm.packing import pack
from nodeloom.llm.quality_classifier import keep_good
from nodeloom.llm.quality_rules import judge
from nodeloom.llm.scratch import owned, release, save
from nodeloom.llm.suffix_dedup import remove_repeats

def _stage(f):
    """A stage that first deletes what the stages before it have written on their way."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"pipeline-{threading.get_ident()}"
        release(spark, docs, owner)
        with owned(owner):
            return f(spark, docs, sf_dir)

    return run


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Keys of rows without an id of their own begin here.
BEYOND = 1 << 62


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fixed limits and the bands of tokeniser fertility; null texts have no words and go."""
    return judge(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model")).where("kept").select(COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row: its id, or a number beyond all ids where other rows share the id or it is null."""
    repeated = docs.groupBy("doc_id").count().where(f"doc_id is null or doc_id >= {BEYOND} or count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.withColumn("key", F.col("doc_id"))
    again = docs["doc_id"].eqNullSafe(repeated["doc_id"])
    # Written once, so that the numbers stay the same however often they are read.
    odd = save(docs.join(repeated, again, "left_semi").withColumn("key", BEYOND + F.monotonically_increasing_id()), "shared-ids")
    return docs.join(repeated, again, "left_anti").withColumn("key", F.col("doc_id")).unionByName(odd)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest id; rows without an id or with a shared one come last.

    Each row is a document of its own, also where ids are null or shared: of such rows one of each group stays, and those that
    link with nothing stay. Null and empty texts link with nothing.
    """
    keyed = _keyed(docs.select(COLUMNS))
    found = jaccard_components(keyed, id_col="key")
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("key"))
    return keyed.join(others, "key", "left_anti").select(COLUMNS)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages; n_chars follows the text, which may be left empty. A null text becomes an empty one."""
    cut = remove_repeats(docs.select(COLUMNS)).withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("quality rules", rules), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", passages), ("best-fit packing", sequences)]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
