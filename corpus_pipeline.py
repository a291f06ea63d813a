"""From raw documents to encoded training texts, in five stages.

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps. All but the last return the columns of documents;
``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.llm import bpe, cotrain, jaccard, mixing, suffixes
from skytrace.llm.common import materialize
from skytrace.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotrain.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; documents without words are linked with nothing and stay."""
    found = jaccard.near_copies(docs)
    lead = found.filter("component_id = doc_id or component_id is null").select("doc_id").distinct()
    return docs.join(lead, docs["doc_id"].eqNullSafe(lead["doc_id"]), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that occur earlier; texts that nothing is left of go."""
    kept = suffixes.remove_repeats(docs, keep=("lang", "source", "n_chars"))
    text = F.col("kept_text")
    return kept.filter((F.col("n_removed") == 0) | (F.trim(text) != "")).select(
        "doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length(text).cast("long")).alias("n_chars")
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.filter("copies > 0").select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again for a check: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe.bpe_round_trip(docs, f"{TOKENIZERS}/word_bpe_49k.json", digest=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("source mixing", mix), ("BPE encoding", encode)]

#: The classifier and the merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
