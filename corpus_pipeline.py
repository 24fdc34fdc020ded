"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and
hands on the columns of ``documents``; the last returns the packed pieces. The stages are
written to Parquet and read again between each other, so that a lost executor costs a task
of one stage.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from standtally.llm import minhash, mixing, packing, quality, surrogates  # noqa: E402
from standtally.llm.common import table  # noqa: E402
from standtally.sources.staging import stage  # noqa: E402

# The last two stages are seeded or iterative, and so is the first: SQL can't express them.
ORACLE_SQL = None


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with n_chars as long as the text is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return docs.select(*[f"`{c}`" for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, out="_quality")
    return scored.filter(F.col("_quality") >= quality.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest number, of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for the personal data in their texts."""
    return _with_length(surrogates.replace_entities(docs), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _with_length(mixing.repeat_documents(mixing.mix(docs)), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence of 1024 tokens."""
    import public_tokenizers

    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", without_near_duplicates),
    ("pii_surrogates", without_personal_data),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each hands on is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
