"""Documents to packed training sequences: quality rules, exact and near dedup, mixing, packing.

Every stage but the last returns the columns of its docs, and mix two more (mix_slot, mix_place).
Where doc_ids are null or repeat, rows are told apart by their texts as well: no clean row goes
because of another one, and rows alike in doc_id and text are one document from the second stage
on. A null text counts as empty: it fails the quality rules. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.llm.common import materialize, read, release
from logspark.llm.dedup import keep_one
from logspark.llm.jaccard import keep_first
from logspark.llm.mixing import TARGETS, with_spots
from logspark.llm.packing import packed_sequences
from logspark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the fixed limits and are no outliers of their language and source; a null language or source is one."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; a null one ranks lowest."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; one without a doc_id only if its group has no other."""
    return keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their spots in a mix to the target weights; rows alike in doc_id and text share a spot.

    Rows of a written table have no order: each carries its spot, and packing follows the spots.
    """
    return with_spots(docs, targets=TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence: bin_id, fill, n_pieces, doc_ids, pieces, place (in the mix, of its first document)."""
    return packed_sequences(docs, order=["mix_slot", "mix_place"])


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: SQL can't express the robust fits of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)  # what a stage has read is on disk no longer than that
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
