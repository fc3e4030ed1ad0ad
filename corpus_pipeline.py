"""From raw documents to token counts: five corpus operators, one after another.

Each stage works on all that its predecessor kept.  Its result is written as Parquet
in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import with_tokens
from millrace.llm.common import read_table, stored, without_rows
from millrace.llm.decontaminate import contaminated
from millrace.llm.quality import quality_rules
from millrace.llm.simhash import simhash_components
from millrace.llm.suffix import without_repeats
from millrace.session import ensure_shared_folder, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return without_rows(docs, quality_rules(docs).where("not kept"), "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints, the one with the smallest doc_id.

    Rows that repeat that doc_id and text stay with it; rows without an id go, unless
    no member of the group has one.
    """
    groups = simhash_components(docs)
    return without_rows(
        docs, groups.where("not (doc_id <=> component_id)"), "doc_id", "text"
    )


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that occur elsewhere.

    A character of which only some bytes go is dropped; n_chars follows the text.
    """
    cut = without_repeats(docs, carry=True)
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(
        *[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c)
          for c in docs.columns]
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = read_table(spark, sf_dir, "benchmark")
    return without_rows(docs, contaminated(docs, items), "doc_id", "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return with_tokens(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", substring_dedup),
    ("bm25_decontamination", decontamination),
    ("byte_bpe", tokens),
]

# No stage but the filters themselves can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last."""
    ship_package(ensure_shared_folder(spark))
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
