"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage reads what the one before it wrote and gives up nothing but what it is there to remove; the
last one returns a row of token counts and digests for every document that is left. What a stage wrote is
deleted when the next one has written its own.

Cases: null and empty texts are one text in every stage (scored, equal to each other, in no shingle and no
benchmark window, of no token); a null doc_id is kept if its text is; rows repeated as a whole leave one; very
long texts are read in full; without documents there are no rows, without labels or benchmark items those stages
drop nothing; other columns pass by, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.byte_bpe import encode_texts
from lodestar.llm.common import discard, staged, table
from lodestar.llm.decontaminate import drop_contaminated
from lodestar.llm.exact_dedup import drop_exact_copies
from lodestar.llm.near_dedup import drop_near_copies
from lodestar.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share four fifths of their five-word shingles one stays."""
    return drop_near_copies(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars."""
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("decontamination", decontamination), ("tokens", tokens)]
#: SQL can't express the classifier, the sketches or the tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
