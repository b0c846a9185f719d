"""Corpus preparation in five stages over the ``documents`` table, each applying one operator of ``feedlab.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents`` and no others, whatever ``docs`` has besides. ``run`` writes what a stage returns to the shared folder
and reads it again as the next stage's docs. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from feedlab.llm import bpe, decontam, jaccard, line_dedup, quality
from feedlab.llm.common import SPACES, stored, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; the others lose their boilerplate lines.

    Null, empty and blank texts have no words and go; very long texts are judged whole; a null source is a source. Repeated
    rows are judged alike and stay as often as they come; copies don't make each other's lines boilerplate. A count equal
    to a limit passes.
    """
    return _columns(quality.without_boilerplate(quality.judge(docs.select(*COLUMNS)).where("kept")))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so does a document that they leave without a word.

    Of equal windows the first in the order (doc_id, text hash, place) stays, a null doc_id before all others. Documents
    without repeats stay as they are, null and empty texts too. Rows with equal doc_id and text are one document.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _columns(out.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(SPACES)) != "")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 on five-word shingles connect, the one with the smallest doc_id stays.

    A similarity of just 0.8 links. Texts without words all stay. Rows are judged by doc_id: repeated rows stay or go
    together, and all rows with a null doc_id stay if one of them has no words or only such rows in its group.
    """
    return jaccard.representatives(docs, "doc_id", "text", k=5, p=4, q=5).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    A share of agreeing tokens just at the limit counts as held. Null and empty texts and items hold nothing. Rows are
    judged by doc_id: repeated rows go or stay together, and so do all rows with a null doc_id.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Token ids of each text, whole, and whether they decode to its bytes; null and empty texts have no ids. One row in, one row out."""
    ranks = bpe.read_ranks(public_tokenizers.path(tokenizer))
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    same = bpe.decode(F.col("ids"), ranks) == F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    return out.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [("quality_rules", quality_rules), ("line_windows", line_windows), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: SQL expresses neither the merges of the last stage nor the alignments of the one before.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
