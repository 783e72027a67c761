"""From raw documents to packed sequences: quality, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of docs; the last one returns
the pieces of packed sequences. Rows without an id are judged like any other; a stage that drops by id never drops them.
Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import op3_toxicity, op9_quality
from pagewright.llm.common import durable, table, without
from pagewright.llm.op6_packing import pack
from pagewright.llm.op8_exact_dedup import copies
from pagewright.llm.similar import similar_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs, holds for good.

    Each row is judged by its text alone: rows without an id too, repeated rows and equal texts alike. Null counts as empty; empty and very short
    texts score near the prior and stay unless most of docs is bad. Long texts are measured whole. Of an empty table nothing stays.
    All columns pass as they are, whatever their names.
    """
    return op9_quality.good_rows(docs, op9_quality.fit(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't make them toxic; the examples are the labelled documents among docs that aren't held out.

    Rows without an id are judged and teach nothing; repeated rows and equal texts are judged alike. A null or empty text, and one that shares no term with
    any example, is judged by the examples without terms. Long texts are read whole. Without labels of both classes all go or stay by the one there is; of
    an empty table nothing stays. All columns pass as they are, whatever their names.
    """
    return op3_toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id. Rows go by id and text, so another text of an id stays.

    Rows without an id stay, and so do all repeated rows of the id that stays (a tie). Null and empty texts are equal. Long texts are hashed where they
    are. Of an empty table nothing stays. All columns pass as they are, whatever their names.
    """
    lesser = copies(docs).filter("doc_id <> keep_id").select(F.col("doc_id").alias("id"), "h").distinct()
    return without(docs, durable(lesser))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, pairs with a five-word similarity of 0.8 or more, the one with the smallest id. Rows go by id and text.

    Rows without an id stay, and so do all repeated rows of the id that stays (a tie). Null, empty and blank texts are alike. Long texts are taken to pieces
    whole, one at a time. Of an empty table nothing stays. All columns pass as they are, whatever their names.
    """
    lesser = similar_texts(docs).filter("not kept").select(F.col("doc_id").alias("id"), "h").distinct()
    return without(docs, durable(lesser))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences along the curve.

    Every row is packed, repeated ones too; a null id stays null, and a null or empty text is the end id alone. Documents that tie on the curve follow one
    another in no particular order. A long text is cut into as many pieces as it fills sequences. An empty table gives no pieces. Columns but doc_id and text aren't
    read, whatever their names.
    """
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Scores, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
