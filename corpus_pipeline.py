"""The corpus pipeline: toxicity, near-dedup, suffix-array dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` is all that the stage before
kept, read again from Parquet. All stages but the last return the columns of
``documents``, extra ones too, whatever their names; the last returns packed pieces.

Null and empty texts are clean in every stage and become one piece with the end
id alone. Rows without a doc_id are scored, have no copies, keep all bytes and
leak nothing; they are packed under a null id. Rows that repeat as they are stay
as often as they are there (they are one document); of an id with several texts
no row goes as a near copy as long as one of them is kept, and each is cut and
packed by its own text, but a leak in one of them takes all. Of equal texts under
several ids the smallest id stays. Very long texts are read whole. An empty table
passes all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from ravelin.llm.lake import Scratch, table
from ravelin.llm.queries import held_out, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under the threshold."""
    model = toxicity.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.below(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    classes = near_dedup.similar_classes(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    copies = classes.where("not kept AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of 100 bytes and more that stand earlier."""
    return substring_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither a trained factorization machine nor bin packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
