"""A corpus pipeline of five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it has kept:
language identification (rejects go), line dedup (recurring lines go), n-gram Jaccard join
(one document of each group stays), benchmark decontamination (documents that hold a
passage of the benchmark go) and packing.  All but the last return the columns of
documents.  A table with other columns beside ``doc_id`` and ``text`` keeps them; without
any document the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.llm import decontaminate, jaccard_join, language, line_dedup, pack
from voxelry.llm.store import Written, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.train(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.deduplicated(docs)
    columns = [F.when(F.col("__n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c, kind in docs.dtypes]
    return cut.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Language scores, templates and tokens can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written before the next reads it, and
    then what the stage has used goes."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch():
            kept = Written(stage(spark, docs, sf_dir), name, stay=True)
        if before is not None:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
