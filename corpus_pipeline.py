"""Corpus pipeline: quality, near-duplicates, benchmark contamination, mixture.

Each stage works on what the stage before kept.  All stages but the last return the columns of
``documents``; the last returns the sampled documents with one more column, ``mixed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fbrank.llm import decontaminate, mixing, quality, setsketch
from fbrank.llm.frames import column
from fbrank.llm.queries import TARGETS, table
from fbrank.session import scratch_path, ship_package

#: share of the tokens left by the other stages that the sample holds at least
SAMPLE = 0.25

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 10) doesn't reject.

    Every row is scored by its own whole text: null and empty texts have a score like any other, repeated rows and
    equal ids share the fate of their texts, very long ones are read whole; an empty table stays empty."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 8; five words, similarity 0.8): that of the smallest id.

    Rows without an id, and texts without words, are nobody's copies and stay (of rows equal in id and text, one); an id used for
    different texts is as many documents; equal rows are one; an empty table stays empty."""
    ship_package(spark)
    return setsketch.drop_near_duplicates(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item (operator 1).

    Null and empty texts hold no window and stay, as do all repeats of a clean row; very long texts are scanned whole;
    items without words match nothing; an empty table stays empty."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights, a quarter of the tokens at least (operator 2).

    A row is sampled by its id (by its text if that is null), so repeated rows stay or go together; null and unlisted sources and
    languages count as 'other'; texts without words weigh nothing and are taken; an empty table stays empty."""
    mixed = mixing.mix(docs, TARGETS, share=SAMPLE)
    return mixed.filter(column(mixed, mixed.columns[-1])["sampled"])


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
                                   ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: the quality stage is learned, which SQL cannot express; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
