"""Readers, and the views of the given test tables (FIXTURES.md §2).

Every view reads whole tables; nothing is sub-sampled.

* topics          benchmark: item_id AS qid, text AS title
* query vectors   the pre-encoded vector of each topic, looked up by id in ``embeddings``
* dense corpus    embeddings: vec_id AS docid, embedding AS vec (a topic never retrieves itself)
* sparse corpus   documents: doc_id AS docid, text
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------- generic readers

TOPIC_SCHEMA = T.StructType([T.StructField("qid", T.StringType()), T.StructField("title", T.StringType())])


def read_topics(spark: SparkSession, path: str, fmt: str = "tsv", *, id_col: str = "qid",
                text_col: str = "title") -> DataFrame:
    """A topic set as ``(qid, title)`` from tsv (no header), json lines or parquet."""
    if fmt == "tsv":
        df = spark.read.csv(path, sep="\t", schema=TOPIC_SCHEMA, quote="", header=False)
    elif fmt == "json":
        df = spark.read.json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown topics format {fmt!r}")
    return df.select(F.col(id_col).alias("qid"), F.col(text_col).alias("title"))


def read_vectors(spark: SparkSession, path_or_name: str, id_col: str = "docid", vec_col: str = "vec", *, registered: bool = False) -> DataFrame:
    """A vector collection by path (parquet) or, if ``registered``, by table name."""
    df = spark.table(path_or_name) if registered else spark.read.parquet(path_or_name)
    return df.select(F.col(id_col).alias("docid"), F.col(vec_col).alias("vec"))


def read_documents(spark: SparkSession, path: str, id_col: str = "docid", text_col: str = "text") -> DataFrame:
    """A text collection as ``(docid, text)``."""
    return spark.read.parquet(path).select(F.col(id_col).alias("docid"), F.col(text_col).alias("text"))


def lookup_encoded(topics: DataFrame, encoded: DataFrame, *, on: str = "qid", vec_col: str = "qv",
                   on_missing: str = "error") -> DataFrame:
    """S3: attach pre-encoded query vectors; a topic without a vector raises (or is dropped).

    ``encoded`` is ``(on, vec_col)``.  The check is a live ``raise_error`` in the plan,
    not a driver-side count.
    """
    joined = topics.join(encoded.select(on, vec_col), on, "left")
    if on_missing == "drop":
        return joined.filter(F.col(vec_col).isNotNull())
    if on_missing != "error":
        raise ValueError("on_missing must be 'error' or 'drop'")
    return joined.withColumn(
        vec_col,
        F.when(F.col(vec_col).isNull(),
               F.raise_error(F.concat(F.lit("no encoded query for topic "), F.col(on).cast("string"))))
        .otherwise(F.col(vec_col)),
    )


def assert_dim(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """Every vector must have ``dim`` components (checked row by row in the projection)."""
    return df.withColumn(
        vec_col,
        F.when(F.size(vec_col) == dim, F.col(vec_col)).otherwise(
            F.raise_error(F.concat(F.lit(f"vector length != {dim}: "), F.size(vec_col).cast("string")))),
    )


def with_prefix(topics: DataFrame, prefix: str | None, col: str = "title") -> DataFrame:
    """Prefix every query text before encoding."""
    if not prefix:
        return topics
    return topics.withColumn(col, F.concat(F.lit(prefix), F.col(col)))


# ---------------------------------------------------------------- views of the test tables

def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("title"))


def dense_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), F.col("embedding").alias("vec"))


def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their pre-encoded vectors (S3 lookup by id)."""
    enc = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return lookup_encoded(topics(spark, sf_dir), enc, on="qid", vec_col="qv").select("qid", "qv")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), "text")
