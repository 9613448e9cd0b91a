"""Graded judgements derived from the given tables (FIXTURES.md §2, whole tables).

* ``pooled_label_qrels``: depth-``pool`` pooling of a first ranking; a pooled document is
  judged by label agreement with the topic's own vector, grade ``1 + docid % 3`` when the
  labels agree, 0 otherwise.  Size is topics x pool depth.
* ``containment_qrels``: a document is relevant to a topic when its text contains the
  topic text verbatim; grade ``1 + coalesce(labels.quality, 0)``.  Candidates come from an
  equi-join on each topic's rarest inner token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.functions.text import tokens

BROADCAST_TOPICS = 1 << 16  # topics whose titles and terms are broadcast

def pooled_label_qrels(pool_run: DataFrame, labels: DataFrame, *, pool: int = 100) -> DataFrame:
    """(qid, docid, rel) for the top-``pool`` documents of every topic in ``pool_run``."""
    lab_q = labels.select(F.col("docid").alias("qid"), F.col("label").alias("_ql"))
    lab_d = labels.select("docid", F.col("label").alias("_dl"))
    return (pool_run.filter(F.col("rank") <= pool).select("qid", "docid")
            .join(lab_q, "qid").join(lab_d, "docid")
            .select("qid", "docid",
                    F.when(F.col("_ql") == F.col("_dl"), 1 + F.col("docid") % 3).otherwise(0)
                    .cast("int").alias("rel")))


def containment_pairs(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """(docid, qid) where ``documents.text`` contains ``topics.title`` (null and empty titles match nothing).

    A document that contains a title contains each of its tokens that have another on both sides.
    Topics are joined to documents on the one of those that the fewest documents have, and
    ``contains`` decides, in the scan that finds the token: of few topics no text or token is shuffled.  Titles of fewer than
    three tokens have none; if there are any, they are joined on the tokens of the collection that contain their first one."""
    titles = topics.select("qid", "title").filter(F.length("title") > 0).withColumn("_t", tokens("title")).persist()
    count = titles.groupBy(F.least(F.size("_t"), F.lit(3)).alias("n")).count()
    sizes = {r["n"]: r["count"] for r in count.collect()}  # of topics with no, one, two and more tokens
    near = F.broadcast if sum(sizes.values()) <= BROADCAST_TOPICS else lambda df: df
    words = documents.select("docid", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    inner = titles.filter(F.size("_t") > 2).select("qid", "title", F.explode(F.slice("_t", 2, F.size("_t") - 2)).alias("term"))
    used = words.join(near(inner.select("term").distinct()), "term", "left_semi")
    freq = used.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    rarest = inner.join(freq, "term").groupBy("qid", "title").agg(F.min_by("term", F.struct("_df", "term")).alias("term"))
    texts = documents.filter(F.col("docid").isNotNull()).select("docid", "text", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    found = texts.join(near(rarest), "term").filter(F.contains("text", "title")).select("docid", "qid")
    if sizes.get(1, 0) + sizes.get(2, 0):
        short = titles.filter(F.size("_t").between(1, 2)).select("qid", "title", F.element_at("_t", 1).alias("_first"))
        by_part = short.join(words.select("term").distinct(), F.contains("term", "_first")).select("qid", "title", "term")
        cand = words.join(by_part, "term").select("docid", "qid", "title").distinct()
        found = found.unionByName(cand.join(documents.select("docid", "text"), "docid").filter(F.contains("text", "title")).select("docid", "qid"))
    if sizes.get(0):
        bare = titles.filter(F.size("_t") == 0).select("qid", "title")  # nothing but marks: compared as they are
        found = found.unionByName(documents.join(bare, F.contains("text", "title")).select("docid", "qid"))
    return found


def containment_qrels(documents: DataFrame, topics: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, docid, rel) with rel = 1 + coalesce(quality, 0)."""
    pairs = containment_pairs(documents, topics)
    return (pairs.join(labels.select("docid", "quality"), "docid", "left")
            .select("qid", "docid", (1 + F.coalesce("quality", F.lit(0))).cast("int").alias("rel")))
