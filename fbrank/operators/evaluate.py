"""Evaluation E1-E6 with graded judgements (the usual trec_eval definitions).

* The evaluator ranks a run by its printed score (6 digits) desc, then docid desc as a
  string; the rank column of the run is ignored.
* Binary measures (AP, recall) count a document relevant when ``rel >= level``;
  nDCG@10 uses the grade itself as gain for every ``rel > 0``.
* Summaries average over all judged topics: a judged topic missing from the run scores 0.

Fixed values: metric names ``map``, ``ndcg_cut_10``, ``recall_1000``; default level 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("map", "ndcg_cut_10", "recall_1000")
DIGITS = 6
JUDGED = 1 << 20  # judgements that are broadcast to a run of a row per topic


def eval_order(run: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``erank``: the evaluator's rank (score printed at 6 digits desc, docid string desc).  A run of a row per topic, with
    its ``hits`` (docid, score) in a list, is ranked list by list where it lies and comes out as a row per hit (keys, qid, docid, erank)."""
    if "hits" in run.columns:
        printed = F.transform("hits", lambda x: F.struct(F.round(x["score"], DIGITS).alias("score"), x["docid"].cast("string").alias("id"), x["docid"].alias("docid")))
        each = run.select(*keys, "qid", F.posexplode(F.sort_array(printed, asc=False)).alias("_at", "_hit"))
        return each.select(*keys, "qid", "_hit.docid", (F.col("_at") + 1).alias("erank"))
    w = Window.partitionBy(*keys, "qid").orderBy(F.round("score", DIGITS).desc(),
                                                  F.col("docid").cast("string").desc())
    return run.withColumn("erank", F.row_number().over(w))


def _hit_sums(run: DataFrame, qrels: DataFrame, level: int, keys: Sequence[str], ndcg_cut: int, recall_cut: int, how: str = "inner") -> DataFrame:
    """Per (keys, qid) with a judged hit (``how`` 'left': with any): sum of precisions, relevant hits in the cut, and DCG.

    The run is computed and ranked once; where only judged hits count, only they go further.  Up to ``JUDGED`` judgements are broadcast
    to a run of lists, which then has no shuffle but for its judged hits."""
    listed = "hits" in run.columns
    ranked = eval_order(run.select(*keys, "qid", *(["hits"] if listed else ["docid", "score"])), keys)
    judged = qrels.select("qid", "docid", "rel").filter(F.col("rel") > 0)
    if listed and judged.count() <= JUDGED:
        judged = F.broadcast(judged)
    hits = ranked.join(judged, ["qid", "docid"], how)
    relevant = F.when(F.col("rel") >= level, 1).otherwise(0)
    so_far = F.sum(relevant).over(Window.partitionBy(*keys, "qid").orderBy("erank"))
    return (hits.withColumn("_n", so_far).groupBy(*keys, "qid")
            .agg(F.sum(F.when(F.col("rel") >= level, F.col("_n") / F.col("erank")).otherwise(0.0)).alias("_prec_sum"),
                 F.sum(F.when(F.col("erank") <= recall_cut, relevant).otherwise(0)).alias("_ret"),
                 F.sum(F.when((F.col("erank") <= ndcg_cut) & (F.col("rel") > 0), F.col("rel") / F.log2(F.col("erank") + 1)).otherwise(0.0)).alias("_dcg")))


def _measures(sums: DataFrame, qrels: DataFrame, level: int, keys: Sequence[str], ndcg_cut: int) -> DataFrame:
    out = sums.join(topic_stats(qrels, level=level, ndcg_cut=ndcg_cut), "qid")
    return out.select(*keys, "qid",
                      F.when(F.col("_R") > 0, F.coalesce("_prec_sum", F.lit(0.0)) / F.col("_R")).otherwise(0.0).alias("map"),
                      F.when(F.col("_idcg") > 0, F.coalesce("_dcg", F.lit(0.0)) / F.col("_idcg")).otherwise(0.0).alias("ndcg_cut_10"),
                      F.when(F.col("_R") > 0, F.coalesce("_ret", F.lit(0)) / F.col("_R")).otherwise(0.0).alias("recall_1000"))


def per_topic(run: DataFrame, qrels: DataFrame, *, level: int = 2, keys: Sequence[str] = (),
              ndcg_cut: int = 10, recall_cut: int = 1000) -> DataFrame:
    """Per (keys, qid) of the run: ap, ndcg_cut_10, recall_1000 over the judged topics it covers."""
    return _measures(_hit_sums(run, qrels, level, keys, ndcg_cut, recall_cut, "left"), qrels, level, keys, ndcg_cut)


def topic_stats(qrels: DataFrame, *, level: int = 2, ndcg_cut: int = 10) -> DataFrame:
    """Per judged topic: R (relevant at ``level``) and the ideal DCG at the cut."""
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("docid"))
    ideal = (qrels.filter(F.col("rel") > 0)
             .withColumn("_i", F.row_number().over(w))
             .filter(F.col("_i") <= ndcg_cut)
             .groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("_i") + 1)).alias("_idcg")))
    r = qrels.groupBy("qid").agg(F.sum(F.when(F.col("rel") >= level, 1).otherwise(0)).alias("_R"))
    return r.join(ideal, "qid", "left").withColumn("_idcg", F.coalesce("_idcg", F.lit(0.0)))


def summarize(per_topic_df: DataFrame, qrels: DataFrame, *, keys: Sequence[str] = (),
              key_values: DataFrame | None = None) -> DataFrame:
    """E5: mean over ALL judged topics; topics absent from the run add 0.

    ``key_values`` lists the key tuples to report (e.g. every trial); defaults to those in
    ``per_topic_df``.  Judged topics per key = key_values x judged qids, formed by summing
    per-topic values and dividing by the judged-topic count (no pair enumeration).
    """
    n_judged = qrels.agg(F.count_distinct("qid").cast("double")).scalar()
    sums = per_topic_df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in METRICS])
    if keys and key_values is not None:
        sums = key_values.select(*keys).distinct().join(sums, list(keys), "left")
    denom = F.greatest(n_judged, F.lit(1.0))
    return sums.select(*keys, *[F.round(F.coalesce(F.col(m), F.lit(0.0)) / denom, DIGITS).alias(m)
                                for m in METRICS])


def evaluate(run: DataFrame, qrels: DataFrame, *, level: int = 2, keys: Sequence[str] = (),
             key_values: DataFrame | None = None) -> DataFrame:
    """Summary metrics (map, ndcg_cut_10, recall_1000) per key tuple."""
    # topics without a judged hit add 0, so only those with one are looked at
    pt = _measures(_hit_sums(run, qrels, level, keys, 10, 1000), qrels, level, keys, 10)
    return summarize(pt, qrels, keys=keys, key_values=key_values)


def metrics_long(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, metric) - the text-log form, a key's metrics in the order of their names (``METRICS``)."""
    return metrics.unpivot(list(keys), list(METRICS), "metric", "value")


def metrics_wide(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Name -> value rows back to one record per key tuple."""
    return long.groupBy(*keys).pivot("metric", list(METRICS)).agg(F.first("value"))
