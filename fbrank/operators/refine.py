"""Dense query refinement V1-V3 and mean pooling P5.

Feedback vectors per (keys) are few (the feedback depth), so they are gathered with an
ordered ``collect_list`` and summed element-wise with higher-order functions: one shuffle
by the query key, no per-component rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.functions.vectors import as_double_array, l2_normalize, sum_vectors


FEEDBACK_ROWS = 1 << 18  # of a broadcast


def attach_vectors(feedback: DataFrame, corpus: DataFrame, *, docid: str = "docid", vec: str = "vec") -> DataFrame:
    """Join stored vectors to the chosen feedback documents only (late materialisation)."""
    return feedback.join(corpus.select(F.col(docid).alias("docid"), F.col(vec).alias("vec")), "docid")


def _gathered(fb_vecs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (fb_vecs.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("fb_pos", as_double_array("vec").alias("v")))).alias("_fb")))


def refine_rocchio(queries: DataFrame, fb_vecs: DataFrame, *, alpha: float = 0.9, beta: float = 0.1,
                   gamma: float = 0.1, topk: int = 3, bottomk: int = 0, keys: Sequence[str] = ("qid",),
                   qv: str = "qv") -> DataFrame:
    """V2: alpha*q + beta*mean(first topk feedback) - gamma*mean(last bottomk feedback).

    ``queries``: keys..., qv.  ``fb_vecs``: keys..., fb_pos, vec.  A query without feedback
    keeps alpha*q (T15).  Output: keys..., qv ARRAY<DOUBLE>.
    """
    g = _gathered(fb_vecs, keys)
    q = queries.select(*keys, as_double_array(qv).alias("_q"))
    j = q.join(g, list(keys), "left").withColumn("_fb", F.coalesce("_fb", F.array()))
    dim = F.size("_q")
    pos = F.slice("_fb", 1, topk) if topk > 0 else F.array()
    pos_v = F.transform(pos, lambda x: x["v"])
    pos_mean = F.transform(sum_vectors(pos_v, dim), lambda x: x / F.greatest(F.size(pos_v), F.lit(1)))
    out = F.zip_with("_q", pos_mean, lambda a, b: F.lit(alpha) * a + F.lit(beta) * b)
    if bottomk > 0:
        neg_v = F.transform(F.slice("_fb", -bottomk, bottomk), lambda x: x["v"])
        n_neg = F.size(neg_v)
        neg_mean = F.transform(sum_vectors(F.when(n_neg > 0, neg_v).otherwise(F.array()), dim),
                               lambda x: x / F.greatest(n_neg, F.lit(1)))
        out = F.zip_with(out, neg_mean, lambda a, b: a - F.lit(gamma) * b)
    return j.select(*keys, out.alias(qv))


def refine_average(queries: DataFrame, fb_vecs: DataFrame, *, keys: Sequence[str] = ("qid",),
                   qv: str = "qv") -> DataFrame:
    """V1: mean of the query vector and all its feedback vectors."""
    g = _gathered(fb_vecs, keys)
    q = queries.select(*keys, as_double_array(qv).alias("_q"))
    j = q.join(g, list(keys), "left").withColumn("_fb", F.coalesce("_fb", F.array()))
    vs = F.transform("_fb", lambda x: x["v"])
    total = F.zip_with("_q", sum_vectors(vs, F.size("_q")), lambda a, b: a + b)
    return j.select(*keys, F.transform(total, lambda x: x / (F.size(vs) + 1)).alias(qv))


def refine_text(topics: DataFrame, feedback: DataFrame, documents: DataFrame, *, sep: str = " ",
                keys: Sequence[str] = ("qid",)) -> DataFrame:
    """V3: query text followed by the feedback passages' text in feedback order, ready to encode.

    The feedback is computed and measured when this is planned: up to ``FEEDBACK_ROWS`` are broadcast to the documents, whose
    texts then aren't shuffled, but those chosen."""
    feedback = feedback.select(*keys, "fb_pos", "docid").persist()
    given = F.broadcast(feedback) if feedback.count() <= FEEDBACK_ROWS else feedback
    fb = (given.join(documents.select("docid", "text"), "docid")
          .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fb_pos", "text"))).alias("_fb")))
    j = topics.join(fb, list(keys), "left").withColumn("_fb", F.coalesce("_fb", F.array()))
    texts = F.concat(F.array(F.col("title")), F.transform("_fb", lambda x: x["text"]))
    return j.select(*keys, F.array_join(texts, sep).alias("title"))


def mean_pool(df: DataFrame, by: Sequence[str], vec: str = "vec", *, normalize: bool = True) -> DataFrame:
    """P5: element-wise mean of the vectors of each group (e.g. token vectors), then L2 norm.

    Components are averaged as rows ``(by, pos)`` so a group of any size streams through the
    aggregation; the pooled vector is rebuilt in component order.
    """
    ex = df.select(*by, F.posexplode(as_double_array(vec)).alias("pos", "x"))
    comp = ex.groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    pooled = (comp.groupBy(*by)
              .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_c"))
              .select(*by, F.transform("_c", lambda c: c["x"]).alias(vec)))
    if normalize:
        pooled = pooled.withColumn(vec, l2_normalize(vec))
    return pooled
