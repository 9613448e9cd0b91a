"""Dense feedback runs (lifecycle A): search, select, refine, search again - one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.functions.positions import sample_positions
from fbrank.operators.feedback import select_donor, select_natural, select_random_split, select_swapped
from fbrank.operators.refine import attach_vectors, refine_average, refine_rocchio, refine_text
from fbrank.operators.search import assign_batches, topk_search


@dataclass(frozen=True)
class DenseSettings:
    """Command settings; defaults are the dense command's own (T12: sweeps use .4/.6, topk = depth)."""

    prf_depth: int = 3
    total_prf_docs: int = 100
    split_num: int = 10
    nsplit: int = 0
    seed: int = 42
    method: str = "rocchio"        # 'rocchio' | 'avg' | 'text'
    mode: str = "random_split"     # 'random_split' | 'natural' | 'swap' | 'donor'
    batch_size: int = 32           # of 'swap'
    alpha: float = 0.9
    beta: float = 0.1
    gamma: float = 0.1
    topk: int = 3
    bottomk: int = 0
    hits: int = 1000


def feedback_for(first: DataFrame, s: DenseSettings) -> DataFrame:
    if s.mode == "natural":
        return select_natural(first, s.prf_depth)
    if s.mode == "random_split":
        return select_random_split(first, seed=s.seed, depth=s.prf_depth, total=s.total_prf_docs,
                                   split_num=s.split_num, nsplit=s.nsplit)
    if s.mode in ("swap", "donor"):
        return _other_topics(first, s)
    raise ValueError(f"unknown selection mode {s.mode!r}")


def _other_topics(first: DataFrame, s) -> DataFrame:
    """F4/F5 for one setting: a grid of one trial; topics without a valid donor get no feedback."""
    spark = first.sparkSession
    pos = sample_positions(s.seed, s.prf_depth, s.total_prf_docs, s.split_num, s.nsplit)
    trial = spark.createDataFrame([(0, s.seed, s.total_prf_docs, s.batch_size, pos)],
                                  "trial_id int, seed int, total_prf_docs int, batch_size int, positions array<int>")
    if s.mode == "donor":
        return select_donor(first, trial).drop("trial_id")
    batches = assign_batches(first.select("qid").distinct(), s.batch_size).withColumn("batch_size", F.lit(s.batch_size))
    return select_swapped(first, trial, batches.select("batch_size", "qid", "batch")).drop("trial_id")


def refine_for(queries: DataFrame, fb_vecs: DataFrame, s: DenseSettings) -> DataFrame:
    if s.method == "rocchio":
        return refine_rocchio(queries, fb_vecs, alpha=s.alpha, beta=s.beta, gamma=s.gamma, topk=s.topk,
                              bottomk=s.bottomk)
    if s.method == "avg":
        return refine_average(queries, fb_vecs)
    raise ValueError(f"unknown refinement {s.method!r}")


@dataclass(frozen=True)
class Texts:
    """What method 'text' needs: topics (qid, title), documents (docid, text) and how texts become vectors:
    ``encode(frame, id_cols)`` gives id_cols and ``qv`` for a frame of id_cols and ``title``."""

    topics: DataFrame
    documents: DataFrame
    encode: Callable[[DataFrame, Sequence[str]], DataFrame]
    sep: str = " "

    def refined(self, feedback: DataFrame, keys: Sequence[str] = ("qid",), topics: DataFrame | None = None) -> DataFrame:
        """V3: each query's text and its feedback passages', encoded anew."""
        return self.encode(refine_text(self.topics if topics is None else topics, feedback, self.documents, sep=self.sep, keys=keys), keys)


def dense_feedback_run(queries: DataFrame, corpus: DataFrame, s: DenseSettings, *,
                       exclude_self: str | None = None, texts: Texts | None = None) -> DataFrame:
    """(qid, docid, score, rank) of the second search; depth 0 = plain search.

    Method 'text' takes the refined vectors from ``texts`` (V3), the others from the stored vectors."""
    if s.prf_depth <= 0:
        return topk_search(queries, corpus, s.hits, exclude_self=exclude_self)
    first = topk_search(queries, corpus, s.total_prf_docs, exclude_self=exclude_self)
    fb = feedback_for(first, s)
    if s.method == "text":
        if texts is None:
            raise ValueError("method 'text' needs texts")
        refined = texts.refined(fb)
    else:
        refined = refine_for(queries, attach_vectors(fb, corpus), s)
    refined = refined.join(queries.drop("qv"), "qid") if exclude_self and exclude_self != "qid" else refined
    return topk_search(refined, corpus, s.hits, exclude_self=exclude_self)
