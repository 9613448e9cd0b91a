"""Sparse feedback runs (lifecycle B): first run -> feedback -> Rocchio terms -> BM25 search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fbrank.operators import sparse as sp
from fbrank.plans.dense import feedback_for


@dataclass(frozen=True)
class SparseSettings:
    """Entry-point defaults: alpha 1, beta .75, k1 .9, b .4, k 1000, feedback vectors 'tf'."""

    prf_depth: int = 3
    total_prf_docs: int = 100
    split_num: int = 10
    nsplit: int = 0
    seed: int = 42
    mode: str = "random_split"   # 'random_split' | 'natural' | 'swap' | 'donor'
    batch_size: int = 32         # of 'swap'
    alpha: float = 1.0
    beta: float = 0.75
    fb_vector: str = "tf"
    k: int = 1000


def sparse_feedback_run(topics: DataFrame, first: DataFrame, index: sp.Index, s: SparseSettings,
                        weights: DataFrame | None = None) -> DataFrame:
    """(qid, docid, score, rank) after Rocchio feedback on ``first``; depth 0 = plain BM25."""
    bow = sp.query_bow(topics, index)
    if s.prf_depth <= 0:
        return sp.bm25_search(bow, index, s.k, weights=weights)
    fb = feedback_for(first, s).persist()
    fb.count()  # its size is then known where it meets the documents
    fbv = sp.mean_feedback(fb, index, mode=s.fb_vector, weights=weights)
    terms = sp.refine_terms(bow, fbv, alpha=s.alpha, beta=s.beta)
    return sp.bm25_search(terms, index, s.k, weights=weights)
