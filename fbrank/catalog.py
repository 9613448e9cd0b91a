"""Registered queries: one Spark DataFrame per operator key of SURVEY §2.

Every query reads the given tables of ``sf_dir`` whole (or frames Spark derives from them).
Doubles are rounded to 6 digits and vectors element-wise on output so results compare by
value with the SQL oracle (``fbrank.oracle``).

Standard settings (FIXTURES.md §3):
  dense   total 100, split 10, depth 3, slice 0, seed 42, alpha .4, beta .6, topk = depth
  swap    total 20, split 2, depth 3, slice 0, seed 42, batch 5
  donor   total 100, slice 0, seed 42
  short   total 1000, split 10, slice 4, seed 23 (positions past the list end are dropped)
  sparse  total 100, split 10, depth 3, slice 0, seed 42, alpha 1, beta .75, k1 .9, b .4, k 1000
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fbrank.functions.positions import sample_positions
from fbrank.functions.vectors import round_vec
from fbrank.operators import evaluate as ev
from fbrank.operators import sparse as sp
from fbrank.operators.encode import EncoderClass, MatrixEncoder, apply_matrix, encode_hashed, encode_named
from fbrank.operators.feedback import (overlaps, select_donor, select_natural, select_positions,
                                       select_swapped, selection_log)
from fbrank.operators.judgements import containment_qrels, pooled_label_qrels
from fbrank.operators.refine import attach_vectors, mean_pool, refine_average, refine_rocchio, refine_text
from fbrank.operators.search import (assign_batches, binary_search, break_ties, max_passage, topk_search)
from fbrank.plans import sweep as sw
from fbrank.plans.dense import DenseSettings, Texts, dense_feedback_run
from fbrank.plans.sparse import SparseSettings, sparse_feedback_run
from fbrank.session import scratch_path
from fbrank.sources import runs as rf
from fbrank.sources import tables as tb
from fbrank.sources.index import stored_index

DENSE = DenseSettings(prf_depth=3, total_prf_docs=100, split_num=10, nsplit=0, seed=42, method="rocchio",
                      alpha=0.4, beta=0.6, topk=3, hits=1000)
SPARSE = SparseSettings(prf_depth=3, total_prf_docs=100, split_num=10, nsplit=0, seed=42, alpha=1.0, beta=0.75)
DENSE_K = 100
VECTOR_TOTAL = 1000          # the vector sweep's total; slices run past the end of shorter rankings
SPARSE_TOTALS = (100, 1000)  # the sparse sweeps' totals
POOL = 100
SWAP = dict(total=20, split_num=2, depth=3, nsplit=0, seed=42, batch=5)
# the swapped sweep's default grid, over two topic sets: here the topics of even and of odd ids
SWAP_GRID = dict(totals=(100, 1000), split_num=10, depth=3, batch=64, topics=("even", "odd"))
SHORT = dict(total=1000, split_num=10, depth=3, nsplit=4, seed=23)
HASH_DIM = 64
TEXT_TOTAL = 100             # the text sweep's total
BINARY_K = 100


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def _stored(rows: DataFrame) -> DataFrame:
    """Judgements or feedback, computed once; Spark then knows their size when it plans the joins with them."""
    rows = rows.persist()
    rows.count()
    return rows


def _run_out(run: DataFrame, keys=("qid",)) -> DataFrame:
    return run.select(*keys, "docid", F.col("rank").cast("int").alias("rank"), _r("score"))


def shared_index(spark: SparkSession, sf_dir: str) -> tuple[sp.Index, DataFrame]:
    """The stored text index of ``sf_dir``'s documents, by document, and its BM25 weights: built once, found again by the
    documents' content (like a search index that is built once and queried many times)."""
    found = stored_index(tb.documents(spark, sf_dir), vectors=True, by_term=False)
    return found.index, found.weights


class Ctx:
    """Frames shared by several queries (built lazily, per call; the text index per session)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    @cached_property
    def topics(self):
        return tb.topics(self.spark, self.sf)

    @cached_property
    def qv(self):
        return tb.query_vectors(self.spark, self.sf)

    @cached_property
    def corpus(self):
        return tb.dense_corpus(self.spark, self.sf)

    @cached_property
    def labels(self):
        return tb.dense_labels(self.spark, self.sf)

    @cached_property
    def docs(self):
        return tb.documents(self.spark, self.sf)

    @cached_property
    def doc_labels(self):
        return tb.table(self.spark, self.sf, "labels").select(F.col("doc_id").alias("docid"), "quality")

    def dense_first(self, k: int = DENSE_K) -> DataFrame:
        return topk_search(self.qv, self.corpus, k, exclude_self="qid")

    @cached_property
    def dense_qrels(self):
        return pooled_label_qrels(self.dense_first(POOL), self.labels, pool=POOL)

    @cached_property
    def _shared(self):
        return shared_index(self.spark, self.sf)

    @property
    def index(self):
        return self._shared[0]

    @property
    def vectors(self):
        """The index with its document vectors, for feedback."""
        return self.index

    @property
    def weights(self):
        return self._shared[1]

    @cached_property
    def bow(self):
        return sp.query_bow(self.topics, self.index)

    @cached_property
    def sparse_first(self):
        return sp.bm25_search(self.bow, self.index, SPARSE.k, weights=self.weights)

    @cached_property
    def sparse_qrels(self):
        return containment_qrels(self.docs, self.topics, self.doc_labels)

    def dense_fb(self) -> DataFrame:
        pos = sample_positions(DENSE.seed, DENSE.prf_depth, DENSE.total_prf_docs, DENSE.split_num, DENSE.nsplit)
        return select_positions(self.dense_first(DENSE.total_prf_docs), pos)

    def sparse_fb(self) -> DataFrame:
        pos = sample_positions(SPARSE.seed, SPARSE.prf_depth, SPARSE.total_prf_docs, SPARSE.split_num, SPARSE.nsplit)
        return _stored(select_positions(self.sparse_first, pos))

    def dense_prf_run(self) -> DataFrame:
        return dense_feedback_run(self.qv, self.corpus, DENSE, exclude_self="qid")

    def sparse_prf_run(self) -> DataFrame:
        return sparse_feedback_run(self.topics, self.sparse_first, self.vectors, SPARSE, weights=self.weights)


# ------------------------------------------------------------------ sources and sinks

def q_topics_scan(spark, sf):
    return tb.read_topics(spark, os.path.join(sf, "benchmark.parquet"), "parquet", id_col="item_id", text_col="text")


def q_vectors_scan(spark, sf):
    v = tb.read_vectors(spark, os.path.join(sf, "embeddings.parquet"), "vec_id", "embedding")
    return v.select("docid", round_vec("vec").alias("vec"))


def q_encoded_query_lookup(spark, sf):
    return Ctx(spark, sf).qv.select("qid", round_vec("qv").alias("qv"))


def q_documents_scan(spark, sf):
    return tb.read_documents(spark, os.path.join(sf, "documents.parquet"), "doc_id", "text")


def q_qrels_scan(spark, sf):
    c = Ctx(spark, sf)
    path = scratch_path(spark, "qrels")
    rf.write_qrels(c.sparse_qrels, path)
    return rf.read_qrels(spark, path)


def q_run_roundtrip(spark, sf):
    c = Ctx(spark, sf)
    path = scratch_path(spark, "run")
    rf.write_run(c.dense_first(), path, tag="Faiss")
    return rf.read_run(spark, path)


def q_run_lines(spark, sf):
    return rf.format_run(Ctx(spark, sf).dense_first(), "Faiss", "trec").select("line")


def q_run_lines_msmarco(spark, sf):
    return rf.format_run(Ctx(spark, sf).dense_first(), "Faiss", "msmarco").select("line")


def q_selection_log(spark, sf):
    c = Ctx(spark, sf)
    fb = c.dense_fb().withColumn("trial_id", F.lit(0))
    pos = sample_positions(DENSE.seed, DENSE.prf_depth, DENSE.total_prf_docs, DENSE.split_num, DENSE.nsplit)
    trials = spark.createDataFrame([(0, DENSE.seed, pos)], "trial_id int, seed int, positions array<int>")
    return selection_log(fb, trials)


def q_metrics_long(spark, sf):
    c = Ctx(spark, sf)
    m = ev.evaluate(c.dense_prf_run(), c.dense_qrels).withColumn("trial_id", F.lit(0))
    long = ev.metrics_long(m, ["trial_id"])
    proj = sw.project_name("vector_position_prf", F.lit("benchmark"), F.lit(DENSE.total_prf_docs))
    return long.select(proj.alias("project"), "metric", _r("value"))


# ------------------------------------------------------------------ projections, validation

def q_feedback_short_list(spark, sf):
    c = Ctx(spark, sf)
    pos = sample_positions(SHORT["seed"], SHORT["depth"], SHORT["total"], SHORT["split_num"], SHORT["nsplit"])
    fb = select_positions(c.dense_first(SHORT["total"]), pos)
    return fb.select("qid", "fb_pos", "docid", _r("score"))


def q_topics_prefixed(spark, sf):
    return tb.with_prefix(Ctx(spark, sf).topics, "query: ")


def q_dim_check(spark, sf):
    c = tb.assert_dim(Ctx(spark, sf).corpus, "vec", 64)
    return c.select("docid", F.size("vec").alias("dim"))


def q_mean_pool_l2(spark, sf):
    e = tb.table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vec"))
    return mean_pool(e, ["label"], "vec").select("label", round_vec("vec").alias("vec"))


# ------------------------------------------------------------------ retrieval

def q_dense_topk(spark, sf):
    return _run_out(Ctx(spark, sf).dense_first())


def q_feedback_vectors(spark, sf):
    c = Ctx(spark, sf)
    fv = attach_vectors(c.dense_fb(), c.corpus)
    return fv.select("qid", "fb_pos", "docid", round_vec("vec").alias("vec"))


def q_prf_dense_rocchio_run(spark, sf):
    return _run_out(Ctx(spark, sf).dense_prf_run())


def q_prf_dense_average_run(spark, sf):
    c = Ctx(spark, sf)
    s = DenseSettings(**{**DENSE.__dict__, "method": "avg"})
    return _run_out(dense_feedback_run(c.qv, c.corpus, s, exclude_self="qid"))


def q_binary_topk(spark, sf):
    c = Ctx(spark, sf)
    return _run_out(binary_search(c.qv, c.corpus, BINARY_K, BINARY_K, exclude_self="qid"))


def q_binary_topk_rerank(spark, sf):
    c = Ctx(spark, sf)
    return _run_out(binary_search(c.qv, c.corpus, BINARY_K, 10, rerank=True, exclude_self="qid"))


def _label_means(spark, sf):
    """A given matrix: a row per label of the embeddings table, its mean vector."""
    e = tb.table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("r"))
    return mean.select(F.col("label").alias("component"), F.transform("r", lambda x: x["m"]).alias("row"))


def q_pca_topk(spark, sf):
    c = Ctx(spark, sf)
    matrix = _label_means(spark, sf)
    qr, cr = apply_matrix(c.qv, "qv", matrix), apply_matrix(c.corpus, "vec", matrix)
    return _run_out(topk_search(qr, cr, 10, exclude_self="qid"))


def q_bm25_topk(spark, sf):
    return _run_out(Ctx(spark, sf).sparse_first)


def q_prf_sparse_rocchio_run(spark, sf):
    return _run_out(Ctx(spark, sf).sparse_prf_run())


def q_prf_sparse_from_run(spark, sf):
    """The sparse command's own start: feedback drawn from a run file, here a dense run that is
    written and read back; its ids take the index's type, its tag names both steps."""
    c = Ctx(spark, sf)
    path = scratch_path(spark, "initial-run")
    rf.write_run(c.dense_first(SPARSE.total_prf_docs), path, tag="Faiss")
    run = rf.read_run(spark, path)
    first = run.select(*[F.col(i).cast(t.schema[i].dataType).alias(i) for i, t in (("qid", c.topics), ("docid", c.docs))], "rank", "score")
    out = sparse_feedback_run(c.topics, first, c.vectors, SPARSE, weights=c.weights)
    tag = run.agg(F.max("tag")).scalar()
    return _run_out(out).withColumn("tag", F.concat(tag, F.lit("+rocchio")))


def q_dense_topk_single(spark, sf):
    """R2: one query's search."""
    c = Ctx(spark, sf)
    one = c.qv.filter(F.col("qid") == c.qv.agg(F.min("qid")).scalar())
    return _run_out(topk_search(one, c.corpus, DENSE_K, exclude_self="qid"))


def q_max_passage(spark, sf):
    h = Ctx(spark, sf).dense_first()
    h = h.withColumn("docid", F.concat_ws("#", F.floor(F.col("docid") / 5).cast("string"),
                                          (F.col("docid") % 5).cast("string")))
    return _run_out(max_passage(h, delimiter="#", max_hits=100))


def q_tie_break(spark, sf):
    return _run_out(break_ties(Ctx(spark, sf).sparse_first))


def q_topic_batches(spark, sf):
    return assign_batches(Ctx(spark, sf).topics.select("qid"), SWAP["batch"])


# ------------------------------------------------------------------ feedback selection

def q_feedback_natural(spark, sf):
    fb = select_natural(Ctx(spark, sf).dense_first(), DENSE.prf_depth)
    return fb.select("qid", "fb_pos", "docid", _r("score"))


def q_feedback_random_split(spark, sf):
    return Ctx(spark, sf).dense_fb().select("qid", "fb_pos", "docid", _r("score"))


def _one_trial(spark, **kw):
    base = dict(trial_id=0, seed=42, split_num=10, nsplit=0, total_prf_docs=100, prf_depth=3, batch_size=32)
    base.update(kw)
    t = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} int" for k in base))
    return t.withColumn("positions", F.array(*[F.lit(p) for p in sample_positions(
        base["seed"], base["prf_depth"], base["total_prf_docs"], base["split_num"], base["nsplit"])]))


def _swapped(spark, c: Ctx):
    trials = _one_trial(spark, seed=SWAP["seed"], split_num=SWAP["split_num"], nsplit=SWAP["nsplit"],
                        total_prf_docs=SWAP["total"], prf_depth=SWAP["depth"], batch_size=SWAP["batch"])
    batched = assign_batches(c.topics.select("qid"), SWAP["batch"]).withColumn("batch_size", F.lit(SWAP["batch"]))
    return trials, select_swapped(c.dense_first(DENSE_K), trials, batched.select("batch_size", "qid", "batch"))


def q_feedback_swapped(spark, sf):
    return _swapped(spark, Ctx(spark, sf))[1].select("trial_id", "qid", "fb_pos", "docid", _r("score"))


def q_feedback_unsatisfied(spark, sf):
    c = Ctx(spark, sf)
    trials, fb = _swapped(spark, c)
    return sw.unsatisfied(trials, c.topics, fb)


def q_feedback_donor(spark, sf):
    c = Ctx(spark, sf)
    trials = _one_trial(spark)
    fb = select_donor(c.dense_first(DENSE_K), trials)
    return fb.select("trial_id", "qid", "fb_pos", "docid", _r("score"))


def q_ranking_overlap(spark, sf):
    c = Ctx(spark, sf)
    second = c.dense_prf_run().filter(F.col("rank") <= 10)
    return overlaps(c.dense_first(), second, ["qid", "docid"]).select("qid", "docid", "rank")


def q_prf_depth_zero(spark, sf):
    c = Ctx(spark, sf)
    s = DenseSettings(**{**DENSE.__dict__, "prf_depth": 0})
    return _run_out(dense_feedback_run(c.qv, c.corpus, s, exclude_self="qid"))


# ------------------------------------------------------------------ refinement

def q_dense_average_vec(spark, sf):
    c = Ctx(spark, sf)
    return refine_average(c.qv, attach_vectors(c.dense_fb(), c.corpus)).select("qid", round_vec("qv").alias("qv"))


def q_dense_rocchio_vec(spark, sf):
    c = Ctx(spark, sf)
    r = refine_rocchio(c.qv, attach_vectors(c.dense_fb(), c.corpus), alpha=DENSE.alpha, beta=DENSE.beta,
                       topk=DENSE.topk)
    return r.select("qid", round_vec("qv").alias("qv"))


def q_dense_rocchio_neg_vec(spark, sf):
    c = Ctx(spark, sf)
    r = refine_rocchio(c.qv, attach_vectors(c.dense_fb(), c.corpus), alpha=0.9, beta=0.1, gamma=0.1,
                       topk=2, bottomk=1)
    return r.select("qid", round_vec("qv").alias("qv"))


def q_feedback_text(spark, sf):
    c = Ctx(spark, sf)
    return refine_text(c.topics, c.sparse_fb(), c.docs, sep=" ")


def q_encode_hashed(spark, sf):
    v = encode_hashed(Ctx(spark, sf).topics, id_cols=("qid",), text="title", dim=HASH_DIM)
    return v.select("qid", round_vec("qv").alias("qv"))


def q_prf_text_dense_run(spark, sf):
    """V3 + U1 + R1: topic text plus its feedback passages' text, encoded anew, searched over the
    encoded documents (the text-based refinement flow, hashing encoder)."""
    c = Ctx(spark, sf)
    text = refine_text(c.topics, c.sparse_fb(), c.docs, sep=" ")
    qv = encode_hashed(text, id_cols=("qid",), text="title", dim=HASH_DIM)
    dv = encode_hashed(c.docs, id_cols=("docid",), text="text", dim=HASH_DIM, out="vec")
    return _run_out(topk_search(qv, dv, DENSE_K))


def q_encode_matrix(spark, sf):
    """U1 with a loaded encoder, chosen by the keyword in its name: hashed tokens times the mean vectors of the labels."""
    c = Ctx(spark, sf)
    rows = _label_means(spark, sf).orderBy("component").collect()  # a row per label
    matrix = spark.sparkContext.broadcast(np.array([r["row"] for r in rows], dtype=np.float64))
    classes = {"hashing": EncoderClass(lambda name: lambda: MatrixEncoder(np.eye(HASH_DIM))),
               "labelmean": EncoderClass(lambda name: lambda: MatrixEncoder(matrix.value)),
               "auto": EncoderClass(lambda name: lambda: MatrixEncoder(np.eye(HASH_DIM)))}
    return encode_named(c.topics, classes, "acme/LabelMean-base", prefix="query: ").select("qid", round_vec("qv").alias("qv"))


def _hash_texts(c: Ctx) -> Texts:
    return Texts(c.topics, c.docs, lambda frame, keys: encode_hashed(frame, id_cols=tuple(keys), text="title", dim=HASH_DIM))


def _encoded(c: Ctx) -> tuple[DataFrame, DataFrame]:
    """Topics and documents as hashed vectors (written once, as both searches read the documents)."""
    qv = encode_hashed(c.topics, id_cols=("qid",), text="title", dim=HASH_DIM)
    path = scratch_path(c.spark, "encoded")
    encode_hashed(c.docs, id_cols=("docid",), text="text", dim=HASH_DIM, out="vec").write.parquet(path)
    return qv, c.spark.read.parquet(path)


def q_prf_dense_text_run(spark, sf):
    """The dense command with text-based refinement (V3): both searches over the encoded documents."""
    c = Ctx(spark, sf)
    qv, dv = _encoded(c)
    s = DenseSettings(**{**DENSE.__dict__, "method": "text"})
    return _run_out(dense_feedback_run(qv, dv, s, texts=_hash_texts(c)))


def q_query_bow(spark, sf):
    return Ctx(spark, sf).bow


def q_doc_tf(spark, sf):
    return Ctx(spark, sf).index.postings.select("term", "docid", "tf")


def q_doc_bm25_weights(spark, sf):
    return Ctx(spark, sf).weights.select("term", "docid", _r("w"))


def q_feedback_mean_tf(spark, sf):
    c = Ctx(spark, sf)
    return sp.mean_feedback(c.sparse_fb(), c.vectors, mode="tf").select("qid", "term", _r("weight"))


def q_feedback_mean_bm25(spark, sf):
    c = Ctx(spark, sf)
    return sp.mean_feedback(c.sparse_fb(), c.vectors, mode="bm25", weights=c.weights).select("qid", "term",
                                                                                         _r("weight"))


def q_sparse_rocchio_terms(spark, sf):
    c = Ctx(spark, sf)
    fbv = sp.mean_feedback(c.sparse_fb(), c.vectors, mode="tf")
    return sp.refine_terms(c.bow, fbv, alpha=SPARSE.alpha, beta=SPARSE.beta).select("qid", "term", _r("weight"))


def q_collection_stats(spark, sf):
    idx = Ctx(spark, sf).index
    n_terms = idx.df.agg(F.count(F.lit(1))).scalar()
    n_post = idx.postings.agg(F.count(F.lit(1))).scalar()
    n_stop = idx.stop.agg(F.count(F.lit(1))).scalar()
    return idx.stats.select("n_docs", _r("avgdl"), n_terms.alias("n_terms"), n_post.alias("n_postings"),
                            n_stop.alias("n_stop"))


# ------------------------------------------------------------------ evaluation

def _pt_out(pt: DataFrame, metric: str) -> DataFrame:
    return pt.select("qid", _r(metric))


def q_eval_map(spark, sf):
    c = Ctx(spark, sf)
    return _pt_out(ev.per_topic(c.dense_prf_run(), c.dense_qrels, level=2), "map")


def q_eval_ndcg10(spark, sf):
    c = Ctx(spark, sf)
    return _pt_out(ev.per_topic(c.sparse_prf_run(), c.sparse_qrels, level=2), "ndcg_cut_10")


def q_eval_recall1000(spark, sf):
    c = Ctx(spark, sf)
    return _pt_out(ev.per_topic(c.sparse_first, c.sparse_qrels, level=1), "recall_1000")


def q_eval_level(spark, sf):
    c = Ctx(spark, sf)
    run = c.dense_prf_run()
    parts = [ev.evaluate(run, c.dense_qrels, level=lv).withColumn("level", F.lit(lv)) for lv in (1, 2)]
    return parts[0].unionByName(parts[1])


def q_eval_complete(spark, sf):
    c = Ctx(spark, sf)
    n = c.sparse_qrels.select("qid").distinct().agg(F.count(F.lit(1))).scalar()
    return ev.evaluate(c.sparse_prf_run(), c.sparse_qrels, level=2).select(n.alias("n_judged"), *ev.METRICS)


def q_eval_summary(spark, sf):
    c = Ctx(spark, sf)
    long = ev.metrics_long(ev.evaluate(c.dense_prf_run(), c.dense_qrels).withColumn("trial_id", F.lit(0)),
                           ["trial_id"])
    return ev.metrics_wide(long, ["trial_id"]).drop("trial_id")


# ------------------------------------------------------------------ sweeps

def _dense_sweep(spark, sf, c: Ctx | None = None):
    c = c or Ctx(spark, sf)
    trials = sw.trial_grid(spark, seed=sw.DEFAULT_SEEDS, nsplit=sw.DEFAULT_SLICES, total_prf_docs=(VECTOR_TOTAL,),
                           split_num=(10,), prf_depth=(3,), alpha=(0.4,), beta=(0.6,))
    qrels = _stored(c.dense_qrels)
    runs = sw.dense_sweep_runs(trials, c.qv, c.corpus, hits=DENSE.hits)
    return sw.evaluate_trials(runs, trials, qrels)


def q_sweep_dense(spark, sf):
    return _dense_sweep(spark, sf)


def _batches(c: Ctx, size: int) -> DataFrame:
    return assign_batches(c.topics.select("qid"), size).withColumn("batch_size", F.lit(size)).select("batch_size", "qid", "batch")


def _swapped_sweep(spark, c: Ctx):
    """Ten seeds and both slices of the small setting, in which most batches have a valid shift."""
    trials = sw.trial_grid(spark, seed=sw.DEFAULT_SEEDS, nsplit=(0, 1), total_prf_docs=(SWAP["total"],), split_num=(SWAP["split_num"],),
                           prf_depth=(SWAP["depth"],), batch_size=(SWAP["batch"],), alpha=(0.4,), beta=(0.6,), mode=("swap",))
    return trials, sw.dense_sweep(trials, c.qv, c.corpus, hits=DENSE.hits, topics_batched=_batches(c, SWAP["batch"]))


def q_sweep_dense_swapped(spark, sf):
    c = Ctx(spark, sf)
    qrels = _stored(c.dense_qrels)
    trials, sweep = _swapped_sweep(spark, c)
    return sw.evaluate_trials(sweep.runs, trials, qrels, covered=sweep.covered)


def _logged(spark, sf) -> str:
    """The small swapped sweep, logged twice: the second time changes nothing."""
    c = Ctx(spark, sf)
    qrels = _stored(c.dense_qrels)
    trials, sweep = _swapped_sweep(spark, c)
    metrics = sw.evaluate_trials(sweep.runs, trials, qrels, covered=sweep.covered).persist()
    folder = scratch_path(spark, "logs")
    for _ in range(2):
        sw.log_sweep(sweep, trials, metrics, folder, "vector_position_prf")
    metrics.unpersist()
    return folder


def q_sweep_metrics_log(spark, sf):
    """Metric rows of a sweep with project and settings, from the log."""
    log = rf.read_log(spark, f"{_logged(spark, sf)}/metrics")
    return log.select("project", "run_name", *sw.SETTINGS, "alpha", "beta", "mode", "topics", "metric", _r("value"))


def q_sweep_selection_log(spark, sf):
    """The feedback of every run and topic of a sweep, from the log."""
    log = rf.read_log(spark, f"{_logged(spark, sf)}/selections")
    return log.select("project", "run_name", "seed", "qid", "docids", "positions", "rand_prf")


def _in_sets(df: DataFrame) -> DataFrame:
    even, odd = SWAP_GRID["topics"]
    return df.withColumn("topics", F.when(F.col("qid") % 2 == 0, even).otherwise(odd))


def _swapped_grid(spark, c: Ctx):
    """The studied swapped grid, every seed, slice, total and topic set: its trials and all topics in batches of their set."""
    g = SWAP_GRID
    trials = sw.trial_grid(spark, seed=sw.DEFAULT_SEEDS, nsplit=sw.DEFAULT_SLICES, total_prf_docs=g["totals"], split_num=(g["split_num"],), topics=g["topics"],
                           prf_depth=(g["depth"],), batch_size=(g["batch"],), alpha=(0.4,), beta=(0.6,), mode=("swap",))
    topics = _in_sets(c.topics.select("qid"))
    each = [assign_batches(topics.filter(F.col("topics") == t), g["batch"]) for t in g["topics"]]
    batched = each[0].unionByName(each[1]).withColumn("batch_size", F.lit(g["batch"])).select("batch_size", "topics", "qid", "batch")
    return trials, batched


def q_sweep_dense_swapped_grid(spark, sf):
    c = Ctx(spark, sf)
    trials, batched = _swapped_grid(spark, c)
    qrels = _stored(c.dense_qrels)
    sweep = sw.dense_sweep(trials, _in_sets(c.qv), c.corpus, hits=DENSE.hits, topics_batched=batched)
    out = sw.evaluate_trials(sweep.runs, trials, qrels, covered=sweep.covered)
    return out.join(F.broadcast(trials.select("trial_id", "topics")), "trial_id")


def q_sweep_dense_swapped_unsatisfied(spark, sf):
    """Topics without a valid shift, per trial of the swapped grid."""
    c = Ctx(spark, sf)
    trials, batched = _swapped_grid(spark, c)
    fb = select_swapped(c.dense_first(max(SWAP_GRID["totals"])).persist(), trials, batched)
    return sw.unsatisfied(trials, _in_sets(c.topics.select("qid")), fb)


def q_sweep_dense_text(spark, sf):
    """The dense sweep with text-based refinement: every seed and slice, each topic's text and feedback texts encoded anew."""
    c = Ctx(spark, sf)
    trials = sw.trial_grid(spark, seed=sw.DEFAULT_SEEDS, nsplit=sw.DEFAULT_SLICES, total_prf_docs=(TEXT_TOTAL,))
    qv, dv = _encoded(c)
    sweep = sw.dense_sweep(trials, qv, dv, hits=DENSE.hits, method="text", exclude_self=None, texts=_hash_texts(c))
    return sw.evaluate_trials(sweep.runs, trials, _stored(c.sparse_qrels))


def _sparse_trials(spark, mode="random_split", totals=SPARSE_TOTALS):
    return sw.trial_grid(spark, seed=sw.DEFAULT_SEEDS, nsplit=sw.DEFAULT_SLICES, total_prf_docs=totals,
                         split_num=(10,), prf_depth=(3,), alpha=(1.0,), beta=(0.75,), mode=(mode,))


def q_sweep_sparse(spark, sf):
    c = Ctx(spark, sf)
    trials = _sparse_trials(spark)
    qrels = _stored(c.sparse_qrels)
    runs = sw.sparse_sweep_runs(trials, c.topics, c.vectors, k=SPARSE.k, first=c.sparse_first, weights=c.weights, listed=True)
    return sw.evaluate_trials(runs, trials, qrels)


def q_sweep_sparse_donor(spark, sf):
    c = Ctx(spark, sf)
    trials = _sparse_trials(spark, "donor")
    qrels = _stored(c.sparse_qrels)
    sweep = sw.sparse_sweep(trials, c.topics, c.vectors, k=SPARSE.k, first=c.sparse_first, weights=c.weights, listed=True)
    return sw.evaluate_trials(sweep.runs, trials, qrels, covered=sweep.covered)


def q_sweep_with_baseline(spark, sf):
    c = Ctx(spark, sf)
    m = _dense_sweep(spark, sf, c).select("nsplit", "seed", *ev.METRICS)
    base = sw.baseline_row(c.dense_first(DENSE.hits), c.dense_qrels).withColumn("seed", F.lit(None).cast("int"))
    return m.unionByName(base.select("nsplit", "seed", *ev.METRICS))


def q_compare_positions(spark, sf):
    c = Ctx(spark, sf)
    m = _dense_sweep(spark, sf, c)
    base = sw.baseline_row(c.dense_first(DENSE.hits), c.dense_qrels)
    return sw.compare_positions(m, base)


def q_evaluate_runs(spark, sf):
    """X6 + S9 + X4: a sweep that is broken off and taken up again.  The runs of the first slices are written as TREC text
    and committed, then the whole grid is asked for: only what is missing is searched.  The committed runs are read
    back, their settings decoded from their names, and evaluated without searching again."""
    c = Ctx(spark, sf)
    trials = sw.trial_grid(spark, seed=sw.DEFAULT_SEEDS, nsplit=sw.DEFAULT_SLICES, total_prf_docs=(VECTOR_TOTAL,))
    folder = scratch_path(spark, "runs")
    search = lambda missing: sw.dense_sweep_runs(missing, c.qv, c.corpus, hits=DENSE.hits)
    for part in (trials.filter(F.col("nsplit") < 4), trials):
        sw.resume_sweep(part, folder, search)
    parsed = rf.read_committed(spark, f"{folder}/dense/benchmark/random_split")
    qrels = c.dense_qrels.select(F.col("qid").cast("string").alias("qid"),
                                 F.col("docid").cast("string").alias("docid"), "rel")
    m = ev.evaluate(parsed, qrels, keys=("run_name",))
    return m.select("run_name", *sw.parse_run_name(F.col("run_name")), *ev.METRICS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topics_scan": q_topics_scan,
    "vectors_scan": q_vectors_scan,
    "encoded_query_lookup": q_encoded_query_lookup,
    "documents_scan": q_documents_scan,
    "qrels_scan": q_qrels_scan,
    "run_roundtrip": q_run_roundtrip,
    "run_lines": q_run_lines,
    "run_lines_msmarco": q_run_lines_msmarco,
    "selection_log": q_selection_log,
    "metrics_long": q_metrics_long,
    "feedback_short_list": q_feedback_short_list,
    "topics_prefixed": q_topics_prefixed,
    "dim_check": q_dim_check,
    "mean_pool_l2": q_mean_pool_l2,
    "dense_topk": q_dense_topk,
    "feedback_vectors": q_feedback_vectors,
    "prf_dense_rocchio_run": q_prf_dense_rocchio_run,
    "prf_dense_average_run": q_prf_dense_average_run,
    "binary_topk": q_binary_topk,
    "binary_topk_rerank": q_binary_topk_rerank,
    "pca_topk": q_pca_topk,
    "bm25_topk": q_bm25_topk,
    "prf_sparse_rocchio_run": q_prf_sparse_rocchio_run,
    "prf_sparse_from_run": q_prf_sparse_from_run,
    "dense_topk_single": q_dense_topk_single,
    "max_passage": q_max_passage,
    "tie_break": q_tie_break,
    "topic_batches": q_topic_batches,
    "feedback_natural": q_feedback_natural,
    "feedback_random_split": q_feedback_random_split,
    "feedback_swapped": q_feedback_swapped,
    "feedback_unsatisfied": q_feedback_unsatisfied,
    "feedback_donor": q_feedback_donor,
    "ranking_overlap": q_ranking_overlap,
    "prf_depth_zero": q_prf_depth_zero,
    "dense_average_vec": q_dense_average_vec,
    "dense_rocchio_vec": q_dense_rocchio_vec,
    "dense_rocchio_neg_vec": q_dense_rocchio_neg_vec,
    "feedback_text": q_feedback_text,
    "encode_hashed": q_encode_hashed,
    "encode_matrix": q_encode_matrix,
    "prf_text_dense_run": q_prf_text_dense_run,
    "prf_dense_text_run": q_prf_dense_text_run,
    "query_bow": q_query_bow,
    "doc_tf": q_doc_tf,
    "doc_bm25_weights": q_doc_bm25_weights,
    "feedback_mean_tf": q_feedback_mean_tf,
    "feedback_mean_bm25": q_feedback_mean_bm25,
    "sparse_rocchio_terms": q_sparse_rocchio_terms,
    "collection_stats": q_collection_stats,
    "eval_map": q_eval_map,
    "eval_ndcg10": q_eval_ndcg10,
    "eval_recall1000": q_eval_recall1000,
    "eval_level": q_eval_level,
    "eval_complete": q_eval_complete,
    "eval_summary": q_eval_summary,
    "sweep_dense": q_sweep_dense,
    "sweep_dense_swapped": q_sweep_dense_swapped,
    "sweep_dense_swapped_grid": q_sweep_dense_swapped_grid,
    "sweep_dense_swapped_unsatisfied": q_sweep_dense_swapped_unsatisfied,
    "sweep_dense_text": q_sweep_dense_text,
    "sweep_metrics_log": q_sweep_metrics_log,
    "sweep_selection_log": q_sweep_selection_log,
    "sweep_sparse": q_sweep_sparse,
    "sweep_sparse_donor": q_sweep_sparse_donor,
    "sweep_with_baseline": q_sweep_with_baseline,
    "compare_positions": q_compare_positions,
    "evaluate_runs": q_evaluate_runs,
}
