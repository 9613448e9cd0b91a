"""Experiments over many settings X1-X8: a whole grid of trials as ONE Spark job.

Trials are rows; ``trial_id`` is carried through every join, window and aggregate.  The first
ranking is computed once per topic set and shared by all trials (the studied scripts redo it
per trial).  Seeded positions are part of the grid, which is configuration; everything else is
DataFrame joins, windows and the search kernels.

A topics frame may have a column ``topics``: the name of the topic set each topic is in.  A trial
then covers the topics of its own set, otherwise all.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fbrank.functions.positions import sample_positions
from fbrank.operators import sparse as sp
from fbrank.operators.evaluate import METRICS, evaluate, metrics_long
from fbrank.operators.feedback import select_donor, select_for_trials, select_swapped, selection_log
from fbrank.operators.refine import attach_vectors, refine_average
from fbrank.operators.search import topk_search
from fbrank.plans.dense import Texts
from fbrank.session import cut_lineage
from fbrank.sources.runs import commit_runs, committed_runs, write_metrics, write_selections

# Default grid of the studied sweeps (fixed values).
DEFAULT_SEEDS = (42, 51, 10, 23, 34, 65, 78, 86, 97, 9)
DEFAULT_SLICES = tuple(range(10))

GRID_COLUMNS = ("seed", "split_num", "nsplit", "total_prf_docs", "prf_depth", "topics", "batch_size",
                "alpha", "beta", "mode")
_TYPES = {"seed": T.IntegerType(), "split_num": T.IntegerType(), "nsplit": T.IntegerType(),
          "total_prf_docs": T.IntegerType(), "prf_depth": T.IntegerType(), "topics": T.StringType(),
          "batch_size": T.IntegerType(), "alpha": T.DoubleType(), "beta": T.DoubleType(), "mode": T.StringType()}


def trial_grid(spark: SparkSession, *, seed: Sequence[int] = DEFAULT_SEEDS, split_num: Sequence[int] = (10,),
               nsplit: Sequence[int] = DEFAULT_SLICES, total_prf_docs: Sequence[int] = (100,),
               prf_depth: Sequence[int] = (3,), topics: Sequence[str] = ("benchmark",),
               batch_size: Sequence[int] = (32,), alpha: Sequence[float] = (0.4,), beta: Sequence[float] = (0.6,),
               mode: Sequence[str] = ("random_split",)) -> DataFrame:
    """Cross product of the parameter lists, ``trial_id`` in grid order.

    The grid is configuration built on the driver from the literal lists, so the seeded
    positions of each cell (F2) are computed there too: the first ones for mode 'natural' (F1),
    none at depth 0 (F7).  Invalid cells get NULL positions; sweeps refuse them (P6)."""
    lists = [seed, split_num, nsplit, total_prf_docs, prf_depth, topics, batch_size, alpha, beta, mode]
    rows = []
    for i, cell in enumerate(itertools.product(*lists)):
        conf = dict(zip(GRID_COLUMNS, cell))
        try:
            pos = list(range(max(conf["prf_depth"], 0))) if conf["mode"] == "natural" else sample_positions(conf["seed"], conf["prf_depth"], conf["total_prf_docs"], conf["split_num"],
                                   conf["nsplit"])
        except ValueError:
            pos = None
        rows.append((i, *cell, pos))
    schema = T.StructType([T.StructField("trial_id", T.IntegerType(), False)]
                          + [T.StructField(c, _TYPES[c], False) for c in GRID_COLUMNS]
                          + [T.StructField("positions", T.ArrayType(T.IntegerType()), True)])
    return spark.createDataFrame(rows, schema)


def run_name(trials: DataFrame) -> Column:
    """Run.<total>.<split>.<depth>.<nsplit>.<seed>.trec"""
    return F.concat_ws(".", F.lit("run"), *[F.col(c).cast("string") for c in
                                            ("total_prf_docs", "split_num", "prf_depth", "nsplit", "seed")],
                       F.lit("trec"))


def assert_unique_names(trials: DataFrame) -> None:
    """Two trials of one name would mix their lines in one run; the grid is configuration."""
    names = [r[0] for r in trials.select(run_name(trials)).collect()]
    if len(set(names)) < len(names):
        raise ValueError("trials share run names; write them to a folder per method, topics and mode")


def parse_run_name(name: Column) -> list[Column]:
    """Decode run.<total>.<split>.<depth>.<nsplit>.<seed>.trec into integer settings."""
    parts = F.split(name, r"\.")
    return [parts.getItem(i).cast("int").alias(c) for i, c in
            enumerate(["total_prf_docs", "split_num", "prf_depth", "nsplit", "seed"], start=1)]


def project_name(method: str, topics: Column, total: Column, mode: Column | None = None) -> Column:
    """X8 (with the selection mode added, T14)."""
    parts = [F.lit(method), topics, total.cast("string")]
    if mode is not None:
        parts.append(mode)
    return F.concat_ws("_", *parts)


def _checked(trials: DataFrame, modes: Sequence[str]) -> DataFrame:
    """The grid, kept for the sweep; an unknown mode or a cell that cannot run is an error."""
    unknown = [r[0] for r in trials.select("mode").distinct().collect() if r[0] not in modes]
    if unknown:
        raise ValueError(f"unknown selection modes {unknown}; this sweep knows {list(modes)}")
    bad = trials.filter(F.col("positions").isNull()).select("trial_id").limit(5).collect()
    if bad:
        raise ValueError(f"trials that cannot run (see validate_trials): {[r[0] for r in bad]}")
    return trials.persist()


def _of_mode(trials: DataFrame, *modes: str) -> DataFrame:
    return trials.filter(F.col("mode").isin(*modes))


@dataclass(frozen=True)
class Sweep:
    """A sweep's runs (trial_id, qid, docid, score, rank), the topics that its trials cover (trial_id, qid) and
    the feedback they were given (trial_id, qid, fb_pos, docid, score)."""

    runs: DataFrame
    covered: DataFrame
    feedback: DataFrame


def _each(trials: DataFrame, topics: DataFrame) -> DataFrame:
    """Every trial with every topic of its set: the topics' columns and trial_id, alpha, beta, prf_depth, mode."""
    own = trials.select("trial_id", "alpha", "beta", "prf_depth", "mode", "topics")
    if "topics" in topics.columns:
        return topics.join(F.broadcast(own), "topics").drop("topics")
    ids = [r[0] for r in trials.select("trial_id").collect()]  # the grid is configuration
    return topics.withColumn("trial_id", F.explode(F.lit(ids).cast("array<int>"))).join(F.broadcast(own.drop("topics")), "trial_id")


def _trial_topics(trials: DataFrame, topics: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every trial with the topics it covers: topics without feedback keep their query (T9, T15).  Swapped and donor
    trials only have the topics for which a valid donor was found (T4; ``unsatisfied`` lists the others)."""
    some = feedback.select("trial_id", "qid").distinct().withColumn("_some", F.lit(True))
    return (_each(trials, topics).join(some, ["trial_id", "qid"], "left")
            .filter(~F.col("mode").isin("swap", "donor") | F.col("_some")).drop("_some"))


def unsatisfied(trials: DataFrame, topics: DataFrame, feedback: DataFrame) -> DataFrame:
    """(trial_id, qid) of topics for which a swapped or donor trial found no valid donor."""
    if "topics" in topics.columns:
        each = topics.join(F.broadcast(trials.select("trial_id", "topics")), "topics")
    else:
        ids = [r[0] for r in trials.select("trial_id").collect()]
        each = topics.withColumn("trial_id", F.explode(F.lit(ids).cast("array<int>")))
    return each.select("trial_id", "qid").join(feedback.select("trial_id", "qid").distinct(), ["trial_id", "qid"], "left_anti")


def _feedback(first: DataFrame, trials: DataFrame, pick: str, picked) -> DataFrame:
    """Feedback of all trials: by position, and for mode ``pick`` by the function ``picked``."""
    fb = select_for_trials(first, _of_mode(trials, "random_split", "natural"))
    return fb.unionByName(picked(first, _of_mode(trials, pick))) if not _of_mode(trials, pick).isEmpty() else fb


def dense_sweep(trials: DataFrame, queries: DataFrame, corpus: DataFrame, *, hits: int = 1000,
                method: str = "rocchio", exclude_self: str | None = "qid",
                topics_batched: DataFrame | None = None, texts: Texts | None = None) -> Sweep:
    """X2 (dense): the second ranking of every (trial_id, qid); ``mode`` per trial row is
    'random_split' (F3), 'natural' (F1) or 'swap' (F4, needs ``topics_batched``); ``method`` is
    'rocchio', 'avg' or 'text' (V3, needs ``texts``)."""
    if method not in ("rocchio", "avg", "text") or method == "text" and texts is None:
        raise ValueError(f"unknown refinement {method!r}, or no texts for it")
    trials = _checked(trials, ("random_split", "natural", "swap"))
    max_total = trials.agg(F.max(F.greatest("total_prf_docs", "prf_depth"))).first()[0]
    first = topk_search(queries, corpus, max_total, exclude_self=exclude_self).persist()
    fb = _feedback(first, trials, "swap", lambda f, t: select_swapped(f, t, topics_batched))
    keys = ("trial_id", "qid")
    kept = [c for c in ("qid", "qv", "topics") if c in queries.columns]
    tq = _trial_topics(trials, queries.select(*kept), fb)
    if method == "rocchio":
        refined = _rocchio_per_trial(tq, attach_vectors(fb, corpus))
    elif method == "avg":
        refined = refine_average(tq.select(*keys, "qv"), attach_vectors(fb, corpus), keys=keys)
    else:
        given = tq.filter("prf_depth > 0").select(*keys).join(texts.topics.select("qid", "title"), "qid")
        plain = tq.filter("prf_depth <= 0").select(*keys, F.col("qv").cast("array<double>").alias("qv"))
        refined = texts.refined(fb, keys, topics=given).unionByName(plain)
    runs = topk_search(refined, corpus, hits, keys=keys, exclude_self=exclude_self)
    return Sweep(runs, tq.select(*keys), fb)


def dense_sweep_runs(trials: DataFrame, queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """The runs of ``dense_sweep`` alone."""
    return dense_sweep(trials, queries, corpus, **options).runs


def _rocchio_per_trial(tq: DataFrame, fbv: DataFrame) -> DataFrame:
    """V2 with per-trial alpha/beta and topk = depth."""
    from fbrank.functions.vectors import as_double_array, sum_vectors

    g = (fbv.groupBy("trial_id", "qid")
         .agg(F.array_sort(F.collect_list(F.struct("fb_pos", as_double_array("vec").alias("v")))).alias("_fb")))
    j = tq.join(g, ["trial_id", "qid"], "left").withColumn("_fb", F.coalesce("_fb", F.array()))
    q = as_double_array("qv")
    pos_v = F.transform(F.slice("_fb", 1, F.greatest(F.col("prf_depth"), F.lit(1))), lambda x: x["v"])
    mean = F.transform(sum_vectors(pos_v, F.size(q)), lambda x: x / F.greatest(F.size(pos_v), F.lit(1)))
    out = F.when(F.col("prf_depth") > 0, F.zip_with(q, mean, lambda a, b: F.col("alpha") * a + F.col("beta") * b)).otherwise(q)
    return j.select("trial_id", "qid", out.alias("qv"))


def sparse_sweep(trials: DataFrame, topics: DataFrame, index: sp.Index, *, k: int = 1000,
                 first: DataFrame | None = None, weights: DataFrame | None = None, method: str = "linear", listed: bool = False) -> Sweep:
    """X2 (sparse): BM25 + Rocchio terms per (trial_id, qid); mode 'random_split', 'natural' or 'donor' (F5).

    ``method='linear'`` scores all trials from shared per-document score rows
    (``rocchio_sweep_search``); ``method='terms'`` builds every refined term vector and searches it.  With ``listed`` the runs may come
    as a row per trial and topic with its hits in a list, which ``evaluate`` takes as well."""
    trials = _checked(trials, ("random_split", "natural", "donor"))
    w = weights if weights is not None else sp.doc_weights(index).persist()
    # what several frames read is computed once, and their plans start from there
    bow = cut_lineage(sp.query_bow(topics, index))
    if first is None:
        first = sp.bm25_search(bow, index, k, weights=w)
    first = cut_lineage(first)
    fb = cut_lineage(_feedback(first, trials, "donor", select_donor))
    keys = ("trial_id", "qid")
    kept = [c for c in ("qid", "topics") if c in topics.columns]
    tq = cut_lineage(_trial_topics(trials, topics.select(*kept), fb).withColumn(
        "alpha", F.when(F.col("prf_depth") > 0, F.col("alpha")).otherwise(1.0)))
    covered = tq.select(*keys)
    if method == "linear":
        lists = fb.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fb_pos", "docid"))).alias("_fb"))
        none = F.array().cast(f"array<{fb.schema['docid'].dataType.simpleString()}>")
        specs = tq.join(lists, list(keys), "left").select(
            *keys, "alpha", "beta", F.coalesce(F.transform("_fb", lambda x: x["docid"]), none).alias("fb"))
        return Sweep(sp.rocchio_sweep_search(specs, bow, index, w, k, listed=listed), covered, fb)
    fbv = sp.mean_feedback(fb, index, keys=keys)
    q_terms = tq.join(bow, "qid").select("trial_id", "qid", "term", (F.col("weight") * F.col("alpha")).alias("weight"))
    f_terms = fbv.join(F.broadcast(trials.select("trial_id", "beta")), "trial_id").select(
        "trial_id", "qid", "term", (F.col("weight") * F.col("beta")).alias("weight"))
    terms = (q_terms.filter("weight > 0").unionByName(f_terms.filter("weight > 0"))
             .groupBy(*keys, "term").agg(F.sum("weight").alias("weight")))
    return Sweep(sp.bm25_search(terms, index, k, keys=keys, weights=w), covered, fb)


def sparse_sweep_runs(trials: DataFrame, topics: DataFrame, index: sp.Index, **options) -> DataFrame:
    """The runs of ``sparse_sweep`` alone."""
    return sparse_sweep(trials, topics, index, **options).runs


SETTINGS = ("seed", "nsplit", "total_prf_docs", "split_num", "prf_depth")


def evaluate_trials(runs: DataFrame, trials: DataFrame, qrels: DataFrame, *, level: int = 2, covered: DataFrame | None = None) -> DataFrame:
    """Metrics per trial (every trial reported), with its settings and run name.

    With ``covered`` (trial_id, qid) there is one more column, ``n_topics``: a trial without any covered topic,
    as a swap or donor trial without a valid donor, has null metrics, not zeros."""
    m = evaluate(runs, qrels, level=level, keys=("trial_id",), key_values=trials)
    out = trials.select("trial_id", *SETTINGS, run_name(trials).alias("run_name")).join(m, "trial_id")
    if covered is None:
        return out
    n = covered.groupBy("trial_id").agg(F.count_distinct("qid").alias("n_topics"))
    out = out.join(n, "trial_id", "left").withColumn("n_topics", F.coalesce("n_topics", F.lit(0)))
    return out.select(*[F.when(F.col("n_topics") > 0, F.col(c)).alias(c) if c in METRICS else c for c in out.columns])


def log_sweep(sweep: Sweep, trials: DataFrame, metrics: DataFrame, folder: str, method: str) -> None:
    """The sweep's selections and metrics, under the project of each trial (method, topics, total, mode), to
    ``folder/selections`` and ``folder/metrics``.  A run that is logged again replaces its own rows."""
    named = trials.withColumn("project", project_name(method, F.col("topics"), F.col("total_prf_docs"), F.col("mode"))).withColumn("run_name", run_name(trials))
    own = F.broadcast(named.select("trial_id", "project", "run_name"))
    swapped = F.broadcast(named.select("trial_id", F.col("mode").isin("swap", "donor").alias("rand_prf")))
    log = selection_log(sweep.feedback, trials).drop("rand_prf").join(swapped, "trial_id").join(own, "trial_id")
    write_selections(log.drop("trial_id"), f"{folder}/selections")
    long = metrics_long(metrics, ["trial_id"]).join(F.broadcast(named.select("trial_id", "project", "run_name", *SETTINGS, "alpha", "beta", "mode", "topics")), "trial_id")
    write_metrics(long.drop("trial_id"), f"{folder}/metrics")


def run_folder(trials: DataFrame, method: str) -> Column:
    """A trial's folder below the place of all runs: method, topics and mode."""
    return F.concat_ws("/", F.lit(method), "topics", "mode")


def resume_sweep(trials: DataFrame, folder: str, search: Callable[[DataFrame], DataFrame], method: str = "dense", *, tag: str = "Faiss") -> list[str]:
    """Runs the trials whose run isn't committed yet, and commits them; returns the names of the runs searched.

    ``search`` gives the runs (trial_id, qid, docid, score, rank) of the trials it is passed; with nothing missing it isn't called.  Runs of
    one method, topic set and mode have a folder of their own below ``folder``, in which names are unique."""
    spark = trials.sparkSession
    named = trials.withColumn("run_name", run_name(trials)).withColumn("_at", run_folder(trials, method))
    done: list[str] = []
    for at in sorted(r[0] for r in named.select("_at").distinct().collect()):  # the grid is configuration
        mine = named.filter(F.col("_at") == at).drop("_at")
        assert_unique_names(mine.drop("run_name"))
        missing = mine.join(committed_runs(spark, f"{folder}/{at}"), "run_name", "left_anti").persist()
        names = sorted(r[0] for r in missing.select("run_name").collect())
        if names:
            runs = search(missing.drop("run_name"))
            commit_runs(runs.join(F.broadcast(missing.select("trial_id", "run_name")), "trial_id"), missing.select("run_name"), f"{folder}/{at}", tag)
            done += [f"{at}/{n}" for n in names]
        missing.unpersist()
    return done


def baseline_row(run: DataFrame, qrels: DataFrame, *, level: int = 2) -> DataFrame:
    """An outside run evaluated as pseudo-slice nsplit = 999."""
    m = evaluate(run, qrels, level=level)
    return m.select(F.lit(999).alias("nsplit"), *METRICS)


def compare_positions(metrics: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Quality by slice across seeds; gain over the baseline when given."""
    agg = []
    for m in METRICS:
        agg += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.min(m), 6).alias(f"{m}_min"),
                F.round(F.max(m), 6).alias(f"{m}_max"), F.round(F.stddev_samp(m), 6).alias(f"{m}_std")]
    out = metrics.groupBy("nsplit").agg(F.count(F.lit(1)).alias("n_trials"), *agg)
    if baseline is not None:
        for m in METRICS:
            out = out.withColumn(f"{m}_gain", F.round(F.col(f"{m}_mean") - baseline.select(m).scalar(), 6))
    return out
