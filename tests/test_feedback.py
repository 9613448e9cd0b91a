import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from fbrank import catalog as cat
from fbrank.functions.positions import sample_positions
from fbrank.operators import feedback
from fbrank.operators.feedback import select_donor, select_positions, select_swapped, validate_trials
from fbrank.operators.search import assign_batches
from fbrank.plans.sweep import trial_grid


def test_short_list_drops_absent_positions(spark):
    run = spark.createDataFrame([(1, d, float(-d), d) for d in range(1, 6)], "qid long, docid long, score double, rank int")
    fb = select_positions(run, [1, 3, 9]).orderBy("fb_pos").collect()
    assert [(r["fb_pos"], r["docid"]) for r in fb] == [(0, 2), (1, 4)]


def test_validate_trials_reports_bad_cells(spark):
    grid = trial_grid(spark, seed=(42,), nsplit=(0, 10, -1), total_prf_docs=(100,), prf_depth=(3, 11))
    reasons = {(r["nsplit"], r["prf_depth"]): r["reason"] for r in validate_trials(grid).collect()}
    assert reasons[(10, 3)] == "slice beyond the last one"
    assert reasons[(-1, 3)] == "negative nsplit"
    assert reasons[(0, 11)] == "sample larger than slice"
    assert (0, 3) not in reasons


def _first(spark):
    return cat.Ctx(spark, SF001).dense_first(cat.DENSE_K).persist()


def test_swapped_is_bijection_and_disjoint(spark):
    c = cat.Ctx(spark, SF001)
    first = _first(spark)
    trials = cat._one_trial(spark, seed=42, split_num=2, nsplit=0, total_prf_docs=20, prf_depth=3, batch_size=5)
    batched = assign_batches(c.topics.select("qid"), 5).withColumn("batch_size", F.lit(5))
    fb = select_swapped(first, trials, batched.select("batch_size", "qid", "batch")).persist()
    own = first.filter("rank <= 20").select("qid", "docid")
    assert fb.join(own, ["qid", "docid"]).count() == 0  # nobody receives a doc of its own top-20
    recipients = fb.select("qid").distinct().count()
    assert recipients == c.topics.count()
    # each topic's own chosen set is given to exactly one recipient (bijection within batches)
    chosen = select_positions(first, [p for p in __import__("fbrank.functions.positions", fromlist=["x"])
                                      .sample_positions(42, 3, 20, 2, 0)])
    sets_given = fb.groupBy("qid").agg(F.array_sort(F.collect_list("docid")).alias("s"))
    sets_own = chosen.groupBy("qid").agg(F.array_sort(F.collect_list("docid")).alias("s"))
    assert sorted(r["s"] for r in sets_given.collect()) == sorted(r["s"] for r in sets_own.collect())


def test_swapped_unsatisfiable_batch_gets_no_rows(spark):
    c = cat.Ctx(spark, SF001)
    first = _first(spark)
    trials = cat._one_trial(spark, seed=42, split_num=2, nsplit=0, total_prf_docs=20, prf_depth=3, batch_size=1)
    batched = assign_batches(c.topics.select("qid"), 1).withColumn("batch_size", F.lit(1))
    assert select_swapped(first, trials, batched.select("batch_size", "qid", "batch")).count() == 0


def test_donor_disjoint_and_not_self(spark):
    first = _first(spark)
    trials = cat._one_trial(spark)
    fb = select_donor(first, trials).persist()
    own = first.filter("rank <= 100").select("qid", "docid")
    assert fb.join(own, ["qid", "docid"]).count() == 0
    assert fb.select("qid").distinct().count() == first.select("qid").distinct().count()


def _random_case(seed, n_topics, universe, longest):
    rng = random.Random(seed)
    run = [(q, d, float(-r), r) for q in range(0, 3 * n_topics, 3) for r, d in enumerate(rng.sample(range(universe), rng.randint(1, longest)), start=1)]
    trials = []
    for t, (s, nsplit, total) in enumerate(itertools.product((42, 9, 51), (0, 1, 4), (10, 30))):
        trials.append((t, s, total, 2, sample_positions(s, 2, total, 5, nsplit), rng.choice([1, 4, 7, 100])))
    return run, trials


def _own(run, q, total):
    return {d for x, d, _, r in run if x == q and r <= total}


def _chosen(run, q, pos):
    return [d for x, d, _, r in sorted(run, key=lambda y: y[3]) if x == q and r - 1 in pos]


def _key(seed, q):
    return hashlib.md5(f"{seed}:{q}".encode()).hexdigest()


def slow_swapped(run, trials):
    out = set()
    topics = sorted({r[0] for r in run})
    for t, seed, total, _, pos, size in trials:
        for b in range(0, len(topics), size):
            batch = sorted(topics[b:b + size], key=lambda q: _key(seed, q))
            n = len(batch)
            for shift in range(1, n):
                if all(not _own(run, q, total) & set(_chosen(run, batch[(i + shift) % n], pos)) for i, q in enumerate(batch)):
                    out |= {(t, q, k, d) for i, q in enumerate(batch) for k, d in enumerate(_chosen(run, batch[(i + shift) % n], pos))}
                    break
    return out


def slow_donors(run, trials):
    out = set()
    topics = sorted({r[0] for r in run})
    n = len(topics)
    for t, seed, total, _, pos, _ in trials:
        has = {q for q in topics if _chosen(run, q, pos)}
        for i, q in enumerate(topics):
            if q not in has or n < 2:
                continue
            start = (i - 1 - int(_key(seed, q)[:8], 16) % (n - 1)) % n
            for step in range(n):
                d = topics[(start - step) % n]
                if d != q and d in has and not _own(run, q, total) & set(_chosen(run, d, pos)):
                    out |= {(t, q, k, x) for k, x in enumerate(_chosen(run, d, pos))}
                    break
    return out


@pytest.mark.parametrize("case", [(1, 23, 60, 30), (2, 40, 400, 40), (3, 1, 9, 9), (4, 12, 13, 12), (5, 30, 3000, 12)])
def test_swaps_and_donors_equal_trying_every_shift(spark, case, monkeypatch):
    monkeypatch.setattr(feedback, "RING_CHUNK", 5)
    run, trials = _random_case(*case)
    first = spark.createDataFrame(run, "qid long, docid long, score double, rank int")
    grid = spark.createDataFrame(trials, "trial_id int, seed int, total_prf_docs int, depth int, positions array<int>, batch_size int")
    topics = sorted({r[0] for r in run})
    batched = spark.createDataFrame([(size, q, i // size) for size in {t[5] for t in trials} for i, q in enumerate(topics)], "batch_size int, qid long, batch int")
    rows = lambda df: {(r.trial_id, r.qid, r.fb_pos, r.docid) for r in df.collect()}
    assert rows(select_swapped(first, grid, batched)) == slow_swapped(run, trials)
    assert rows(select_donor(first, grid)) == slow_donors(run, trials)


def test_swap_plan_has_no_rounds(spark):
    plans = []
    for n in (8, 64):
        run, trials = _random_case(1, n, 10 * n, 10)
        first = spark.createDataFrame(run, "qid long, docid long, score double, rank int")
        grid = spark.createDataFrame([t[:5] + (n,) for t in trials], "trial_id int, seed int, total_prf_docs int, depth int, positions array<int>, batch_size int")
        batched = spark.createDataFrame([(n, 3 * i, 0) for i in range(n)], "batch_size int, qid long, batch int")
        plans.append(select_swapped(first, grid, batched)._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert plans[0] == plans[1] < 40
