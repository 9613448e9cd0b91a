import numpy as np
import pytest
from pyspark.sql import functions as F

from fbrank.operators import sparse as sp
from fbrank.operators import search
from fbrank.operators.search import binary_search, break_ties, max_passage, topk_search


def _brute(Q, C, ids, k, exclude=None, qids=None):
    out = {}
    for i, q in enumerate(Q):
        s = C @ q
        order = sorted(range(len(ids)), key=lambda j: (-round(float(s[j]), 9), ids[j]))
        if exclude is not None:
            order = [j for j in order if ids[j] != qids[i]]
        out[int(qids[i])] = [int(ids[j]) for j in order[:k]]
    return out


# scanned in 1, 3 or 5 partitions by 1 to 3 blocks of queries, or (no bytes for a broadcast) in shuffled groups
LAYOUTS = [(1, dict(blocks=1)), (3, dict(blocks=2)), (5, dict(blocks=1)), (4, dict(blocks=3)), (2, dict()), (3, dict(query_bytes=0))]


@pytest.mark.parametrize("parts,layout", LAYOUTS)
def test_topk_matches_brute_force(spark, parts, layout):
    rng = np.random.default_rng(7)
    C = rng.normal(size=(97, 8)).round(2)
    C[10] = C[11]  # exact tie: docid order decides
    Q = C[[0, 10, 20, 30]]
    ids = list(range(97))
    qids = [0, 10, 20, 30]
    corpus = spark.createDataFrame([(i, C[i].tolist()) for i in ids], "docid long, vec array<double>").repartition(parts)
    queries = spark.createDataFrame([(q, C[q].tolist()) for q in qids], "qid long, qv array<double>")
    got = topk_search(queries, corpus, 7, exclude_self="qid", **layout)
    res = {}
    for r in got.orderBy("qid", "rank").collect():
        res.setdefault(r["qid"], []).append(r["docid"])
    assert res == _brute(Q, C, ids, 7, exclude=True, qids=qids)
    ranks = [r["rank"] for r in got.filter("qid = 0").orderBy("rank").collect()]
    assert ranks == list(range(1, 8))


def test_topk_plan_has_partial_and_final_window_limit(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "docid long, vec array<double>")
    queries = spark.createDataFrame([(100, [1.0, 0.0])], "qid long, qv array<double>")
    plan = topk_search(queries, corpus, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CrossJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_binary_search_hamming_and_rerank(spark):
    vecs = {1: [1.0, 1.0, 1.0, 1.0], 2: [1.0, 1.0, 1.0, -1.0], 3: [-1.0, -1.0, -1.0, -1.0], 4: [0.5, 0.2, 0.1, 0.3]}
    corpus = spark.createDataFrame(list(vecs.items()), "docid long, vec array<double>")
    q = spark.createDataFrame([(0, [0.9, 0.1, 0.5, 0.2])], "qid long, qv array<double>")
    hits = binary_search(q, corpus, 3, 3).orderBy("rank").collect()
    assert [r["docid"] for r in hits] == [1, 4, 2]
    assert [r["score"] for r in hits] == [0.0, 0.0, -1.0]
    rr = binary_search(q, corpus, 3, 2, rerank=True).orderBy("rank").collect()
    assert [r["docid"] for r in rr] == [1, 4]


def test_max_passage_keeps_best_passage(spark):
    hits = spark.createDataFrame([(1, "7#0", 0.9, 1), (1, "7#3", 0.8, 2), (1, "8#1", 0.7, 3)],
                                 "qid long, docid string, score double, rank int")
    out = [(r["docid"], r["rank"]) for r in max_passage(hits, max_hits=5).orderBy("rank").collect()]
    assert out == [("7", 1), ("8", 2)]


def test_break_ties_lowers_later_equal_scores(spark):
    hits = spark.createDataFrame([(1, 5, 6.2279, 1), (1, 9, 6.2279, 2), (1, 2, 6.1, 3)],
                                 "qid long, docid long, score double, rank int")
    out = [(r["docid"], round(r["score"], 6)) for r in break_ties(hits).orderBy("rank").collect()]
    assert out == [(5, 6.2279), (9, 6.227899), (2, 6.1)]


def test_break_ties_never_meets_the_next_score(spark):
    hits = spark.createDataFrame([(1, i, s, i) for i, s in enumerate([3e-6, 3e-6, 2e-6, 2e-6], 1)], "qid long, docid long, score double, rank int")
    out = [r["score"] for r in break_ties(hits).orderBy("rank").collect()]
    assert out == [3e-6, 2e-6, 1e-6, 0.0]


def test_bm25_matches_closed_form(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "banana pie"), (3, "cherry tart"), (4, "dune")],
                                 "docid long, text string")
    idx = sp.build_index(docs)
    q = spark.createDataFrame([(1, "apple", 1.0)], "qid long, term string, weight double")
    got = sp.bm25_search(q, idx, 10).collect()
    n, df, tf, dl = 4, 1, 2, 3
    avgdl = (3 + 2 + 2 + 1) / 4
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    want = idf * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))
    assert [(r["docid"], r["rank"]) for r in got] == [(1, 1)]
    assert got[0]["score"] == pytest.approx(want)


def test_bm25_join_plan_stays_in_jvm(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "banana pie")], "docid long, text string")
    idx = sp.build_index(docs)
    q = spark.createDataFrame([(1, "apple", 1.0)], "qid long, term string, weight double")
    plan = sp.bm25_search(q, idx, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bm25_equals_plain_python(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(8)
    texts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 12))] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "docid long, text string")
    terms = [(q, t, w) for q in range(6) for t in rng.sample("abcdefghijklmnopz", 4) for w in (rng.choice([0.5, 1.0, 2.5, -1.0]),)] + [(0, "", 3.0)]
    df = Counter(t for x in texts for t in set(x))
    stop = {t for t, n in df.items() if n > len(texts) / 2}
    kept = [Counter(t for t in x if t not in stop) for x in texts]
    avg = sum(sum(c.values()) for c in kept) / len(kept)
    got = sorted((r.qid, r["rank"], r.docid, round(r.score, 9)) for r in sp.bm25_search(spark.createDataFrame(terms, "qid long, term string, weight double"), sp.build_index(docs), 7).collect())
    want = []
    for q in range(6):
        score = {}
        for _, t, w in (x for x in terms if x[0] == q and x[2] > 0 and x[1] and x[1] not in stop):
            idf = math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5))
            for i, c in enumerate(kept):
                if c[t]:
                    score[i] = score.get(i, 0) + w * idf * c[t] / (c[t] + 0.9 * (0.6 + 0.4 * sum(c.values()) / avg))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
        want += [(q, r, i, round(v, 9)) for r, (i, v) in enumerate(best, 1)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


@pytest.mark.parametrize("layout", [dict(), dict(UNIT_CELLS=400, PAIR_BUDGET=500, CELL_BUDGET=300, SHARD_DOCS=20, DENSE_TERM_CELLS=600), dict(UNIT_CELLS=1)])
def test_rocchio_sweep_linear_equals_terms(spark, layout, monkeypatch):
    from conftest import SF001
    from fbrank import catalog as cat
    from fbrank.plans import sweep as sw

    for name, value in layout.items():
        monkeypatch.setattr(sp, name, value)
    c = cat.Ctx(spark, SF001)
    trials = sw.trial_grid(spark, seed=(42, 9), nsplit=(0, 3), alpha=(1.0, 0.0), beta=(0.75,))
    lin = sw.sparse_sweep_runs(trials, c.topics, c.index, k=1000, first=c.sparse_first, weights=c.weights)
    ter = sw.sparse_sweep_runs(trials, c.topics, c.index, k=1000, first=c.sparse_first, weights=c.weights,
                               method="terms")
    got, want = ({(r.trial_id, r.qid, r.docid): r.score for r in x.collect()} for x in (lin, ter))  # every matching document
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), rtol=1e-11)


def test_a_sweep_block_is_scored_in_bounded_pieces(monkeypatch):
    """One shard, two topics, many trials: whatever the budgets, the hits are those of whole dense products."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    post = [(f"t{t}", d, float(rng.random() + 0.1)) for t in range(40) for d in range(50) if rng.random() < (0.7 if t < 5 else 0.1)]
    shard_rows = pa.table({"term": [p[0] for p in post], "docid": [p[1] for p in post], "w": [p[2] for p in post]})
    W = np.zeros((40, 50))
    for t, d, w in post:
        W[int(t[1:]), d] = w
    U = (rng.random((12, 40)) < 0.2) * 1.0
    rows = [dict(_kind=1, qid=q, term=f"t{t}", weight=1.0) for q in (0, 1) for t in range(q, 40, 7)]
    rows += [dict(_kind=2, f=f, term=f"t{t}", weight=U[f, t]) for f in range(12) for t in range(40) if U[f, t]] + [dict(_kind=2, f=3, term="unseen", weight=1.0)]
    specs = [(t, q, [0.0, 0.5, 1.0][t % 3], 0.75, rng.choice(13, size=t % 4, replace=False).tolist()) for t in range(30) for q in (0, 1, 2)]
    rows += [dict(_kind=3, trial_id=t, qid=q, alpha=a, beta=b, fb=fb) for t, q, a, b, fb in specs]
    block = pa.Table.from_pylist(rows, pa.schema([("_kind", pa.int32()), ("qid", pa.int64()), ("term", pa.string()), ("weight", pa.float64()), ("f", pa.int64()), ("trial_id", pa.int32()),
                                                  ("alpha", pa.float64()), ("beta", pa.float64()), ("fb", pa.list_(pa.int64())), ("docid", pa.int64())]))
    B = np.zeros((3, 40))
    for q in (0, 1):
        B[q, q::7] = 1.0
    for budgets in (dict(), dict(UNIT_CELLS=150, PAIR_BUDGET=10, CELL_BUDGET=120, DENSE_TERM_CELLS=100), dict(UNIT_CELLS=1, CELL_BUDGET=1, DENSE_TERM_CELLS=0)):
        for name, value in budgets.items():
            monkeypatch.setattr(sp, name, value)
        got = {(r["trial_id"], r["qid"], r["docid"]): r["score"] for b in sp._block_hits(sp._Shard(shard_rows), block, 50, ["trial_id", "qid", "docid", "score"]) for r in b.to_pylist()}
        want = {}
        for t, q, a, b, fb in specs:
            score = a * B[q] @ W + (b / len(fb) * sum(U[f] @ W for f in fb if f < 12) if fb else 0)
            want |= {(t, q, d): s for d, s in enumerate(np.broadcast_to(score, 50)) if s > 0}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_layouts_are_bounded_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    corpus = spark.createDataFrame([(f"d{i:04d}", rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(700)], "docid string, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(50)], "qid long, qv array<double>")
    want = topk_search(queries, corpus, 20, blocks=1).orderBy("qid", "rank").collect()
    assert len(want) == 1000
    monkeypatch.setattr(search, "BLOCK_BYTES", 4000)  # several blocks, several groups
    monkeypatch.setattr(search, "CELL_BUDGET", 300)
    for layout in (dict(), dict(query_bytes=0), dict(blocks=50)):
        assert topk_search(queries, corpus, 20, **layout).orderBy("qid", "rank").collect() == want
    assert topk_search(queries.limit(0), corpus, 20).count() == topk_search(queries, corpus.limit(0), 20).count() == 0


def test_the_corpus_is_searched_where_it_is_scanned(spark, tmp_path):
    path = str(tmp_path / "vectors.parquet")
    spark.createDataFrame([(i, [float(i % 7), float(i % 5)], "x") for i in range(60)], "docid long, vec array<float>, extra string").repartition(4).write.parquet(path)
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "qid long, qv array<double>")
    found = topk_search(queries, spark.read.parquet(path), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "MapInArrow" in plan and "extra" not in plan  # the hits by topic, nothing else
    assert found.count() == 45


def test_a_task_keeps_k_hits_and_ties(spark):
    best = search._Best(2, 3)
    for lo in range(0, 40_000, 100):
        ids = np.arange(lo, lo + 100)
        best.add(np.repeat([0, 1], 100), np.tile(ids, 2), np.concatenate([ids % 7 * 1.0, np.zeros(100)]))
    rows, ids, scores = best.cut()
    assert ids[rows == 0].tolist() == [6, 13, 20] and ids[rows == 1].tolist() == [0, 1, 2] and best.held == 6


@pytest.mark.parametrize("metric", ["ip", "hamming"])
def test_tasks_send_little_more_than_k_hits_of_a_query(spark, monkeypatch, metric):
    """With floors the hits that leave all tasks don't grow with their number, and the result is that without."""
    rng = np.random.default_rng(11)
    vecs = rng.integers(-3, 4, (4000, 8)).astype(float)
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vecs)], "docid long, vec array<double>").repartition(16)
    queries = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(30)], "qid long, qv array<double>")
    few = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vecs[:40])], "docid long, vec array<double>").repartition(16)
    sent = []
    for name in ("rank_cut_hits", "limit_per_topic"):
        monkeypatch.setattr(search, name, lambda hits, *a, f=getattr(search, name), **b: sent.append(hits) or f(hits, *a, **b))
    args = dict(exclude_self="qid", metric=metric)
    rows = lambda c, k: [tuple(r) for r in topk_search(queries, c, k, **args).orderBy("qid", "rank").collect()]
    plain, small = rows(corpus, 100), rows(few, 100)
    monkeypatch.setattr(search, "FLOOR_HITS", 0)
    assert rows(corpus, 100) == plain and len(plain) == 3000 and rows(few, 100) == small and len(small) == 30 * 39
    if metric == "ip":
        assert sent[2].count() < 30 * 100 * 2.5 < 30 * 100 * 10 < sent[0].count()
