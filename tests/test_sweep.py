"""Sweeps: layouts and methods must not matter, and every trial covers every topic."""
import pytest

from conftest import SF001
from fbrank import catalog as cat
from fbrank.operators import evaluate as ev
from fbrank.operators.search import topk_search
from fbrank.plans import sweep as sw
from fbrank.plans.dense import DenseSettings, dense_feedback_run


def _metrics(df):
    return sorted((r["trial_id"], r["map"], r["ndcg_cut_10"], r["recall_1000"]) for r in df.collect())


def test_metrics_do_not_depend_on_the_layout(spark):
    queries = spark.createDataFrame([(1, [1.0])], "qid long, qv array<double>")
    corpus = spark.createDataFrame([(i, [x]) for i, x in enumerate([0.1234570, 0.1234565, 0.5, 0.0000125, 0.0000134])], "docid long, vec array<double>")
    qrels = spark.createDataFrame([(1, 1, 2), (1, 3, 2)], "qid long, docid long, rel int")
    got = {tuple(ev.evaluate(topk_search(queries, corpus.repartition(n), 5), qrels).first()) for n in (1, 2, 5)}
    assert len(got) == 1


def test_ties_leave_the_kernel_cut(spark):
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, qv array<double>")
    corpus = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "docid long, vec array<double>")
    for n in (1, 3):
        assert [r.docid for r in topk_search(queries, corpus.repartition(n), 10).orderBy("rank").collect()] == list(range(10))
    from fbrank.operators.search import _partial_topk
    import numpy as np
    assert len(_partial_topk(np.zeros((2, 300)), 10, np.arange(300))[0]) == 20


@pytest.mark.parametrize("setting", [dict(nsplit=9, total_prf_docs=1000), dict(prf_depth=0), dict(mode="natural")])
def test_dense_sweep_equals_the_single_run(spark, setting):
    c = cat.Ctx(spark, SF001)
    one = sw.trial_grid(spark, **{k: (v,) for k, v in (dict(seed=42, nsplit=0) | setting).items()})
    runs = sw.dense_sweep_runs(one, c.qv, c.corpus, hits=50)
    s = DenseSettings(**(dict(alpha=0.4, beta=0.6, topk=3, hits=50, seed=42) | setting))
    want = dense_feedback_run(c.qv, c.corpus, s, exclude_self="qid")
    a, b = (sorted((r.qid, r["rank"], r.docid) for r in x.collect()) for x in (runs, want))
    assert a == b and len({q for q, *_ in a}) == c.qv.count()


def test_sweeps_refuse_what_they_do_not_know(spark):
    c = cat.Ctx(spark, SF001)
    for bad in (dict(mode=("random_split", "other")), dict(nsplit=(12,)), dict(prf_depth=(50,))):
        with pytest.raises(ValueError):
            sw.dense_sweep_runs(sw.trial_grid(spark, **(dict(seed=(42,), nsplit=(0,)) | bad)), c.qv, c.corpus)


def test_sparse_sweep_methods_agree(spark):
    c = cat.Ctx(spark, SF001)
    trials = sw.trial_grid(spark, seed=(42, 9), nsplit=(0, 9), total_prf_docs=(1000,), alpha=(1.0,), beta=(0.75,))
    q = c.sparse_qrels.persist()
    kw = dict(k=1000, first=c.sparse_first, weights=c.weights)
    linear = sw.sparse_sweep_runs(trials, c.topics, c.index, **kw)
    terms = sw.sparse_sweep_runs(trials, c.topics, c.index, method="terms", **kw)
    assert _metrics(sw.evaluate_trials(linear, trials, q)) == _metrics(sw.evaluate_trials(terms, trials, q))
    assert linear.select("trial_id", "qid").distinct().count() == terms.select("trial_id", "qid").distinct().count()


def test_bm25_keeps_string_ids(spark):
    from fbrank.operators import sparse as sp

    docs = spark.createDataFrame([("D1", "apple pie"), ("D2", "pear"), ("D3", "apple"), ("D4", "plum"), ("D5", "fig")], "docid string, text string")
    idx = sp.build_index(docs)
    q = spark.createDataFrame([("a", "apple", 1.0), ("b", "pear", 1.0)], "qid string, term string, weight double")
    assert sorted((r.qid, r.docid) for r in sp.bm25_search(q, idx, 5).collect()) == [("a", "D1"), ("a", "D3"), ("b", "D2")]


def test_resuming_searches_only_what_is_not_committed(spark, tmp_path):
    from fbrank.sources import runs as rf

    hits = lambda ids: spark.createDataFrame([(t, q, 10 * q + r, 1.0 / r, r) for t in ids for q in (1, 2) for r in (1, 2)], "trial_id int, qid long, docid long, score double, rank int")
    asked = []

    def search(missing):
        asked.append(sorted(r.trial_id for r in missing.collect()))
        return hits([i for i in asked[-1] if i != 3])  # trial 3 finds nothing

    grid = sw.trial_grid(spark, seed=(42, 9), nsplit=(0, 1), mode=("random_split", "natural"))
    folder, at = str(tmp_path / "runs"), str(tmp_path / "runs") + "/dense/benchmark/random_split"
    some = grid.filter("nsplit = 0 and mode = 'random_split'")
    assert len(sw.resume_sweep(some, folder, search)) == 2 and len(asked) == 1
    rf.write_named_runs(hits([4]).join(grid.select("trial_id", sw.run_name(grid).alias("run_name")), "trial_id"), f"{at}/runs")  # a job lost before it committed
    before = {r.run_name for r in rf.read_committed(spark, at).select("run_name").distinct().collect()}
    assert len(before) == 2
    done = sw.resume_sweep(grid, folder, search)
    assert len(done) == 6 and len({d.rsplit("/", 1)[0] for d in done}) == 2  # a folder per mode, where equal names don't meet
    assert sorted(i for a in asked for i in a) == list(range(8))
    assert sw.resume_sweep(grid, folder, search) == [] and len(asked) == 3  # nothing missing: no search, the empty run included
    assert rf.read_committed(spark, at).count() == 4 * 4 and rf.committed_runs(spark, at).count() == 4


def test_trials_without_a_valid_swap_have_no_metrics(spark):
    c = cat.Ctx(spark, SF001)
    trials = sw.trial_grid(spark, seed=(42,), nsplit=(0,), total_prf_docs=(20,), split_num=(2,), batch_size=(1, 5), mode=("swap",))
    batched = cat._batches(c, 1).unionByName(cat._batches(c, 5))
    sweep = sw.dense_sweep(trials, c.qv, c.corpus, hits=20, topics_batched=batched)
    got = {r.trial_id: r for r in sw.evaluate_trials(sweep.runs, trials, c.dense_qrels, covered=sweep.covered).collect()}
    assert (got[0].n_topics, got[0]["map"], got[0].ndcg_cut_10, got[0].recall_1000) == (0, None, None, None)
    assert got[1].n_topics > 0 and got[1]["map"] is not None
    assert sw.unsatisfied(trials, c.topics.select("qid"), sweep.feedback).filter("trial_id = 0").count() == c.topics.count()


def test_trials_cover_their_own_topic_set(spark):
    c = cat.Ctx(spark, SF001)
    trials = sw.trial_grid(spark, seed=(42,), nsplit=(0,), topics=("even", "odd"))
    sweep = sw.dense_sweep(trials, cat._in_sets(c.qv), c.corpus, hits=5)
    n = {(r.trial_id, r.qid % 2) for r in sweep.runs.select("trial_id", "qid").distinct().collect()}
    assert n == {(0, 0), (1, 1)}
    whole = sw.dense_sweep(sw.trial_grid(spark, seed=(42,), nsplit=(0,)), c.qv, c.corpus, hits=5)
    rows = lambda s: sorted((r.qid, r["rank"], r.docid) for r in s.runs.collect())
    assert rows(sweep) == rows(whole)


def test_text_sweep_equals_the_single_run(spark):
    c = cat.Ctx(spark, SF001)
    qv, dv = cat._encoded(c)
    one = sw.trial_grid(spark, seed=(42,), nsplit=(0,), prf_depth=(3, 0))
    runs = sw.dense_sweep(one, qv, dv, hits=20, method="text", exclude_self=None, texts=cat._hash_texts(c)).runs
    for trial, depth in ((0, 3), (1, 0)):
        s = DenseSettings(seed=42, prf_depth=depth, method="text", hits=20)
        want = dense_feedback_run(qv, dv, s, texts=cat._hash_texts(c))
        a, b = (sorted((r.qid, r["rank"], r.docid) for r in x.collect()) for x in (runs.filter(f"trial_id = {trial}"), want))
        assert a == b and len(a) == 20 * c.topics.count()
    with pytest.raises(ValueError):
        sw.dense_sweep(one, qv, dv, method="text")


def test_a_sparse_sweep_moves_rows_of_documents_and_sorts_hits_once(spark):
    """A row per document or feedback document reaches the kernel, not one per posting, and hits are sorted after their shuffle only."""
    c = cat.Ctx(spark, SF001)
    trials = sw.trial_grid(spark, seed=(42,), nsplit=(0,), alpha=(1.0,), beta=(0.75,))
    runs = sw.sparse_sweep_runs(trials, c.topics, c.index, k=50, first=c.sparse_first, weights=c.weights)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and plan.count("collect_list(struct(term") >= 2
    assert runs.agg({"rank": "max"}).first()[0] == 50 and runs.groupBy("trial_id", "qid").count().agg({"count": "max"}).first()[0] == 50
    import pyarrow as pa

    from fbrank.operators import sparse as sp
    rows = pa.table({"qid": [1, 2, 3], "terms": [["a", "b"], [], None], "weights": [[1.0, 2.0], [], None]}, pa.schema([("qid", pa.int64()), ("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))]))
    assert sp._each_term(rows, "w").to_pylist() == [dict(qid=1, term="a", w=1.0), dict(qid=1, term="b", w=2.0), dict(qid=3, term=None, w=None)]


def test_a_stored_sparse_sweep_shuffles_neither_documents_nor_hits(spark):
    """Before, documents were dealt to shards and every shard's best hits to their trial and topic."""
    c = cat.Ctx(spark, SF001)
    trials = sw.trial_grid(spark, seed=(42, 9), nsplit=(0, 3), alpha=(1.0,), beta=(0.75,))
    args = dict(k=50, first=c.sparse_first, weights=c.weights)
    runs = sw.sparse_sweep_runs(trials, c.topics, c.index, **args)
    after, kernel, _ = runs._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")
    assert kernel and "Exchange" not in after and "Window" not in after
    lists = sw.sparse_sweep_runs(trials, c.topics, c.index, listed=True, **args)
    assert lists.columns == ["trial_id", "qid", "hits"] and lists.count() == runs.select("trial_id", "qid").distinct().count()
    qrels = c.sparse_qrels.persist()
    assert _metrics(ev.evaluate(lists, qrels, keys=("trial_id",), key_values=trials)) == _metrics(ev.evaluate(runs, qrels, keys=("trial_id",), key_values=trials))
    ranked = lambda run: sorted((r.trial_id, r.qid, r.docid, r.erank) for r in ev.eval_order(run, ("trial_id",)).collect())
    assert ranked(lists) == ranked(runs)


def test_a_stored_sweep_equals_the_dealt_one_with_ties_and_repeated_topics(spark):
    from fbrank.operators import sparse as sp
    from fbrank.sources.index import stored_index

    docs = spark.createDataFrame([(f"d{i:03d}", f"w{i % 7} w{i % 5} w{i % 5} x{i % 3} common{i % 2}") for i in range(300)] + [("d900", "w1 x2"), ("d900", "w1"), ("d901", None), (None, "w2 w3")], "docid string, text string")
    topics = spark.createDataFrame([("a", "w1 x2"), ("b", "w3"), ("b", "w3"), ("c", "nothing"), (None, "w1")], "qid string, title string")
    index = stored_index(docs, vectors=True, by_term=False).index
    bow = sp.query_bow(topics, index).persist()
    specs = spark.createDataFrame([(t, q, 1.0 if t else 0.0, 0.5, fb) for t in range(4) for q, fb in (("a", ["d001", "d002"][:t]), ("b", ["d004"]), ("b", ["d004"]), ("c", []), (None, ["d001"]))],
                                  "trial_id int, qid string, alpha double, beta double, fb array<string>")
    rows = lambda run: sorted((r.trial_id, r.qid, r["rank"], r.docid, round(r.score, 9)) for r in run.collect())
    for k in (7, 1000):
        got, want = rows(sp.rocchio_sweep_search(specs, bow, index, index.weights, k)), rows(sp.rocchio_sweep_search(specs, bow, index, index.weights, k, n_shards=3))
        assert got == want and max(r[2] for r in got) <= k
    assert {r[1] for r in got} == {"a", "b"}


def test_a_task_of_a_sweep_keeps_k_hits_of_a_trial(spark):
    import numpy as np

    from fbrank.operators import sparse as sp
    best, rng = sp._Kept(3, 50), np.random.default_rng(2)
    seen = np.full((3, 0), 0.0)
    for lo in range(0, 60_000, 1000):
        scores = np.stack([rng.random(1000), np.ones(1000), np.full(1000, -np.inf)])
        scores[2, :1] = 1.0 if lo < 5000 else -np.inf
        seen = np.hstack([seen, scores])
        best.add(scores, np.arange(lo, lo + 1000))
        assert best.held <= best.room
    rows, ids, scores = best.cut()
    assert set(np.argsort(-seen[0])[:50]) <= set(ids[rows == 0]) and set(range(50)) <= set(ids[rows == 1]) and sorted(ids[rows == 2]) == [0, 1000, 2000, 3000, 4000]
