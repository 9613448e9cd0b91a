"""What grows with the documents is read where it lies; only what belongs to topics and hits is shuffled."""
import numpy as np
from pyspark.sql import functions as F

from fbrank.operators import encode, judgements
from fbrank.operators import evaluate as ev
from fbrank.operators.refine import refine_text
from fbrank.operators.search import _partial_topk


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containment_shuffles_no_text(spark, monkeypatch):
    texts = [(1, "one two three four"), (1, "zero one two three four"), (2, "one two four three"), (3, None), (4, "a b, one two three four"), (None, "one two three four"), (5, "?!"), (6, "fourth")]
    docs = spark.createDataFrame(texts, "docid long, text string")
    long = [(1, "one two three four"), (2, "two three four"), (3, None), (4, "")]
    pairs = judgements.containment_pairs(docs, spark.createDataFrame(long, "qid long, title string"))
    want = sorted((d, q) for d, t in texts for q, title in long if d is not None and t and title and title in t)
    assert sorted(map(tuple, pairs.collect())) == want and len(want) == 6
    assert "Exchange hashpartitioning(docid" not in _plan(pairs)
    some = [*long, (5, "four"), (6, "?!"), (7, "e two")]
    want = sorted(((d, q) for d, t in texts for q, title in some if (d is not None or title == "?!") and t and title and title in t), key=str)
    for most in (judgements.BROADCAST_TOPICS, 0):
        monkeypatch.setattr(judgements, "BROADCAST_TOPICS", most)
        assert sorted(map(tuple, judgements.containment_pairs(docs, spark.createDataFrame(some, "qid long, title string")).collect()), key=str) == want


def test_feedback_texts_are_looked_up_without_shuffling_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "docid long, text string")
    fb = spark.createDataFrame([(1, 1, 7), (1, 0, 9), (2, 0, 99)], "qid long, fb_pos int, docid long")
    topics = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "qid long, title string")
    out = refine_text(topics, fb, docs)
    assert "Exchange hashpartitioning(docid" not in _plan(out)
    assert sorted((r.qid, r.title) for r in out.collect()) == [(1, "a text 9 text 7"), (2, "b"), (3, "")]


def test_hashed_texts_shuffle_a_row_per_text(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(encode, "TOKENS_AT_ONCE", 2)
    texts = [(1, "a b a c"), (1, "d"), (2, None), (3, ""), (None, "a"), (4, "É é z"), (4, "É é z")]
    got = encode.encode_hashed(spark.createDataFrame(texts, "id long, t string"), id_cols=("id",), text="t", dim=8)
    plan = _plan(got)
    assert "MapInArrow" in plan and "Generate" not in plan
    of = {}
    for i, t in texts:
        v = of.setdefault(i, np.zeros(8))
        for w in (t or "").lower().split() if i is not None else ():
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 8] += 1 if int(h[8], 16) % 2 == 0 else -1
    want = sorted((str(i), np.round(of[i] / (np.linalg.norm(of[i]) or 1), 9).tolist()) for i, _ in texts)
    assert sorted((str(r.id), np.round(r.qv, 9).tolist()) for r in got.collect()) == want


def test_per_topic_reads_the_run_once(spark):
    run = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 2.0, 2), (2, 5, 1.0, 1), (3, 1, 1.0, 1)], "qid long, docid long, score double, rank int").withColumn("score", F.col("score") * F.rand(1) * 0 + F.col("score"))
    qrels = spark.createDataFrame([(1, 2, 2), (2, 7, 2), (4, 1, 1)], "qid long, docid long, rel int")
    out = ev.per_topic(run, qrels)
    assert _plan(out).count("rand(1)") == 1
    assert sorted((r.qid, round(r["map"], 6), round(r.recall_1000, 6)) for r in out.collect()) == [(1, 0.5, 1.0), (2, 0.0, 0.0)]


def test_entries_below_the_floor_need_no_partition(monkeypatch):
    s = np.full((3, 50), -np.inf)
    s[0, :4], s[1, 5:9] = 1.0, np.arange(4)
    monkeypatch.setattr(np, "partition", lambda *a, **b: 1 / 0)
    assert len(_partial_topk(s, 4)[0]) == 8
