import math

import pytest

from fbrank.operators import evaluate as ev


def _frames(spark):
    run = spark.createDataFrame(
        [("1", "a", 4.0), ("1", "b", 3.0), ("1", "c", 2.0), ("1", "d", 1.0)], "qid string, docid string, score double")
    qrels = spark.createDataFrame(
        [("1", "a", 2), ("1", "c", 1), ("1", "e", 3), ("2", "x", 2)], "qid string, docid string, rel int")
    return run, qrels


def test_per_topic_level2(spark):
    run, qrels = _frames(spark)
    pt = {r["qid"]: r for r in ev.per_topic(run, qrels, level=2).collect()}
    assert pt["1"]["map"] == pytest.approx(0.5)
    assert pt["1"]["recall_1000"] == pytest.approx(0.5)
    ndcg = (2 + 1 / 2) / (3 + 2 / math.log2(3) + 1 / 2)
    assert pt["1"]["ndcg_cut_10"] == pytest.approx(ndcg)
    assert round(ndcg, 6) == 0.525005


def test_per_topic_level1(spark):
    run, qrels = _frames(spark)
    pt = {r["qid"]: r for r in ev.per_topic(run, qrels, level=1).collect()}
    assert round(pt["1"]["map"], 6) == 0.555556


def test_all_judged_topics_averaged(spark):
    run, qrels = _frames(spark)
    m = ev.evaluate(run, qrels, level=2).first()
    assert m["map"] == pytest.approx(0.25)  # topic 2 judged, absent from the run -> 0
    assert m["recall_1000"] == pytest.approx(0.25)


def test_eval_order_ignores_rank_and_breaks_ties_by_docid_desc(spark):
    run = spark.createDataFrame([("1", "a", 1.0), ("1", "b", 1.0)], "qid string, docid string, score double")
    r = {x["docid"]: x["erank"] for x in ev.eval_order(run).collect()}
    assert r == {"b": 1, "a": 2}


def test_metrics_long_wide_roundtrip(spark):
    run, qrels = _frames(spark)
    m = ev.evaluate(run, qrels).withColumn("trial_id", __import__("pyspark.sql.functions").sql.functions.lit(0))
    wide = ev.metrics_wide(ev.metrics_long(m, ["trial_id"]), ["trial_id"]).first()
    assert wide["map"] == pytest.approx(0.25)
