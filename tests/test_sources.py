import json
import os
import tempfile

from pyspark.sql import functions as F

from fbrank.sources import runs as rf
from fbrank.sources import tables as tb


def test_read_topics_tsv_and_json(spark):
    d = tempfile.mkdtemp(prefix="fbrank-topics-")
    with open(os.path.join(d, "t.tsv"), "w") as f:
        f.write("1\thow long is a flea life cycle\n2\twhat is a \"quoted\" word\n")
    with open(os.path.join(d, "t.json"), "w") as f:
        f.write(json.dumps({"id": "1", "text": "a b"}) + "\n")
    tsv = {r["qid"]: r["title"] for r in tb.read_topics(spark, os.path.join(d, "t.tsv")).collect()}
    assert tsv == {"1": "how long is a flea life cycle", "2": 'what is a "quoted" word'}
    js = tb.read_topics(spark, os.path.join(d, "t.json"), "json", id_col="id", text_col="text").first()
    assert (js["qid"], js["title"]) == ("1", "a b")


def test_lookup_encoded_missing_raises_or_drops(spark):
    topics = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, title string")
    enc = spark.createDataFrame([(1, [1.0])], "qid long, qv array<double>")
    assert tb.lookup_encoded(topics, enc, on_missing="drop").count() == 1
    try:
        tb.lookup_encoded(topics, enc).collect()
        raised = False
    except Exception as e:  # raise_error surfaces as a Spark runtime error
        raised = "no encoded query for topic 2" in str(e)
    assert raised


def test_topic_set_alias(spark):
    df = spark.createDataFrame([("dl20",), ("dl19-passage",)], "t string")
    assert [r[0] for r in df.select(rf.qrels_name(F.col("t"))).collect()] == ["dl20-passage", "dl19-passage"]




def test_logs_hold_a_run_once_however_often_it_is_written(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="fbrank-log-"), "m")
    schema = "project string, run_name string, seed int, metric string, value double"
    one = spark.createDataFrame([("p1", "run.1", 42, "map", 0.5), ("p1", "run.1", 42, "ndcg_cut_10", 0.4), ("p1", "2", 9, "map", 0.1)], schema)
    other = spark.createDataFrame([("p2", "run.1", 42, "map", 0.7)], schema)
    for rows in (one, other, one, one):
        rf.write_metrics(rows, d)
    back = rf.read_log(spark, d)
    assert sorted(map(tuple, back.select(*one.columns).collect())) == sorted([*map(tuple, one.collect()), *map(tuple, other.collect())])
    rf.write_metrics(one.filter("run_name = '2'").withColumn("value", F.lit(0.2)), d)  # a run's newer rows replace its older ones
    assert rf.read_log(spark, d).filter("run_name = '2'").first()["value"] == 0.2 and rf.read_log(spark, d).count() == 4
