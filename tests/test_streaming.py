import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from fbrank import catalog as cat
from fbrank.streaming.topic_stream import start_topic_stream


def test_topic_stream_matches_batch(spark):
    c = cat.Ctx(spark, SF001)
    base = tempfile.mkdtemp(prefix="fbrank-stream-")
    tdir = os.path.join(base, "topics")
    topics = c.topics.select(F.col("qid").cast("long").alias("qid"), "title")
    # topics arrive as two files
    topics.filter("qid % 2 = 0").coalesce(1).write.parquet(os.path.join(tdir, "a"))
    topics.filter("qid % 2 = 1").coalesce(1).write.parquet(os.path.join(tdir, "b"))
    enc = c.qv
    q = start_topic_stream(spark, os.path.join(tdir, "*"), enc, c.corpus, os.path.join(base, "out"),
                           os.path.join(base, "ckpt"), cat.DENSE)
    q.awaitTermination(600)
    got = spark.read.parquet(os.path.join(base, "out")).drop("batch_id")
    want = cat.q_prf_dense_rocchio_run(spark, SF001)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_a_batch_that_runs_again_is_there_once(spark):
    """The sink after a restart that lost the second batch's commit."""
    c = cat.Ctx(spark, SF001)
    base = tempfile.mkdtemp(prefix="fbrank-stream-")
    tdir, out, ckpt = (os.path.join(base, x) for x in ("topics", "out", "ckpt"))
    topics = c.topics.select(F.col("qid").cast("long").alias("qid"), "title")
    for name, part in (("a", 0), ("b", 1)):
        topics.filter(F.col("qid") % 2 == part).coalesce(1).write.parquet(os.path.join(tdir, name))
    start = lambda: start_topic_stream(spark, os.path.join(tdir, "*"), c.qv, c.corpus, out, ckpt, cat.DenseSettings(hits=20)).awaitTermination(600)
    start()
    n = spark.read.parquet(out).count()
    for lost in ("commits/1", "commits/.1.crc"):
        os.remove(os.path.join(ckpt, lost))
    start()
    assert n == 20 * c.topics.count() == spark.read.parquet(out).count()
