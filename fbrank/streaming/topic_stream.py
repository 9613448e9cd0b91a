"""Topics as a stream: the dense feedback command over topic files as they arrive.

The studied command buffers topics into batches of ``batch_size`` and searches each full
batch.  Here a Structured Streaming source plays that buffer: every micro-batch of topic
rows (``maxFilesPerTrigger`` files) goes through the same lazy plan as the batch job -
lookup of encoded vectors, search, feedback selection, refinement, second search - and its
run rows are written to the partition of its number in a parquet sink.  A micro-batch that is run
again after a restart replaces its own partition, so each is there once; the corpus side is a static frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fbrank.plans.dense import DenseSettings, dense_feedback_run
from fbrank.sources.tables import lookup_encoded

TOPIC_STREAM_SCHEMA = T.StructType([T.StructField("qid", T.LongType()), T.StructField("title", T.StringType())])


def start_topic_stream(spark: SparkSession, topics_dir: str, encoded: DataFrame, corpus: DataFrame, out_dir: str,
                       checkpoint: str, settings: DenseSettings, *, files_per_batch: int = 1,
                       exclude_self: str | None = "qid", available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``encoded``: (qid, qv) pre-encoded query vectors; ``corpus``: (docid, vec).
    Output rows: (qid, docid, rank, score, batch_id).
    """
    topics = (spark.readStream.schema(TOPIC_STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
              .parquet(topics_dir))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        queries = lookup_encoded(batch.select("qid"), encoded, on="qid", vec_col="qv").select("qid", "qv")
        hits = dense_feedback_run(queries, corpus, settings, exclude_self=exclude_self)
        (hits.select("qid", "docid", "rank", F.round("score", 6).alias("score"), F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_dir))

    writer = topics.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
