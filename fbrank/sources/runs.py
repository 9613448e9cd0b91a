"""Run files, judgement files and logs: S5-S9, S11.

TREC run line:      ``qid Q0 docid rank score tag`` (score printed with 6 decimals)
MS MARCO run line:  ``qid<TAB>docid<TAB>rank``
TREC qrels line:    ``qid 0 docid rel``
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_FORMATS = ("trec", "msmarco")


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parse_run_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split TREC run lines into typed columns (qid, q0, docid, rank INT, score DOUBLE, tag)."""
    f = _fields(F.col(value))
    keep = [c for c in lines.columns if c != value]
    return (lines.filter(F.length(F.trim(F.col(value))) > 0)
            .select(*keep,
                    f.getItem(0).alias("qid"), f.getItem(1).alias("q0"), f.getItem(2).alias("docid"),
                    f.getItem(3).cast("int").alias("rank"), f.getItem(4).cast("double").alias("score"),
                    f.getItem(5).alias("tag")))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """One TREC run file (or folder of part files)."""
    return parse_run_lines(spark.read.text(path))


def _folder_name() -> Column:
    """The run's name of the file that a line was read from."""
    at = F.col("_metadata.file_path")
    ours, theirs = F.regexp_extract(at, r"run_name=([^/]+)/[^/]*$", 1), F.regexp_extract(at, r"([^/]+\.trec)$", 1)
    return F.url_decode(F.when(ours != "", ours).otherwise(theirs))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run under ``folder`` and its sub-folders, tagged by run name: ``*.trec`` files by
    their file name, runs of ``write_named_runs`` by the name of their folder; other files are ignored."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", _folder_name().alias("run_name"))
    return parse_run_lines(lines.filter(F.col("run_name") != ""))


def write_named_runs(hits: DataFrame, folder: str, tag: str = "Faiss", *, max_hits: int = 1000, parts: int = 8) -> None:
    """Many runs in one job: a sub-folder per ``run_name`` of up to ``parts`` files, each with whole
    topics sorted by (qid, rank).  Other runs of the folder stay."""
    h = hits.filter(F.col("rank") <= max_hits)
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("qid").cast("string"), F.col("docid").cast("string"),
                           F.col("rank"), F.col("score"), F.lit(tag))
    (h.select("run_name", "qid", "rank", line.alias("value"))
     .repartition("run_name", F.pmod(F.xxhash64("qid"), F.lit(parts))).sortWithinPartitions("run_name", "qid", "rank")
     .select("run_name", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").text(folder))


def format_run(hits: DataFrame, tag: str = "Faiss", fmt: str = "trec", *, max_hits: int = 1000) -> DataFrame:
    """Run lines as one string column ``line``, capped at ``max_hits`` per topic."""
    h = hits.filter(F.col("rank") <= max_hits)
    if fmt == "trec":
        line = F.format_string("%s Q0 %s %d %.6f %s", F.col("qid").cast("string"), F.col("docid").cast("string"),
                               F.col("rank"), F.col("score"), F.lit(tag))
    elif fmt == "msmarco":
        line = F.concat_ws("\t", F.col("qid").cast("string"), F.col("docid").cast("string"),
                           F.col("rank").cast("string"))
    else:
        raise ValueError(f"unknown run format {fmt!r}; expected one of {RUN_FORMATS}")
    return h.select("qid", "rank", line.alias("line"))


def write_run(hits: DataFrame, path: str, tag: str = "Faiss", fmt: str = "trec", *, max_hits: int = 1000,
              partitions: int | None = None) -> None:
    """Write a run as text, topics range-partitioned and sorted by (qid, rank) in each file."""
    lines = format_run(hits, tag, fmt, max_hits=max_hits)
    n = partitions or int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "qid").sortWithinPartitions("qid", "rank")
     .select("line").write.mode("overwrite").text(path))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Graded judgements ``(qid STRING, docid STRING, rel INT)`` from TREC qrels text."""
    f = _fields(F.col("value"))
    return (spark.read.text(path).filter(F.length(F.trim("value")) > 0)
            .select(f.getItem(0).alias("qid"), f.getItem(2).alias("docid"), f.getItem(3).cast("int").alias("rel")))


def write_qrels(qrels: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("docid").cast("string"),
                       F.col("rel").cast("string"))
    qrels.select(line.alias("value")).write.mode("overwrite").text(path)


def qrels_name(topics: Column) -> Column:
    """Topic-set alias -> judgement-set name (fixed value: dl20 -> dl20-passage)."""
    return F.when(topics == "dl20", F.lit("dl20-passage")).otherwise(topics)


def append_log(rows: DataFrame, path: str, by: Sequence[str] = ("project", "run_name")) -> None:
    """Appends rows to a log of one partition per run: a run that is written again replaces its own rows and
    no others, so a job that is retried or repeated leaves each run's rows once."""
    (rows.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_metrics(long: DataFrame, path: str) -> None:
    """Metric rows (``project, run_name``, the run's settings, ``metric, value``), a run's once."""
    append_log(long, path)


def write_selections(log: DataFrame, path: str) -> None:
    """The feedback chosen per run and topic (``project, run_name, seed, qid, docids, positions, rand_prf``), a run's once."""
    append_log(log, path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_log`` wrote; run names are text whatever they look like."""
    return (spark.read.option("basePath", path).parquet(path)
            .withColumn("project", F.col("project").cast("string")).withColumn("run_name", F.col("run_name").cast("string")))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def committed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of a folder that were written whole: (run_name, n_lines)."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], "run_name string, n_lines long")
    return spark.read.parquet(f"{folder}/manifest").select(F.col("run_name").cast("string").alias("run_name"), "n_lines")


def commit_runs(hits: DataFrame, names: DataFrame, folder: str, tag: str = "Faiss", *, max_hits: int = 1000) -> None:
    """Writes runs (a row of ``names`` each, empty ones too) and then lists them in the folder's manifest.  A job lost in between leaves
    files of runs that the manifest doesn't name: they are not read and are written anew."""
    spark = hits.sparkSession
    write_named_runs(hits, f"{folder}/runs", tag, max_hits=max_hits)
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/runs").select(_folder_name().alias("run_name"))
    counts = lines.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_lines"))
    done = names.select("run_name").distinct().join(counts, "run_name", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    done.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")  # a row per run of one grid


def read_committed(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that the manifest names."""
    return read_runs(spark, f"{folder}/runs").join(F.broadcast(committed_runs(spark, folder).select("run_name").distinct()), "run_name")
