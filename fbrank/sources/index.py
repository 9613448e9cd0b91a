"""A text index that is stored, keyed by the content of the documents.

``stored_index`` keeps two layouts below a folder named by a hash of all documents and by the parameters, each written when it is first
asked for.  By document (``vectors``): a row per document with its terms and their counts, bucketed by ``docid``; searches score
documents where they are scanned, feedback looks documents up, and nothing but the texts, dealt by id once, is
shuffled to build it.  By term (``by_term``): the postings with their BM25 weights, bucketed and sorted by ``term``, for term joins that
leave the postings where they are.  The collection's statistics lie beside them.  Documents that change give another
folder, so no search ever reads an index of other documents; equal documents find the index that is there, in a
later session too if the folder is given.

A layout counts as written when its last table is; what a lost job left behind is written anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fbrank.operators import sparse as sp
from fbrank.session import ensure_checkpoint_dir
from fbrank.sources.runs import _exists


FORMAT = "v3"  # of the stored tables; part of the key


@dataclass(frozen=True)
class StoredIndex:
    """Statistics and postings of a collection, and the BM25 weight of every posting."""

    index: sp.Index
    weights: DataFrame  # term, docid, w
    key: str


def content_key(documents: DataFrame, *settings) -> str:
    """A hash of all (docid, text) rows, in whatever order and layout, and of the settings."""
    row = F.xxhash64("docid", "text")
    parts = [F.sum(F.pmod(F.xxhash64(row, F.lit(i)), F.lit(1 << 31))) for i in range(2)]  # sums, so that repeated rows count
    n, *sums = documents.agg(F.count(F.lit(1)), *parts, F.bit_xor(row)).first()
    return "_".join([f"{n:x}", *(f"{(x or 0) & (1 << 64) - 1:x}" for x in sums), *(str(s).replace(".", "p") for s in settings)])


def stored_index(documents: DataFrame, folder: str | None = None, *, vectors: bool = False, by_term: bool = True, k1: float = sp.K1, b: float = sp.B) -> StoredIndex:
    """The index of ``documents`` (docid, text) below ``folder``, written if it isn't there: by document with ``vectors``,
    by term with ``by_term``.  By default the folder is the application's own in the shared checkpoint folder; name one to keep
    indexes for later applications."""
    spark = documents.sparkSession
    documents = documents.select("docid", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = content_key(documents, FORMAT, k1, b, buckets)
    at = f"{folder or ensure_checkpoint_dir(spark) + '/text-index-' + spark.sparkContext.applicationId}/{key}"
    if by_term and not _exists(spark, f"{at}/done/_SUCCESS"):
        index = sp.build_index(documents)
        _write(sp.weighted_by_term(index, buckets, k1=k1, b=b), at, key, "term", buckets)
        _statistics(spark, at, index)
        index.release()
        spark.range(1).write.mode("overwrite").parquet(f"{at}/done")
    rows = None
    if vectors or not by_term:
        if not _exists(spark, f"{at}/done_docid/_SUCCESS"):
            _write(sp.document_terms(documents, buckets), at, key, "docid", buckets)
            spark.range(1).write.mode("overwrite").parquet(f"{at}/done_docid")
        rows = _read(spark, at, key, "docid", buckets)
        if not by_term:
            if not _exists(spark, f"{at}/terms/_SUCCESS"):
                sp.document_frequencies(rows, documents).write.mode("overwrite").parquet(f"{at}/terms")
            _statistics(spark, at, sp.index_of_rows(rows, spark.read.parquet(f"{at}/terms"), documents))
    df, stats, stop = (spark.read.parquet(f"{at}/{part}") for part in ("df", "stats", "stop"))
    if not by_term:
        index = sp.Index(sp.kept_postings(rows, stop).select("term", "docid", "tf"), df, sp.kept_lengths(rows, stop), stats, stop, rows=rows, k1=k1, b=b)
        index.weights = sp.doc_weights(index, k1=k1, b=b)
        return StoredIndex(index, index.weights, key)
    postings = _read(spark, at, key, "term", buckets)
    doclen = spark.read.parquet(f"{at}/doclen") if _exists(spark, f"{at}/doclen/_SUCCESS") else sp.kept_lengths(rows, stop)
    index = sp.Index(postings.select("term", "docid", "tf"), df, doclen, stats, stop, rows=rows, weights=postings.select("term", "docid", "w"), k1=k1, b=b)
    return StoredIndex(index, index.weights, key)


def _statistics(spark: SparkSession, at: str, index: sp.Index) -> None:
    """Writes the statistics that aren't there: equal for both layouts, and never written over, as frames read them."""
    parts = [("df", index.df), ("stop", index.stop), ("stats", index.stats)] + ([("doclen", index.doclen)] if index.rows is None else [])
    for part, frame in parts:
        if not _exists(spark, f"{at}/{part}/_SUCCESS"):
            frame.write.mode("overwrite").parquet(f"{at}/{part}")


def _name(key: str, by: str) -> str:
    return f"text_index_{key}_{by}".lower()


def _write(postings: DataFrame, at: str, key: str, by: str, buckets: int) -> None:
    postings.sparkSession.sql(f"DROP TABLE IF EXISTS {_name(key, by)}")
    (postings.write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
     .option("path", f"{at}/by_{by}").saveAsTable(_name(key, by)))


def _read(spark: SparkSession, at: str, key: str, by: str, buckets: int) -> DataFrame:
    """The table, made known to the session if it isn't."""
    if not spark.catalog.tableExists(_name(key, by)):
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{at}/by_{by}").schema.fields)
        spark.sql(f"CREATE TABLE {_name(key, by)} ({kinds}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}/by_{by}'")
    return spark.table(_name(key, by))
