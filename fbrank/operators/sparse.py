"""Sparse side V4-V10 and R7: analysis, postings, collection statistics, BM25 and Rocchio terms.

Everything is long-form rows joined on ``term``:

* postings ``(term, docid, tf)`` - built once from the documents and reused (persist or write), or read out of stored rows
  ``(docid, terms, tfs)`` of one document each (``document_terms``);
* collection stats: ``df`` per term, ``dl`` per document, ``N`` and ``avgdl`` as one row;
* a query is weighted terms ``(keys..., qid, term, weight)``; BM25 is
  ``weighted terms JOIN postings ON term``, summed per (keys, qid, docid), then a top-k window; over stored rows the query
  terms are broadcast and documents are scored where they are scanned, so that only the best hits of each task are shuffled.

Fixed BM25 form (exact document length, no length quantisation):
    idf    = ln(1 + (N - df + 0.5) / (df + 0.5))
    tfpart = tf / (tf + k1 * (1 - b + b * dl / avgdl))
    score  = sum(weight * idf * tfpart)
Stop words: terms in more than half of all documents are dropped from queries and postings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from fbrank.functions.text import STOP_DF_FRACTION, tokens
from fbrank.operators.search import (BLOCK_BYTES, HIT_BYTES, TIE_EPS, _Best, _first_of_equal, _hits, _partial_topk, docid_order, index_in_order, limit_per_topic,
                                     rank_cut_hits, rank_key)
from fbrank.session import cut_lineage

K1 = 0.9
B = 0.4


@dataclass
class Index:
    """Postings and statistics of a document collection."""

    postings: DataFrame   # term, docid, tf
    df: DataFrame         # term, df, idf
    doclen: DataFrame     # docid, dl
    stats: DataFrame      # one row: n_docs, avgdl
    stop: DataFrame       # term
    raw: DataFrame | None = None  # kept term counts
    rows: DataFrame | None = None  # docid, terms, tfs, stored by docid, stop words included: document vectors
    weights: DataFrame | None = None  # term, docid, w of the stored parameters
    k1: float = K1
    b: float = B

    @property
    def by_doc(self) -> DataFrame | None:
        """(docid, term, tf) of the stored rows."""
        return None if self.rows is None else kept_postings(self.rows, self.stop)

    def vectors(self) -> DataFrame:
        """(term, docid, tf) to be looked up by document."""
        return self.postings if self.rows is None else self.by_doc.select("term", "docid", "tf")

    def release(self) -> None:
        """Lets go of the raw term counts that ``build_index`` keeps."""
        if self.raw is not None:
            self.raw.unpersist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Texts dealt by their ids into the session's number of shuffle partitions (at least one per core): term counts by (id,
    term), document lengths and the join of the two then need no shuffle of the much more numerous term rows."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def term_counts(df: DataFrame, id_cols: Sequence[str], text: str = "text") -> DataFrame:
    """(ids..., term, tf) term counts of each text (V4/V5 before stop words)."""
    src = spread(df.select(*id_cols, text), *id_cols)
    return (src.select(*id_cols, F.explode(tokens(text)).alias("term"))
            .groupBy(*id_cols, "term").agg(F.count(F.lit(1)).cast("int").alias("tf")))


def build_index(documents: DataFrame, *, persist: bool = True) -> Index:
    """V5 + V10: postings without stop words, df/idf, document lengths, N and avgdl.

    The documents are tokenised once: the raw term counts are persisted (memory and disk;
    a lost block is recomputed from the scan) and every statistic reads them.
    """
    raw = term_counts(documents, ["docid"])
    if persist:
        raw = raw.persist()
    n_docs = documents.select("docid").distinct().agg(F.count(F.lit(1))).scalar()  # scalar subquery
    dfs = raw.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Stop words are few by construction: each occurs in more than N/2 documents, so there are
    # fewer than 2 x (average distinct terms per document) of them - a proven broadcast bound.
    stop = dfs.filter(F.col("df") > n_docs * STOP_DF_FRACTION).select("term")
    kept = dfs.filter(F.col("df") <= n_docs * STOP_DF_FRACTION)
    idf = kept.select("term", "df", _idf(n_docs, F.col("df")).alias("idf"))
    postings = raw.join(F.broadcast(stop), "term", "left_anti")
    doclen = (documents.select("docid").distinct()
              .join(postings.groupBy("docid").agg(F.sum("tf").cast("bigint").alias("dl")), "docid", "left")
              .withColumn("dl", F.coalesce("dl", F.lit(0).cast("bigint"))))
    stats = doclen.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Index(postings, idf, doclen, stats, stop, raw if persist else None)


TOKENS_AT_ONCE = 1 << 20  # tokens, or postings, that a task handles in one step


def document_terms(documents: DataFrame, parts: int) -> DataFrame:
    """(docid, terms, tfs): a row per document id with its distinct terms, in order, and their counts, before stop words.

    Texts are dealt and sorted by id, so the texts of one id come one after the other, and are counted where they lie.
    Rows without an id are no document that a search could return; ``document_frequencies`` counts them."""
    dealt = documents.filter(F.col("docid").isNotNull()).repartition(parts, "docid").sortWithinPartitions("docid")
    out = T.StructType([T.StructField("docid", documents.schema["docid"].dataType, True), T.StructField("terms", T.ArrayType(T.StringType()), True),
                        T.StructField("tfs", T.ArrayType(T.IntegerType()), True)])
    return dealt.select("docid", tokens("text").alias("terms")).mapInArrow(_count_terms, out)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``TOKENS_AT_ONCE`` list elements (of column 1), or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS_AT_ONCE, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (docid, tokens) in order of docid to (docid, terms, tfs), equal ids together."""
    held = None
    for piece in _pieces(batches):
        rows = pa.Table.from_batches([piece] if held is None else [held, piece]).combine_chunks().to_batches()[0]
        at = rows.column(0).dictionary_encode().indices.to_numpy()
        last = int(np.flatnonzero(at == at[-1])[0])  # the next piece may go on with this document
        if last:
            yield _counted(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield _counted(held)


def _counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    ids, lists = rows.column(0), rows.column(1)
    at = ids.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words, n = coded.dictionary, max(len(coded.dictionary), 1)
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = np.searchsorted(first, np.repeat(np.arange(len(ids)), lengths), side="right") - 1
    key, tf = np.unique(doc * n + place[coded.indices.to_numpy()], return_counts=True)
    ends = pa.array(np.searchsorted(key // n, np.arange(len(first) + 1)), pa.int32())
    terms = words.take(pa.array(order[key % n], pa.int64()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                                      names=["docid", "terms", "tfs"])


def document_frequencies(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, df), stop words included; rows without an id count as one document, as in ``build_index``."""
    bare = documents.filter(F.col("docid").isNull()).select(F.explode(tokens("text")).alias("term")).distinct()
    return rows.select(F.explode("terms").alias("term")).unionAll(bare).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_of_rows(rows: DataFrame, frequencies: DataFrame, documents: DataFrame) -> Index:
    """The index of stored rows and their document frequencies."""
    one = F.lit(1).alias("one")
    bare = documents.filter(F.col("docid").isNull()).select(one).limit(1)
    n_docs = rows.select(one).unionAll(bare).agg(F.count(F.lit(1))).scalar()
    stop = frequencies.filter(F.col("df") > n_docs * STOP_DF_FRACTION).select("term")
    idf = frequencies.filter(F.col("df") <= n_docs * STOP_DF_FRACTION).select("term", "df", _idf(n_docs, F.col("df")).alias("idf"))
    doclen = kept_lengths(rows, stop)
    stats = (doclen.select("dl").unionAll(bare.select(F.lit(0).cast("bigint").alias("dl")))
             .agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))
    return Index(kept_postings(rows, stop).select("term", "docid", "tf"), idf, doclen, stats, stop, rows=rows)


def _stop_list(stop: DataFrame) -> Column:
    """The stop words as an array: few by construction (see ``build_index``)."""
    return F.coalesce(stop.agg(F.collect_list("term")).scalar(), F.array().cast("array<string>"))


def _with_length(rows: DataFrame, stop: DataFrame) -> DataFrame:
    n = F.zip_with("terms", "tfs", lambda t, tf: F.when(F.array_contains("_stop", t), F.lit(0)).otherwise(tf))
    return rows.withColumn("_stop", _stop_list(stop)).withColumn("dl", F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("_stop")


def kept_lengths(rows: DataFrame, stop: DataFrame) -> DataFrame:
    """(docid, dl) of stored rows, without stop words."""
    return _with_length(rows, stop).select("docid", "dl")


def kept_postings(rows: DataFrame, stop: DataFrame) -> DataFrame:
    """The rows' other columns with (term, tf) for each term that is no stop word."""
    rest = [c for c in rows.columns if c not in ("terms", "tfs")]
    each = rows.select(*rest, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    return each.toDF(*rest, "term", "tf").join(F.broadcast(stop), "term", "left_anti").select(*rest, "term", "tf")


def query_bow(topics: DataFrame, index: Index, *, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """V4: query terms and counts, stop words removed: (keys, term, weight)."""
    return (term_counts(topics, list(keys), "title").join(index.stop, "term", "left_anti")
            .select(*keys, "term", F.col("tf").cast("double").alias("weight")))


def _idf(n_docs, df):
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def doc_weights(index: Index, *, k1: float = K1, b: float = B) -> DataFrame:
    """V6: BM25 weight of every (term, docid) posting: idf * tfpart (query weight 1).

    Document frequency and length come from partial-aggregated ``groupBy``s joined back to the
    postings, not from windows: a frequent term (up to half of all documents) is a hot key, and
    AQE can split a skewed join partition (or broadcast a small side), which it cannot do for a
    window partition.  N and avgdl are scalar subqueries.
    """
    if index.rows is not None:  # lengths are at hand where the terms lie
        p = kept_postings(_with_length(index.rows, index.stop), index.stop).join(index.df.select("term", "idf"), "term")
    else:
        p = index.postings.join(index.df.select("term", "idf"), "term").join(index.doclen, "docid")
    return p.select("term", "docid", _weight(index, k1, b).alias("w"))


def _weight(index: Index, k1: float, b: float) -> Column:
    avgdl = index.stats.select("avgdl").scalar()
    return F.col("idf") * (F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)))


def weighted_by_term(index: Index, buckets: int, *, k1: float = K1, b: float = B) -> DataFrame:
    """(term, docid, tf, w) dealt by term into ``buckets``: lengths are joined where the term counts lie, by document,
    and the one shuffle that deals the postings by term also serves the join with the terms' statistics."""
    dealt = index.postings.join(index.doclen, "docid").repartition(buckets, "term")
    return dealt.join(index.df.select("term", "idf"), "term").select("term", "docid", "tf", _weight(index, k1, b).alias("w"))


def bm25_search(weighted_terms: DataFrame, index: Index, k: int = 1000, *, keys: Sequence[str] = ("qid",),
                k1: float = K1, b: float = B, weights: DataFrame | None = None) -> DataFrame:
    """Weighted any-term BM25 search; returns keys..., docid, score, rank (rank <= k).

    Terms with empty text or weight <= 0 are skipped (V9).  ``weights`` may pass a persisted
    ``doc_weights`` frame, or a stored one (``sources.index``), to reuse across searches.

    Over an index that is stored by document (``rows``) the query terms, up to ``QUERY_TERMS`` of them, are broadcast and documents are
    scored where they are scanned: every document against every query, the hits that can be among the best
    leave the task.  That work and what it shuffles are in proportion to documents times queries and to hits times tasks, whatever the
    frequency of the terms.

    Otherwise a term equi-join, sums by (keys, docid) that start before the shuffle, and the usual top-k window: a frequent
    term is a hot key of the join, which adaptive execution splits; nothing is copied, collected or cut.  Sums
    don't depend on the order in which parts arrive (``exact_sum``), so equal documents have equal scores.
    """
    q = weighted_terms.filter((F.col("weight") > 0) & (F.length("term") > 0)).select(*keys, "term", "weight")
    if index.rows is not None and (weights is None or weights is index.weights):
        found = _score_rows(q, index, k, list(keys), *((k1, b) if weights is None else (index.k1, index.b)))
        if found is not None:
            return limit_per_topic(found, k, keys=keys)
    w = weights if weights is not None else doc_weights(index, k1=k1, b=b)
    scored = q.join(w, "term").groupBy(*keys, "docid").agg(exact_sum(F.col("weight") * F.col("w")).alias("score"))
    return limit_per_topic(scored, k, keys=keys)


QUERY_TERMS = 1 << 22  # (query, term) rows of a search that are broadcast
SCORE_CELLS = 1 << 21  # scores (of a query by a document) a task holds


def _score_rows(q: DataFrame, index: Index, k: int, keys: Sequence[str], k1: float, b: float) -> DataFrame | None:
    """The best hits of each task that scans the stored rows, or None if there are too many query terms for a broadcast."""
    terms = q.join(index.df.select("term", "idf"), "term").select(*keys, "term", (F.col("weight") * F.col("idf")).alias("weight")).persist()
    if terms.count() > QUERY_TERMS:
        terms.unpersist()
        return None
    table = terms.toArrow().combine_chunks()
    terms.unpersist()
    code = np.zeros(table.num_rows, np.int64)
    for c in keys:
        each = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(each.dictionary) + 1) + each.indices.to_numpy(), return_inverse=True)[1]
    first, unit = np.unique(code, return_index=True, return_inverse=True)[1:]
    words = table.column("term").combine_chunks().dictionary_encode()
    stats = index.stats.first()
    payload = (table.select(keys).take(pa.array(first, pa.int64())), words.dictionary, unit.astype(np.int32), words.indices.to_numpy(), table.column("weight").to_numpy(),
               pa.array([r[0] for r in index.stop.collect()], pa.string()), stats["avgdl"] or 0.0)
    rows = index.rows.select("docid", "terms", "tfs")
    out = T.StructType([T.StructField(c, q.schema[c].dataType, True) for c in keys]
                       + [T.StructField("docid", rows.schema["docid"].dataType, True), T.StructField("score", T.DoubleType(), True)])
    return rows.mapInArrow(_rows_kernel(q.sparkSession.sparkContext.broadcast(payload), keys, k, k1, b, out.names), out)


def _rows_kernel(payload, keys: Sequence[str], k: int, k1: float, b: float, names: Sequence[str]):
    """Scores the documents that a task scans, some thousands at a time, by all queries, and keeps each query's best;
    of more queries than a task has room for hits, those of each block of documents."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, words, unit, code, weight, stop, avgdl = payload.value
        n, kind, best = queries.num_rows, None, None
        if not n:
            return
        if n <= BLOCK_BYTES // (HIT_BYTES * k):
            best = _Best(n, k)
        by = np.argsort(unit, kind="stable")
        unit, code, weight = unit[by], code[by], weight[by]
        most = max(1, min(SCORE_CELLS // n, 1 << 14)) if best is not None else 1 << 14
        held, docs = [], 0

        def score():
            ids = pa.concat_arrays([h[0] for h in held]).to_numpy(zero_copy_only=False)
            shard = _Shard.of_codes(*(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)), ids, len(words))
            step = max(1, SCORE_CELLS // len(ids))
            for r0 in range(0, n, step):
                at = slice(*np.searchsorted(unit, [r0, min(n, r0 + step)]))
                sc = shard.scores(unit[at] - r0, code[at], weight[at], min(n, r0 + step) - r0)
                sc[~(sc > 0)] = -np.inf  # every contribution is positive: matched <=> score > 0
                if best is not None:
                    sc[sc < best.floor[r0:r0 + step, None]] = -np.inf
                rr, cc = _partial_topk(sc, k, shard.order)
                yield rr + r0, ids[cc], sc[rr, cc]

        def flush():
            for found in score() if held else ():
                if best is not None:
                    best.add(*found)
                else:
                    yield pa.RecordBatch.from_arrays(_hits(queries, keys, found, kind, names), names=names)

        for piece in _pieces(batches):
            kind = piece.schema.field(0).type
            for lo in range(0, piece.num_rows, most):
                some = piece.slice(lo, most)
                if docs + some.num_rows > most or sum(len(h[1]) for h in held) > 2 * TOKENS_AT_ONCE:
                    yield from flush()
                    held.clear()
                    docs = 0
                held.append(_weighted(some, docs, words, stop, avgdl, k1, b))
                docs += some.num_rows
        yield from flush()
        if best is not None and kind is not None and (found := best.cut()) is not None:
            yield pa.RecordBatch.from_arrays(_hits(queries, keys, found, kind, names), names=names)

    return search


def _weighted(rows: pa.RecordBatch, place: int, words: pa.Array, stop: pa.Array, avgdl: float, k1: float, b: float):
    """Ids, and of the terms that queries have: code, document (from ``place`` on) and tfpart."""
    lists = rows.column(1)
    doc = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    terms, tf = lists.flatten(), rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not pa.types.is_dictionary(terms.type):
        terms = terms.dictionary_encode()
    at = terms.indices.to_numpy()  # each term is looked up once
    kept = ~pc.is_in(terms.dictionary, value_set=stop).to_numpy(zero_copy_only=False).astype(bool)
    dl = np.bincount(doc, weights=tf * kept[at], minlength=rows.num_rows)
    code = pc.fill_null(pc.index_in(terms.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)[at]
    at = code >= 0
    doc, tf = doc[at], tf[at]
    return rows.column(0), code[at], doc + place, tf / (tf + k1 * (1 - b + b * dl[doc] / avgdl))


def exact_sum(x: Column) -> Column:
    """Sum of non-negative doubles (below 2^23, at most 2^20 of the largest size) that is the same in any order:
    two integer sums, of the multiples of 2^-20 and of what is left in multiples of 2^-60."""
    scaled = x * F.lit(2.0 ** 20)
    high = F.floor(scaled)
    low = F.floor((scaled - high) * F.lit(2.0 ** 40))
    return F.sum(high) / F.lit(2.0 ** 20) + F.sum(low) / F.lit(2.0 ** 60)


SHARD_DOCS = 16384       # documents of one shard of a sweep, about
UNIT_CELLS = 1 << 24     # scores (of a topic's words or a feedback document, by a shard's document) a task holds
CELL_BUDGET = 1 << 22    # scores of refined queries a task holds
PAIR_BUDGET = 1 << 16    # posting contributions per step inside a task
DENSE_TERM_CELLS = 1 << 24  # cells of the dense (heavy term x document) block of a shard
HEAVY_DENSITY = 1 / 16      # a term is "heavy" when it occurs in at least this share of a shard's documents
SCAN_DOCS = 2048            # documents of a stored index that a sweep's task scores at once
SCAN_CELLS = 1 << 21        # scores of feedback documents, and of trials, that it holds for them
HELD_BYTES = 32             # of a hit that a sweep's task holds
SWEEP_BYTES = 48 << 20      # of all hits that it holds


class _Shard:
    """A shard's postings by term: scores the rows (unit, term, weight) of a few units against its documents.

    Light terms add one contribution per posting; heavy ones (frequent in the shard) are a dense
    term x document block that is multiplied with the units' weights.  All contributions are positive, so a
    document matches a unit exactly when its score is > 0."""

    def __init__(self, rows: pa.Table):
        coded = rows.column("term").combine_chunks().dictionary_encode()
        place, docids = pd.factorize(rows.column("docid").to_numpy())
        self.words = coded.dictionary
        self._lay(coded.indices.to_numpy(), place, rows.column("w").to_numpy(), np.asarray(docids), len(self.words))

    @classmethod
    def of_codes(cls, code: np.ndarray, place: np.ndarray, w: np.ndarray, docids: np.ndarray, n_terms: int) -> _Shard:
        """Postings of terms that are numbers below ``n_terms`` and documents that are places in ``docids``."""
        self = cls.__new__(cls)
        self._lay(code, place, w, docids, n_terms)
        return self

    def codes(self, terms: pa.ChunkedArray) -> np.ndarray:
        """The shard's numbers of terms, -1 for those it doesn't have."""
        return pc.fill_null(pc.index_in(terms, value_set=self.words), -1).to_numpy()

    def _lay(self, code: np.ndarray, place: np.ndarray, w: np.ndarray, docids: np.ndarray, n_terms: int) -> None:
        self.docids, self.nd = docids, len(docids)
        self.order = docid_order(docids)
        by = np.argsort(code, kind="stable")
        self.doc, self.w = place[by], w[by]
        self.count = np.bincount(code, minlength=n_terms)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        heavy = np.nonzero(self.count >= max(2, self.nd * HEAVY_DENSITY))[0]
        heavy = heavy[np.argsort(-self.count[heavy], kind="stable")[:DENSE_TERM_CELLS // max(self.nd, 1)]]
        self.row_of = np.full(n_terms, -1)
        self.row_of[heavy] = np.arange(len(heavy))
        self.dense = np.zeros((len(heavy), self.nd))
        for i, c in enumerate(heavy):
            at = slice(self.start[c], self.start[c + 1])
            self.dense[i, self.doc[at]] = self.w[at]

    def scores(self, unit: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n units x documents) scores; terms below 0 are in no document."""
        out = np.zeros((n, self.nd))
        unit, weight, code = unit[code >= 0], weight[code >= 0], code[code >= 0]
        heavy = self.row_of[code] >= 0
        some = np.zeros((n, len(self.dense)))
        np.add.at(some, (unit[heavy], self.row_of[code[heavy]]), weight[heavy])
        np.matmul(some, self.dense, out=out)
        unit, weight, code = unit[~heavy], weight[~heavy], code[~heavy]
        cuts = np.searchsorted(np.cumsum(self.count[code]), np.arange(PAIR_BUDGET, self.count[code].sum() + PAIR_BUDGET, PAIR_BUDGET))
        for lo, hi in zip([0, *cuts], [*cuts, len(code)], strict=True):
            c, n_of = code[lo:hi], self.count[code[lo:hi]]
            if not n_of.any():
                continue
            at = np.repeat(self.start[c] - (np.cumsum(n_of) - n_of), n_of) + np.arange(n_of.sum())
            first, last = unit[lo:hi].min(), unit[lo:hi].max() + 1
            to, by = self.doc[at], np.repeat(weight[lo:hi], n_of) * self.w[at]
            if last - first > 1:
                to = to + np.repeat((unit[lo:hi] - first) * self.nd, n_of)
            if (last - first) * self.nd <= 4 * len(to):  # sums of a few whole rows, which a cache holds
                out[first:last] += np.bincount(to, weights=by, minlength=(last - first) * self.nd).reshape(-1, self.nd)
            else:
                np.add.at(out.reshape(-1), to + first * self.nd, by)
        return out


def rocchio_sweep_search(specs: DataFrame, bow: DataFrame, index: Index, weights: DataFrame, k: int = 1000, *,
                         n_shards: int | None = None, listed: bool = False) -> DataFrame:
    """BM25 of many Rocchio-refined queries at once, by linearity of the score.

    For a refined query alpha*bow(q) + beta*mean_f tf(f) (all weights positive, T10),
    score(d) = alpha*S_bow(q, d) + beta/n * sum_f S_f(d), where S_f is the BM25 score of feedback
    document f used as a query: a topic's trials share these scores instead of each expanding whole documents.

    Over an index that is stored by document a task has a block of topics and reads the stored rows, so that neither documents nor
    hits are shuffled (``_sweep_stored``).  With ``listed`` the result then is a row per trial and topic, (trial_id, qid, hits), with the hits
    (docid, score) in order of rank, of which an evaluation needs no shuffle either.

    Otherwise documents are dealt into shards, topics into blocks of a few.  A shard's rows come to a task in order: its
    documents, then block after block the topics, their feedback documents (each a row with its terms and weights) and the
    trials.  The task keeps the documents' postings and the scores of the units of one block (``UNIT_CELLS``), so what it
    holds does not grow with topics or trials; the documents are copied only where there are fewer shards than cores.
    A query's hits leave a shard cut to k, so they are ranked once, after the shuffle.

    ``specs``: (trial_id, qid, alpha, beta, fb ARRAY<docid>), repeated rows being equal; ``bow``: (qid, term, weight).
    Returns trial_id, qid, docid, score, rank (rank <= k).
    """
    if n_shards is None and index.rows is not None and weights is index.weights and (files := _stored_files(index)):
        lists = _sweep_stored(specs, bow, index, files, k)
        return lists if listed else unlisted(lists)
    cores = specs.sparkSession.sparkContext.defaultParallelism
    specs = cut_lineage(specs.select("trial_id", "qid", "alpha", "beta", "fb"))  # a row per trial and topic; read several times
    if n_shards is None:  # shards of at least 16k documents, so that the partial top-k prunes, and of bounded size
        rows = index.doclen.count()
        n_shards = int(max(1, min(cores, rows // max(16 * k, 1)), -(-rows // SHARD_DOCS)))
    lanes = max(1, cores // n_shards)
    used = specs.select("qid", F.explode_outer("fb").alias("docid")).distinct()
    most = used.groupBy("qid").agg(F.count("docid").alias("n")).agg(F.max("n")).first()[0] or 1
    per_block = max(1, UNIT_CELLS // SHARD_DOCS // (most + 1))
    blocks = (index_in_order(specs.select("qid").distinct(), "qid", "i")
              .select("qid", F.floor(F.col("i") / per_block).cast("int").alias("_blk")))
    specs = specs.join(blocks, "qid")
    units = used.filter("docid is not null").join(blocks, "qid").select("_blk", "docid").distinct()
    fed = _document_lists(index, units).select(F.lit(2).alias("_kind"), "_blk", F.col("docid").alias("f"), "terms", "weights")
    words = _lists(bow, "qid", "weight").join(blocks, "qid").select(F.lit(1).alias("_kind"), "_blk", "qid", "terms", "weights")
    trials = specs.select(F.lit(3).alias("_kind"), "_blk", "trial_id", "qid", "alpha", "beta", "fb")
    side = (words.unionByName(fed, allowMissingColumns=True).unionByName(trials, allowMissingColumns=True)
            .withColumn("_group", F.explode(F.sequence(F.pmod("_blk", F.lit(lanes)), F.lit(n_shards * lanes - 1), F.lit(lanes)))))
    posts = (_lists(weights, "docid", "w").select(F.lit(0).alias("_kind"), F.lit(-1).alias("_blk"), "docid", "terms", "weights", F.pmod(F.xxhash64("docid"), F.lit(n_shards)).cast("int").alias("_shard"))
             .withColumn("_group", F.explode(F.sequence(F.col("_shard") * lanes, F.col("_shard") * lanes + lanes - 1))).drop("_shard"))
    stream = (posts.unionByName(side, allowMissingColumns=True).repartitionById(n_shards * lanes, F.col("_group"))
              .sortWithinPartitions("_group", "_blk", "_kind"))
    out = T.StructType([T.StructField(c, specs.schema[c].dataType, True) for c in ("trial_id", "qid")]
                       + [T.StructField("docid", weights.schema["docid"].dataType, True), T.StructField("score", T.DoubleType(), True)])
    return rank_cut_hits(stream.mapInArrow(_sweep_kernel(k, out.names), out), k, keys=("trial_id", "qid"))


def _lists(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, terms, weights): a row per key of rows (key, term, weight)."""
    pairs = rows.groupBy(key).agg(F.collect_list(F.struct("term", F.col(weight).alias("weight"))).alias("_p"))
    return pairs.select(key, F.col("_p.term").alias("terms"), F.col("_p.weight").alias("weights"))


def _document_lists(index: Index, units: DataFrame) -> DataFrame:
    """(docid, _blk, terms, weights) with the term counts of the documents of ``units`` (docid, _blk).  Stored rows
    still have stop words, which no posting has."""
    if index.rows is not None:
        lists = index.rows.select("docid", "terms", F.col("tfs").cast("array<double>").alias("weights"))
    else:
        used = index.vectors().join(units.select("docid").distinct(), "docid", "left_semi")
        lists = _lists(used.select("docid", "term", F.col("tf").cast("double").alias("tf")), "docid", "tf")
    return lists.join(units, "docid")


def _sweep_kernel(k: int, names: Sequence[str]):
    def pieces(batches):
        """Tables of equal (group, block), whole, in order."""
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column("_group").to_numpy(), batch.column("_blk").to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if key is not None and tuple(keys[lo]) != key:
                        yield key, pa.Table.from_batches(held)
                        held = []
                    key = tuple(keys[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield key, pa.Table.from_batches(held)

    def search(batches):
        shard = None
        for (_, block), rows in pieces(batches):
            if block < 0:
                shard = _Shard(_each_term(rows, "w"))
            elif shard is not None:
                yield from _block_hits(shard, _each_term(rows, "weight"), k, names)

    return search


def _each_term(rows: pa.Table, weight: str) -> pa.Table:
    """Rows with lists of terms and weights as a row per term; rows without lists stay."""
    terms, weights = (rows.column(c).combine_chunks() for c in ("terms", "weights"))
    n = pc.fill_null(pc.list_value_length(terms), 1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    has = terms.is_valid().to_numpy(zero_copy_only=False)[row]
    place = pa.array(np.cumsum(has) - 1, mask=~has)
    out = rows.drop_columns(["terms", "weights"]).take(pa.array(row))
    return out.append_column("term", terms.flatten().take(place)).append_column(weight, weights.flatten().take(place))


class _Block:
    """The topics' words, feedback documents and trials of one block, laid out for scoring by one shard after the other.

    ``words`` and ``units`` are (row, code, weight) of the topics' words and of feedback documents; ``trow`` has the topic's row of each trial (-1: no
    words), ``frow`` the feedback documents' rows (-1: without kept terms), trial after trial as ``n_fb`` counts them."""

    def __init__(self, words, n_topics: int, units, n_units: int, trow: np.ndarray, frow: np.ndarray, n_fb: np.ndarray, alpha: np.ndarray, beta: np.ndarray, room: int):
        self.trow, self.frow, self.n_fb, self.alpha, self.n_topics = trow, frow, n_fb, alpha, n_topics
        self.coef = np.where(n_fb > 0, beta / np.maximum(n_fb, 1), 0.0)
        self.start = np.concatenate([[0], np.cumsum(n_fb)])
        self.words, self.units = _by_row(*words, n_topics), _by_row(*units, n_units)
        self.pieces = []
        lo = 0
        while lo < len(n_fb):  # as many trials as have feedback documents for which there is room
            hi = max(lo + 1, int(np.searchsorted(self.start, self.start[lo] + room, side="right")) - 1) if n_units > room else len(n_fb)
            mine = np.unique(frow[self.start[lo]:self.start[hi]])
            self.pieces.append((lo, hi, mine[mine >= 0]))
            lo = hi

    def scored(self, shard: _Shard, step: int, codes=None):
        """(first trial, scores of at most ``step`` trials by the shard's documents, -inf where nothing matches); ``codes`` are the
        shard's numbers of the block's.  Documents are scored by the feedback documents, or by the refined queries if these are fewer."""
        def scores(row, code, weight, n):
            return shard.scores(row, code if codes is None else codes[code], weight, n)

        s_q = np.vstack([scores(*_take(self.words, np.arange(self.n_topics)), self.n_topics), np.zeros((1, shard.nd))])
        for lo, hi, mine in self.pieces:
            s_f = scores(*_take(self.units, mine), len(mine)) if len(mine) <= hi - lo else None
            for r0 in range(lo, hi, step):
                r1 = min(hi, r0 + step)
                sc = self.alpha[r0:r1, None] * s_q[self.trow[r0:r1]]
                if s_f is None:
                    unit, trial = self.frow[self.start[r0]:self.start[r1]], np.repeat(np.arange(r1 - r0), self.n_fb[r0:r1])
                    unit, trial = unit[unit >= 0], trial[unit >= 0]
                    at, code, weight = _take(self.units, unit)
                    sc += scores(trial[at], code, weight * self.coef[r0:r1][trial][at], r1 - r0)
                for j in range(int(self.n_fb[r0:r1].max(initial=0)) if s_f is not None else 0):
                    have = np.flatnonzero(self.n_fb[r0:r1] > j)
                    unit = self.frow[self.start[r0 + have] + j]
                    have, unit = have[unit >= 0], unit[unit >= 0]
                    sc[have] += self.coef[r0 + have, None] * s_f[np.searchsorted(mine, unit)]
                sc[~(sc > 0)] = -np.inf  # every contribution is positive: matched <=> score > 0
                yield r0, sc


def _by_row(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int):
    """(start of each row, code, weight), in order of the row."""
    by = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), code[by].astype(np.int32), weight[by]


def _take(rows, some: np.ndarray):
    """Place in ``some``, code and weight of the entries of some rows."""
    start, code, weight = rows
    n = start[some + 1] - start[some]
    at = np.arange(n.sum()) + np.repeat(start[some] - (np.cumsum(n) - n), n)
    return np.repeat(np.arange(len(some)), n), code[at], weight[at]


def _rows_of(values: pa.ChunkedArray | pa.Array, among: pa.Array) -> np.ndarray:
    """The places of ``values`` in ``among``, -1 for what isn't there."""
    return pc.fill_null(pc.index_in(values if values.type == among.type else values.cast(among.type), value_set=among), -1).to_numpy()


def _trials_of(specs: pa.Table):
    """The feedback documents of all trials, one after the other, and their numbers."""
    fb = specs.column("fb").combine_chunks()
    return fb.flatten(), fb.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _block_hits(shard: _Shard, rows: pa.Table, k: int, names: Sequence[str]):
    """The partial top-k of the trials of one block of topics against one shard."""
    kind = rows.column("_kind").to_numpy()
    words, terms, specs = (rows.filter(pa.array(kind == i)) for i in (1, 2, 3))
    kinds = [rows.schema.field(c).type for c in ("trial_id", "qid", "docid")]
    flat, n_fb = _trials_of(specs)
    topics, docs = (pc.unique(t.column(c)) for t, c in ((words, "qid"), (terms, "f")))
    block = _Block((_rows_of(words.column("qid"), topics), shard.codes(words.column("term")), words.column("weight").to_numpy()), len(topics),
                   (_rows_of(terms.column("f"), docs), shard.codes(terms.column("term")), terms.column("weight").to_numpy()), len(docs),
                   _rows_of(specs.column("qid"), topics), _rows_of(flat, docs), n_fb, *(specs.column(c).to_numpy() for c in ("alpha", "beta")),
                   max(1, UNIT_CELLS // max(shard.nd, 1)))
    for r0, sc in block.scored(shard, max(1, CELL_BUDGET // max(shard.nd, 1))):
        rr, cc = _partial_topk(sc, k, shard.order)
        trial = pa.array(rr + r0, pa.int64())
        yield pa.RecordBatch.from_arrays([specs.column("trial_id").combine_chunks().take(trial), specs.column("qid").combine_chunks().take(trial),
                                          pa.array(shard.docids[cc], kinds[2]), pa.array(sc[rr, cc])], names=names)


def unlisted(lists: DataFrame) -> DataFrame:
    """A run of a row per trial and topic as a row per hit: trial_id, qid, docid, score, rank."""
    each = lists.select("trial_id", "qid", F.posexplode("hits").alias("_at", "_hit"))
    return each.select("trial_id", "qid", "_hit.docid", "_hit.score", (F.col("_at") + 1).alias("rank"))


def _stored_files(index: Index) -> tuple[list[str], list[str]] | None:
    """The files of the stored rows and of the terms' statistics, if tasks can open them."""
    files = tuple(sorted(frame.inputFiles()) for frame in (index.rows, index.df))
    try:
        for each in files:
            pafs.FileSystem.from_uri(each[0])
    except (IndexError, OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    return files


def _sweep_stored(specs: DataFrame, bow: DataFrame, index: Index, files: tuple[list[str], list[str]], k: int) -> DataFrame:
    """(trial_id, qid, hits): all trials of a topic, or a part of them, are in one task, which reads the stored rows twice, for its feedback
    documents and to score all documents, some thousands at a time.

    A task holds the best hits of its trials (``SWEEP_BYTES``), the terms of its feedback documents and ``SCAN_CELLS`` scores.  Only the
    trials and the topics' words are shuffled, whatever the number of documents; the rows are read once more for each block."""
    spark = specs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    specs = cut_lineage(specs.filter("qid is not null").groupBy("trial_id", "qid", "alpha", "beta", "fb").agg(F.count(F.lit(1)).cast("int").alias("n")))
    n_topics, most, total = specs.groupBy("qid").agg(F.count(F.lit(1)).alias("_t")).agg(F.count(F.lit(1)), F.max("_t"), F.sum("_t")).first()
    parts = max(1, -(-(most or 0) * k * HELD_BYTES // SWEEP_BYTES))
    lanes = max(-(-(total or 0) * k * HELD_BYTES // (SWEEP_BYTES * parts)), -(-cores // parts), 1)
    lanes = max(1, min(n_topics, -(-lanes // cores) * cores))
    at = index_in_order(specs.select("qid").distinct(), "qid", "i").select("qid", (F.floor(F.col("i") * lanes / max(n_topics, 1)) * parts).cast("int").alias("_first"))
    part = F.pmod(F.xxhash64("trial_id"), F.lit(parts)).cast("int")
    trials = specs.join(at, "qid").select(F.lit(3).alias("_kind"), (F.col("_first") + part).alias("_blk"), "trial_id", "qid", "alpha", "beta", "fb", "n")
    words = (_lists(bow, "qid", "weight").join(at, "qid")
             .select(F.lit(1).alias("_kind"), F.explode(F.sequence("_first", F.col("_first") + (parts - 1))).alias("_blk"), "qid", "terms", "weights"))
    stream = words.unionByName(trials, allowMissingColumns=True).repartitionById(lanes * parts, F.col("_blk"))
    hit = T.StructType([T.StructField("docid", index.rows.schema["docid"].dataType, True), T.StructField("score", T.DoubleType(), True)])
    out = T.StructType([T.StructField(c, specs.schema[c].dataType, True) for c in ("trial_id", "qid")] + [T.StructField("hits", T.ArrayType(hit), True)])
    stats = index.stats.first()
    payload = spark.sparkContext.broadcast((*files, pa.array([r[0] for r in index.stop.collect()], pa.string()), stats["avgdl"] or 0.0))
    found = stream.mapInArrow(_stored_kernel(payload, k, index.k1, index.b, out.names), out)
    best = F.sort_array(F.transform("hits", lambda x: F.struct((-rank_key(x["score"])).alias("key"), x["docid"].alias("docid"), x["score"].alias("score"))))
    return found.select("trial_id", "qid", F.transform(F.slice(best, 1, k), lambda x: F.struct(x["docid"].alias("docid"), x["score"].alias("score"))).alias("hits"))


def _scan(files: Sequence[str], columns: Sequence[str], rows: int, words: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """The rows of stored files, so many at a time at most, the columns ``words`` coded."""
    for path in files:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as source, pq.ParquetFile(source, read_dictionary=list(words)) as f:
            for batch in f.iter_batches(batch_size=rows, columns=list(columns), use_threads=False):
                yield batch.select(list(columns))


def _scan_rows(files: Sequence[str], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in _scan(files, ("docid", "terms", "tfs"), rows, ("terms.list.element",)):
        yield from _pieces([batch])


def _stored_kernel(payload, k: int, k1: float, b: float, names: Sequence[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        rows = pa.Table.from_batches(held) if held else None
        for blk in pc.unique(rows.column("_blk")).to_pylist() if held else ():
            yield from _stored_hits(rows.filter(pc.equal(rows.column("_blk"), blk)), *payload.value, k, k1, b, names)

    return search


def _stored_hits(rows: pa.Table, files: Sequence[str], df_files: Sequence[str], stop: pa.Array, avgdl: float, k: int, k1: float, b: float, names: Sequence[str]):
    """The best hits, in no order, of the trials of one block of topics, scored by all stored documents."""
    kind = rows.column("_kind").to_numpy()
    words, specs = _each_term(rows.filter(pa.array(kind == 1)), "weight"), rows.filter(pa.array(kind == 3)).sort_by("qid")
    if not specs.num_rows:
        return
    flat, n_fb = _trials_of(specs)
    block, vocabulary = _stored_block(words, specs, flat, n_fb, files, df_files)
    kept: dict[int, _Kept] = {}
    held, docs, id_type = [], 0, None

    def flush():
        ids = pa.concat_arrays([h[0] for h in held]).to_numpy(zero_copy_only=False)
        shard = _Shard.of_codes(*(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)), ids, len(vocabulary))
        for r0, sc in block.scored(shard, max(1, SCAN_CELLS // SCAN_DOCS)):
            kept.setdefault(r0, _Kept(len(sc), k)).add(sc, ids)

    for piece in _scan_rows(files, SCAN_DOCS):
        id_type = piece.schema.field(0).type
        if held and (docs + piece.num_rows > SCAN_DOCS or sum(len(h[1]) for h in held) > 2 * TOKENS_AT_ONCE):
            flush()
            held, docs = [], 0
        held.append(_weighted(piece, docs, vocabulary, stop, avgdl, k1, b))
        docs += piece.num_rows
    if held:
        flush()
    copies = specs.column("n").to_numpy()
    for r0, best in kept.items():
        r, ids, scores = best.cut()
        n = copies[r + r0]
        r, ids, scores = (np.repeat(x, n) for x in (r, ids, scores))
        trial, size = np.unique(r, return_counts=True)
        hits = pa.StructArray.from_arrays([pa.array(ids, id_type), pa.array(scores, pa.float64())], names=["docid", "score"])
        at = pa.array(trial + r0, pa.int64())
        yield pa.RecordBatch.from_arrays([*(specs.column(c).combine_chunks().take(at) for c in names[:2]),
                                          pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), hits)], names=names)


def _stored_block(words: pa.Table, specs: pa.Table, flat: pa.Array, n_fb: np.ndarray, files: Sequence[str], df_files: Sequence[str]) -> tuple[_Block, pa.Array]:
    """The block of trials, with the terms of its feedback documents looked up in the stored rows, and its vocabulary.  Stop words
    have no statistics and are left out."""
    asked, topics = pc.unique(flat), pc.unique(words.column("qid"))
    found = []
    for piece in _scan_rows(files, SCAN_DOCS // 4):
        at = _rows_of(piece.column(0), asked)
        if (at >= 0).any():
            some = piece.filter(pa.array(at >= 0))
            n = pc.fill_null(pc.list_value_length(some.column(1)), 0).to_numpy(zero_copy_only=False)
            terms = some.column(1).flatten().dictionary_decode().dictionary_encode()
            found.append((terms.dictionary, np.repeat(at[at >= 0].astype(np.int32), n), terms.indices.to_numpy(), some.column(2).flatten().to_numpy(zero_copy_only=False)))
    vocabulary = pc.unique(pa.chunked_array([*words.column("term").chunks, *(f[0] for f in found)], pa.string()))
    idf = np.full(len(vocabulary), np.nan)
    for batch in _scan(df_files, ("term", "idf"), TOKENS_AT_ONCE // 4):
        at = _rows_of(batch.column(0), vocabulary)
        idf[at[at >= 0]] = batch.column(1).to_numpy(zero_copy_only=False)[at >= 0]

    def weighted(row, code, weight):
        has = np.isfinite(idf[code])
        return row[has], code[has], weight[has] * idf[code[has]]

    units = [weighted(unit, _rows_of(terms, vocabulary)[code], tf) for terms, unit, code, tf in found] or [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))]
    found.clear()
    units = [np.concatenate(x) for x in zip(*units, strict=True)]
    return _Block(weighted(_rows_of(words.column("qid"), topics), _rows_of(words.column("term"), vocabulary), words.column("weight").to_numpy()), len(topics),
                  units, len(asked), _rows_of(specs.column("qid"), topics), _rows_of(flat, asked), n_fb,
                  *(specs.column(c).to_numpy() for c in ("alpha", "beta")), max(1, SCAN_CELLS // SCAN_DOCS)), vocabulary


class _Kept:
    """The best hits of some trials while documents come by: those that can be among a trial's k first by rounded score and docid."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.held, self.room = k, np.full(n, -np.inf), [], 0, max(n * k + n * k // 4, 1 << 14)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all trials by some documents, -inf for what doesn't match."""
        rr, cc = np.nonzero((scores >= self.floor[:, None]) & (scores > -np.inf))
        self.parts.append((rr.astype(np.int32), ids[cc], scores[rr, cc]))
        self.held += len(rr)
        if self.held > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        n = np.bincount(rows, minlength=len(self.floor))
        many = np.flatnonzero(n > self.k)
        if len(many):
            by = np.argsort(rows, kind="stable")
            rows, ids, scores = rows[by], ids[by], scores[by]
            place = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(n)])[rows]
            of = np.full(len(n), -1)
            of[many] = np.arange(len(many))
            block = np.full((len(many), n.max()), -np.inf)
            at = of[rows] >= 0
            block[of[rows[at]], place[at]] = scores[at]
            kth = np.partition(block, n.max() - self.k, axis=1)[:, n.max() - self.k]
            self.floor[many] = np.maximum(self.floor[many], kth - TIE_EPS)
            keep = scores >= self.floor[rows]
            rows, ids, scores = rows[keep], ids[keep], scores[keep]
            if len(rows) > self.room:  # of equal scores only the k first documents can be among the best
                rows, at = _first_of_equal(rows, np.arange(len(rows)), scores, docid_order(ids), self.k)
                ids, scores = ids[at], scores[at]
        self.parts, self.held = [(rows, ids, scores)], len(rows)
        return self.parts[0]


def mean_feedback(feedback: DataFrame, index: Index, *, mode: str = "tf", keys: Sequence[str] = ("qid",),
                  weights: DataFrame | None = None) -> DataFrame:
    """V7: per (keys): sum of the feedback documents' term vectors divided by the number of
    feedback documents (all of them, even ones without terms), weights > 0 kept.

    ``mode='tf'`` uses raw term counts, ``mode='bm25'`` the V6 weights.  A stored index has its documents
    bucketed by id, so the feedback documents are shuffled to them, or broadcast, and not the other way."""
    if mode not in ("tf", "bm25"):
        raise ValueError(f"unknown feedback vector mode {mode!r}")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n")
    fed = feedback.select(*keys, "docid", n).filter(" and ".join(f"`{c}` is not null" for c in keys))
    if index.rows is not None:
        rows = index.rows if mode == "tf" else _with_length(index.rows, index.stop)
        found = kept_postings(fed.join(rows, "docid"), index.stop)
        if mode == "tf":
            found = found.withColumn("w", F.col("tf").cast("double"))
        else:
            found = found.join(index.df.select("term", "idf"), "term").withColumn("w", _weight(index, index.k1, index.b))
    elif mode == "tf":
        found = fed.join(index.vectors().select("term", "docid", F.col("tf").cast("double").alias("w")), "docid")
    else:
        found = fed.join(weights if weights is not None else doc_weights(index), "docid")
    return (found.groupBy(*keys, "_n", "term").agg(F.sum("w").alias("_s"))
            .select(*keys, "term", (F.col("_s") / F.col("_n")).alias("weight"))
            .filter(F.col("weight") > 0))


def refine_terms(query_terms: DataFrame, fb_terms: DataFrame, *, alpha: float = 1.0, beta: float = 0.75,
                 keys: Sequence[str] = ("qid",)) -> DataFrame:
    """V8: alpha*q + beta*fb over the union of terms; only weights > 0 survive."""
    a = query_terms.select(*keys, "term", (F.col("weight") * alpha).alias("weight")).filter("weight > 0")
    f = fb_terms.select(*keys, "term", (F.col("weight") * beta).alias("weight")).filter("weight > 0")
    return (a.unionByName(f).groupBy(*keys, "term").agg(F.sum("weight").alias("weight"))
            .filter(F.col("weight") > 0))
