"""Retrieval operators R1-R5, R8-R11.

Exact top-k vector search reads the corpus where it is scanned:

* the queries are measured and, up to ``QUERY_BYTES``, broadcast;
* ``mapInArrow`` over the corpus partitions scores documents against queries with NumPy products, ``BLOCK_BYTES`` of
  vectors at a time and as many queries after the other as a task can hold with their hits, and keeps the
  k best per query (plus exact ties);
* a global ``row_number() <= k`` window (``WindowGroupLimit`` partial + final) merges what tasks kept.

The corpus is never shuffled; at most k rows (and ties) per query and ``BLOCK_BYTES`` of vectors are.  Of many queries the
scores that a hit must reach are found first (``_floors``), so that all tasks together send little more than k hits a
query, however many they are.  Where a scan has fewer partitions than the cluster has cores, it is read for as many blocks of queries as keep the cores busy.

Larger query sets meet the corpus in shuffled groups instead (hash shards of the corpus by query blocks, both
bounded by bytes).  Both ways share one kernel; the result does not depend on the layout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fbrank.functions.vectors import dot, sign_vec
from fbrank.session import cut_lineage

RANK_DIGITS = 9      # fixed value: ranking key is round(score, 9), then docid
TIE_EPS = 1e-9       # candidates within this of the k-th score are kept (exact ties survive)
CELL_BUDGET = 1 << 21  # score-matrix cells per NumPy step inside one task
QUERY_BYTES = 128 << 20  # of all queries of a search that are broadcast
BLOCK_BYTES = 64 << 20   # of a block's queries and best hits in one task; of a shuffled shard or block of vectors
FLOOR_HITS = 1 << 22     # hits of all tasks of a search, from which on floors are found first
HIT_BYTES = 128          # of a hit while a task sorts its best ones


def rank_key(score: Column | str = "score") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.round(s, RANK_DIGITS)


def _matrix(col: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0), dtype=dtype)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1)


def _bits(m: np.ndarray) -> np.ndarray:
    return np.packbits(m > 0, axis=1)


def _scores(qm: np.ndarray, cm: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return qm @ cm.T
    if metric == "hamming":  # qm, cm are packed bit codes; higher score = closer
        x = np.bitwise_xor(qm[:, None, :], cm[None, :, :])
        return -np.bitwise_count(x).sum(axis=2, dtype=np.int64).astype(np.float64)
    raise ValueError(f"unknown metric {metric!r}")


def _partial_topk(scores: np.ndarray, k: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row/col indices that cover each row's k best entries by (score rounded anyhow, docid).

    Entries within TIE_EPS of the k-th stay, whose order rounding decides; of entries with the same
    score only the k first in ``order`` (a column's place in docid order) can be among the best."""
    nq, nc = scores.shape
    finite = np.isfinite(scores)
    if nc <= k:
        return np.nonzero(finite)
    many = np.flatnonzero(finite.sum(axis=1) > k)  # of the others every entry stays
    if len(many):
        part = np.partition(scores if len(many) == nq else scores[many], nc - k, axis=1)[:, nc - k]
        finite[many] &= scores[many] >= (part - TIE_EPS)[:, None]
    rr, cc = np.nonzero(finite)
    if order is not None and len(rr) > nq * k:
        rr, cc = _first_of_equal(rr, cc, scores[rr, cc], order, k)
    return rr, cc


def _first_of_equal(rr, cc, ss, order, k):
    """Drops what comes after the k first, in docid order, of a row's entries with one score."""
    at = np.lexsort((order[cc], ss, rr))
    new = np.ones(len(at), bool)
    new[1:] = (rr[at][1:] != rr[at][:-1]) | (ss[at][1:] != ss[at][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    keep = np.sort(at[np.arange(len(at)) - start < k])
    return rr[keep], cc[keep]


def docid_order(ids: np.ndarray) -> np.ndarray:
    """Each document's place when sorted by id (numbers, or strings by code point)."""
    return np.unique(ids, return_inverse=True)[1]


class _Best:
    """The best hits per query so far: (query row, docid, score) arrays, cut now and then."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor, self.room = k, np.full(n, -np.inf) if floor is None else floor.copy(), max(n * k + n * k // 4, 1 << 16)
        self.parts, self.held = [], 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((rows, ids, scores))
        self.held += len(rows)
        if self.held > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Keeps each query's k first by score and the exact or nearly exact ties of the last, which rounding decides."""
        if not self.parts:
            return None
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.lexsort((docid_order(ids), -scores, rows))
        rows, ids, scores = rows[by], ids[by], scores[by]
        first = np.searchsorted(rows, rows, side="left")
        place = np.arange(len(rows)) - first
        last = np.minimum(first + self.k - 1, np.searchsorted(rows, rows, side="right") - 1)
        same = np.ones(len(rows), bool)
        same[1:] = (rows[1:] != rows[:-1]) | (scores[1:] != scores[:-1])
        tie = np.arange(len(rows)) - np.maximum.accumulate(np.where(same, np.arange(len(rows)), 0))
        keep = ((place < self.k) | (scores >= scores[last] - TIE_EPS)) & (tie < self.k)
        full = place == self.k - 1
        self.floor[rows[full]] = np.maximum(self.floor[rows[full]], scores[full] - TIE_EPS)
        self.parts, self.held = [(rows[keep], ids[keep], scores[keep])], int(keep.sum())
        return self.parts[0]


def _read(docids, vecs) -> tuple[np.ndarray, np.ndarray]:
    ids = docids.to_numpy(zero_copy_only=False) if isinstance(docids, pa.Array) else docids.to_numpy()
    return ids, _matrix(vecs)


def _searched(qt: pa.Table, batches: Iterable[tuple[np.ndarray, np.ndarray]], qv: str, k: int, metric: str, exclude: str | None,
              floor: np.ndarray | None = None):
    """Query rows, docids and scores of the best hits over batches of docids and their vectors, not below the queries' ``floor``."""
    qm = _matrix(qt.column(qv))
    if metric == "hamming":
        qm = _bits(qm)
    excl = qt.column(exclude).to_numpy() if exclude else None
    best = _Best(len(qm), k, floor)
    for ids, cm in batches:
        if not len(ids) or not len(qm):
            continue
        cells = CELL_BUDGET
        if metric == "hamming":
            cm = _bits(cm)
            cells = max(1, CELL_BUDGET // cm.shape[1])  # a pair takes as many bytes as a code
        order = docid_order(ids)
        cols = min(len(ids), cells)
        rows = max(1, cells // cols)
        for c0 in range(0, len(ids), cols):
            for r0 in range(0, len(qm), rows):
                s = _scores(qm[r0:r0 + rows], cm[c0:c0 + cols], metric)
                if excl is not None:
                    s[excl[r0:r0 + rows, None] == ids[None, c0:c0 + cols]] = -np.inf
                s[s < best.floor[r0:r0 + rows, None]] = -np.inf
                rr, cc = _partial_topk(s, k, order[c0:c0 + cols])
                best.add(rr + r0, ids[c0 + cc], s[rr, cc])
    return best.cut()


def _hits(qt: pa.Table, keys: Sequence[str], found, id_type: pa.DataType, names: Sequence[str]) -> list[pa.Array]:
    rows, ids, scores = found if found is not None else (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
    at = pa.array(rows, pa.int64())
    return [*((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).take(at) for c in map(qt.column, keys)),
            pa.array(ids, id_type), pa.array(scores, pa.float64())]


def topk_search(queries: DataFrame, corpus: DataFrame, k: int, *, keys: Sequence[str] = ("qid",),
                qv: str = "qv", docid: str = "docid", vec: str = "vec", metric: str = "ip",
                exclude_self: str | None = None, blocks: int | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact top-k per query row.

    Returns ``keys..., docid, score DOUBLE, rank INT`` with rank 1..k ordered by
    ``round(score, 9) desc, docid asc``.  ``exclude_self`` names a query column whose value
    must never be retrieved as a docid (a topic drawn from the corpus).

    The queries are computed and measured when the search is planned: up to ``query_bytes`` they are
    broadcast in ``blocks`` (by default as many as keep the cores busy) and the corpus is searched
    where it is scanned; larger sets are searched in shuffled groups.
    """
    spark = queries.sparkSession
    keys = list(keys)
    qcols = list(dict.fromkeys(keys + ([exclude_self] if exclude_self else [])))
    q = queries.select(*qcols, F.col(qv).cast("array<double>").alias(qv)).persist()
    n, top, size = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(qv)), F.lit(0)), F.coalesce(F.sum(F.size(qv)), F.lit(0)) * 8).first()
    c = corpus.select(F.col(docid), F.col(vec).cast("array<double>").alias(vec))
    id_field = corpus.schema[docid]
    out = T.StructType([T.StructField(kc, queries.schema[kc].dataType, True) for kc in keys]
                       + [T.StructField(docid, id_field.dataType, True), T.StructField("score", T.DoubleType(), True)])
    if size > query_bytes:
        found = _in_groups(q, c, k, out, keys, qv, docid, vec, metric, exclude_self, int(top), int(size))
        return limit_per_topic(found, k, keys=keys, docid=docid)
    table = q.toArrow().combine_chunks()
    q.unpersist()
    cores = spark.sparkContext.defaultParallelism
    # a corpus that is computed with a shuffle has as many partitions as that gives it; a scan's are known
    parts = cores if "Exchange" in c._jdf.queryExecution().executedPlan().toString() else max(1, c.rdd.getNumPartitions())
    blocks = max(1, min(n, blocks or -(-cores // parts)))
    at_once = max(1, BLOCK_BYTES // (8 * top + HIT_BYTES * k))
    found = floors = None
    if n * k * parts >= FLOOR_HITS and parts > 1:
        floors = _floors(table, c, k, qv, docid, metric, exclude_self, parts, blocks, 8 * top)
    for b in range(blocks):
        mine = np.arange(b, n, blocks)
        block = spark.sparkContext.broadcast((table.take(pa.array(mine, pa.int64())), None if floors is None else floors[mine]))
        part = c.mapInArrow(_scan_kernel(block, keys, qv, k, at_once, metric, exclude_self, out.names), out)
        found = part if found is None else found.unionAll(part)
    return (limit_per_topic if floors is None else rank_cut_hits)(found, k, keys=keys, docid=docid)


def _floors(table: pa.Table, c: DataFrame, k: int, qv: str, docid: str, metric: str, exclude: str | None, parts: int, blocks: int, query_bytes: int) -> np.ndarray:
    """A score per query that at least k documents reach (-inf if fewer are known to).

    Every task finds its few best scores of a query, about twice its share of k, and gives every ``step``-th of them, which stands for
    ``step`` documents that reach it.  The score at which these add up to k is a bound, whatever way documents are dealt; where they are
    dealt evenly little more than k documents reach it."""
    spark = c.sparkSession
    step = max(1, -(-k // (2 * parts)))
    few = min(k, 4 * step)
    at_once = max(1, BLOCK_BYTES // (query_bytes + HIT_BYTES * few))
    numbered = table.append_column("_row", pa.array(np.arange(table.num_rows), pa.int64()))
    found = None
    for b in range(blocks):
        block = spark.sparkContext.broadcast((numbered.take(pa.array(np.arange(b, table.num_rows, blocks), pa.int64())), None))
        out = T.StructType([T.StructField("_row", T.LongType()), T.StructField(docid, c.schema[docid].dataType), T.StructField("score", T.DoubleType())])
        part = c.mapInArrow(_scan_kernel(block, ["_row"], qv, few, at_once, metric, exclude, out.names, step=step), out).select("_row", "score")
        found = part if found is None else found.unionAll(part)
    enough = -(-k // step)
    best = found.groupBy("_row").agg(F.element_at(F.sort_array(F.collect_list("score"), asc=False), enough).alias("floor"))
    got = best.filter("floor is not null").toArrow()
    floors = np.full(table.num_rows, -np.inf)
    floor = got.column("floor").to_numpy()
    floors[got.column("_row").to_numpy()] = floor - 2 * TIE_EPS - np.abs(floor) * 1e-12  # a product's last bits may differ the next time
    return floors


def _scan_kernel(block, keys, qv, k, at_once, metric, exclude, names, step: int = 1):
    """Searches what a task scans, ``BLOCK_BYTES`` of vectors at a time, for ``at_once`` queries after the other; with a
    ``step`` it gives every step-th hit of a query."""
    def against(queries, held: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        qt, floor = queries
        for r0 in range(0, qt.num_rows, at_once):
            some = qt.slice(r0, at_once)
            found = _searched(some, held, qv, k, metric, exclude, None if floor is None else floor[r0:r0 + at_once])
            if found is not None and step > 1:
                place = np.arange(len(found[0])) - np.searchsorted(found[0], found[0], side="left")
                found = tuple(x[place % step == step - 1] for x in found)
            if found is not None:
                yield pa.RecordBatch.from_arrays(_hits(some, keys, found, kind, names), names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            held.append(_read(batch.column(0), batch.column(1)))
            size += held[-1][1].nbytes
            if size > BLOCK_BYTES:
                yield from against(block.value, held, kind)
                held, size = [], 0
        if held:
            yield from against(block.value, held, kind)

    return search


def _in_groups(q: DataFrame, c: DataFrame, k: int, out: T.StructType, keys, qv, docid, vec, metric, exclude, dim: int, size: int) -> DataFrame:
    """The search of query sets too large to broadcast: a corpus shard of at least 4k documents and a query block
    per group, each of about ``BLOCK_BYTES``; a query is copied once per shard, a document once per block."""
    shards = max(1, -(-c.count() * 8 * max(dim, 1) // BLOCK_BYTES))
    blocks = max(1, -(-size // BLOCK_BYTES))
    left = (q.withColumn("_blk", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
            .withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    right = (c.withColumn("_shard", F.pmod(F.xxhash64(docid), F.lit(shards)).cast("int"))
             .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(qt: pa.Table, ct: pa.Table) -> pa.Table:
        found = _searched(qt, [_read(ct.column(docid), ct.column(vec))], qv, k, metric, exclude)
        return pa.Table.from_arrays(_hits(qt, keys, found, ct.schema.field(docid).type, out.names), names=out.names)

    return left.groupBy("_blk", "_shard").cogroup(right.groupBy("_blk", "_shard")).applyInArrow(search, out)


def limit_per_topic(hits: DataFrame, k: int, *, keys: Sequence[str] = ("qid",), docid: str = "docid",
                    score: str = "score") -> DataFrame:
    """row_number over (keys) by round(score,9) desc, docid asc; keep rank <= k."""
    w = Window.partitionBy(*keys).orderBy(rank_key(score).desc(), F.col(docid).asc())
    return (hits.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def rank_cut_hits(hits: DataFrame, k: int, *, keys: Sequence[str] = ("qid",), docid: str = "docid") -> DataFrame:
    """``limit_per_topic`` for hits of which each task kept a query's k best already: sorted once, after the shuffle.

    Spark puts a limit of its own before the shuffle, a sort of all hits, where it finds rank and k compared directly."""
    w = Window.partitionBy(*keys).orderBy(rank_key("score").desc(), F.col(docid).asc())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.lit(k) - F.col("rank") >= 0)


def binary_search(queries: DataFrame, corpus: DataFrame, binary_k: int, k: int, *, rerank: bool = False,
                  keys: Sequence[str] = ("qid",), qv: str = "qv", docid: str = "docid", vec: str = "vec",
                  exclude_self: str | None = None) -> DataFrame:
    """Hamming top-``binary_k`` over sign codes; with ``rerank``, rescore the candidates by
    dot(query, +-1 code) and keep ``k``.  Without rerank, score = -hamming distance."""
    cand = topk_search(queries, corpus, binary_k, keys=keys, qv=qv, docid=docid, vec=vec, metric="hamming",
                       exclude_self=exclude_self)
    if not rerank:
        return cand.filter(F.col("rank") <= k)
    qsel = queries.select(*keys, F.col(qv).alias("_qv"))
    scored = (cand.drop("score", "rank")
              .join(qsel, list(keys))
              .join(corpus.select(F.col(docid), F.col(vec).alias("_vec")), docid)
              .withColumn("score", dot("_qv", sign_vec("_vec")))
              .drop("_qv", "_vec"))
    return limit_per_topic(scored, k, keys=keys, docid=docid)


def max_passage(hits: DataFrame, *, delimiter: str = "#", max_hits: int = 100, keys: Sequence[str] = ("qid",),
                docid: str = "docid") -> DataFrame:
    """Best passage per document (prefix before ``delimiter``), re-ranked, capped."""
    doc = F.substring_index(F.col(docid).cast("string"), delimiter, 1)
    w_doc = Window.partitionBy(*keys, "_doc").orderBy(F.col("rank").asc())
    best = (hits.withColumn("_doc", doc)
            .withColumn("_r", F.row_number().over(w_doc))
            .filter("_r = 1")
            .select(*keys, F.col("_doc").alias(docid), "score", F.col("rank").alias("_orig_rank")))
    w = Window.partitionBy(*keys).orderBy(F.col("_orig_rank").asc())
    return (best.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= max_hits)
            .drop("_orig_rank"))


def break_ties(hits: DataFrame, *, keys: Sequence[str] = ("qid",), docid: str = "docid",
               digits: int = 6, step: float = 1e-6) -> DataFrame:
    """In rank order, each score is its rounded value or the previous one less ``step``,
    whichever is lower, so that no two of a topic are equal; re-ranked.

    In closed form: the running minimum of (score + place x step), less place x step."""
    w = Window.partitionBy(*keys).orderBy(F.col("rank").asc())
    place = F.row_number().over(w)
    lifted = F.round(F.col("score"), digits) + place * F.lit(step)
    out = (hits.withColumn("_place", place).withColumn("_lifted", lifted)
           .withColumn("score", F.round(F.min("_lifted").over(w) - F.col("_place") * F.lit(step), digits))
           .drop("_place", "_lifted", "rank"))
    wr = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(docid).asc())
    return out.withColumn("rank", F.row_number().over(wr))


def index_in_order(df: DataFrame, order_col: str, name: str = "i") -> DataFrame:
    """0-based position of each row in ``order_col`` order: rows are dealt by range and numbered in
    their partition, to which the sizes of the partitions before it are added."""
    dealt = cut_lineage(df.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order_col))
    return (dealt.join(starts, "_part").withColumn(name, (F.col("_start") + own - 1).cast("long"))
            .drop("_part", "_start"))


def assign_batches(topics: DataFrame, batch_size: int, *, qid: str = "qid") -> DataFrame:
    """Batches of ``batch_size`` topics in qid order; the last batch may be short.

    No single-partition window is needed for large topic sets (``index_in_order``).
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    indexed = index_in_order(topics, qid, "_idx")
    return (indexed.withColumn("batch", F.floor(F.col("_idx") / batch_size).cast("int"))
            .withColumn("batch_pos", (F.col("_idx") % batch_size).cast("int"))
            .drop("_idx"))
