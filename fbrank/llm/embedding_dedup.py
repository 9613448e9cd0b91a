"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Each vector is scaled to unit length and quantised to int8 steps of its own size; the length of
what quantisation lost is computed exactly, so the product of two quantised vectors bounds their
cosine from both sides.  A tile product is one matrix product of de-quantised codes.  Pairs whose
upper bound is below the threshold are done; pairs whose lower bound reaches it are links; only
the rest is computed again in double precision.

Equal vectors are one class and only classes are compared.  All pairs of tiles are compared, each
pair of tiles is one group of at most about ``2 * TILE`` rows.  A group returns, per vector with a
link, the number of links and one edge of a spanning forest; no pair leaves it.
The work grows with the square of the number of distinct vectors: any pair may be a link, and at
this threshold cell bounds on high-dimensional vectors exclude next to nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.llm.components import connected_components, smallest_reachable
from fbrank.llm.frames import column, settled

TILE = 2048
ROWS = 512
PAIRS = 65_536


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, step sizes, and the exact length of what the codes leave out, for rows of unit length."""
    step = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * step[:, None], axis=1)
    return codes, step, lost


def _decoded(codes: np.ndarray, step: np.ndarray) -> np.ndarray:
    return codes.astype(np.float32) * step.astype(np.float32)[:, None]


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Link matrix of unit rows ``a`` and ``b`` (double precision): ``a @ b.T >= threshold``, exactly."""
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    da, db = _decoded(qa, sa), _decoded(qb, sb)
    # single precision: de-quantising and the product each err by less than dim * 2**-22 on unit vectors
    slack = (a.shape[1] + 8) * 2.0**-22
    # |a.b - a'.b'| <= |a'| |b - b'| + |a - a'| |b|, with |a'| <= 1 + |a - a'|
    grow = 1.0 + (ea.max() if len(ea) else 0.0)
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), ROWS):
        near = da[at : at + ROWS] @ db.T
        bound = (ea[at : at + ROWS] + slack)[:, None].astype(np.float32) + (grow * eb).astype(np.float32)[None, :]
        bound += np.float32(1e-6)
        maybe = near + bound >= threshold
        if maybe.any():
            i, j = np.nonzero(maybe)
            sure = near[i, j] - bound[i, j] >= threshold
            out[at + i[sure], j[sure]] = True
            i, j = at + i[~sure], j[~sure]
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                out[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return out


def _unit(column_: pa.ChunkedArray, dim: int) -> np.ndarray:
    x = np.asarray(column_.combine_chunks().flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]  # else squares of very small or large numbers would be lost
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _pair_of_tiles(threshold: float):
    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key)
        tile = table.column("tile").to_numpy()
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        unit = _unit(table.column("vec"), dim)
        of_i, of_j = np.nonzero(tile == i)[0], np.nonzero(tile == j)[0]
        found = tile_links(unit[of_i], unit[of_j], threshold)
        if i == j:
            np.fill_diagonal(found, False)
        x, y = found.any(axis=1), found.any(axis=0)
        if i == j:
            who = of_i[x]
            link, count = found[np.ix_(x, x)], found[x] @ copies[of_j]
        else:
            who = np.concatenate([of_i[x], of_j[y]])
            n, m = int(x.sum()), int(y.sum())
            link = np.zeros((n + m, n + m), bool)
            link[:n, n:] = found[np.ix_(x, y)]
            link[n:, :n] = link[:n, n:].T
            count = np.concatenate([found[x] @ copies[of_j], found[:, y].T @ copies[of_i]])
        return pa.table({"a": pa.array(ids[who], pa.int64()), "b": pa.array(smallest_reachable(ids[who], link), pa.int64()),
                         "links": pa.array(count, pa.int64())})

    return links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                 tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of one length link at cosine >= ``threshold`` (above 0).  A vector that is null, empty, zero, or holds a
    null or non-finite component links with nothing.  A row without an id links with nothing and
    is kept, its ``component_id`` null.  Rows repeated under one id are vectors of their own.
    Other columns are not read."""
    vec = column(vectors, vec_col)
    if vectors.select(vec).schema[0].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), vec.alias("vec"))
    sound = (F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & F.exists("vec", lambda x: x != 0.0) & F.col("id").isNotNull())
    rows = rows.select("id", "vec", F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = rows.filter("sound").select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(7), F.reverse("vec")).alias("k2"))
    classes = settled(keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    n_tiles = F.lit(max(1, -(-classes.count() // tile)))
    paired = (classes.select("rep", "copies", "vec", F.pmod(F.xxhash64("k1", "k2"), n_tiles).cast("int").alias("tile"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), (n_tiles - 1).cast("int"))))
              .select("rep", "copies", "vec", "tile", F.size("vec").alias("dim"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    found = settled(paired.groupBy("dim", "i", "j").applyInArrow(_pair_of_tiles(threshold), "a long, b long, links long"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    components = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    of_class = (classes.select("rep", "copies", "k1", "k2").join(counts, "rep", "left").join(components, "rep", "left")
                .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    linked = keyed.select("id", "k1", "k2").join(of_class, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.filter("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                            F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
