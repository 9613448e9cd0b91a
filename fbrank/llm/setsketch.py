"""MinHash-style near-duplicates with SetSketch registers.

Each document's set of word shingles is hashed and summarised by ``M`` registers; register *i*
holds ``floor(1 - log_b x)``, cut to ``0 .. 255``, of the smallest exponential variate ``x`` that
the set's elements draw under hash *i* (rate ``A``).  Registers of a union are element-wise
maxima, and registers of similar sets agree with nearly the probability of their Jaccard
similarity, so bands of register values find the candidates.

Documents with equal sets are one class from the start and only classes are compared.  Bands with
the same members are compared once.  A bucket of any size is split into tiles of about ``TILE``
classes and every pair of tiles is one task's group: nothing is capped and no group grows with the
data.  A pair that shares several bands belongs to the first of them.  In a group, a pair is
dropped when it belongs to another or when the joint likelihood of its registers (given the two
set sizes) speaks against the threshold by more than ``SURE`` nats.  This is tested on the bands'
registers alone; then the full shingle sets of members with a pair left are fetched, and those
pairs are confirmed on them.  A group returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.llm.components import connected_components, smallest_reachable
from fbrank.llm.frames import column, fresh, settled

SHINGLE = 5
M = 144
BASE, RATE = 1.2, 20.0
TILE = 1024
SURE = 10.0
#: word hashes that a Python worker remembers; more are only computed again
WORDS_KEPT = 400_000

_ODD = np.random.default_rng(20240229).integers(0, 2**64, size=(8, M), dtype=np.uint64) | np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORD = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; fewer words are one shingle, none is an empty set."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORD.__getitem__, words), np.uint64, n)
    m = min(n, k)
    rng = np.random.default_rng(k).integers(0, 2**64, size=k + 1, dtype=np.uint64) | np.uint64(1)
    h = np.full(n - m + 1, m, np.uint64) * rng[k]
    for i in range(m):
        h += w[i : n - m + 1 + i] * rng[i]
    return np.unique(_mix(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """``M`` SetSketch registers of a set of 64-bit hashes (all zero for the empty set)."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        x = (hashes[at : at + 512, None] ^ _ODD[0]) * _ODD[1]
        np.minimum(least, x.min(axis=0), out=least)
    if not len(hashes):
        return np.zeros(M, np.uint8)
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_rows(percent: int) -> int:
    """Registers per band: as many as leave a pair at the threshold a chance below 1 in 50,000 to share no band."""
    return next(r for r in (6, 5, 4, 3, 2, 1) if r == 1 or (1 - (percent / 100) ** r) ** (M // r) < 2e-5)


def band_keys(reg: np.ndarray, rows: int) -> np.ndarray:
    """One integer per band: its number and its registers, so that only equal bands have equal keys."""
    n = M // rows
    b = np.zeros((n, 8), np.uint8)
    b[:, :rows] = reg[: n * rows].reshape(n, rows)
    b[:, 7] = np.arange(n, dtype=np.uint8) % 128
    b[:, 6] = np.arange(n, dtype=np.uint8) // 128
    return b.view(np.int64).ravel()


def _set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that only equal sets share."""
    with np.errstate(over="ignore"):
        a, b = (int(_mix(h + _ODD[2 + i, 0]).sum(dtype=np.uint64)) for i in (0, 1))
    return a - 2**63, b - 2**63


def _sketch(batches: Iterator[pa.RecordBatch], k: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, k1, k2, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            h = shingle_set(text, k)
            a, b = _set_key(h)
            n.append(len(h)), k1.append(a), k2.append(b)
            bands.append(band_keys(registers(h), rows) if len(h) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], names=["id", "mark", "n", "k1", "k2", "bands"])


def pack(h: np.ndarray) -> bytes:
    """A set for the shuffle: six bytes of each hash.  Two sets of 20,000 differ by chance from their
    64-bit intersection, by one element, less than twice in a million."""
    return (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.zeros((len(data) // 6, 8), np.uint8)
    b[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return b.view(np.uint64).ravel()


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):  # sets are larger than texts
            k1, k2, sets, regs = [], [], [], []
            for text in part.column(0).to_pylist():
                h = shingle_set(text, k)
                a, b = _set_key(h)
                k1.append(a), k2.append(b), sets.append(pack(h)), regs.append(registers(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())],
                names=["k1", "k2", "hashes", "reg"])


def _more(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1.0 - x * (BASE - 1.0) / BASE, 1e-300)) / np.log(BASE)


def log_likelihood(j, above, below, n_a, n_b, m=M):
    """Joint log-likelihood of ``above`` registers larger in A and ``below`` larger in B, of ``m``, at Jaccard ``j``."""
    u = n_a / (n_a + n_b)
    p = np.maximum(_more(u - (1 - u) * j), 1e-12)
    q = np.maximum(_more((1 - u) - u * j), 1e-12)
    return above * np.log(p) + below * np.log(q) + (m - above - below) * np.log(np.maximum(1 - p - q, 1e-12))


def possible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (A x B) may reach the threshold: by their sizes (exact) and by joint likelihood."""
    ok = np.minimum(na[:, None], nb[None, :]) * 100 >= percent * np.maximum(na[:, None], nb[None, :])
    k = ra.shape[1]
    if ok.size <= 64:
        above, below = ((ra[:, None] > rb[None]).sum(axis=2, dtype=np.uint8), (ra[:, None] < rb[None]).sum(axis=2, dtype=np.uint8))
    else:  # a register at a time, so that memory is that of the pairs
        above, below = np.zeros(ok.shape, np.uint8), np.zeros(ok.shape, np.uint8)
        for i in range(k):
            above += ra[:, i, None] > rb[None, :, i]
            below += ra[:, i, None] < rb[None, :, i]
    same = k - above.astype(np.int16) - below
    j0 = percent / 100.0
    ok &= same >= k * (j0 - 0.35)  # further off than any likelihood in question
    x, y = np.nonzero(ok & (same < k * j0))
    for at in range(0, len(x), 100_000):
        i, j = x[at : at + 100_000], y[at : at + 100_000]
        a, b, n, m = above[i, j].astype(float), below[i, j].astype(float), na[i].astype(float), nb[j].astype(float)
        here = log_likelihood(np.minimum(j0, np.minimum(n, m) / np.maximum(n, m)), a, b, n, m, k)
        best = np.max([log_likelihood(np.minimum(g, np.minimum(n, m) / np.maximum(n, m)), a, b, n, m, k)
                       for g in np.linspace(j0 - 0.4, j0, 9)], axis=0)
        ok[i, j] = best - here <= SURE
    return ok


def belongs(ka: np.ndarray, kb: np.ndarray, band: int) -> np.ndarray:
    """Which pairs (A x B, rows of band keys) share no band before that of ``band``.

    A pair's first shared band is always among the buckets compared: of buckets with the same
    members the one of the least key stays, and keys are in the order of their bands."""
    ok = np.ones((len(ka), len(kb)), bool)
    for i in np.nonzero(ka[:1] >> 48 < band >> 48)[1]:
        ok &= ka[:, i, None] != kb[None, :, i]
    return ok


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections between the first ``split`` sets and the others (or all, if none are others)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[col] > 1
    renumber = np.cumsum(count > 1) - 1
    owner, col = owner[common], renumber[col[common]]
    rows, cols = (split, n - split) if split < n else (n, n)
    out = np.zeros((rows, cols), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = 2048
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        dense = np.zeros((n, width), np.float32)
        dense[owner[lo:hi], col[lo:hi] - at] = 1.0
        out += dense[:split] @ (dense[split:] if split < n else dense).T
    return out


def _group_members(percent: int, rows: int):
    """The members of a group that have a pair to confirm there: those whose sets must be fetched."""
    def members(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, i, j = (x.as_py() for x in key)
        tile, size = table.column("tile").to_numpy(), table.column("n").to_numpy()
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(tile), -1)
        a, b = np.nonzero(tile == i)[0], np.nonzero(tile == j)[0]
        ok = belongs(keys[a], keys[b], band)
        if i == j:
            np.fill_diagonal(ok, False)
        if ok.any():
            reg = np.ascontiguousarray(keys).view(np.uint8).reshape(len(tile), -1, 8)[:, :, :rows].reshape(len(tile), -1)
            ok &= possible(reg[a], reg[b], size[a], size[b], percent)
        some = np.zeros(len(tile), bool)
        some[a[ok.any(axis=1)]] = True
        some[b[ok.any(axis=0)]] = True
        return table.filter(pa.array(some)).select(["k1", "k2", "rep", "least", "band", "tile", "i", "j"])

    return members


def _group_links(percent: int, rows: int):
    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cross = key[1].as_py() != key[2].as_py()
        table = table.sort_by([("tile", "ascending")])
        ids, tile = table.column("rep").to_numpy(), table.column("tile").to_numpy()
        sets = [unpack(x) for x in table.column("hashes").to_pylist()]
        reg = np.array([np.frombuffer(x, np.uint8) for x in table.column("reg").to_pylist()]).reshape(len(ids), M)
        size = np.array([len(s) for s in sets], np.int64)
        split = int(np.searchsorted(tile, key[2].as_py())) if cross else len(ids)
        a, b = slice(0, split), slice(split, None) if cross else slice(0, None)
        if len(ids) < 2 or cross and not 0 < split < len(ids):
            a_end, b_end = ids[:0], ids[:0]
        else:
            keys = np.array([band_keys(r, rows) for r in reg])
            ok = belongs(keys[a], keys[b], key[0].as_py()) & possible(reg[a], reg[b], size[a], size[b], percent)
            if not cross:
                np.fill_diagonal(ok, False)
            if len(ids) > 24 and ok.any():
                both = _overlaps(sets, split).astype(np.int64)
                ok &= 100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)
            else:
                for i, j in zip(*np.nonzero(ok), strict=True):
                    if cross or i < j:
                        s, t = sets[i], sets[j + split if cross else j]
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        ok[i, j] = 100 * both >= percent * (len(s) + len(t) - both)
                        if not cross:
                            ok[j, i] = ok[i, j]
            if cross:
                link = np.zeros((len(ids), len(ids)), bool)
                link[:split, split:], link[split:, :split] = ok, ok.T
            else:
                link = ok
            some = link.any(axis=1)
            b_end = ids[some]
            a_end = smallest_reachable(b_end, link[np.ix_(some, some)])
        return pa.table({"a": pa.array(a_end, pa.int64()), "b": pa.array(b_end, pa.int64())})

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Links join documents whose shingle sets have ``100 * |both| >= percent * |either|``.
    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the row's own.

    A null or blank text has no shingles and is linked with nothing.  A row without an id is
    linked with nothing: its ``component_id`` is null and it is kept.  Rows repeated under one id
    are each placed by their own text.  Other columns are not read.  Ids are integers."""
    found = _grouped(docs, id_col, text_col, percent, shingle, tile)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                        F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, tile: int) -> DataFrame:
    """Per row of ``docs``: ``id, mark`` (a hash of the text), ``n, k1, k2`` (the set's size and key), ``component_id``
    and ``first``: whether its set is the one with the component's smallest (id, set key).

    Classes of equal sets are the nodes, under numbers of their own, so ids reused over different texts link nothing."""
    per_band = band_rows(percent)
    text = column(docs, text_col)
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text.cast("binary")).alias("mark"))
    sketched = settled(rows.mapInArrow(lambda it: _sketch(it, shingle, per_band), "id long, mark long, n long, k1 long, k2 long, bands array<long>"))
    alike = sketched.filter("n > 0 and id is not null")
    # numbered where they are checkpointed: rep is the node, least the smallest id of the class
    classes = settled(alike.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
                      .withColumn("rep", F.monotonically_increasing_id()))
    bands = classes.select("k1", "k2", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("k1").alias("first"), F.bit_xor(F.xxhash64("k1", "k2")).alias("mark"))
    once = buckets.filter("size > 1").groupBy("size", "first", "mark").agg(F.min("band").alias("band")).select("band", "size")
    n_tiles = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    tiled = (bands.join(once, "band").withColumn("tile", F.pmod(F.xxhash64("k1", "k2"), n_tiles).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), n_tiles - 1)))
             .select("k1", "k2", "band", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    tested = settled(tiled.join(classes, ["k1", "k2"]).groupBy("band", "i", "j").applyInArrow(
        _group_members(percent, per_band), "k1 long, k2 long, rep long, least long, band long, tile int, i int, j int"))
    wanted = tested.select(F.col("least").alias("id")).distinct()
    full = (rows.filter("id is not null").join(wanted, "id", "left_semi").select("text")
            .mapInArrow(lambda it: _full_sets(it, shingle), "k1 long, k2 long, hashes binary, reg binary")
            .groupBy("k1", "k2").agg(F.first("hashes").alias("hashes"), F.first("reg").alias("reg")))
    grouped = tested.join(full, ["k1", "k2"]).select("band", "i", "j", "rep", "tile", "hashes", "reg")
    links = grouped.groupBy("band", "i", "j").applyInArrow(_group_links(percent, per_band), "a long, b long")
    found = connected_components(links).withColumnRenamed("node", "rep")
    linked = settled(classes.select("rep", "least", "k1", "k2").join(found, "rep"))
    heads = linked.groupBy("component").agg(F.min(F.struct("least", "k1", "k2")).alias("head"))
    headed = linked.join(heads, "component").select("k1", "k2", "head")
    labelled = classes.select("k1", "k2", "least").join(headed, ["k1", "k2"], "left").select(
        "k1", "k2", F.coalesce("head", F.struct("least", "k1", "k2")).alias("head"))
    alone = sketched.filter("n = 0 or id is null").select("id", "mark", "n", "k1", "k2", F.col("id").alias("component_id"), F.lit(True).alias("first"))
    together = alike.select("id", "mark", "n", "k1", "k2").join(labelled, ["k1", "k2"]).select(
        "id", "mark", "n", "k1", "k2", F.col("head.least").alias("component_id"), (F.struct("id", "k1", "k2") == F.col("head")).alias("first"))
    return together.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each group the one with the smallest id.

    Rows without an id stay, and rows without words, of which only those equal in id and text are one.  An id
    reused over different texts is as many documents: each is grouped by its own text, and of rows with the group's
    smallest id and equal sets of shingles one stays (that whose text has the smallest hash)."""
    found = _grouped(docs, id_col, text_col, percent, SHINGLE, TILE).filter("first and id is not null")
    ident = column(docs, id_col)
    kept, mark = fresh(docs, "kept_id"), fresh(docs, "kept_mark")
    blank = found.filter("n = 0").select("id", "mark").distinct()
    stay = found.filter("n > 0").groupBy("id", "k1", "k2").agg(F.min("mark").alias("mark")).select("id", "mark").unionByName(blank)
    stay = stay.select(F.col("id").alias(kept), F.col("mark").alias(f"{mark}_"))
    marked = docs.withColumn(mark, F.xxhash64(column(docs, text_col).cast("binary")))
    once = (marked.join(stay, (column(marked, id_col).cast("long") == stay[kept]) & (marked[mark] == stay[f"{mark}_"]), "left_semi")
            .dropDuplicates([id_col, mark]).drop(mark))
    return once.unionByName(docs.filter(ident.isNull()))
