"""Operator 12, vector code compression: product quantisation with Orchard's search.

Components become integers ``floor(1024 * x)`` and vectors are cut into equal consecutive parts, each
with a codebook of its own.  Codebooks start as the parts of the vectors with the smallest ids; a
round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index)
and replaces each entry by the floor of its parts' mean.  All arithmetic is in integers, so that
neither the layout nor the order of rows changes a result.

The nearest entry is found by Orchard's method: every entry has the list of all entries sorted by their
distance to it.  A search walks the list of its current entry and jumps to the list of any better one;
entries seen before are marked and not measured again; it stops where the list is farther from the
current entry than twice the current distance, as no entry beyond can be nearer (by the triangle
inequality; entries at exactly twice the distance are still seen, which keeps ties right).  Many
searches walk side by side; those in the same list measure its entries together, each those within its own reach.

Scale: a task holds a batch of vectors and the codebooks; per round only sums and counts per (part, entry) are
shuffled and reach the driver, ``parts * entries`` rows of at most ``dimension / parts`` components, whatever the
number of vectors.

Defined results: rows with a null vector, or one with null or non-finite components, are dropped.
Shorter vectors (empty ones too) are filled with zeros up to the longest one's length, and that up to
a multiple of the number of parts.  Repeated rows count as often as they occur; of rows with equal ids the vectors'
own order decides who starts a codebook; null ids come last.  Tables with fewer vectors than entries have smaller
codebooks; an empty table gives no rows.  Components beyond 2^24 in size are refused with an error,
as squared distances would not fit into 64 bits.  Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column, settled

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 24      # size of a component that still leaves room for squared distances of 2^13 components
SEARCHES = 4096        # searches that walk side by side
FAR = 1 << 62


class Codebook:
    """Entries of one part, with every entry's neighbours sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = _squares(entries[:, None, :] - entries[None, :, :])
        self.between = gaps
        self.near = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.near, axis=1)
        self.start = int(np.argmin(gaps.astype(np.float64).sum(axis=1))) if len(entries) else 0  # the most central entry

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the index of its nearest entry, the lower of equals, and the squared distance."""
        codes, dist = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for i in range(0, len(parts), SEARCHES):
            codes[i:i + SEARCHES], dist[i:i + SEARCHES] = self._walk(parts[i:i + SEARCHES])
        return codes, dist

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(x), self.start)
        best = _squares(x - self.entries[self.start])
        seen = np.zeros((len(x), len(self.entries)), bool)
        seen[:, self.start] = True
        walking = np.arange(len(x))
        while len(walking):
            walking = walking[np.argsort(at[walking], kind="stable")]
            jumped = []
            for rows in np.split(walking, np.flatnonzero(np.diff(at[walking])) + 1):
                # of a sorted list the rest is too far as soon as one entry is (distances are squared: twice is four times)
                here, reach = at[rows[0]], 4 * best[rows]
                them = np.sort(self.near[here, :np.searchsorted(self.gaps[here], reach.max(), side="right")])
                new = (self.between[here, them] <= reach[:, None]) & ~seen[rows[:, None], them]
                if not new.any():
                    continue
                seen[rows[:, None], them] |= new
                dist = self._distances(x[rows], them)
                dist[~new] = FAR
                first = dist.argmin(axis=1)  # of equals the lowest index
                found, index = dist[np.arange(len(rows)), first], them[first]
                better = (found < best[rows]) | ((found == best[rows]) & (index < here))
                jump = rows[better]
                at[jump], best[jump] = index[better], found[better]
                jumped.append(jump)
            walking = np.concatenate(jumped) if jumped else walking[:0]
        return at, best

    def _distances(self, x: np.ndarray, them: np.ndarray) -> np.ndarray:
        """Squared distances of rows to entries, exact: by a product of doubles where these hold all sums."""
        e = self.entries[them]
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(e).max(initial=0)))
        if 4 * top * top * max(x.shape[1], 1) < 1 << 53:
            out = x.astype(np.float64) @ e.T.astype(np.float64)
            out *= -2
            out += _squares(x)[:, None]
            out += _squares(e)[None, :]
            return out
        return _squares(x[:, None, :] - e[None, :, :])


def _squares(gaps: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", gaps, gaps)


@dataclass
class Codes:
    """What ``compress`` returns: rows of ids, codes and errors, and the final entries per part."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of the entries' components, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.codebooks for v in book.ravel()).encode()).hexdigest()


def _integers(vec: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows of integers, filled up with zeros."""
    n = len(vec)
    lens = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, width), np.int64)
    values = np.floor(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(values) and np.abs(values).max() > LARGEST * SCALE:
        raise ValueError(f"components beyond {LARGEST} in size can't be compressed")
    row = np.repeat(np.arange(n), lens)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    v = column(vectors, vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _train(data: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: sums and counts of the parts of each entry, then their floored means."""
    parts = len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for p, x in enumerate(_cut(_integers(batch.column(0), width), parts)):
                codes, _ = search[p].nearest(x)
                np.add.at(total[p], codes, np.column_stack([x, np.ones(len(x), np.int64)]))
        for p, t in enumerate(total):
            used = np.nonzero(t[:, -1])[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()),
                                              pa.array(list(t[used]), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    per_task = data.select("vec").mapInArrow(sums, "part int, entry int, sums array<bigint>")
    each = per_task.select("part", "entry", F.posexplode("sums").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("x").alias("x"))
    rows = each.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("part", "entry", "s.x").collect()
    new = [b.copy() for b in books]
    for part, entry, x in rows:
        new[part][entry] = np.array(x[:-1], np.int64) // x[-1]
    return new


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", keep: tuple[str, ...] = (),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors: ``rows`` has vec_id, the columns of ``keep``, code ARRAY<INT> and error LONG."""
    if entries > 256 or parts < 1 or rounds < 0:
        raise ValueError("codes have 1 to 256 entries a part, one part or more and no negative number of rounds")
    good = usable(vectors, vec)
    data = good.select(column(good, vec_id).alias("id"), *[column(good, c).alias(f"keep{i}") for i, c in enumerate(keep)],
                       column(good, vec).cast("array<double>").alias("vec"))
    width = data.agg(F.max(F.size("vec"))).first()[0] or 0
    width = -(-width // parts) * parts
    first = data.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).toArrow()
    seeds = _integers(first.column("vec").combine_chunks(), width) if first.num_rows else np.zeros((0, width), np.int64)
    books = [b.copy() for b in _cut(seeds, parts)]
    if first.num_rows:
        for _ in range(rounds):
            books = _train(data, books, width)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            found = [search[p].nearest(x) for p, x in enumerate(_cut(_integers(batch.column("vec"), width), parts))]
            code = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out if c not in ("code", "error")], pa.array(list(code), pa.list_(pa.int32())),
                                              pa.array(sum(e for _, e in found), pa.int64())], names=out)

    out = [c for c in data.columns if c != "vec"] + ["code", "error"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.drop("vec").schema.fields)
    coded = settled(data.mapInArrow(codes, schema + ", code array<int>, error bigint"))  # the last search is made once, whatever reads it
    return Codes(coded.select(F.col("id").alias(vec_id), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "code", "error"), books)


def decompress(codes: DataFrame, codebooks: list[np.ndarray], code: str = "code") -> DataFrame:
    """The integer vectors that the codes stand for, as the column ``decoded``; the codebooks are at most
    256 entries a part, so they travel as literals."""
    books = [F.lit([[int(v) for v in e] for e in b.tolist()]) for b in codebooks]
    return codes.withColumn("decoded", F.concat(*[b[column(codes, code)[p]] for p, b in enumerate(books)]))


def error_by(rows: DataFrame, by: str, error: str = "error") -> DataFrame:
    """``rows`` with ``<by>_error``: the error summed over the rows with an equal ``by`` (nulls together)."""
    total = rows.groupBy(column(rows, by).alias("_by")).agg(F.sum(column(rows, error)).cast("long").alias(f"{by}_error"))
    return rows.join(total, column(rows, by).eqNullSafe(F.col("_by"))).drop("_by")
