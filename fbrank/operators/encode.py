"""U1 query/passage encoding and R6 PCA reduction.

The default encoder is signed feature hashing, written in SQL expressions:
token -> md5 -> bucket (first 8 hex digits mod dim) and sign (9th hex digit parity),
summed per text and L2-normalised.

Fixed values: bucket = int(md5(token)[0:8], 16) % dim; sign = +1 if int(md5(token)[8], 16)
is even else -1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fbrank.functions.text import tokens
from fbrank.functions.vectors import dot, l2_normalize
from fbrank.sources.tables import with_prefix


def encode_hashed(df: DataFrame, *, id_cols: Sequence[str] = ("qid",), text: str = "title", dim: int = 64,
                  out: str = "qv") -> DataFrame:
    """Signed feature hashing of the tokens of ``text`` into ``dim`` components, L2-normalised.

    Tokens are counted by component where the texts are read, a token's hash computed once per task, so a row of ``dim``
    counts per text is shuffled, not its tokens.  Texts of one id are counted together; null ids have none."""
    kinds = [T.StructField(c, df.schema[c].dataType, True) for c in id_cols]
    counts = (df.select(*id_cols, tokens(text).alias("_t")).filter(F.size("_t") > 0)
              .mapInArrow(_hash_counts(dim), T.StructType([*kinds, T.StructField("_x", T.ArrayType(T.IntegerType()), True)])))
    sums = counts.groupBy(*id_cols).agg(*[F.sum(F.col("_x")[i]).alias(f"_{i}") for i in range(dim)])
    sparse = sums.select(*id_cols, F.array(*[F.col(f"_{i}").cast("double") for i in range(dim)]).alias("_m"))
    base = df.select(*id_cols).join(sparse, list(id_cols), "left")
    vec = F.coalesce("_m", F.array_repeat(F.lit(0.0), dim))
    return base.select(*id_cols, l2_normalize(vec).alias(out))


HASHES_KEPT = 1 << 20  # hashes of tokens that a task keeps
TOKENS_AT_ONCE = 1 << 20


def _hash_counts(dim: int):
    """Rows (ids..., tokens) to (ids..., signed counts by component)."""
    def signed(token: str) -> int:  # component, and its sign
        digest = hashlib.md5(token.encode()).hexdigest()
        bucket = int(digest[:8], 16) % dim
        return bucket if int(digest[8], 16) % 2 == 0 else ~bucket

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS_AT_ONCE, side="right")))
                some, lo = batch.slice(lo, hi - lo), hi
                lists = some.column(some.num_columns - 1)
                coded = lists.flatten().dictionary_encode()
                if len(known) > HASHES_KEPT:
                    known.clear()
                at = np.array([known[t] if t in known else known.setdefault(t, signed(t)) for t in coded.dictionary.to_pylist()], np.int64)
                at = at[coded.indices.to_numpy()]
                row = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                x = np.bincount(row * dim + np.where(at < 0, ~at, at), weights=np.where(at < 0, -1.0, 1.0), minlength=some.num_rows * dim)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * dim, pa.int32()), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], vectors], names=[*some.schema.names[:-1], "_x"])

    return count


Encoder = Callable[[list[str]], np.ndarray]


def encode_batches(df: DataFrame, load: Callable[[], Encoder], *, id_cols: Sequence[str] = ("qid",), text: str = "title",
                   out: str = "qv", batch_size: int = 256) -> DataFrame:
    """U1 with any encoder of lists of texts: ``load`` is called once per task, texts (null: empty) are encoded
    ``batch_size`` at a time, and every row of ``df`` gets its vector.  Nothing is shuffled or collected."""
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = None
        for texts in batches:
            encoder = encoder or load()
            given = texts.fillna("").tolist()
            vectors = [v for i in range(0, len(given), batch_size) for v in np.asarray(encoder(given[i:i + batch_size]), dtype=np.float64)]
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return df.select(*id_cols, F.pandas_udf(encode, "array<double>")(F.col(text)).alias(out))


TOKEN = regex.compile(r"[\p{L}\p{N}]+")  # as functions.text.tokens


class MatrixEncoder:
    """Hashed, signed counts of a text's tokens times a given matrix (a row per bucket), L2-normalised."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.asarray(matrix, dtype=np.float64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), len(self.matrix)))
        for row, t in zip(counts, texts, strict=True):
            for token in TOKEN.findall(t.lower()):
                digest = hashlib.md5(token.encode()).hexdigest()
                row[int(digest[:8], 16) % len(row)] += 1.0 if int(digest[8], 16) % 2 == 0 else -1.0
        out = counts @ self.matrix
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


@dataclass(frozen=True)
class EncoderClass:
    """A kind of encoder: ``load`` makes the loader of one from its name; ``pool`` L2-normalises what it gives."""

    load: Callable[[str], Callable[[], Encoder]]
    pool: bool = False


def choose_encoder(classes: Mapping[str, EncoderClass], name: str, kind: str | None = None, *, default: str = "auto") -> EncoderClass:
    """The class named ``kind``, else the first whose keyword is contained in the encoder's name, else ``default``."""
    if kind is not None:
        if kind not in classes:
            raise ValueError(f"unknown encoder class {kind!r}; known are {list(classes)}")
        return classes[kind]
    return next((c for keyword, c in classes.items() if keyword in name.lower()), None) or classes[default]


def encode_named(df: DataFrame, classes: Mapping[str, EncoderClass], name: str, kind: str | None = None, *, prefix: str | None = None,
                 id_cols: Sequence[str] = ("qid",), text: str = "title", out: str = "qv") -> DataFrame:
    """Texts, prefixed (P2), through the encoder chosen by class or name; pooling classes normalise (P5)."""
    chosen = choose_encoder(classes, name, kind)
    vectors = encode_batches(with_prefix(df, prefix, text), chosen.load(name), id_cols=id_cols, text=text, out=out)
    return vectors.withColumn(out, l2_normalize(F.col(out))) if chosen.pool else vectors


def pca_fit(corpus: DataFrame, n: int, vec: str = "vec"):
    """Fit a PCA model on the corpus vectors (pyspark.ml, distributed)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    feats = corpus.select(array_to_vector(F.col(vec).cast("array<double>")).alias("_f"))
    return PCA(k=n, inputCol="_f", outputCol="_p").fit(feats)


def pca_apply(df: DataFrame, model, vec: str) -> DataFrame:
    """Project ``vec`` with a fitted PCA model (both queries and corpus use the same model)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    keep = [c for c in df.columns if c != vec]
    f = df.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("_f"))
    return model.transform(f).select(*keep, vector_to_array("_p").alias(vec))


def apply_matrix(df: DataFrame, vec: str, matrix: DataFrame) -> DataFrame:
    """R6 with a given model: ``vec`` becomes its products with the rows of ``matrix``
    (component, row), in component order.  A matrix has a row per output dimension."""
    rows = matrix.agg(F.array_sort(F.collect_list(F.struct("component", "row")))).scalar()
    wide = df.withColumn("_matrix", rows)
    product = F.transform("_matrix", lambda r: dot(F.col(vec).cast("array<double>"), r["row"]))
    return wide.withColumn(vec, product).drop("_matrix")
