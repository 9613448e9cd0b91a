"""Quality classifier: Bradley-Terry scores learned from preference pairs.

In a preference pair a document labelled good beats one labelled bad.  The chance of that is the
logistic function of the difference of their scores, and a score is linear in features of the
whole text, so the loss is the logistic loss of feature differences (no intercept).  The cut is a
quantile of the labelled documents' scores: as large a share is rejected there as is labelled bad.
Reported scores are ``1 / (1 + exp(-(s - cut) - logit(0.7)))``, so 0.7 is the cut.

The fit uses a bounded sample of labelled rows (``max_labelled``, lowest hashes of their ids); its
features are a few megabytes on the driver.  Scoring covers every row and whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column

MAX_LABELLED = 20_000
PAIRS_PER_LABELLED = 8
KEEP = 0.7
RIDGE = 1e-3

_CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "high": bytes(range(128, 256)),
    "stop": b".,;:?'\"-()", "bang": b"!", "bar": b"|", "other": bytes(c for c in range(33, 127) if chr(c) in "#$%&*+/<=>@[\\]^_`{}~"),
    "control": bytes(c for c in range(32) if c not in (9, 10, 11, 12, 13)) + b"\x7f",
}
FEATURES = [*_CLASSES, "symbol_words", "upper_words", "word_length", "long_words", "distinct", "top_word", "echo", "lines_again", "line_words", "stops", "size"]


def features(text: bytes | None) -> list[float]:
    """Numbers that describe the whole text; null counts as empty."""
    text = text or b""
    n = len(text)
    share = [(n - len(text.translate(None, c))) / max(n, 1) for c in _CLASSES.values()]
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    odd = _CLASSES["other"] + b"!|"
    lines = [x for x in text.split(b"\n") if x.strip()]
    return share + [
        sum(c for w, c in counts.items() if w[-1] in odd) / k,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / k,
        sum(len(w) * c for w, c in counts.items()) / k,
        sum(c for w, c in counts.items() if len(w) > 24) / k,
        math.log(len(counts) + 1) / math.log(k + 1),
        max(counts.values(), default=0) / k if k > 20 else 0.0,
        sum(map(eq, words, words[1:])) / k,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(k / max(len(lines), 1)),
        text.count(b".") / k,
        math.log1p(k),
    ]


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores, cut at six, and their hinges one deviation to both sides."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = _wide(x, self.mean, self.scale) @ self.weights - self.cut + math.log(KEEP / (1 - KEEP))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the mean of ``log(1 + exp(-d.w))`` plus a ridge, by Newton steps with halving."""
    def loss(w):
        return np.logaddexp(0, -differences @ w).mean() + ridge / 2 * w @ w

    w = np.zeros(differences.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -500, 500)))
        grad = -(differences * p[:, None]).mean(axis=0) + ridge * w
        hess = (differences * (p * (1 - p))[:, None]).T @ differences / len(differences) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, seed: int = 11) -> Model:
    """Model from features and labels.  Without labels of both kinds nothing is known: all is kept."""
    if not len(x) or good.all() or not good.any():
        k = x.shape[1]
        return Model(np.zeros(k), np.ones(k), np.zeros(3 * k), -1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    wide = _wide(x, mean, scale)
    rng = np.random.default_rng(seed)
    wins, losses = np.nonzero(good)[0], np.nonzero(~good)[0]
    n = PAIRS_PER_LABELLED * max(len(wins), len(losses))
    pairs = wide[np.resize(rng.permutation(wins), n)] - wide[rng.choice(losses, n)]
    w = bradley_terry(pairs)
    s = np.sort(wide @ w)
    k = int((~good).sum())
    return Model(mean, scale, w, float((s[k - 1] + s[k]) / 2))


def training_rows(id_col: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the training rows of ``labels`` whose documents are in ``docs``.  Null ids or labels are not learned;
    of rows repeated under one id, one is."""
    ident = column(labels, id_col)
    sample = (labels.filter(training_rows(ident) & column(labels, label_col).isNotNull())
              .select(ident.alias("id"), (column(labels, label_col) == 1).alias("good")).distinct()
              .orderBy(F.xxhash64(F.lit(3), "id"), "id", "good").limit(max_labelled))
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("binary").alias("text"))

    @F.pandas_udf("array<double>")
    def described(text: pd.Series) -> pd.Series:
        return text.map(features)

    rows = texts.join(F.broadcast(sample), "id").select("id", "good", described("text").alias("x"))  # bounded: max_labelled rows
    # rows may be repeated under one id without bound; one of them is learned
    got = rows.groupBy("id", "good").agg(F.min("x").alias("x")).orderBy("id", "good").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["good"].to_numpy(bool))


def score(text: Column, model: Model) -> Column:
    """Score column, 0 to 1, of a text column; null and empty texts have the features of an empty text."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.score(np.array([features(t) for t in s], float).reshape(len(s), len(FEATURES))), dtype="float64")

    return scored(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.  A null id is not held out; repeated rows score alike."""
    model = learn(docs, labels, id_col, text_col, **options)
    ident = column(docs, id_col)
    scored = docs.select(ident.alias("doc_id"), F.coalesce(~training_rows(ident), F.lit(False)).alias("held_out"),
                         score(column(docs, text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is at least the cut."""
    model = learn(docs, labels, id_col, text_col, **options)
    return docs.filter(score(column(docs, text_col), model) >= KEEP)
