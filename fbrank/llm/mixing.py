"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed per cell (source, language, topic).  Cell weights are rescaled to one
margin after the other until the margins have their targets (``TOLERANCE``).  A document's
sampling probability is its cell's fitted weight over its natural weight, divided by the largest
such ratio: the largest sample that meets the targets without a probability above one.  If that
sample is below a share of all tokens (``SHARE``), a rare cell would set its size: then the share
does, cells that would pass probability one are taken whole, and the others are raked again.

Documents are read by DataFrame operations only.  Categories without a target share one category,
``OTHER``, so there are at most (targets + 1) categories per margin and their product bounds the
cell table: it is raked on the driver, and broadcast.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column, fresh

OTHER = "other"
#: rounds of the SQL, enough on dense cells; here raking goes on until it has converged
ROUNDS = 10
#: of the worst margin, relative to its target
TOLERANCE = 1e-9
PATIENCE = 1000
#: the expected sample's share of all tokens, at least
SHARE = 0.15
#: a margin off by more than this, relative to its target, is reported
UNMET = 1e-3
SEED = "mix-1"
#: runs of characters above the space; one range, which is what regular expressions count fastest
WORD = r"[!-\x{10FFFF}]+"
DIGITS, SYMBOLS, SPEECH = r"[0-9]", r"[#$%&*+/<=>@\[\]\\^_`{}~|]", r"[?!\"“”»«]"

_log = logging.getLogger(__name__)


def n_tokens(text: Column) -> Column:
    """Words of the whole text, cut at spaces and control characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars))


def topic(text: Column) -> Column:
    """Kind of text, from shares of characters over the whole of it; null or empty text is prose."""
    n = F.length(text)
    return (F.when(_count(text, DIGITS) * 50 > n, "numeric").when(_count(text, SYMBOLS) * 50 > n, "markup")
            .when(_count(text, SPEECH) * 200 > n, "speech").otherwise("prose"))


def _category(value: Column, targets: dict[str, float]) -> Column:
    value = value.cast("string")
    return F.when(value.isin(*targets), value).otherwise(F.lit(OTHER))


def _totals(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def _raked(w: np.ndarray, index: list[np.ndarray], targets: list[np.ndarray], rounds: int | None) -> np.ndarray:
    """``rounds`` rounds; None: until the worst relative margin error is within ``TOLERANCE``, or
    has not halved in ``PATIENCE`` rounds (targets that contradict each other can't be met)."""
    best, since = np.inf, 0
    while rounds is None or rounds > 0:
        for at, t in zip(index, targets, strict=True):
            w = w * (t / np.maximum(_totals(w, at, len(t)), 1e-300))[at]
        if rounds is not None:
            rounds -= 1
            continue
        error = max(float((np.abs(_totals(w, at, len(t)) - t)[t > 0] / t[t > 0]).max(initial=0.0)) for at, t in zip(index, targets, strict=True))
        best, since = (error, 0) if error < best / 2 else (best, since + 1)
        if error <= TOLERANCE or since >= PATIENCE:
            break
    return w


def fit(cells: list[tuple], margins: dict[str, dict[str, float]], rounds: int | None = None, share: float = 0.0) -> tuple[list[float], list[tuple[str, str, float, float]]]:
    """Probabilities of ``cells`` (a category per margin, then tokens), and the margins not met:
    ``(margin, category, target, reached)``, shares of the expected sample's tokens.

    The expected sample holds ``share`` of all tokens at least.  If the largest sample without a
    probability above one is smaller, cells that would pass one are taken whole and the others are
    raked again to what is left of the targets; what a category can't give goes to the others of
    its margin in proportion."""
    tokens = np.array([float(c[-1] or 0) for c in cells])
    out = np.ones(len(cells))
    some = np.flatnonzero(tokens > 0)
    if not len(some):
        return out.tolist(), []
    natural = tokens[some] / tokens.sum()
    names, index, targets = [], [], []
    for m, listed in enumerate(margins.values()):
        found, at = np.unique([str(cells[k][m]) for k in some], return_inverse=True)
        held = _totals(natural, at, len(found))
        other = found == OTHER
        asked = np.array([0.0 if o else float(listed[k]) for k, o in zip(found, other, strict=True)])
        scaled = asked / asked.sum() * (1 - held[other].sum()) if asked.sum() > 0 else asked
        names.append(found), index.append(at), targets.append(np.where(other, held, scaled))
    w = _raked(natural, index, targets, rounds)
    if share * (w / natural).max() <= 1:
        p = w / natural / (w / natural).max()
    else:
        most = natural / share
        whole, left = np.zeros(len(some), bool), targets
        while (over := ~whole & (w > most * (1 + 1e-9))).any():
            whole |= over
            if whole.all():
                break
            rest, after = 1 - most[whole].sum(), []
            for at, t in zip(index, left, strict=True):
                t = np.maximum(t - _totals(np.where(over, most, 0.0), at, len(t)), 0.0)
                t = np.where(_totals(~whole * 1.0, at, len(t)) > 0, t, 0.0)
                after.append(t * (rest / t.sum()) if t.sum() > 0 else t)
            left = after
            w = np.where(whole, most, _raked(np.where(whole, 0.0, natural), index, left, rounds))
        p = np.where(whole, 1.0, np.minimum(w / most, 1.0))
    out[some] = p
    sample, unmet = natural * p, []
    for name, found, at, t in zip(margins, names, index, targets, strict=True):
        reached = _totals(sample, at, len(t)) / sample.sum()
        unmet += [(name, str(k), float(x), float(y)) for k, x, y in zip(found, t, reached, strict=True) if abs(y - x) > UNMET * x]
    return out.tolist(), unmet


def rake(cells: DataFrame, margins: dict[str, dict[str, float]], rounds: int | None = None, share: float = 0.0) -> DataFrame:
    """``cells`` (one row per cell: a column per margin, ``tokens``) with ``probability``.

    A margin's targets are weights: they are scaled to sum to what listed categories that occur
    leave to ``OTHER``, which keeps its natural share.  Cells without tokens get probability 1.
    Margins that the sample can't meet are logged."""
    rows = sorted(([*map(str, r[:-1]), float(r[-1] or 0)] for r in cells.select(*margins, "tokens").collect()))  # bounded: a product of configured sizes
    fitted, unmet = fit(rows, margins, rounds, share)
    for name, category, target, reached in unmet:
        _log.warning("mixture: %s %s has %.6f of the expected sample's tokens, target %.6f", name, category, reached, target)
    columns = {name: pa.array([r[m] for r in rows], pa.string()) for m, name in enumerate(margins)}
    return cells.sparkSession.createDataFrame(pa.table(columns | {"tokens": pa.array([r[-1] for r in rows], pa.float64()), "probability": pa.array(fitted, pa.float64())}))


def chance(id_col: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id (the text where there is none) and the seed alone."""
    of = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text",
        rounds: int | None = None, seed: str = SEED, share: float = SHARE) -> DataFrame:
    """All rows and columns of ``docs`` plus one column ``mixed`` (longer if taken), the last:
    ``struct<topic, n_tokens, probability, sampled>``.

    ``targets`` maps columns of ``docs``, and ``topic``, to weights per category.  Null or
    unlisted categories are ``OTHER``.  Documents without tokens carry no weight and are sampled
    like the rest of their cell.  Rows repeated under one id are sampled together.  The expected
    sample holds ``share`` of the tokens at least (see ``fit``)."""
    text = column(docs, text_col)
    extra = fresh(docs, "mixed")
    cell, key, odds = (fresh(docs, n) for n in ("mix_cell", "mix_key", "mix_odds"))
    values = {name: topic(text) if name == "topic" else column(docs, name) for name in targets}
    marked = docs.withColumn(extra, F.struct(topic(text).alias("topic"), n_tokens(text).alias("n_tokens"))).withColumn(
        cell, F.concat_ws("\x1f", *[_category(values[n], targets[n]) for n in targets]))
    sums = marked.groupBy(column(marked, cell).alias("cell")).agg(F.sum(column(marked, extra)["n_tokens"]).alias("tokens"))
    names = [f"m{i}" for i in range(len(targets))]
    parts = sums.select("cell", "tokens", *[F.split("cell", "\x1f")[i].alias(n) for i, n in enumerate(names)])
    fitted = rake(parts.select(*names, "tokens"), dict(zip(names, targets.values(), strict=True)), rounds, share)
    table = fitted.select(F.concat_ws("\x1f", *names).alias(key), F.col("probability").alias(odds))
    joined = marked.join(F.broadcast(table), column(marked, cell) == table[key])  # bounded: a product of configured sizes
    m = column(joined, extra)
    done = F.struct(m["topic"].alias("topic"), m["n_tokens"].alias("n_tokens"), F.col(odds).alias("probability"),
                    (chance(column(docs, id_col), text, seed) < F.col(odds)).alias("sampled"))
    return joined.withColumn(extra, done).drop(cell, key, odds)
