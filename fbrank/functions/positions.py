"""Seeded feedback positions (F2, F8) and the per-trial hash keys used by F4/F5.

``random.Random(seed).sample(range(width), depth)`` is the exact rule of the studied
experiments (their standard library, reseeded on every call).  It is a Python-only
algorithm, so it runs as a small helper on the driver, once per cell of a grid.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_width(total: int, split_num: int) -> int:
    """int(total / split_num); the remainder ranks are never chosen."""
    return int(total / split_num)


def check_slice(depth: int, total: int, split_num: int, nsplit: int) -> None:
    """P6 for one literal setting."""
    if split_num <= 0:
        raise ValueError("split_num must be positive")
    if not 0 <= nsplit < split_num:
        raise ValueError(f"slice {nsplit} isn't among {split_num}")
    if depth > slice_width(total, split_num):
        raise ValueError(f"sample larger than slice: depth={depth}, width={slice_width(total, split_num)}")


def sample_positions(seed: int, depth: int, total: int, split_num: int, nsplit: int) -> list[int]:
    """0-based sorted positions inside slice ``nsplit`` of the first ``total`` ranks."""
    if depth <= 0:
        return []
    check_slice(depth, total, split_num, nsplit)
    width = slice_width(total, split_num)
    picked = sorted(random.Random(seed).sample(range(width), depth))
    return [p + width * nsplit for p in picked]


def seeded_order_key(seed: Column | str, qid: Column | str) -> Column:
    """md5(seed || ':' || qid): deterministic per-trial topic order."""
    s = F.col(seed) if isinstance(seed, str) else seed
    q = F.col(qid) if isinstance(qid, str) else qid
    return F.md5(F.concat_ws(":", s.cast("string"), q.cast("string")))


def seeded_offset(seed: Column | str, qid: Column | str) -> Column:
    """First 8 hex digits of the order key as BIGINT."""
    return F.conv(F.substring(seeded_order_key(seed, qid), 1, 8), 16, 10).cast("bigint")
