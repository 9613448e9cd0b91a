"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fbrank.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (names are not case sensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """The column of that name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
