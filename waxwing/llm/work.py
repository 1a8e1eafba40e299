"""Shared folder for written intermediates, and small plan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxwing.operators.staging import folder, staged  # noqa: F401

#: At most this many rows of a small key table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted first), else unhinted for a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
