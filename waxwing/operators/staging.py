"""Written intermediates, and numbering over many tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a session on one machine may leave that unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="waxwing-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/waxwing-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_in_order(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in the order, which must have no ties to be the same in each run.

    Rows are range-partitioned, sorted and written; each part's rows are numbered on from the counts of the parts before
    it. So no task holds more than a part, and only a count for each part meets in one.
    """
    part, row = (f"{name}_part", f"{name}_row")
    ordered = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # The number of a row is that of its part, then the row's within it.
    ordered = ordered.withColumn(row, F.monotonically_increasing_id())
    ordered = staged(ordered.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND((1 << 33) - 1)), folder(df.sparkSession))
    counts = ordered.groupBy(part).agg(F.count("*").alias("rows"))
    before = counts.select(part, (F.sum("rows").over(W.orderBy(part)) - F.col("rows")).alias("before"))
    return ordered.join(before, part).withColumn(name, F.col("before") + F.col(row) + 1).drop(part, row, "before")
