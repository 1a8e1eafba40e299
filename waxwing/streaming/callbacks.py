"""A watched stream that hands new rows to a callback, each batch once however often it is run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException


@dataclass
class Importer:
    """What ``foreachBatch`` calls: rows whose key is known already go, the rest goes through ``callback`` into ``path``.

    A batch writes its rows into a folder of its own number and then its line in the ledger. ``imported`` reads what the
    ledger names, so a batch that broke in between is not seen; run again it overwrites its own folder, and one that the
    ledger has changes nothing. ``known`` gives the keys of the catalogue when a batch begins. Rows that repeat a key
    within a batch count once, in the order of ``first``; rows without a key go. ``path`` must be shared by all executors.
    """

    spark: SparkSession
    path: str
    key: str
    schema: str
    callback: Callable[[DataFrame], DataFrame] = staticmethod(lambda rows: rows)
    known: Callable[[], DataFrame] | None = None
    first: str | None = None

    def ledger(self) -> DataFrame:
        """(batch, rows) of the batches that are done."""
        try:
            return self.spark.read.schema("rows long, batch long").parquet(f"{self.path}/ledger")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "rows long, batch long")

    def imported(self) -> DataFrame:
        """The rows of all batches that are done, each with its ``batch``."""
        done = self.ledger().select("batch")
        if done.isEmpty():
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/rows").join(F.broadcast(done), "batch", "left_semi").select(*(c.split()[0] for c in self.schema.split(", ")), "batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if not self.ledger().filter(F.col("batch") == number).isEmpty():
            return
        rows = batch.filter(F.col(self.key).isNotNull())
        if self.first:
            best = F.min_by(F.struct(*batch.columns), F.struct(self.first, *(c for c in batch.columns if c not in (self.key, self.first))))
            rows = rows.groupBy(self.key).agg(best.alias("row")).select("row.*")
        else:
            rows = rows.dropDuplicates([self.key])
        rows = rows.join(self.imported().select(self.key), self.key, "left_anti")
        if self.known:
            rows = rows.join(self.known().select(self.key), self.key, "left_anti")
        self.callback(rows).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        count = self.spark.read.parquet(f"{self.path}/rows/batch={number}").agg(F.count("*").alias("rows"))
        count.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={number}")


def watched_into(stream: DataFrame, importer: Importer, checkpoint: str) -> DataStreamWriter:
    """The stream's writer, ready to ``trigger`` and ``start``."""
    return stream.writeStream.foreachBatch(importer).option("checkpointLocation", checkpoint)
