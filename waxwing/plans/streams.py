"""Queries of status lifecycles: from the table, and from the table read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from waxwing.operators.staging import folder
from waxwing.plans.registry import query, table
from waxwing.streaming import lifecycle

_FINISHED, _KEEP, _ABANDONED = ("purchase", "error"), 1800, 21600

_STAGES = f"""WITH lined AS (
  SELECT user_id::VARCHAR AS key, ts, event_id, event_type AS stage, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS before, lag(event_type) OVER w AS last FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, event_type)),
marked AS (SELECT *, before IS NULL OR us - before > CASE WHEN last IN ('purchase', 'error') THEN {_KEEP} ELSE {_ABANDONED} END * 1000000::BIGINT AS new FROM lined),
lives AS (SELECT *, sum(new::BIGINT) OVER (PARTITION BY key ORDER BY ts, event_id, stage ROWS UNBOUNDED PRECEDING)::BIGINT AS life FROM marked),
told AS (
  SELECT key, life, row_number() OVER w AS nth, stage, ts AS moment, array_to_string(list(stage) OVER w, '>') AS stages FROM lives WHERE new OR last <> stage
  WINDOW w AS (PARTITION BY key, life ORDER BY ts, event_id, stage ROWS UNBOUNDED PRECEDING))
SELECT key, life, nth, stage, epoch_us(moment) AS "at", stages FROM told"""


def _shown(df):
    return df.withColumn("stages", F.array_join("stages", ">")).withColumn("at", F.unix_micros("at"))


@query("stage_history", _STAGES)
def stage_history(spark, d):
    return _shown(lifecycle.stages(table(spark, d, "events"), "user_id", "ts", "event_type", ["event_id"], _FINISHED, _KEEP, _ABANDONED))


@query("stage_stream", f"{_STAGES} WHERE moment <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def stage_stream(spark, d):
    """The same from the table as a stream, to where the watermark comes: an hour before the last event."""
    path, events = folder(spark), table(spark, d, "events")
    events.write.parquet(f"{path}/in")  # a stream reads folders, and the table may be one file
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    with lifecycle.state_store(spark):
        told = lifecycle.tracked(stream, "user_id", "ts", "event_type", ["event_id"], "1 hour", _FINISHED, _KEEP, _ABANDONED)
        run = told.writeStream.format("parquet").option("path", f"{path}/told").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
    return _shown(spark.read.schema(told.schema).parquet(f"{path}/told"))
