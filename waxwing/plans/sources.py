"""Queries over files that Spark writes from the tables, read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from waxwing.operators import outcomes
from waxwing.operators.staging import folder
from waxwing.plans.registry import query, table
from waxwing.sources import catalog, library, plugins, projects, sinks
from waxwing.sources.adapters import TRACKS_SQL, entries, nodes, tracks
from waxwing.streaming import ingest


@query(
    "source_pages",
    """WITH p AS (SELECT *, page_id // 20 AS n FROM pages)
SELECT page_id AS id, coalesce(CASE WHEN page_id % 3 > 0 THEN url END, '') AS title, CASE WHEN page_id % 5 > 0 THEN 'u' || page_id ELSE '' END AS artist, (length(html) % 1000)::BIGINT AS duration_ms, NULL AS kind
FROM p WHERE n % 10 NOT IN (3, 7) AND page_id % 4 > 0 AND (page_id % 3 > 0 OR page_id % 5 > 0)
UNION ALL SELECT NULL, NULL, NULL, NULL, CASE n % 10 WHEN 3 THEN 'quota' ELSE 'parse' END FROM p WHERE n % 10 IN (3, 7) GROUP BY n""",
)
def source_pages(spark, d):
    """The pages as responses of twenty records each, through the source registered for them; some responses are errors."""
    i, n = F.col("page_id"), F.floor(F.col("page_id") / 20)
    user = F.struct(F.when(i % 5 > 0, F.concat(F.lit("u"), i.cast("string"))).alias("username"))
    record = F.struct(F.when(i % 4 > 0, i).alias("id"), F.when(i % 3 > 0, F.col("url")).alias("title"), user.alias("user"), (F.length("html") % 1000).alias("duration"))
    bodies = table(spark, d, "pages").groupBy(n.alias("n")).agg(F.to_json(F.struct(F.collect_list(record).alias("collection"))).alias("body"))
    body = F.when(F.col("n") % 10 == 3, '{"error": {"code": 429}}').when(F.col("n") % 10 == 7, '{"collection": [').otherwise(F.col("body"))
    path = folder(spark)
    bodies.select(body.alias("value")).write.text(path)
    plugins.register(spark, plugins.SavedPages)
    return plugins.scan(spark, "saved_pages", path=path).select("id", "title", "artist", "duration_ms", F.col("error.kind").alias("kind"))


@query(
    "project_sections",
    """SELECT l_orderkey::VARCHAR AS track_id, 'order ' || l_orderkey AS title, count(*) FILTER (l_linenumber % 4 <> 3)::BIGINT AS volumes, round(coalesce(sum(l_quantity) FILTER (l_linenumber % 4 <> 3), 0), 4) AS total,
  count(*)::BIGINT AS cues, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS names, coalesce(string_agg('vol=bad' || l_linenumber, ' ' ORDER BY l_linenumber, l_partkey) FILTER (l_linenumber % 4 = 3), '') AS wrong
FROM lineitem GROUP BY l_orderkey""",
)
def project_sections(spark, d):
    """Orders as edit projects: a volume section and a cue for each line, some with a volume that is no number."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    number = lambda x: F.when(x["l_linenumber"] % 4 == 3, text("bad", x["l_linenumber"])).otherwise(x["l_quantity"].cast("string"))
    volume = F.array_join(F.transform("lines", lambda x: text('<section start="', x["l_linenumber"], '" vol="', number(x), '"/>')), "")
    cues = F.array_join(F.transform("lines", lambda x: text('<cue index="', x["l_linenumber"], '" name="', x["l_partkey"], '"/>')), "")
    key = F.col("l_orderkey")
    body = text('<project><tracks><track trackid="', key, '"><song><title>order ', key, "</title></song><edit><volume><data>", volume, "</data></volume><prepared><hotcue><data>", cues, "</data></hotcue></prepared></edit></track></tracks></project>")
    read = projects.parsed(orders.select(key.cast("string").alias("path"), body.alias("text")))
    total = F.aggregate("volume", F.lit(0.0), lambda s, x: s + x["vol"])
    return read.select("track_id", "title", F.size("volume").cast("long").alias("volumes"), F.round(total, 4).alias("total"), F.size("hotcues").cast("long").alias("cues"), F.array_join(F.transform("hotcues", lambda x: x["name"]), ",").alias("names"), F.coalesce(F.try_element_at("errors", F.lit("volume")), F.lit("")).alias("wrong"))


@query(
    "typed_failures",
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'BinaryMissing' WHEN value > 100 THEN 'Timeout' WHEN (props->>'$.k')::INTEGER % 10 = 0 THEN 'DecodeError' END AS kind,
  CASE WHEN event_type <> 'signup' AND NOT coalesce(value > 100, false) AND (props->>'$.k')::INTEGER % 10 <> 0 THEN round(value / ((props->>'$.k')::INTEGER % 10), 6) END AS score FROM events""",
)
def typed_failures(spark, d):
    """Events through two steps that fail in three ways; a row that failed goes on with its error."""
    k = F.from_json("props", "k int")["k"]
    first = outcomes.outcome(F.col("value"), (outcomes.MISSING, F.col("event_type") == "signup", F.col("event_type")), (outcomes.TIMEOUT, F.col("value") > 100, F.col("value")))
    second = outcomes.then(first, lambda v: v / F.nullif(k % 10, F.lit(0)), (outcomes.DECODE, k % 10 == 0, F.col("props")))
    return table(spark, d, "events").select("event_id", second.alias("o")).select("event_id", F.col("o.error.kind").alias("kind"), F.round("o.value", 6).alias("score"))


@query(
    "collection_round_trip",
    f"SELECT id::VARCHAR AS id, title, artist, round(bpm, 6) AS bpm, rating, bitrate, path, 2::BIGINT AS beats FROM {TRACKS_SQL}",
)
def collection_round_trip(spark, d):
    """The catalogue as collection XML with two beats a track, read back."""
    beat = lambda at: F.struct(F.lit(at).alias("time"), F.col("bpm"), F.lit(1).alias("beat"), F.lit("4/4").alias("metro"))
    path = folder(spark)
    sinks.write_tracks(tracks(spark, d).withColumn("beats", F.array(beat(0.1), beat(0.6))), path)
    return catalog.read_tracks(spark, path).select("id", "title", "artist", F.round("bpm", 6).alias("bpm"), "rating", "bitrate", "path", F.size("beats").cast("long").alias("beats"))


@query(
    "selection_round_trip",
    f"SELECT id::VARCHAR AS id, title, (SELECT count(DISTINCT p_partkey) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 5 = 2))::BIGINT AS written FROM {TRACKS_SQL} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 5 = 2)",
)
def selection_round_trip(spark, d):
    """The tracks of every fifth playlist as collection XML, counted while written, read back."""
    path = folder(spark)
    held = entries(spark, d).withColumn("pid", F.col("pid") % 5)
    written = sinks.restricted_export(tracks(spark, d), held, [2], path)
    return catalog.read_tracks(spark, path).select("id", "title", F.lit(written).cast("long").alias("written"))


@query("stream_ingest", "SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id % 3 > 0 GROUP BY user_id")
def stream_ingest(spark, d):
    """Events as files of a watched folder, at most two a batch: each new user once, known ones never."""
    path, events = folder(spark), table(spark, d, "events").select("event_id", "user_id")
    for part in range(4):  # folders below the watched one
        events.filter(F.col("event_id") % 4 == part).write.parquet(f"{path}/in/day{part}")
    known = events.filter("user_id % 3 = 0").select("user_id").distinct()
    stream = ingest.watched(spark, f"{path}/in", events.schema, per_trigger=2)
    firsts = stream.join(known, "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("event_id"))

    def replace(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/{number % 2}")
        replace.last = number % 2

    run = firsts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out/{replace.last}").select("user_id", "event_id")


@query(
    "library_contents",
    f"SELECT 'o' || l_orderkey AS pid, l_orderkey::VARCHAR AS name, l_linenumber::BIGINT AS pos, t.id::VARCHAR AS id, title, round(bpm, 6) AS bpm, rating::INTEGER AS rating, 0::BIGINT AS duration_ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN {TRACKS_SQL} t ON t.id = l_partkey",
)
def library_contents(spark, d):
    """All playlists with their tracks through the common view of catalogues."""
    held = library.opened(spark, "tables", d).contents()
    return held.select("pid", "name", "pos", "id", "title", F.round("bpm", 6).alias("bpm"), "rating", "duration_ms")
