"""Queries of grouped counts, ordered sequences, the tree and the stores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waxwing.functions.text import normalize_artist, normalize_title, split_artists, title_stem, version_tag
from waxwing.operators import aggregates as A
from waxwing.operators import hierarchy as H
from waxwing.operators import sequences as S
from waxwing.operators import stores as D
from waxwing.operators.staging import numbered_in_order
from waxwing.plans.registry import query, table
from waxwing.plans.text import _label, _stem
from waxwing.sources.adapters import NODES_SQL, TITLES_SQL, entries, nodes, titles, tracks
from waxwing.sources.adapters import TRACKS_SQL as T

_events = lambda spark, d: table(spark, d, "events")

# --- Grouped counts ---


@query("agg_artists", f"SELECT 'art_' || (row_number() OVER (ORDER BY name) - 1) AS id, name, n AS count FROM (SELECT name, count(*) AS n FROM (SELECT unnest([artist, genre]) AS name FROM {T}) GROUP BY 1) QUALIFY n >= 80")
def agg_artists(spark, d):
    credit = tracks(spark, d).select(F.explode(split_artists(F.concat_ws(" & ", "artist", "genre"))).alias("artist"))
    return A.ranked_counts(credit, "artist", "art_", 80)


@query("agg_genres", f"SELECT genre, count(*)::BIGINT AS n FROM {T} WHERE genre <> '' GROUP BY 1")
def agg_genres(spark, d):
    return tracks(spark, d).filter("genre <> ''").groupBy("genre").agg(F.count("*").alias("n"))


@query("agg_labels", f"SELECT trim(artist) AS label, count(*)::BIGINT AS n FROM {T} GROUP BY 1")
def agg_labels(spark, d):
    return tracks(spark, d).groupBy(normalize_artist(F.col("artist")).alias("label")).agg(F.count("*").alias("n"))


@query("agg_first_value", f"SELECT genre, count(*)::BIGINT AS n, min_by(path, id) FILTER (WHERE rating > 2) AS artwork FROM {T} GROUP BY 1")
def agg_first_value(spark, d):
    return tracks(spark, d).groupBy("genre").agg(F.count("*").alias("n"), A.first_where("path", "id", F.col("rating") > 2).alias("artwork"))


@query("drill_artist", f"SELECT id, title FROM {T} WHERE artist = 'Brand#12'")
def drill_artist(spark, d):
    return tracks(spark, d).filter(F.array_contains(split_artists(F.concat_ws(", ", "artist", "genre")), "Brand#12")).select("id", "title")


@query("dup_groups", f"SELECT min_by(title, id) AS title, min_by(artist, id) AS artist, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*)::BIGINT AS n FROM {T} GROUP BY lower(title), lower(artist) HAVING count(*) > 1")
def dup_groups(spark, d):
    return A.duplicate_groups(tracks(spark, d)).withColumn("ids", F.array_join("ids", ","))


@query("auto_playlists", f"SELECT artist, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM {T} GROUP BY 1 HAVING count(*) >= 80")
def auto_playlists(spark, d):
    lists = tracks(spark, d).groupBy("artist").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.filter(F.size("ids") >= 80).withColumn("ids", F.array_join("ids", ","))


@query("hist_dense", f"SELECT v AS value, count(id)::BIGINT AS n FROM (SELECT range::INTEGER AS v FROM range(0, 9)) LEFT JOIN (SELECT * FROM {T} WHERE color_id <> 4) ON color_id = v GROUP BY 1")
def hist_dense(spark, d):
    return A.dense_histogram(tracks(spark, d).filter("color_id <> 4"), "color_id", 0, 8)


@query("tag_counts", "SELECT tag, count(l_orderkey)::BIGINT AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(tag) LEFT JOIN lineitem ON l_returnflag = tag GROUP BY 1")
def tag_counts(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tag")).agg(F.count("*").alias("n"))
    defined = spark.createDataFrame([(x,) for x in "ANRX"], "tag string")
    return defined.join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("subset_counts", f"SELECT rating > 0 AS ranked, count(*)::BIGINT AS n, round_even(sum(bitrate * 40000)::BIGINT / 1024 / 1024, 1) AS mb FROM {T} GROUP BY 1")
def subset_counts(spark, d):
    return tracks(spark, d).groupBy((F.col("rating") > 0).alias("ranked")).agg(F.count("*").alias("n"), F.bround(F.sum(F.col("bitrate") * 40000) / 1024 / 1024, 1).alias("mb"))


@query("capacity_estimate", f"SELECT sum(b)::BIGINT AS source, round_even(sum(b)::BIGINT * 5.5::DOUBLE / 1024 / 1024, 1) AS target_mb, sum(b)::BIGINT * 5.5::DOUBLE * 1.5 > 1e10::DOUBLE AS abort, sum(b)::BIGINT * 5.5::DOUBLE * 1.2 > 1e10::DOUBLE AS warn FROM (SELECT bitrate * 30000 AS b FROM {T} WHERE ends_with(path, '.m4a'))")
def capacity_estimate(spark, d):
    need = tracks(spark, d).filter(F.endswith("path", F.lit(".m4a"))).agg(F.sum(F.col("bitrate") * 30000).alias("source"))
    target = F.col("source") * 5.5
    return need.select("source", F.bround(target / 1024 / 1024, 1).alias("target_mb"), (target * 1.5 > 1e10).alias("abort"), (target * 1.2 > 1e10).alias("warn"))


@query("convert_plan", f"SELECT id, path AS source, regexp_replace(path, '[.][^.]*$', '.aiff') AS target, bitrate * 30000 AS size FROM {T} WHERE NOT ends_with(path, '.aiff') AND regexp_matches(path, '[.](m4a|ogg)$')")
def convert_plan(spark, d):
    wanted = tracks(spark, d).filter(F.col("path").rlike(r"\.(m4a|ogg)$") & ~F.endswith("path", F.lit(".aiff")))
    return wanted.select("id", F.col("path").alias("source"), F.regexp_replace("path", r"\.[^.]*$", ".aiff").alias("target"), (F.col("bitrate") * 30000).alias("size"))


@query("canonical_project", "SELECT event_id::VARCHAR AS id, coalesce(event_type, '') AS title, value AS bpm, CASE WHEN user_id % 10 = 0 THEN 0 ELSE trunc(value)::INTEGER END AS rating, CASE WHEN floor(value) < 100 THEN floor(value)::BIGINT * 1000 ELSE floor(value)::BIGINT END AS duration_ms FROM events")
def canonical_project(spark, d):
    raw = F.when(F.col("user_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string"))
    seconds = F.floor("value")
    return _events(spark, d).select(F.col("event_id").cast("string").alias("id"), F.coalesce("event_type", F.lit("")).alias("title"), F.col("value").alias("bpm"), F.coalesce(raw.try_cast("double").try_cast("int"), F.lit(0)).alias("rating"), F.when(seconds < 100, seconds * 1000).otherwise(seconds).alias("duration_ms"))


@query("playlist_sizes", "SELECT o_orderkey AS pid, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def playlist_sizes(spark, d):
    sizes = entries(spark, d).groupBy("pid").agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pid")).join(sizes, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("download_stats", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS done, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed, count(DISTINCT user_id)::BIGINT AS devices, min(ts) AS first, max(ts) AS last FROM events")
def download_stats(spark, d):
    return _events(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("user_id").alias("devices"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("kpi", f"SELECT count(*)::BIGINT AS total, floor(round(avg(bpm) FILTER (WHERE bpm > 95), 6) + 0.5)::BIGINT AS bpm, count(DISTINCT genre)::BIGINT AS keys FROM {T}")
def kpi(spark, d):
    return tracks(spark, d).agg(F.count("*").alias("total"), F.floor(F.round(F.avg(F.when(F.col("bpm") > 95, F.col("bpm"))), 6) + 0.5).alias("bpm"), F.count_distinct("genre").alias("keys"))


@query("hist_bpm", f"SELECT (floor(bpm / 2) * 2)::BIGINT AS bin, count(*)::BIGINT AS n FROM {T} GROUP BY 1")
def hist_bpm(spark, d):
    return tracks(spark, d).groupBy(A.bins(F.col("bpm"), 2).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("genre_share", f"SELECT name, count(*)::BIGINT AS n, floor(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part) + 0.5)::BIGINT AS pct FROM (SELECT CASE WHEN id % 9 = 0 THEN 'Unknown' ELSE artist END AS name FROM {T}) GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def genre_share(spark, d):
    return A.shares(tracks(spark, d).withColumn("g", F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("artist"))), "g", 10)


@query("key_dist", "SELECT trim(role) AS key, count(*)::BIGINT AS n FROM conversations WHERE trim(role) <> '' GROUP BY 1")
def key_dist(spark, d):
    return table(spark, d, "conversations").select(F.trim("role").alias("key")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"))


@query("task_stats", "SELECT count(*) FILTER (WHERE s NOT IN ('purchase', 'error'))::BIGINT AS active, count(*) FILTER (WHERE s = 'purchase')::BIGINT AS done, count(*) FILTER (WHERE s = 'error')::BIGINT AS failed, round(avg(secs) FILTER (WHERE s = 'purchase'), 3) AS avg_secs FROM (SELECT max_by(event_type, (ts, event_id)) AS s, epoch(max(ts)) - epoch(min(ts)) AS secs FROM events GROUP BY user_id)")
def task_stats(spark, d):
    steps = _events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("s")))).alias("h"))
    last, first = F.element_at("h", -1), F.element_at("h", 1)
    tasks = steps.select(last["s"].alias("s"), (last["ts"].cast("timestamp").cast("double") - first["ts"].cast("timestamp").cast("double")).alias("secs"))
    done, failed = F.col("s") == "purchase", F.col("s") == "error"
    return tasks.agg(F.count_if(~done & ~failed).alias("active"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"), F.round(F.avg(F.when(done, F.col("secs"))), 3).alias("avg_secs"))


@query("best_of_group", f"SELECT title, id, (rating * 100 + bitrate + length(path) * 10)::INTEGER AS score FROM {T} QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, id) = 1")
def best_of_group(spark, d):
    return A.best_of(tracks(spark, d), "title", F.col("rating") * 100 + F.col("bitrate") + F.length("path") * 10, "id").select("title", "id", "score")


_VAR = f"(SELECT id, artist, regexp_replace({_stem}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS root, {_label} AS label, (1990 + id % 30)::INTEGER AS year, {_stem} AS stem, id % 101 = 7 AS pinned FROM {TITLES_SQL})"
_SCORE = "CASE WHEN pinned THEN 1.0::DOUBLE ELSE round(CASE WHEN coalesce(label, 'original') = 'original' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN year = min(year) OVER (PARTITION BY root) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(stem) = min(length(stem)) OVER (PARTITION BY root) THEN 0.1::DOUBLE ELSE 0 END, 3) END"
_PICK = f"(SELECT root, id AS canonical_id, score FROM (SELECT *, {_SCORE} AS score FROM {_VAR}) QUALIFY row_number() OVER (PARTITION BY root ORDER BY score DESC, id) = 1)"


def _variants(spark, d):
    stem = title_stem(F.col("title"))
    return titles(spark, d).select("id", "artist", normalize_title(stem).alias("root"), version_tag(F.col("title"))["label"].alias("label"), (F.col("id") % 30 + 1990).cast("int").alias("year"), stem.alias("stem"), (F.col("id") % 101 == 7).alias("pinned"))


@query("canonical_pick", f"SELECT root, canonical_id, score FROM {_PICK}")
def canonical_pick(spark, d):
    return A.canonical(_variants(spark, d))


@query("variant_edges", f"SELECT v.id AS track_id, p.canonical_id AS parent_id, v.root, CASE WHEN lower(v.artist) = lower(h.artist) THEN 0.75::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM {_VAR} v JOIN {_PICK} p USING (root) JOIN {_VAR} h ON h.id = p.canonical_id WHERE v.id <> p.canonical_id")
def variant_edges(spark, d):
    return A.variant_edges(_variants(spark, d))


@query("profile_prune", "SELECT c_nationkey AS drive, c_mktsegment AS label, coalesce(max_by(c_custkey, c_custkey) FILTER (WHERE c_acctbal > 9000), max(c_custkey)) AS kept, max_by(c_name, c_custkey) FILTER (WHERE c_acctbal > 0) AS playlists FROM customer GROUP BY 1, 2")
def profile_prune(spark, d):
    connected = F.max(F.when(F.col("c_acctbal") > 9000, F.col("c_custkey")))
    names = F.max_by(F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("drive"), F.col("c_mktsegment").alias("label")).agg(F.coalesce(connected, F.max("c_custkey")).alias("kept"), names.alias("playlists"))


@query("merge_counts", f"SELECT lower(title) AS title, min(id) AS keeper, sum(bitrate)::BIGINT AS plays FROM {T} GROUP BY 1")
def merge_counts(spark, d):
    return tracks(spark, d).groupBy(F.lower("title").alias("title")).agg(F.min("id").alias("keeper"), F.sum("bitrate").alias("plays"))


@query("percentiles", "SELECT user_id, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.8), 6) AS p80 FROM events GROUP BY 1")
def percentiles(spark, d):
    at = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return _events(spark, d).groupBy("user_id").agg(at(0.2).alias("p20"), at(0.5).alias("p50"), at(0.8).alias("p80"))


@query("downbeat_argmax", "SELECT user_id, max_by(k, (round(m, 9), -k)) AS downbeat FROM (SELECT user_id, event_id % 4 AS k, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1")
def downbeat_argmax(spark, d):
    means = _events(spark, d).groupBy("user_id", (F.col("event_id") % 4).alias("k")).agg(F.avg("value").alias("m"))
    return means.groupBy("user_id").agg(F.max_by("k", F.struct(F.round("m", 9), -F.col("k"))).alias("downbeat"))


@query("history_sessions", "SELECT o_custkey AS session, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS tracks FROM orders GROUP BY 1")
def history_sessions(spark, d):
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("h"))
    return lists.select("session", F.array_join(F.transform("h", lambda x: x["o_orderkey"].cast("string")), ",").alias("tracks"))


@query("surrogate_keys", f"SELECT id, artist, dense_rank() OVER (ORDER BY artist) AS artist_id FROM {T}")
def surrogate_keys(spark, d):
    keys = numbered_in_order(tracks(spark, d).select("artist").distinct(), ["artist"], "artist_id")
    return tracks(spark, d).join(keys, "artist").select("id", "artist", "artist_id")


# --- Ordered sequences: a user's events are a track's beats, their values its energies ---

_BEATS = "(SELECT user_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
_ORDER = ["ts", "event_id"]


@query("phrase_cues", f"SELECT user_id, ts, event_id, type, CASE type WHEN 'phrase_start' THEN 'P' ELSE 'B' END || i AS label, i::INTEGER AS index FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY n) AS i FROM (SELECT *, CASE WHEN n % 16 = 0 THEN 'phrase_start' ELSE 'bar_start' END AS type FROM {_BEATS} WHERE n % 4 = 0))")
def phrase_cues(spark, d):
    return S.phrase_cues(_events(spark, d), "user_id", _ORDER, 16)


@query("grid_cues", f"SELECT user_id, ts, event_id, ((n - a) // 8)::INTEGER AS number FROM (SELECT *, coalesce(min(n) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id), 0) AS a FROM {_BEATS}) WHERE n >= a AND (n - a) % 8 = 0 AND (n - a) // 8 < 5")
def grid_cues(spark, d):
    return S.grid_cues(_events(spark, d), "user_id", _ORDER, F.col("event_type") == "view", 2, 5)


@query("beat_number", f"SELECT event_id, ((n - 5) % 4 + 4) % 4 + 1 AS beat FROM {_BEATS}")
def beat_number(spark, d):
    return S.numbered(_events(spark, d), "user_id", _ORDER).select("event_id", S.beat_number(F.col("n"), F.lit(5)).cast("long").alias("beat"))


@query("lag_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def lag_delta(spark, d):
    return _events(spark, d).select("event_id", F.round(F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy(*_ORDER)), 6).alias("delta"))


@query("lag_cosine", "SELECT vec_id, round(1 - list_cosine_similarity(e, p), 6) AS change FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL")
def lag_cosine(spark, d):
    from waxwing.functions.music import cosine_distance

    before = F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, d, "embeddings").withColumn("before", before).filter("before is not null")
    return rows.select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("before")), 6).alias("change"))


_PHRASES = "(SELECT user_id, event_id, value / 500 AS e, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events)"


@query("phrase_classify", f"""SELECT event_id, CASE WHEN n = 1 THEN 'Intro' WHEN n = k THEN 'Outro' WHEN e - b > 0.3::DOUBLE AND c > bar AND b < p50 THEN 'Drop' WHEN e >= p80 THEN 'Chorus' WHEN e <= p20 THEN 'Bridge' WHEN e - b > 0.15::DOUBLE AND c > bar * 0.7::DOUBLE THEN 'Up' ELSE 'Verse' END AS label
    FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM {_PHRASES}) JOIN (SELECT user_id, quantile_cont(e, 0.8) AS p80, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.2) AS p20, coalesce(quantile_cont(c, 0.75) FILTER (WHERE n > 1), 0) AS bar FROM {_PHRASES} GROUP BY 1) USING (user_id)""")
def phrase_classify(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", (F.col("value") / 500).alias("e"), ((F.col("event_id") * 7919 % 1000) / 1000.0).alias("c"))
    return S.classified(rows, "user_id", "event_id", "e", "c").select("event_id", "label")


@query("run_merge", """WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) - 1) // 3 AS p FROM b),
    r AS (SELECT user_id, event_type, min((ts, event_id)) AS f, count(*) AS rows, list(floor(value) ORDER BY ts, event_id) AS v FROM c GROUP BY user_id, g, p, event_type)
    SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY f) - 1)::INTEGER AS run, event_type, rows::INTEGER AS rows, CASE rows WHEN 1 THEN v[1] WHEN 2 THEN round((v[1] + v[2]) / 2, 3) ELSE round((round((v[1] + v[2]) / 2, 3) + v[3]) / 2, 3) END AS value FROM r""")
def run_merge(spark, d):
    return S.merged_runs(_events(spark, d).withColumn("value", F.floor("value")), "user_id", _ORDER, "event_type", "value", 3)


@query("hot_cues_topk", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS f, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 0 END) + value / 250 AS s FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f DESC, s DESC, event_id) AS r FROM a) SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS number FROM b WHERE r <= 8")
def hot_cues_topk(spark, d):
    impact = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "error", 2).otherwise(0) + F.col("value") / 250
    return S.top_cues(_events(spark, d), "user_id", "event_id", impact, 8).select("user_id", "event_id", "number")


def _timed(spark, d):
    return _events(spark, d).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", (F.col("event_type") == "purchase").alias("sure"), "value")


_SPACED = """WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts)::DOUBLE AS t, event_type = 'purchase' AS sure, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, event_id, n, t AS lt, 1 AS c, true AS k FROM p WHERE n = 1
UNION ALL SELECT user_id, event_id, n, CASE WHEN k THEN t ELSE lt END, CASE WHEN k THEN c + 1 ELSE c END, k FROM (SELECT p.user_id, p.event_id, p.n, p.t, a.lt, a.c, a.c < 40 AND (p.sure OR p.t - a.lt >= 12 * 3.6e9::DOUBLE) AS k FROM a JOIN p ON p.user_id = a.user_id AND p.n = a.n + 1))
SELECT user_id, event_id FROM a WHERE k"""


@query("spacing_thin", _SPACED)
def spacing_thin(spark, d):
    return S.thinned(_timed(spark, d).select("user_id", "t", "event_id", "sure"), "user_id", "t", "sure", 12 * 3.6e9, 40).select("user_id", "event_id")


_CURVE = "(SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS n, stddev_pop(value) OVER (PARTITION BY user_id) AS sd FROM events)"
_ANCHORS = f"""WITH RECURSIVE p AS MATERIALIZED {_CURVE}, a AS (SELECT user_id, n, t, value, t AS lt, value AS lv, true AS k FROM p WHERE n = 1
UNION ALL SELECT user_id, n, t, value, CASE WHEN k THEN t ELSE lt END, CASE WHEN k THEN value ELSE lv END, k FROM (SELECT p.user_id, p.n, p.t, p.value, a.lt, a.lv, p.sd >= 0.5 AND abs(p.value - a.lv) >= 50 AND p.t - a.lt >= 7200 AS k FROM a JOIN p ON p.user_id = a.user_id AND p.n = a.n + 1))
SELECT user_id, t, value FROM a WHERE k"""


@query("tempo_anchors", _ANCHORS)
def tempo_anchors(spark, d):
    return S.change_points(_timed(spark, d).withColumn("t", F.col("t") / 1e6), "user_id", "t", "value", 50.0, 7200.0, 0.5)


_MATCHED = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS t, event_type = 'purchase' AS sure FROM events),
refs AS MATERIALIZED (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM e WHERE NOT sure),
dets AS MATERIALIZED (SELECT user_id, list({'j': j, 't': t} ORDER BY j) AS d FROM (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS j FROM e WHERE sure) GROUP BY user_id),
a AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS used, []::DOUBLE[] AS gaps FROM e
  UNION ALL SELECT user_id, n, CASE WHEN c IS NULL THEN used ELSE list_append(used, c.j) END, CASE WHEN c IS NULL THEN gaps ELSE list_append(gaps, c.gap) END
  FROM (SELECT a.user_id, refs.n, used, gaps, list_sort(list_transform(list_filter(coalesce(d, []), lambda x: abs(x.t - refs.t) <= 1800.0 AND NOT list_contains(used, x.j)), lambda x: {'gap': abs(x.t - refs.t), 'j': x.j}))[1] AS c
    FROM a JOIN refs ON refs.user_id = a.user_id AND refs.n = a.n + 1 LEFT JOIN dets ON dets.user_id = a.user_id))
SELECT a.user_id, round(2.0 * len(gaps) / total, 9) AS f_measure, round(list_median(gaps), 6) AS median_error
FROM a JOIN (SELECT user_id, count(*) AS total, count(*) FILTER (NOT sure) AS n FROM e GROUP BY user_id) USING (user_id, n)"""


@query("beat_f_measure", _MATCHED)
def beat_f_measure(spark, d):
    both = _timed(spark, d).select("user_id", (F.col("t") / 1e6).alias("t"), "sure")
    scores = S.match_scores(both, "user_id", "t", "sure", 1800.0)
    return scores.select("user_id", F.round("f_measure", 9).alias("f_measure"), F.round("median_error", 6).alias("median_error"))


@query("local_peak", "SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / max(value) OVER (PARTITION BY user_id), 3) AS peak FROM events")
def local_peak(spark, d):
    return _events(spark, d).select("event_id", S.local_peak(None, "user_id", _ORDER, "value").alias("peak"))


@query("rms_bins", f"SELECT user_id, n // 8 AS bin, round(sqrt(avg(value * value)), 6) AS rms FROM {_BEATS} GROUP BY ALL HAVING count(*) = 8")
def rms_bins(spark, d):
    return S.rms_bins(_events(spark, d), "user_id", _ORDER, "value", 8).withColumn("rms", F.round("rms", 6))


@query("stage_changes", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def stage_changes(spark, d):
    return D.changes(_events(spark, d), "user_id", _ORDER, "event_type").select("event_id", "event_type")


@query("resequence", "SELECT l_orderkey AS pid, l_linenumber AS pos, l_partkey AS track_id, l_suppkey AS tie, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber, l_partkey, l_suppkey) - 1 AS seq FROM lineitem")
def resequence(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("tie"), (F.col("l_linenumber") % 3).alias("k"))
    return S.numbered(rows, "pid", ["k", "pos", "track_id", "tie"], "seq").withColumn("seq", F.col("seq").cast("long")).drop("k")


@query("stage_last", "SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2")
def stage_last(spark, d):
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))


@query("first_onset", f"SELECT user_id, greatest(min(n) - 1, 0) AS onset FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM {_BEATS}) WHERE value > 0.5::DOUBLE * m GROUP BY 1")
def first_onset(spark, d):
    rows = S.numbered(_events(spark, d), "user_id", _ORDER).withColumn("m", F.max("value").over(W.partitionBy("user_id")))
    return rows.filter(F.col("value") > F.col("m") * 0.5).groupBy("user_id").agg(F.greatest(F.min("n") - 1, F.lit(0)).cast("long").alias("onset"))


@query("progress_eta", f"SELECT event_id, round((n + 1) * 100.0::DOUBLE / k, 3) AS pct, round((epoch(ts) - epoch(f)) / (n + 1) * (k - n - 1), 2) AS eta FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS k, min(ts) OVER (PARTITION BY user_id) AS f FROM {_BEATS})")
def progress_eta(spark, d):
    own = W.partitionBy("user_id")
    secs = lambda c: c.cast("timestamp").cast("double")
    rows = S.numbered(_events(spark, d), "user_id", _ORDER).withColumns({"k": F.count("*").over(own), "f": F.min("ts").over(own)})
    done = F.col("n") + 1
    return rows.select("event_id", F.round(done * 100.0 / F.col("k"), 3).alias("pct"), F.round((secs(F.col("ts")) - secs(F.col("f"))) / done * (F.col("k") - done), 2).alias("eta"))


# --- The tree ---

N = NODES_SQL
_TREE = f"WITH RECURSIVE n AS {N}, t AS (SELECT id, 0 AS depth, name AS path FROM n WHERE parent_id = 'ROOT' UNION ALL SELECT n.id, depth + 1, path || '/' || name FROM n JOIN t ON n.parent_id = t.id)"
_BELOW = f"WITH RECURSIVE n AS {N}, t AS (SELECT id FROM n WHERE id = '{{}}' UNION SELECT n.id FROM n JOIN t ON n.parent_id = t.id)"


@query("tree_paths", f"{_TREE} SELECT id, depth, path FROM t")
def tree_paths(spark, d):
    return H.paths(nodes(spark, d))


@query("folder_tracks", f"{_BELOW.format('n3')} SELECT DISTINCT l_partkey AS track_id FROM lineitem JOIN t ON t.id = 'o' || l_orderkey")
def folder_tracks(spark, d):
    named = entries(spark, d).withColumn("pid", F.concat(F.lit("o"), F.col("pid").cast("string")))
    return H.tracks_below(nodes(spark, d), named, "n3")


@query("tree_delete", f"{_BELOW.format('r1')} SELECT id, type FROM n WHERE id NOT IN (SELECT id FROM t)")
def tree_delete(spark, d):
    return H.without_subtree(nodes(spark, d), "r1").select("id", "type")


@query(
    "tree_cycle",
    "SELECT 'c' || c_custkey AS id, 'o' || o_orderkey AS new_parent, c_custkey <> o_custkey AS allowed FROM orders JOIN customer ON c_custkey = CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 - 2 * (o_custkey % 2) END",
)
def tree_cycle(spark, d):
    """Moves of customers below an order: every second is one of their own, which would close a ring."""
    own, other = F.col("o_custkey"), F.col("o_custkey") + 1 - 2 * (F.col("o_custkey") % 2)
    moved = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, own).otherwise(other).alias("c_custkey"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("new_parent"))
    moves = moved.join(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "new_parent")
    return H.allowed_moves(nodes(spark, d), moves)


@query("tree_ancestors", "SELECT DISTINCT unnest(['o' || o_orderkey, 'c' || o_custkey, 'n' || c_nationkey, 'r' || n_regionkey]) AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def tree_ancestors(spark, d):
    every = nodes(spark, d)
    return H.ancestors(every, every.filter("type = 1")).select("id").distinct()


@query("tree_emit", f"{_TREE} SELECT t.id, t.depth, row_number() OVER (PARTITION BY parent_id ORDER BY seq, t.id) - 1 AS seq FROM t JOIN n USING (id)")
def tree_emit(spark, d):
    every = nodes(spark, d)
    rows = H.paths(every).join(every.select("id", "parent_id", F.col("seq").alias("old")), "id")
    return S.numbered(rows, "parent_id", ["old", "id"], "seq").select("id", "depth", F.col("seq").cast("long").alias("seq"))


@query("tree_next_seq", f"SELECT n.id AS parent_id, coalesce(max(c.seq), -1) + 1 AS next FROM {N} n LEFT JOIN {N} c ON c.parent_id = n.id GROUP BY 1")
def tree_next_seq(spark, d):
    return H.next_seq(nodes(spark, d))


@query("tree_flatten", f"SELECT n.id, parent_id, count(l_orderkey)::BIGINT AS n FROM {N} n LEFT JOIN lineitem ON n.id = 'o' || l_orderkey WHERE type = 1 GROUP BY 1, 2")
def tree_flatten(spark, d):
    sizes = entries(spark, d).groupBy(F.concat(F.lit("o"), F.col("pid").cast("string")).alias("id")).agg(F.count("*").alias("n"))
    return nodes(spark, d).filter("type = 1").join(sizes, "id", "left").select("id", "parent_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("tree_find", f"SELECT min(id) AS id FROM {N} WHERE name = 'NATION_7'")
def tree_find(spark, d):
    return nodes(spark, d).filter("name = 'NATION_7'").agg(F.min("id").alias("id"))


# --- Stores: events are a log, a user is a key ---


@query("upsert_latest", "SELECT user_id, min_by(event_type, (ts, event_id)) AS title, max_by(value, (ts, event_id)) AS value, max_by(props, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS props FROM events GROUP BY 1")
def upsert_latest(spark, d):
    log = _events(spark, d).withColumn("title", F.col("event_type")).withColumn("props", F.when(F.col("event_type") == "purchase", F.col("props")))
    return D.upserted(log, "user_id", _ORDER, first=["title"], last=["value"], filled=["props"])


@query("dedup_probe", "SELECT user_id FROM events GROUP BY 1 HAVING max_by(event_type, (ts, event_id)) <> 'error'")
def dedup_probe(spark, d):
    return latest_status(spark, d).filter("status <> 'error'").select("user_id")


@query("latest_status", "SELECT user_id, max_by(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def latest_status(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct(*_ORDER)).alias("status"))


@query("dedup_hash", "SELECT md5(text) AS hash, min(doc_id) AS id, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def dedup_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))


@query("point_update", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type = 'error' THEN left(props || repeat('x', 600), 500) END AS error FROM events")
def point_update(spark, d):
    failed = F.col("event_type") == "error"
    return _events(spark, d).select("event_id", F.when(failed, "failed").otherwise(F.col("event_type")).alias("status"), F.when(failed, F.left(F.concat("props", F.lit("x" * 600)), F.lit(500))).alias("error"))


@query("replace_latest", "SELECT user_id, event_type AS platform, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def replace_latest(spark, d):
    return D.latest(_events(spark, d), ["user_id", "event_type"], _ORDER).select("user_id", F.col("event_type").alias("platform"), "value", "event_id")


@query("ttl_stale", "SELECT event_id FROM events WHERE epoch(ts) < 1706000000 - 604800")
def ttl_stale(spark, d):
    rows = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return D.stale(rows, "at", 1706000000, 604800).select("event_id")


_RUNS = "(SELECT event_id, user_id AS content, event_type AS field, 'run' || event_id % 3 AS run_id, value AS before, event_id % 11 = 0 AS reverted FROM events)"


def _journal(spark, d):
    return _events(spark, d).select("event_id", F.col("user_id").alias("content"), F.col("event_type").alias("field"), F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")).alias("run_id"), F.col("value").alias("before"), (F.col("event_id") % 11 == 0).alias("reverted"))


@query("undo_log", f"SELECT run_id, count(*)::BIGINT AS mutations, count(*) FILTER (WHERE reverted)::BIGINT AS undone FROM {_RUNS} GROUP BY 1")
def undo_log(spark, d):
    return _journal(spark, d).groupBy("run_id").agg(F.count("*").alias("mutations"), F.count_if("reverted").alias("undone"))


@query("undo_revert", f"SELECT content, field, min_by(before, event_id) AS value FROM {_RUNS} WHERE run_id = 'run1' AND NOT reverted GROUP BY 1, 2")
def undo_revert(spark, d):
    return D.reverted(_journal(spark, d), "run1", ["content", "field"], "event_id", "before")


@query("batch_update", f"SELECT id, CASE WHEN id % 4 = 1 THEN 5 ELSE rating END AS rating, title FROM {T}")
def batch_update(spark, d):
    update = tracks(spark, d).filter("id % 4 = 1").select("id", F.lit(5).alias("rating"))
    return D.updated(tracks(spark, d).select("id", "rating", "title"), update, "id", ["rating"])


@query("add_entry_dedup", "SELECT l_orderkey AS pid, l_partkey AS track_id FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders")
def add_entry_dedup(spark, d):
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("track_id"))
    return entries(spark, d).select("pid", "track_id").unionByName(new).distinct()


@query("merge_memberships", f"SELECT pid, coalesce(k, track_id) AS track_id, min(pos) AS pos FROM (SELECT l_orderkey AS pid, l_partkey AS track_id, l_linenumber AS pos FROM lineitem) LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY lower(title), lower(artist)) AS k FROM {T}) ON id = track_id GROUP BY 1, 2")
def merge_memberships(spark, d):
    keeper = F.min("id").over(W.partitionBy(F.lower("title"), F.lower("artist")))
    return D.merged_memberships(entries(spark, d), tracks(spark, d).select(F.col("id").alias("track_id"), keeper.alias("keeper")))


@query("cache_validity", "SELECT page_id AS path, page_id % 3 <> 0 AND page_id % 4 <> 1 AND page_id % 5 <> 2 AND page_id % 7 <> 3 AS hit FROM pages")
def cache_validity(spark, d):
    p = F.col("page_id")
    files = table(spark, d, "pages").select(p.alias("path"), F.length("html").alias("size"), (p * 10.0).alias("mtime"))
    cache = table(spark, d, "pages").filter("page_id % 3 <> 0").select(p.alias("path"), F.when(p % 4 == 1, 1).otherwise(2).alias("version"), (F.length("html") + F.when(p % 5 == 2, 1).otherwise(0)).alias("size"), (p * 10.0 + F.when(p % 7 == 3, 1.5).otherwise(0.5)).alias("mtime"))
    return D.cache_hits(files, cache, 2).select("path", "hit")


@query("cache_stats", "SELECT count(*)::BIGINT AS n, sum(strlen(html))::BIGINT AS bytes FROM pages")
def cache_stats(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


@query("running_status", "SELECT event_id, sum((event_type = 'purchase')::INTEGER) OVER w::BIGINT AS done, sum((event_type = 'error')::INTEGER) OVER w::BIGINT AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_status(spark, d):
    states = {"done": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"}
    return D.running(_events(spark, d), _ORDER, "user_id", states).select("event_id", "done", "failed")


@query("debounce_sessions", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a) SELECT user_id, min(ts) AS start, max(ts) AS end, count(*)::BIGINT AS events FROM b GROUP BY user_id, g")
def debounce_sessions(spark, d):
    return D.sessions(_events(spark, d), "user_id", "ts", "2 hours")


@query("stability_gate", "WITH a AS (SELECT user_id, event_id, floor(value / 40)::INTEGER AS size, row_number() OVER w AS r, lag(floor(value / 40)::INTEGER) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, min(r)::INTEGER AS read FROM a WHERE r <= 6 AND size > 0 AND size = b GROUP BY 1")
def stability_gate(spark, d):
    reads = _events(spark, d).select("user_id", "ts", "event_id", F.floor(F.col("value") / 40).cast("int").alias("size"))
    return D.stable_files(reads, "user_id", _ORDER, "size")


@query("usb_playcounts", "SELECT o_orderkey AS id, epoch(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END)::BIGINT AS last_played, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 40)::INTEGER END AS plays FROM orders")
def usb_playcounts(spark, d):
    added, played = F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 != 0, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")).otherwise("")
    when = F.unix_timestamp(F.coalesce(F.try_to_timestamp(played, F.lit("yyyy-MM-dd")), F.try_to_timestamp(added, F.lit("yyyy-MM-dd"))))
    plays = F.when(F.col("o_orderkey") % 5 == 0, "many").otherwise((F.col("o_orderkey") % 40).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), when.alias("last_played"), F.coalesce(plays.try_cast("int"), F.lit(0)).alias("plays"))
