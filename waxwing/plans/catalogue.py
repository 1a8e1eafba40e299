"""Queries of catalogue upkeep: names and paths, playlists, variants, journals, keys and tempi."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waxwing.functions import music as M
from waxwing.functions import text as X
from waxwing.operators import hierarchy as H
from waxwing.operators import joins as J
from waxwing.operators import stores as D
from waxwing.operators.staging import numbered_in_order
from waxwing.plans.joins import _DIFF, _sides
from waxwing.plans.registry import query, table
from waxwing.sources.adapters import NODES_SQL, entries, nodes, tracks
from waxwing.sources.adapters import TRACKS_SQL as T

_events = lambda spark, d: table(spark, d, "events")


@query("artist_fallback", f"SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'Unknown Artist' ELSE artist END AS artist_name, url_encode(title || ' & ~' || id || '.mp3') AS filename FROM {T}")
def artist_fallback(spark, d):
    artist = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, None).otherwise(F.col("artist"))
    path = F.concat(F.lit("/music/"), "artist", F.lit("/"), "title", F.lit(" & ~"), F.col("id").cast("string"), F.lit(".mp3"))
    return tracks(spark, d).select("id", F.coalesce(F.nullif(artist, F.lit("")), F.lit("Unknown Artist")).alias("artist_name"), X.quoted_name(path).alias("filename"))


@query("excluded_playlists", "SELECT event_id AS id FROM events WHERE event_type <> 'click'")
def excluded_playlists(spark, d):
    name = F.when(F.col("event_type") == "click", " Import ").otherwise(F.col("event_type"))
    return _events(spark, d).filter(~F.lower(F.trim(name)).isin("import")).select(F.col("event_id").alias("id"))


_NAMED = f"(SELECT id, title || (CASE id % 4 WHEN 0 THEN '.MP3' WHEN 1 THEN '.txt' WHEN 2 THEN '.alac' ELSE 'mp3' END) AS path FROM {T})"


@query("audio_files", f"SELECT id FROM {_NAMED} WHERE id % 4 IN (0, 2)")
def audio_files(spark, d):
    ending = F.element_at(F.array(*map(F.lit, (".MP3", ".txt", ".alac", "mp3"))), (F.col("id") % 4 + 1).cast("int"))
    return tracks(spark, d).filter(X.is_audio(F.concat("title", ending))).select("id")


@query("restricted_export", f"SELECT id, title FROM {T} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 4 = 1)")
def restricted_export(spark, d):
    chosen = entries(spark, d).filter("pid % 4 = 1").select(F.col("track_id").alias("id"))
    return J.restricted(tracks(spark, d), chosen).select("id", "title")


@query("likes_playlist", "SELECT user_id, count(*)::BIGINT AS track_count, sum(floor(value))::BIGINT AS duration, min_by(props, (ts, event_id)) AS artwork FROM events WHERE event_type = 'purchase' GROUP BY 1")
def likes_playlist(spark, d):
    liked = _events(spark, d).filter("event_type = 'purchase'").groupBy("user_id")
    return liked.agg(F.count("*").alias("track_count"), F.sum(F.floor("value")).cast("long").alias("duration"), F.min_by("props", F.struct("ts", "event_id")).alias("artwork"))


@query("count_rows", "SELECT count(*)::BIGINT AS n FROM documents")
def count_rows(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"))


@query("tree_sorted", f"SELECT parent_id, string_agg(id, ',' ORDER BY seq, id) AS children FROM {NODES_SQL} GROUP BY 1")
def tree_sorted(spark, d):
    lists = nodes(spark, d).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("c"))
    return lists.select("parent_id", F.array_join(F.col("c.id"), ",").alias("children"))


@query("cluster_by_confidence", "SELECT p_brand AS root, p_partkey AS track_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def cluster_by_confidence(spark, d):
    best = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select(F.col("p_brand").alias("root"), F.col("p_partkey").alias("track_id"), F.row_number().over(best).cast("long").alias("place"))


@query("render_cap", f"SELECT id, title FROM {T} WHERE contains(lower(title), '1') ORDER BY lower(title), id LIMIT 200")
def render_cap(spark, d):
    return tracks(spark, d).filter(F.contains(F.lower("title"), F.lit("1"))).orderBy(F.lower("title"), "id").limit(200).select("id", "title")


@query("folder_union", "SELECT DISTINCT 'n' || c_nationkey AS top, l_partkey AS track_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")
def folder_union(spark, d):
    every = nodes(spark, d)
    below = H.descendants(every, every.filter(F.startswith("id", F.lit("n"))))
    own = entries(spark, d).select(F.concat(F.lit("o"), F.col("pid").cast("string")).alias("id"), "track_id")
    return below.join(own, "id").select("top", "track_id").distinct()


_SOURCES, _TARGET = "lineitem WHERE l_orderkey % 10 = 1", "lineitem WHERE l_orderkey % 10 = 2"


@query("playlist_merge", f"SELECT l_partkey AS track_id, min(l_orderkey * 10 + l_linenumber) AS first FROM {_SOURCES} AND l_partkey NOT IN (SELECT l_partkey FROM {_TARGET}) GROUP BY 1")
def playlist_merge(spark, d):
    own = entries(spark, d)
    return J.merged_playlist(own.filter("pid % 10 = 1"), own.filter("pid % 10 = 2")).select("track_id", (F.col("first.pid") * 10 + F.col("first.pos")).alias("first"))


@query("playlist_merge_verified", f"SELECT l_orderkey AS pid, bool_and(l_partkey IN (SELECT l_partkey FROM {_TARGET})) AS complete FROM {_SOURCES} GROUP BY 1")
def playlist_merge_verified(spark, d):
    own = entries(spark, d)
    return J.complete_sources(own.filter("pid % 10 = 1"), own.filter("pid % 10 = 2"))


@query("path_membership", f"SELECT id, id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS known FROM {T}")
def path_membership(spark, d):
    held = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).distinct().withColumn("known", F.lit(True))
    return tracks(spark, d).select("id").join(held, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


_TITLE = "CASE p_partkey % 6 WHEN 0 THEN concat(' ', p_name, '?  .') WHEN 1 THEN concat(p_name, ': ', p_type) WHEN 2 THEN 'con.1' WHEN 3 THEN ' ' WHEN 4 THEN concat(p_type, repeat(' long', 30)) ELSE p_brand END"
_SAFE = "rtrim(substr(trim(regexp_replace(regexp_replace({0}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g'), ' ._'), 1, 80), ' ._')"
_STEM = f"CASE WHEN trim(t) = '' THEN 'Unknown' WHEN upper(split_part({_SAFE.format('t')}, '.', 1)) IN ('CON', 'NUL') THEN '_' || {_SAFE.format('t')} ELSE coalesce(nullif({_SAFE.format('t')}, ''), 'Unknown') END"


@query("save_path", f"SELECT id, '/music/' || artist || '/' || stem || CASE WHEN n > 0 THEN ' (' || n || ')' ELSE '' END || '.mp3' AS path FROM (SELECT *, row_number() OVER (PARTITION BY artist, stem ORDER BY id) - 1 AS n FROM (SELECT id, artist, {_STEM} AS stem FROM (SELECT p_partkey AS id, p_brand AS artist, {_TITLE} AS t FROM part)))")
def save_path(spark, d):
    """The path of each download: safe parts, and a number after the names that others of the folder have before it."""
    named = table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.safe_name(F.col("p_brand")).alias("artist"), X.safe_name(F.expr(_TITLE)).alias("stem"))
    n = F.row_number().over(W.partitionBy("artist", "stem").orderBy("id")) - 1
    suffix = F.when(F.col("n") > 0, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    return named.withColumn("n", n).select("id", F.concat(F.lit("/music/"), "artist", F.lit("/"), "stem", suffix, F.lit(".mp3")).alias("path"))


@query("guess_extension", "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN '.flac' WHEN 1 THEN (CASE WHEN contains(url, '?') THEN '.mp3' ELSE '.opus' END) ELSE '.mp3' END AS extension FROM pages")
def guess_extension(spark, d):
    kind = F.when(F.col("page_id") % 4 == 0, "Audio/X-FLAC; charset=x").otherwise("text/html")
    ending = F.element_at(F.array(*map(F.lit, (".wav", "/a.OPUS?x=b.wav", "/.wav", "/a.exe"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), X.extension_of(kind, F.concat("url", ending)).alias("extension"))


@query("basename", f"SELECT id, string_split(replace(path, '/music', 'C:\\music'), '/')[-1] AS name FROM {T}")
def basename(spark, d):
    return tracks(spark, d).select("id", X.basename(F.replace("path", F.lit("/"), F.when(F.col("id") % 2 == 0, "\\").otherwise("/"))).alias("name"))


_ONSETS = "(SELECT p_partkey AS id, p_retailprice / 10 AS bpm, (p_size * 7)::BIGINT AS onsets, (p_partkey % 40)::DOUBLE AS seconds FROM part)"


@query("onset_density", f"SELECT id, CASE WHEN seconds >= 5 AND onsets > 0 AND bpm > 6 AND onsets / seconds / (bpm / 60) > 5.5 AND bpm * 2 < 220 THEN bpm * 2 WHEN seconds >= 5 AND onsets > 0 AND bpm > 6 AND onsets / seconds / (bpm / 60) < 0.4 AND bpm / 2 > 40 THEN bpm / 2 ELSE bpm END AS bpm FROM {_ONSETS}")
def onset_density(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("bpm"), (F.col("p_size") * 7).cast("long").alias("onsets"), (F.col("p_partkey") % 40).cast("double").alias("seconds"))
    return rows.select("id", M.density_corrected(F.col("bpm"), F.col("onsets"), F.col("seconds"), 40.0, 220.0).alias("bpm"))


_FAMILIES = ", ".join(f"({f}, {m}, {list(map(float, family[m]))}::DOUBLE[])" for f, family in enumerate(M.PROFILES) for m in (0, 1))
_KEYS = f"""WITH v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: abs(x::DOUBLE)) AS c FROM embeddings), p(family, mode, profile) AS (VALUES {_FAMILIES}),
x AS (SELECT vec_id, s.s AS shift, family, mode, c[((i.i + s.s) % 12 + 1)::BIGINT] AS a, profile[(i.i + 1)::BIGINT] AS b FROM v, range(12) s(s), range(12) i(i), p),
c AS (SELECT vec_id, shift, family, mode, corr(a, b) AS r FROM x GROUP BY ALL),
m AS (SELECT vec_id, shift, mode, avg(r) * CASE WHEN mode = 1 THEN 1.1::DOUBLE ELSE 1 END AS score FROM c GROUP BY vec_id, shift, mode)
SELECT vec_id, {M.PITCHES}[(shift + 1)::BIGINT] AS pitch, CASE WHEN mode = 1 THEN 'minor' ELSE 'major' END AS mode, round(score, 5) AS score FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, shift, mode) = 1"""


@query("key_correlate", _KEYS)
def key_correlate(spark, d):
    chroma = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", M.key_of(chroma).alias("key")).select("vec_id", "key.pitch", "key.mode", F.round("key.score", 5).alias("score"))


_KIND = "CASE WHEN event_type = 'click' THEN 'centroid' WHEN event_type = 'view' THEN 'cluster_1' ELSE event_type END"


@query("taste_vectors", f"SELECT user_id::VARCHAR AS profile_id, {_KIND} AS kind, max_by(value, (ts, event_id)) AS vector FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def taste_vectors(spark, d):
    log = _events(spark, d).select(F.col("user_id").cast("string").alias("profile_id"), F.expr(_KIND).alias("kind"), F.col("value").alias("vector"), "ts", "event_id")
    return D.taste_vectors(log, ["ts", "event_id"]).select("profile_id", "kind", "vector")


@query("variant_store", f"SELECT id AS track_id, artist AS root, max_by(c, v) AS confidence FROM (SELECT id, artist, bpm AS c, 0 AS v FROM {T} UNION ALL SELECT id, artist, bpm / 2, 1 FROM {T} WHERE id % 3 = 0) GROUP BY 1, 2")
def variant_store(spark, d):
    """Variant edges replaced by their key: a second scan writes over a part of the first."""
    first = tracks(spark, d).select(F.col("id").alias("track_id"), F.col("artist").alias("root"), F.col("bpm").alias("confidence"), F.lit(0).alias("scan"))
    second = first.filter("track_id % 3 = 0").withColumns({"confidence": F.col("confidence") / 2, "scan": F.lit(1)})
    return D.latest(first.unionByName(second), ["track_id", "root"], ["scan"]).drop("scan")


@query("run_list", "SELECT 'run' || event_id % 3 AS run_id, max(ts) AS created_at, max_by(event_type, (ts, event_id)) AS status, count(*)::BIGINT AS mutation_count, row_number() OVER (ORDER BY max(ts) DESC, 1) AS place FROM events GROUP BY 1")
def run_list(spark, d):
    """Runs, newest first, numbered over many tasks."""
    log = _events(spark, d).withColumn("run_id", F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")))
    runs = log.groupBy("run_id").agg(F.max("ts").alias("created_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("mutation_count"))
    return numbered_in_order(runs, [F.desc("created_at"), "run_id"])


@query("manifest_list", "SELECT 'manifest-' || p_partkey || '.json' AS filename, p_name AS target, (p_size % 3)::BIGINT AS tracks, CASE WHEN p_size % 3 > 0 THEN p_type END AS scope_kind FROM part WHERE p_partkey % 5 > 1")
def manifest_list(spark, d):
    text = F.to_json(F.struct(F.col("p_name").alias("target"), F.when(F.col("p_size") % 3 > 0, F.array_repeat(F.lit("t"), (F.col("p_size") % 3).cast("int"))).alias("tracks"), F.when(F.col("p_size") % 3 > 0, F.struct(F.col("p_type").alias("kind"))).alias("scope")))
    name = F.concat(F.when(F.col("p_partkey") % 5 == 1, "/b/x-").otherwise("/b/manifest-"), F.col("p_partkey").cast("string"), F.lit(".json"))
    files = table(spark, d, "part").select(name.alias("path"), F.when(F.col("p_partkey") % 5 == 0, "no json").otherwise(text).alias("text"))
    return D.manifests(files).select("filename", "target", "tracks", "scope_kind")


@query("playcount_commit", f"SELECT side, track_id, n AS play_count FROM (SELECT track_id, CASE source WHEN 'equal' THEN pc_count WHEN 'pc' THEN pc_count WHEN 'usb' THEN usb_count ELSE pc_count + usb_count END AS n, unnest(['pc', 'usb']) AS side, unnest([pc_count, usb_count]) AS old FROM {_DIFF}) WHERE old <> n")
def playcount_commit(spark, d):
    return J.committed(_sides(spark, d), "sum")


_WAVE = "2.0::DOUBLE * pi() * (700.0::DOUBLE * (pow(10.0::DOUBLE, (m.lo + (m.hi - m.lo) * k.k / 7.0::DOUBLE) / 2595.0::DOUBLE) - 1.0::DOUBLE)) / 11025.0::DOUBLE * i.i"


@query("mel_bands", f"SELECT vec_id, k::BIGINT AS band, round(pow(sum(x * cos(w)), 2) + pow(sum(x * sin(w)), 2), 5) AS energy FROM (SELECT vec_id, k.k AS k, embedding[(i.i + 1)::BIGINT]::DOUBLE AS x, {_WAVE} AS w FROM embeddings, range(64) i(i), range(8) k(k), (SELECT 2595.0::DOUBLE * log10(1.0::DOUBLE + 80.0::DOUBLE / 700.0::DOUBLE) AS lo, 2595.0::DOUBLE * log10(1.0::DOUBLE + 4000.0::DOUBLE / 700.0::DOUBLE) AS hi) m) GROUP BY 1, 2")
def mel_bands(spark, d):
    """Goertzel's energies equal those of the transform at the same frequencies."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(M.mel_bands(F.col("embedding"), 8)).alias("band", "energy"))
    return rows.select("vec_id", F.col("band").cast("long").alias("band"), F.round("energy", 5).alias("energy"))
