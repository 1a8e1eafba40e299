"""Queries of joins, set operations and orderings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waxwing.operators import joins as J
from waxwing.operators.staging import numbered_in_order
from waxwing.plans.registry import query, table
from waxwing.sources.adapters import TRACKS_SQL as T
from waxwing.sources.adapters import entries, tracks


@query("join_dims_left", "SELECT c_custkey AS id, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_dims_left(spark, d):
    nation = table(spark, d, "nation").filter("n_nationkey % 4 <> 0")
    named = J.with_dimension(table(spark, d, "customer"), nation, "c_nationkey", "n_nationkey", "n_name", "nation")
    keyed = named.join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return J.with_dimension(keyed, table(spark, d, "region"), "n_regionkey", "r_regionkey", "r_name", "region").select(F.col("c_custkey").alias("id"), "nation", "region")


@query("join_left_filter", "SELECT p_partkey AS id, p_name AS title, s_name AS artist FROM part LEFT JOIN supplier ON p_partkey = s_suppkey WHERE p_name <> ''")
def join_left_filter(spark, d):
    return table(spark, d, "part").filter("p_name <> ''").join(table(spark, d, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("s_name").alias("artist"))


@query("catalog_load", "SELECT c_custkey AS id, c_name AS title, coalesce(n_name, '') AS artist, coalesce(r_name, '') AS album, count(o_orderkey)::BIGINT AS plays FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def catalog_load(spark, d):
    plays = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("plays"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    facts = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(plays, "c_custkey", "left")
    return facts.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.coalesce("n_name", F.lit("")).alias("artist"), F.coalesce("r_name", F.lit("")).alias("album"), F.coalesce("plays", F.lit(0)).cast("long").alias("plays"))


_FEW = f"(SELECT * FROM {T} WHERE id % 10 <> 3)"


@query("playlist_tracks", f"SELECT l_orderkey AS pid, l_linenumber AS pos, id, title FROM lineitem JOIN {_FEW} ON l_partkey = id")
def playlist_tracks(spark, d):
    return J.playlist_tracks(entries(spark, d), tracks(spark, d).filter("id % 10 <> 3")).select("pid", "pos", F.col("track_id").alias("id"), "title")


@query("playlist_tracks_once", f"SELECT pid, id, min(pos) AS pos FROM (SELECT l_orderkey % 50 AS pid, l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) JOIN {_FEW} USING (id) GROUP BY ALL")
def playlist_tracks_once(spark, d):
    merged = entries(spark, d).select((F.col("pid") % 50).alias("pid"), "track_id", (F.col("pid") * 10 + F.col("pos")).alias("pos"))
    return J.playlist_tracks(merged, tracks(spark, d).filter("id % 10 <> 3"), once=True).select("pid", F.col("track_id").alias("id"), "pos")


@query("cues_nested", "SELECT c_custkey AS id, coalesce(n, 0)::BIGINT AS n, coalesce(cues, '') AS cues FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(event_type || ':' || event_id, ',' ORDER BY ts, event_id) AS cues FROM events GROUP BY 1) ON user_id = c_custkey")
def cues_nested(spark, d):
    cues = J.nested(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "events"), "id", "user_id", ["event_type", "event_id"], ["ts", "event_id"], "cues")
    text = F.array_join(F.transform("cues", lambda x: F.concat_ws(":", x["event_type"], x["event_id"].cast("string"))), ",")
    return cues.select("id", F.size("cues").cast("long").alias("n"), text.alias("cues"))


@query("tags_nested", f"SELECT id, coalesce(tags, '') AS tags FROM {T} LEFT JOIN (SELECT l_partkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) USING (id)")
def tags_nested(spark, d):
    tags = table(spark, d, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_partkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("tags"))
    return tracks(spark, d).select("id").join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


_SIDE = "(SELECT l_partkey AS track_id, count(*) AS play_count, epoch(max(l_shipdate))::DOUBLE AS last_played FROM lineitem WHERE l_linestatus = '{}' GROUP BY 1)"
_SYNC = 915148800.0 + 2 * 31536000
_DIFF = f"""(SELECT p.track_id, p.play_count AS pc_count, u.play_count AS usb_count, CASE WHEN p.play_count = u.play_count THEN 'equal'
    WHEN p.last_played > {_SYNC} AND u.last_played > {_SYNC} THEN 'conflict' WHEN p.last_played > {_SYNC} THEN 'pc' ELSE 'usb' END AS source, p.last_played AS plp, u.last_played AS ulp
    FROM {_SIDE.format("O")} p JOIN {_SIDE.format("F")} u USING (track_id))"""


def _sides(spark, d):
    plays = table(spark, d, "lineitem").groupBy("l_linestatus", F.col("l_partkey").alias("track_id")).agg(F.count("*").alias("play_count"), F.max("l_shipdate").cast("timestamp").cast("double").alias("last_played"))
    return J.reconcile(plays.filter("l_linestatus = 'O'"), plays.filter("l_linestatus = 'F'"), _SYNC)


@query("playcount_diff", f"SELECT track_id, source, pc_count, usb_count, CASE source WHEN 'equal' THEN pc_count WHEN 'pc' THEN pc_count WHEN 'usb' THEN usb_count END AS resolved_count, CASE source WHEN 'equal' THEN greatest(plp, ulp) WHEN 'pc' THEN plp WHEN 'usb' THEN ulp END AS resolved_last_played FROM {_DIFF}")
def playcount_diff(spark, d):
    return _sides(spark, d).select("track_id", "source", "pc_count", "usb_count", "resolved_count", "resolved_last_played")


for _name, _sql in (("take_max", "greatest(pc_count, usb_count)"), ("take_pc", "pc_count"), ("take_usb", "usb_count"), ("sum", "pc_count + usb_count")):

    @query(f"playcount_resolve_{_name}", f"SELECT track_id, {_sql} AS count FROM {_DIFF} WHERE source = 'conflict'")
    def _resolve(spark, d, name=_name):
        return _sides(spark, d).filter("source = 'conflict'").select("track_id", J.resolved(name).alias("count"))


_HASH = "md5(coalesce(p_name, '') || '|' || coalesce(p_brand, '') || '|' || {})"
_OLD, _NEW = f"(SELECT p_partkey AS id, p_name AS title, p_brand AS artist, {_HASH.format('p_size')} AS hash FROM part WHERE p_partkey % 3 <> 0)", f"(SELECT p_partkey AS id, p_name AS title, p_brand AS artist, {_HASH.format('(p_size + p_partkey % 2)')} AS hash FROM part WHERE p_partkey % 5 <> 0)"


def _hashed(spark, d, rest, size):
    rows = table(spark, d, "part").filter(rest).withColumn("size", F.expr(size))
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), J.row_hash("p_name", "p_brand", "size").alias("hash"))


_old = lambda spark, d: _hashed(spark, d, "p_partkey % 3 <> 0", "p_size")
_new = lambda spark, d: _hashed(spark, d, "p_partkey % 5 <> 0", "p_size + p_partkey % 2")


@query("usb_scan_hash", f"SELECT id, title, artist, hash FROM {_NEW}")
def usb_scan_hash(spark, d):
    return _new(spark, d)


@query("diff_added", f"SELECT DISTINCT hash FROM {_NEW} WHERE hash NOT IN (SELECT hash FROM {_OLD})")
def diff_added(spark, d):
    return J.added(_new(spark, d), _old(spark, d)).select("hash")


@query("diff_removed", f"SELECT DISTINCT hash FROM {_OLD} WHERE hash NOT IN (SELECT hash FROM {_NEW})")
def diff_removed(spark, d):
    return J.added(_old(spark, d), _new(spark, d)).select("hash")


@query("diff_updated", f"SELECT DISTINCT hash FROM {_NEW} n WHERE hash NOT IN (SELECT hash FROM {_OLD}) AND (lower(title), lower(artist)) IN (SELECT (lower(title), lower(artist)) FROM {_OLD})")
def diff_updated(spark, d):
    named = lambda df: df.withColumns({"_t": F.lower("title"), "_a": F.lower("artist")})
    old, new = _old(spark, d), _new(spark, d)
    return named(new.join(old.select("hash"), "hash", "left_anti")).join(named(old), ["_t", "_a"], "left_semi").select("hash").distinct()


@query("playlist_diff", "SELECT 'added' AS change, o_orderkey AS pid FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3') UNION ALL SELECT 'removed', o_orderkey FROM orders WHERE o_orderpriority < '3' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P'))")
def playlist_diff(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), "o_orderstatus", "o_orderpriority")
    new, old = orders.filter(F.col("o_orderstatus").isin("O", "P")), orders.filter("o_orderpriority < '3'")
    one = lambda a, b, name: a.join(b.select("pid"), "pid", "left_anti").select(F.lit(name).alias("change"), "pid")
    return one(new, old, "added").unionByName(one(old, new, "removed"))


@query("semi_tag", f"SELECT id FROM {T} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')")
def semi_tag(spark, d):
    return tracks(spark, d).select("id").join(table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("id")), "id", "left_semi")


@query("semi_playlist", f"SELECT id, title FROM {T} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 10 = 3)")
def semi_playlist(spark, d):
    return tracks(spark, d).join(entries(spark, d).filter("pid % 10 = 3").select(F.col("track_id").alias("id")), "id", "left_semi").select("id", "title")


@query("merge_by_path", "SELECT coalesce(b.k, a.k) AS path, coalesce(b.title, a.title) AS title, coalesce(b.bpm, a.bpm) AS bpm, CASE WHEN a.k IS NULL THEN 'update' WHEN b.k IS NULL THEN 'base' ELSE 'both' END AS source FROM (SELECT p_partkey AS k, p_name AS title, p_retailprice AS bpm FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN upper(p_name) END AS title, p_retailprice * 2 AS bpm FROM part WHERE p_partkey % 2 = 0) b ON a.k = b.k")
def merge_by_path(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("bpm"), "p_size")
    base = part.filter("path % 3 <> 0").drop("p_size")
    update = part.filter("path % 2 = 0").select("path", F.when(F.col("p_size") > 25, F.upper("title")).alias("title"), (F.col("bpm") * 2).alias("bpm"))
    return J.merged_by(base, update, "path").withColumnRenamed("_source", "source")


@query("new_files_anti", "SELECT p.page_id AS id, url FROM pages p WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def new_files_anti(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return pages.join(pages.filter("id % 3 = 0").select("url"), "url", "left_anti").select("id", "url")


@query("subset_check", "SELECT count(*)::BIGINT AS absent, count(*) = 0 AS verified FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def subset_check(spark, d):
    absent = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(table(spark, d, "customer"), "c_custkey", "left_anti").agg(F.count("*").alias("absent"))
    return absent.withColumn("verified", F.col("absent") == 0)


_BEATS = "(SELECT user_id, event_id, epoch(ts)::DOUBLE AS t FROM events WHERE event_type {})"


@query("asof_nearest", f"SELECT user_id, event_id, t, mark AS nearest, gap FROM (SELECT l.*, r.t AS mark, abs(r.t - l.t) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t DESC) AS n FROM {_BEATS.format(chr(61) + chr(39) + 'click' + chr(39))} l LEFT JOIN {_BEATS.format(chr(61) + chr(39) + 'view' + chr(39))} r USING (user_id)) WHERE n = 1")
def asof_nearest(spark, d):
    beats = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), "event_type")
    return J.nearest(beats.filter("event_type = 'click'").drop("event_type"), beats.filter("event_type = 'view'"), "user_id", "t", "t")


@query("asof_error_stats", f"SELECT user_id, count(*)::BIGINT AS n, round(max(gap), 3) AS worst FROM (SELECT l.user_id, l.event_id, min(abs(r.t - l.t)) AS gap FROM {_BEATS.format(chr(61) + chr(39) + 'click' + chr(39))} l JOIN {_BEATS.format(chr(61) + chr(39) + 'view' + chr(39))} r USING (user_id) GROUP BY ALL) GROUP BY 1")
def asof_error_stats(spark, d):
    return asof_nearest(spark, d).filter("gap is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("gap"), 3).alias("worst"))


@query("snap_nearest", "SELECT e.event_id, m.value AS snapped FROM (SELECT * FROM events WHERE event_type = 'purchase') e JOIN (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(value - v), value) AS n FROM (SELECT x.event_id AS a, x.value AS v, y.value FROM events x JOIN events y ON x.user_id = y.user_id AND y.event_type = 'signup' WHERE x.event_type = 'purchase')) m ON m.a = e.event_id AND n = 1")
def snap_nearest(spark, d):
    events = table(spark, d, "events")
    marks = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.collect_list("value").alias("marks"))
    return events.filter("event_type = 'purchase'").join(marks, "user_id").select("event_id", J.snap(F.col("value"), F.col("marks")).alias("snapped"))


_TITLES = "(SELECT min(p_partkey) AS mid, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS k FROM part GROUP BY 2)"


@query("fuzzy_exact", f"SELECT page_id AS id, mid AS match_id, 1.0::DOUBLE AS score FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Red Widget!' WHEN 1 THEN 'small-ring' ELSE 'Blue Bolt' END AS q FROM pages) JOIN {_TITLES} ON k = lower(regexp_replace(q, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))")
def fuzzy_exact(spark, d):
    from waxwing.functions.text import normalize_title

    asked = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, "Red Widget!").when(F.col("page_id") % 3 == 1, "small-ring").otherwise("Blue Bolt").alias("q"))
    known = tracks(spark, d).groupBy(normalize_title(F.col("title"), fold=False).alias("k")).agg(F.min("id").alias("match_id"))
    return asked.join(known, normalize_title(F.col("q"), fold=False) == F.col("k")).select("id", "match_id", F.lit(1.0).alias("score"))


@query("match_preview", "SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'dead' WHEN c_acctbal > 5000 THEN 'matched' ELSE 'unmatched' END AS status, c_name AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey")
def match_preview(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 7 <> 0")
    status = F.when(F.col("c_custkey").isNull(), "dead").when(F.col("c_acctbal") > 5000, "matched").otherwise("unmatched")
    return table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("c_name").alias("title"))


@query("sync_summary", "SELECT count(*) FILTER (WHERE c_custkey IS NOT NULL)::BIGINT AS matched, count(*) FILTER (WHERE c_custkey IS NULL)::BIGINT AS dead, count(*) FILTER (WHERE c_custkey IS NOT NULL AND o_orderstatus = 'F')::BIGINT AS already, count(*) FILTER (WHERE c_custkey IS NOT NULL AND o_orderstatus <> 'F')::BIGINT AS added FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey")
def sync_summary(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 7 <> 0").select("c_custkey")
    joined = table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    hit, own = F.col("c_custkey").isNotNull(), F.col("o_orderstatus") == "F"
    return joined.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("dead"), F.count_if(hit & own).alias("already"), F.count_if(hit & ~own).alias("added"))


@query("duplicate_enrich", f"SELECT p.page_id AS id, t.title, t.bitrate FROM pages p LEFT JOIN (SELECT path, min_by(title, id) AS title, min_by(bitrate, id) AS bitrate FROM {T} GROUP BY 1) t ON t.path = '/music/Brand#' || (page_id % 25) || '/red widget.mp3'")
def duplicate_enrich(spark, d):
    known = tracks(spark, d).groupBy("path").agg(F.min_by("title", "id").alias("title"), F.min_by("bitrate", "id").alias("bitrate"))
    asked = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("/music/Brand#"), (F.col("page_id") % 25).cast("string"), F.lit("/red widget.mp3")).alias("path"))
    return asked.join(known, "path", "left").select("id", "title", "bitrate")


@query("union_sources", "SELECT 'library' AS source, p_partkey AS id, p_name AS title, NULL::DOUBLE AS balance FROM part UNION ALL SELECT 'device', s_suppkey, s_name, s_acctbal FROM supplier")
def union_sources(spark, d):
    library = table(spark, d, "part").select(F.lit("library").alias("source"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    device = table(spark, d, "supplier").select(F.lit("device").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("balance"))
    return library.unionByName(device, allowMissingColumns=True)


@query("union_tagged", "SELECT 'import' AS src, event_id AS id, ts FROM events WHERE event_type = 'click' UNION ALL SELECT 'download', event_id, ts FROM events WHERE event_type = 'view'")
def union_tagged(spark, d):
    events = table(spark, d, "events")
    one = lambda kind, name: events.filter(F.col("event_type") == kind).select(F.lit(name).alias("src"), F.col("event_id").alias("id"), "ts")
    return one("click", "import").unionByName(one("view", "download"))


@query("union_distinct", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def union_distinct(spark, d):
    own = table(spark, d, "lineitem")
    return own.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")).union(own.filter("l_linestatus = 'O'").select("l_partkey")).distinct()


@query("set_diff_tags", "SELECT id, coalesce(list_aggregate(list_sort(list_filter(w, lambda x: NOT list_contains(c, x))), 'string_agg', ','), '') AS to_add, coalesce(list_aggregate(list_sort(list_filter(c, lambda x: NOT list_contains(w, x))), 'string_agg', ','), '') AS to_remove FROM (SELECT l_partkey AS id, list(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'O') AS w0, list(DISTINCT l_returnflag) FILTER (WHERE l_linestatus = 'F') AS c0, coalesce(w0, []) AS w, coalesce(c0, []) AS c FROM lineitem GROUP BY 1)")
def set_diff_tags(spark, d):
    flags = lambda status: F.collect_set(F.when(F.col("l_linestatus") == status, F.col("l_returnflag")))
    both = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(flags("O").alias("w"), flags("F").alias("c"))
    minus = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return both.select("id", minus("w", "c").alias("to_add"), minus("c", "w").alias("to_remove"))


@query("sort_dynamic", f"SELECT id, title, row_number() OVER (ORDER BY lower(coalesce(title, '')) DESC, id) AS place FROM {T}")
def sort_dynamic(spark, d):
    return numbered_in_order(tracks(spark, d).select("id", "title"), [F.lower(F.coalesce("title", F.lit(""))).desc(), F.col("id")])


@query("history_page", "SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def history_page(spark, d):
    return table(spark, d, "events").filter("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id", "ts")


@query("history_filter", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 7 AND props ILIKE '%8%'")
def history_filter(spark, d):
    wanted = {"event_type": "error", "user_id": 7, "device": None}
    found = table(spark, d, "events")
    for column, value in wanted.items():
        if value is not None:
            found = found.filter(F.col(column) == value)
    return found.filter(F.col("props").ilike("%8%")).select("event_id")


@query("top_played", "SELECT l_partkey AS id, count(*)::BIGINT AS plays FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY plays DESC, id LIMIT 10")
def top_played(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), "id").limit(10)


@query("pick_bitrate", f"SELECT title, min(id) AS id, bitrate FROM (SELECT *, max(bitrate) OVER (PARTITION BY title) AS m FROM {T}) WHERE bitrate = m GROUP BY title, bitrate")
def pick_bitrate(spark, d):
    return J.first_per(tracks(spark, d), ["title"], [F.desc("bitrate"), "id"]).select("title", "id", "bitrate")


@query("retention_cap", "WITH e AS (SELECT event_id, event_type IN ('purchase', 'error') AS finished, ts FROM events) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY finished ORDER BY ts, event_id) AS n, (SELECT count(*) FROM e) - 8000 AS over FROM e) WHERE NOT (finished AND n <= over)")
def retention_cap(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").isin("purchase", "error").alias("finished"), "ts")
    # Only finished rows can go, the oldest first.
    ranked = numbered_in_order(rows.filter("finished"), ["ts", "event_id"], "n")
    drop = ranked.crossJoin(rows.agg((F.count("*") - 8000).alias("over"))).filter("n <= over").select("event_id")
    return rows.select("event_id").join(drop, "event_id", "left_anti")


@query("slot_cap", "SELECT p_partkey AS id FROM part ORDER BY p_partkey LIMIT 300")
def slot_cap(spark, d):
    return tracks(spark, d).select("id").orderBy("id").limit(300)


@query("reorder", "SELECT l_orderkey AS pid, l_linenumber AS pos, l_partkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN f THEN 1.5 ELSE n END, l_linenumber, l_partkey, l_suppkey) - 1 AS new_pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1 AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::DOUBLE AS n FROM lineitem)")
def reorder(spark, d):
    """The last entry of each playlist moves to the second place."""
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    # The entry after which none follows is the last, so one sort is enough: the first stays, the last follows it, and what was behind moves on.
    n, last = F.row_number().over(own), F.lead(F.lit(True)).over(own).isNull()
    rows = table(spark, d, "lineitem").withColumns({"n": n, "last": last})
    place = F.when(F.col("n") == 1, 0).when(F.col("last"), 1).otherwise(F.col("n"))
    return rows.select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("track_id"), place.cast("long").alias("new_pos"))


@query("sample_n", "SELECT p_partkey AS id, p_name AS title FROM part ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 100")
def sample_n(spark, d):
    """A sample of 100 that depends on the ids and a seed only."""
    return tracks(spark, d).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":7"))), "id").limit(100).select("id", "title")


@query("scope_dedup", "SELECT id, min(pos) AS pos FROM (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) GROUP BY 1")
def scope_dedup(spark, d):
    wanted = entries(spark, d).select(F.col("track_id").alias("id"), (F.col("pid") * 10 + F.col("pos")).alias("pos"))
    return J.first_per(wanted, ["id"], ["pos"])
