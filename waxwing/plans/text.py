"""Queries of the title, artist, comment and file-name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from waxwing.functions import text as X
from waxwing.plans.registry import query, table
from waxwing.sources.adapters import TITLES_SQL, titles

V = TITLES_SQL


def _projected(key, sql, /, **columns):
    @query(key, f"SELECT id, {sql} FROM {V}" if " FROM (SELECT *" not in sql else f"SELECT id, {sql} FROM {V})")
    def run(spark, d):
        return titles(spark, d).select("id", *(make().alias(alias) for alias, make in columns.items()))


_t, _a = (lambda: F.col("title")), (lambda: F.col("artist"))
_projected("clean_tag", "trim(regexp_replace(replace(replace(replace('  ' || title || '  x', '(Original Mix)', ''), '(Extended Mix)', ''), 'Original Mix', ''), '\\s+', ' ', 'g')) AS tag", tag=lambda: X.clean_tag(F.concat(F.lit("  "), _t(), F.lit("  x"))))
_projected("normalize_title", "regexp_replace(trim(lower(title)), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS plain", plain=lambda: X.normalize_title(_t()))
_stem = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '(?i)\\s+(feat\\.?|ft\\.?|featuring|with)\\s+.*$', ''), '(\\s*[(\\[][^()\\[\\]]*[)\\]]\\s*)+$', ''), '\\s[-–—]\\s.*$', ''), '\\s+', ' ', 'g')))"  # noqa: RUF001
_projected("title_stem", f"{_stem} AS stem", stem=lambda: X.title_stem(_t()))
_label = "CASE id % 8 WHEN 0 THEN 'original' WHEN 1 THEN 'remix' WHEN 2 THEN 'edit' WHEN 3 THEN 'extended' WHEN 5 THEN 'remix' WHEN 6 THEN 'edit' END"
_remixer = "CASE WHEN id % 8 IN (1, 5) THEN artist WHEN id % 8 = 2 THEN 'Radio' END"  # the remixer shape comes before the plain one
_modifiers = "CASE id % 8 WHEN 0 THEN 'Original' WHEN 1 THEN 'Remix' WHEN 2 THEN 'Edit' WHEN 3 THEN 'Extended' WHEN 5 THEN 'Extended,Remix' WHEN 6 THEN '2019' END"
_tag = lambda: X.version_tag(_t())
_projected("version_tag", f"{_label} AS label, {_remixer} AS remixer, {_modifiers} AS modifiers", label=lambda: _tag()["label"], remixer=lambda: _tag()["remixer"], modifiers=lambda: F.array_join(_tag()["modifiers"], ","))
_projected("classify_variant", f"coalesce({_label}, 'original') AS label, {_stem} AS root, {_remixer} AS remixer, regexp_replace(trim(lower(artist)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS primary_artist", label=lambda: F.coalesce(_tag()["label"], F.lit("original")), root=lambda: X.title_stem(_t()), remixer=lambda: _tag()["remixer"], primary_artist=lambda: X.normalize_title(_a()))
_projected("rename_template", "regexp_replace(artist || ' - ' || title || ' ' || round_even(id / 4.0, 0)::BIGINT, '[<>:\"/\\\\|?*]', '', 'g') AS name", name=lambda: X.rename("%Artist% - %Title% %BPM%%Key%", _a(), _t(), F.col("id") / 4.0, F.lit("")))
_projected("comment_set", "'new' AS comment", comment=lambda: X.changed_comment("set", _t(), put="new"))
_projected("comment_append", "CASE WHEN contains(title, 'Mix') THEN title ELSE title || ' Mix' END AS comment", comment=lambda: X.changed_comment("append", _t(), put="Mix"))
_projected("comment_remove", "trim(replace(title, 'Mix', '')) AS comment", comment=lambda: X.changed_comment("remove", _t(), find="Mix"))
_projected("comment_replace", "trim(replace(title, 'Mix', 'Cut')) AS comment", comment=lambda: X.changed_comment("replace", _t(), find="Mix", put="Cut"))
_projected("comment_unknown", "title AS comment", comment=lambda: X.changed_comment("swap", _t(), find="Mix"))
_dirty = "'. ' || replace(title, ' ', '/') || '?' || chr(7) || artist || ' .'"
_dirty_c = lambda: F.concat(F.lit(". "), F.replace(_t(), F.lit(" "), F.lit("/")), F.lit("?"), F.lit("\x07"), _a(), F.lit(" ."))
_projected("clean_filename", f"CASE WHEN id % 9 = 0 THEN '_NUL' ELSE regexp_replace(replace(replace(replace({_dirty}, '/', '_'), '?', '_'), chr(7), ''), '^[ .]+|[ .]+$', '', 'g') END AS name", name=lambda: X.clean_filename(F.when(F.col("id") % 9 == 0, "nul..".upper()).otherwise(_dirty_c())))
_projected("dest_path", "CASE WHEN length(p) <= 60 THEN p WHEN length(title) > length(p) - 60 THEN '/usb/Contents/' || artist || '/' || trim(left(title, 40)) || '/' || left(title, length(title) - (length(p) - 60)) || '.mp3' ELSE '/usb/Contents/track_' || left(md5(title || '.mp3'), 8) || '.mp3' END AS path FROM (SELECT *, '/usb/Contents/' || artist || '/' || trim(left(title, 40)) || '/' || title || '.mp3' AS p", path=lambda: X.dest_path("/usb", _a(), _t(), F.concat(_t(), F.lit(".mp3")), 60))
_projected("xml_safe", "title || '-x' AS safe", safe=lambda: X.xml_safe(F.concat(_t(), F.lit("\x01-\x1fx"))))
_projected("hash_path", "'P' || left(upper(md5(title)), 3) || '/' || substr(upper(md5(title)), 4, 8) AS folder", folder=lambda: X.hash_path(_t()))
_projected("digests", "md5(title) AS md5, sha1(title) AS sha1, sha256(title) AS sha256", md5=lambda: F.md5(_t()), sha1=lambda: F.sha1(_t()), sha256=lambda: F.sha2(_t(), 256))
_projected("filename_parse", "CASE WHEN id % 2 = 0 THEN artist WHEN id % 8 = 3 THEN split_part(title, ' - ', 1) END AS found_artist, CASE WHEN id % 8 = 3 THEN 'Extended Mix' ELSE trim(title) END AS found_title", found_artist=lambda: _parts()["artist"], found_title=lambda: _parts()["title"])
_parts = lambda: X.filename_parts(F.concat(F.when(F.col("id") % 2 == 0, F.concat(_a(), F.lit(" - "))).otherwise(F.lit("")), _t(), F.lit(".flac")))
_projected("rating_popm", "CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 64 WHEN 3 THEN 128 WHEN 4 THEN 196 ELSE 255 END AS popm", popm=lambda: F.element_at(F.array(*map(F.lit, (0, 1, 64, 128, 196, 255))), (F.col("id") % 6 + 1).cast("int")))
_projected("path_decode", "'/music/' || artist || '/' || title || '+1.mp3' AS path", path=lambda: X.decode_path(F.concat(F.lit("file://localhost/music/"), F.replace(F.url_encode(_a()), F.lit("+"), F.lit("%20")), F.lit("/"), F.replace(F.url_encode(_t()), F.lit("+"), F.lit("%20")), F.lit("+1.mp3"))))
_projected("release_year", "CASE WHEN id % 3 = 0 THEN 1990 + (id % 30)::INTEGER END AS year", year=lambda: F.substring(F.when(F.col("id") % 3 == 0, F.concat((F.col("id") % 30 + 1990).cast("string"), F.lit("-05-01"))).otherwise(F.lit("soon")), 1, 4).try_cast("int"))
_credit = "'01. ' || artist || ' feat. DJ ' || left(title, 3) || ' & Someone Rework, Other vs. '"


@query("split_artists", f"SELECT id, artist || '|' || left(title, 3) || '|Someone|Other' AS artists FROM {V}")
def split_artists(spark, d):
    credit = F.concat(F.lit("01. "), "artist", F.lit(" feat. DJ "), F.left("title", F.lit(3)), F.lit(" & Someone Rework, Other vs. "))
    return titles(spark, d).select("id", F.array_join(X.split_artists(credit), "|").alias("artists"))


@query("normalize_artist", f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(c, '^\\d{{1,2}}[\\s.-]+', ''), '(?i)^.*(supported by|premiere:?|exclusive:?|dj\\s+)\\s*', ''), '(?i)\\s+(re-?edit|edit|r[em]+ix|rework|bootleg|flip|cut|vip)\\s*.*$', '')) AS artist FROM (SELECT id, CASE id % 3 WHEN 0 THEN '7 - ' || artist WHEN 1 THEN 'Premiere: ' || artist || ' Remix' ELSE title END AS c FROM {V})")
def normalize_artist(spark, d):
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("7 - "), "artist")).when(F.col("id") % 3 == 1, F.concat(F.lit("Premiere: "), "artist", F.lit(" Remix"))).otherwise(F.col("title"))
    return titles(spark, d).select("id", X.normalize_artist(name).alias("artist"))


@query("alias_map", f"SELECT id, CASE artist WHEN 'Brand#1' THEN 'One' WHEN 'Brand#2' THEN 'Two' ELSE artist END AS artist FROM {V}")
def alias_map(spark, d):
    names = spark.createDataFrame([("Brand#1", "One"), ("Brand#2", "Two")], "artist string, name string")
    return titles(spark, d).join(F.broadcast(names), "artist", "left").select("id", F.coalesce("name", "artist").alias("artist"))


@query("clean_titles", f"SELECT id, title AS title, CASE id % 4 WHEN 0 THEN title WHEN 1 THEN title WHEN 2 THEN 'someone - ' || title ELSE title END AS cleaned FROM {V} WHERE id % 8 <> 3")
def clean_titles(spark, d):
    shown = F.when(F.col("id") % 4 == 0, F.concat(F.upper("artist"), F.lit(" - "), "title")).when(F.col("id") % 4 == 1, F.concat("title", F.lit(" | "), F.col("artist"))).when(F.col("id") % 4 == 2, F.concat(F.lit("someone - "), "title")).otherwise(F.col("title"))
    return titles(spark, d).filter("id % 8 <> 3").select("id", "title", X.clean_title(shown, F.col("artist")).alias("cleaned"))


_SHAPES = "CASE id % 7 WHEN 0 THEN title || ' (' || artist || ')' WHEN 1 THEN title || ' ft. X' WHEN 2 THEN '03 - ' || title WHEN 3 THEN 'A &amp; ' || title WHEN 4 THEN '“' || title || '”' WHEN 5 THEN artist || ' - ' || title ELSE title || ' [ABC123]' END"
_PLAIN = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS artist, p_brand AS brand, p_name AS title FROM part)"
_RULES = {1: ("id % 7 = 0", "brand", "title"), 2: ("id % 7 = 1", "NULL::VARCHAR", "title || ' ft. X'"), 4: ("id % 7 = 2", "NULL::VARCHAR", "title"), 5: ("id % 7 = 3", "NULL::VARCHAR", "'A & ' || title"), 6: ("id % 7 = 4", "NULL::VARCHAR", "'\"' || title || '\"'"), 7: ("id % 7 = 5", "NULL::VARCHAR", "title"), 8: ("id % 7 = 6", "NULL::VARCHAR", "title")}


def _malformed(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    shaped = part.withColumn("title", F.expr(_SHAPES)).withColumn("artist", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("artist")))
    return shaped.select("id", F.explode(X.metadata_fixes(F.col("artist"), F.col("title"))).alias("fix")).select("id", "fix.rule_id", "fix.confidence", F.col("fix.artist").alias("new_artist"), F.col("fix.title").alias("new_title"))


_SURE = {1: 0.9, 2: 0.5, 4: 0.95, 5: 0.98, 6: 0.98, 7: 0.9, 8: 0.85}
_rule_sql = lambda n: f"SELECT id, {n} AS rule_id, {_SURE[n]}::DOUBLE AS confidence, {_RULES[n][1]} AS new_artist, {_RULES[n][2]} AS new_title FROM {_PLAIN} WHERE {_RULES[n][0]}"
query("fix_scan", " UNION ALL ".join(map(_rule_sql, _RULES)))(_malformed)
for _n in _RULES:
    query(f"fix_rule{_n}", _rule_sql(_n))(lambda spark, d, n=_n: _malformed(spark, d).filter(F.col("rule_id") == n))


@query("host_suffix", "SELECT page_id AS id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) IN ('example.com', 'example.org') OR regexp_matches(lower(url), '^[a-z]+://[^/:?#]*[.](example[.]com|example[.]org)([/:?#]|$)') AS allowed FROM pages")
def host_suffix(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), X.host_allowed(F.col("url"), ["example.com", "example.org"]).alias("allowed"))


@query("path_prefixes", "SELECT DISTINCT id, list_aggregate(parts[1:n], 'string_agg', '/') AS prefix FROM (SELECT p_partkey AS id, ['music', p_brand, p_type] AS parts, unnest(range(1, 4)) AS n FROM part)")
def path_prefixes(spark, d):
    parts = F.array(F.lit("music"), "p_brand", "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("id", F.array_join(F.slice("parts", 1, F.col("n")), "/").alias("prefix")).distinct()


@query("json_unnest", "SELECT event_id AS id, (props->>'$.k')::INTEGER AS k FROM events WHERE (props->>'$.k')::INTEGER > 50")
def json_unnest(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k int")["k"].alias("k")).filter("k > 50")


@query("json_normalize", "SELECT event_id AS id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'user' || user_id) AS title FROM events WHERE event_id % 5 <> 0")
def json_normalize(spark, d):
    record = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("title"), F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username")).alias("user")))
    parsed = table(spark, d, "events").select(F.from_json(record, "id long, title string, user struct<username: string>").alias("r"))
    return parsed.filter("r.id is not null and (r.title is not null or r.user.username is not null)").select("r.id", F.coalesce("r.title", "r.user.username").alias("title"))
