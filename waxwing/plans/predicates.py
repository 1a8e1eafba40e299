"""Queries of the predicate languages, scopes and library filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from waxwing.operators import predicates as P
from waxwing.plans.registry import query, table
from waxwing.sources.adapters import TRACKS_SQL, entries, tracks

T = TRACKS_SQL
NOW = 946684800.0  # 2000-01-01, the "now" of the dated queries


def _rule(field, operator, left, right=None, unit="0"):
    return {"Field": field, "Operator": operator, "ValueLeft": left, "ValueRight": right, "ValueUnit": unit}


def _smart(name, criteria, where):
    @query(name, f"SELECT id, title, bpm, rating FROM {T} WHERE {where}")
    def run(spark, d):
        return tracks(spark, d).filter(P.smart(criteria, now=NOW)).select("id", "title", "bpm", "rating")


_of = lambda *rules, op="all": {"LogicalOperator": op, "conditions": list(rules)}
_smart("smart_all", _of(_rule("8", "0", "92", "97"), _rule("7", "3", "2"), _rule("1", "5", "RING")), "bpm BETWEEN 92 AND 97 AND rating > 2 AND contains(lower(title), 'ring')")
_smart("smart_any", _of(_rule("8", "3", "99"), _rule("1", "7", "red"), op="any"), "bpm > 99 OR starts_with(lower(title), 'red')")
_smart("smart_empty", {}, "true")
_smart("smart_unknown_field", _of(_rule("99", "1", "x")), "false")
_smart("smart_bad_number", _of(_rule("7", "2", "n/a")), "false")
_smart("smart_numeric_range", _of(_rule("7", "0", "2", "4")), "rating BETWEEN 2 AND 4")
_smart("smart_numeric_eq", _of(_rule("7", "1", "3")), "rating = 3")
_smart("smart_numeric_ne", _of(_rule("7", "2", "3")), "rating <> 3")
_smart("smart_numeric_gt", _of(_rule("8", "3", "95.5")), "bpm > 95.5")
_smart("smart_numeric_lt", _of(_rule("11", "4", "120")), "bitrate < 120")
_smart("smart_string_eq", _of(_rule("2", "1", "brand#7")), "lower(artist) = 'brand#7'")
_smart("smart_string_ne", _of(_rule("4", "2", "promo")), "lower(genre) <> 'promo'")
_smart("smart_string_contains", _of(_rule("1", "5", "Widget")), "contains(lower(title), 'widget')")
_smart("smart_string_not_contains", _of(_rule("1", "6", "widget")), "NOT contains(lower(title), 'widget')")
_smart("smart_string_starts", _of(_rule("2", "7", "BRAND#1")), "starts_with(lower(artist), 'brand#1')")
_smart("smart_string_ends", _of(_rule("1", "8", "bolt")), "ends_with(lower(title), 'bolt')")


def _dated(name, rule, where):
    """Order dates as text in one of the three formats, or one that is none of them."""
    text = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END"
    sql = f"SELECT o_orderkey AS id, {text} AS stock_date FROM orders WHERE o_orderkey % 4 <> 3 AND ({where.format(t='epoch(date_trunc(' + chr(39) + 'day' + chr(39) + ', o_orderdate))')})"

    @query(name, sql)
    def run(spark, d):
        forms = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        forms = forms.when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
        dated = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), forms.alias("stock_date"))
        return dated.filter(P.smart(_of(rule), now=NOW))


_dated("smart_date_newer", _rule("10", "3", "26", unit="2"), f"{{t}} >= {NOW} - 26 * 7 * 86400.0")
_dated("smart_date_older", _rule("10", "4", "40", unit="3"), f"{{t}} < {NOW} - 40 * 30 * 86400.0")
_dated("smart_date_range", _rule("10", "0", "100", "400", unit="1"), f"{{t}} BETWEEN {NOW} - 400 * 86400.0 AND {NOW} - 100 * 86400.0")


@query(
    "date_multi_format",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE epoch(o_orderdate)::DOUBLE END AS ts FROM orders",
)
def date_multi_format(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), P.epoch(text).alias("ts"))


STORED = {"title": ("title", "str"), "artist": ("artist", "str"), "genre": ("genre", "str"), "bpm": ("bpm", "float"), "rating": ("rating", "float"), "grouping": ("color_id", "float")}


def _stored(name, xml, where):
    @query(name, f"SELECT id, title, artist, bpm FROM {T} WHERE {where}")
    def run(spark, d):
        return tracks(spark, d).filter(P.stored(*P.parse_rules(xml), STORED)).select("id", "title", "artist", "bpm")


_cond = lambda p, o, left, right="": f'<CONDITION PropertyName="{p}" Operator="{o}" ValueLeft="{left}" ValueRight="{right}"/>'
_list = lambda op, *c: f'<NODE LogicalOperator="{op}">{"".join(c)}</NODE>'
_stored("rules_and", _list(1, _cond("genre", 8, "Promo"), _cond("rating", 6, "2")), "lower(genre) = 'promo' AND rating > 2")
_stored("rules_or", _list(2, _cond("title", 1, "BLUE"), _cond("grouping", 3, "4")), "contains(lower(title), 'blue') OR abs(color_id - 4) < 0.5")
_stored("rules_numeric_tol", _list(1, _cond("bpm", 3, "9120")), "abs(bpm * 100 - 9120) < 0.5")
_stored("rules_numeric_not", _list(1, _cond("bpm", 4, "9120")), "abs(bpm * 100 - 9120) >= 0.5")
_stored("rules_between", _list(1, _cond("bpm", 5, "9100", "9400")), "bpm * 100 BETWEEN 9100 AND 9400")
_stored("rules_string", _list(1, _cond("artist", 4, "Brand#3"), _cond("title", 2, "ring")), "lower(artist) <> 'brand#3' AND NOT contains(lower(title), 'ring')")
_stored("rules_unknown", _list(2, _cond("tempo", 3, "1"), _cond("genre", 3, "small")), "lower(genre) = 'small'")
TAGS_SQL = "(SELECT l_partkey AS id, list_sort(list(DISTINCT (4294967295 - ascii(l_returnflag))::VARCHAR)) AS tags FROM lineitem GROUP BY 1)"


def _tags(spark, d):
    tag = (F.lit(4294967295) - F.ascii("l_returnflag")).cast("string")
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def _tagged(name, operator, negate):
    signed = (4294967295 - ord("R")) - 4294967296

    @query(name, f"SELECT id, array_to_string(tags, ',') AS tags FROM {TAGS_SQL} WHERE {negate} list_contains(tags, '{4294967295 - ord('R')}')")
    def run(spark, d):
        keep = P.stored(True, [P.Rule("myTag", operator, str(signed))], {"myTag": ("tags", "tags")})
        return _tags(spark, d).filter(keep).select("id", F.array_join("tags", ",").alias("tags"))


_tagged("tag_in", 8, "")
_tagged("tag_not_in", 9, "NOT")


def _search(name, text, where):
    @query(name, f"SELECT id, title, artist FROM {T} WHERE {where}")
    def run(spark, d):
        found = tracks(spark, d)
        return found.filter(P.search(text, found.columns)).select("id", "title", "artist")


_hay = "lower(concat_ws(' ', title, artist, genre))"
_search("search_tokens", "Genre:promo bpm:>95 ring label:", f"contains(lower(genre), 'promo') AND bpm > 95 AND contains({_hay}, 'ring')")
_search("search_bpm_range", "bpm:91.5-93", "bpm BETWEEN 91.5 AND 93")
_search("search_bpm_near", "bpm:94", "floor(bpm + 0.5) = 94")
_search("search_rating", "rating:>3", "rating > 3")
_search("search_rating_equal", "rating:2", "rating = 2")
_search("search_free", "blue #1", f"contains({_hay}, 'blue') AND contains({_hay}, '#1')")
_search("search_unknown_field", "mood:dark", f"contains({_hay}, 'mood:dark')")
_search("search_year", "year:1999", "false")


@query("search_or", f"SELECT id, title, artist FROM {T} WHERE contains(lower(title), 'green') OR contains(lower(artist), 'green') OR contains(lower(genre), 'green')")
def search_or(spark, d):
    return tracks(spark, d).filter(P.any_contains("Green", "title", "artist", "genre")).select("id", "title", "artist")


_STREAMED = "CASE id % 6 WHEN 0 THEN 'spotify:' || id WHEN 1 THEN 'tidal:' || id WHEN 2 THEN '' ELSE path END"


@query("filter_scheme", f"SELECT id, {_STREAMED} AS path FROM {T} WHERE id % 6 NOT IN (0, 1)")
def filter_scheme(spark, d):
    path = F.when(F.col("id") % 6 == 0, F.concat(F.lit("spotify:"), "id")).when(F.col("id") % 6 == 1, F.concat(F.lit("tidal:"), "id")).when(F.col("id") % 6 == 2, "").otherwise(F.col("path"))
    return tracks(spark, d).select("id", path.alias("path")).filter(P.is_local())


def _filtered(name, keep, where, columns=("id", "title", "bitrate")):
    @query(name, f"SELECT {', '.join(columns)} FROM {T} WHERE {where}")
    def run(spark, d):
        return tracks(spark, d).filter(keep()).select(*columns)


_filtered("insight_low_quality", P.low_quality, "bitrate > 0 AND bitrate < 320")
_filtered("queue_unrated", lambda: F.coalesce("rating", F.lit(0)) == 0, "coalesce(rating, 0) = 0")
_filtered("scope_path", lambda: P.under_path("\\MUSIC\\Brand#1\\"), "lower(path) = '/music/brand#1' OR starts_with(lower(path), '/music/brand#1/')", ("id", "path"))
for _kind, _where, _value in (
    ("all", "true", None),
    ("all_lossy", "regexp_matches(path, '[.](m4a|mp3|aac|ogg|opus)$')", None),
    ("all_lossless", "regexp_matches(path, '[.](aiff|aif|wav|flac|alac)$')", None),
    ("ranked", "rating > 0", None),
    ("unranked", "rating = 0", None),
    ("by_color", "color_id = 4", 4),
    ("uncolored", "color_id = 0", None),
):
    _filtered(f"scope_{_kind}", lambda k=_kind, v=_value: P.scope(k, v), _where, ("id", "path"))


@query("scope_by_file_type", f"SELECT id, path FROM {T} WHERE bitrate % 4 = 0 AND bitrate / 8 % 3 = 1")
def scope_by_file_type(spark, d):
    return tracks(spark, d).withColumn("file_type", (F.col("bitrate") / 8).cast("int") % 3).filter(P.scope("by_file_type", 1)).select("id", "path")


@query("scope_by_mytag", f"SELECT id, path FROM {T} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def scope_by_mytag(spark, d):
    tags = table(spark, d, "lineitem").select(F.col("l_partkey").alias("track_id"), F.col("l_returnflag").alias("tag_id"))
    return P.in_scope(tracks(spark, d), {"kind": "library_subset", "subset_kind": "by_mytag", "tag_id": "A"}, tags).select("id", "path")


@query("scope_dispatch", f"SELECT id, 'ids' AS scope FROM {T} WHERE id IN (3, 5, 8) UNION ALL SELECT id, 'playlist' FROM {T} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 7) UNION ALL SELECT id, 'm4a' FROM {T} WHERE ends_with(path, '.m4a')")
def scope_dispatch(spark, d):
    requests = {"ids": {"kind": "track_ids", "track_ids": ["3", 5, 8]}, "playlist": {"kind": "playlist", "playlist_id": 7}, "m4a": {"kind": "all_m4a"}}
    parts = [P.in_scope(tracks(spark, d), x, entries=entries(spark, d)).select("id", F.lit(name).alias("scope")) for name, x in requests.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("insight_missing", "SELECT c_custkey AS id FROM customer WHERE c_acctbal <= 0")
def insight_missing(spark, d):
    art = F.when(F.col("c_acctbal") > 0, F.lit("cover.jpg")).when(F.col("c_acctbal") < -500, F.lit(""))
    return table(spark, d, "customer").withColumn("artwork", art).filter(P.missing("artwork")).select(F.col("c_custkey").alias("id"))


@query("insight_lost", f"SELECT t.id, coalesce(n, 0)::BIGINT AS play_count FROM {T} t LEFT JOIN (SELECT l_partkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) p USING (id) WHERE coalesce(n, 0) <= 4")
def insight_lost(spark, d):
    plays = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    return tracks(spark, d).join(plays, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("play_count")).filter("play_count <= 4")


@query("unanalyzed", f"SELECT id FROM {T} WHERE id % 7 IN (0, 1)")
def unanalyzed(spark, d):
    bpm = F.when(F.col("id") % 7 == 0, F.lit(0.0)).when(F.col("id") % 7 > 1, F.col("bpm"))
    return tracks(spark, d).withColumn("bpm", bpm).filter(F.coalesce("bpm", F.lit(0.0)) <= 0).select("id")


@query("queue_untagged", "SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 1 OR doc_id % 5 = 2")
def queue_untagged(spark, d):
    comment = F.when(F.col("doc_id") % 5 == 1, F.lit("  ")).when(F.col("doc_id") % 5 != 2, F.col("lang"))
    return table(spark, d, "documents").withColumn("comment", comment).filter(F.trim(F.coalesce("comment", F.lit(""))) == "").select(F.col("doc_id").alias("id"))


@query(
    "criteria_round_trip",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CASE WHEN p_size % 2 = 0 THEN 'any' ELSE 'all' END END AS logic, CASE WHEN p_partkey % 11 > 0 THEN '0' END AS automatic,
  CASE WHEN p_partkey % 11 > 0 THEN '8 3 ' || p_size || ' <' || p_name || '> & "q" 0' || CASE WHEN p_size % 2 = 0 THEN '; 2 1  x 4' ELSE '' END END AS conditions, p_partkey % 11 > 0 AS same FROM part""",
)
def criteria_round_trip(spark, d):
    """Rules of stored lists from XML to structs, back to XML and to structs again; every eleventh is no XML."""
    attributes = F.concat(F.lit('Operator="3" Field="8" ValueLeft="'), F.col("p_size").cast("string"), F.lit('" ValueRight="&lt;'), F.col("p_name"), F.lit('&gt; &amp; &quot;q&quot;"'))
    even = F.col("p_size") % 2 == 0
    xml = F.concat(F.lit("<SmartList "), F.when(even, 'LogicalOperator="any" ').otherwise(""), F.lit('AutomaticUpdate="0"><CONDITION '), attributes, F.lit("/>"), F.when(even, '<CONDITION Field="2" ValueRight="x" ValueUnit="4"/>').otherwise(""), F.when(F.col("p_partkey") % 11 == 0, "<Smart").otherwise("</SmartList>"))
    read = table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.criteria(xml).alias("c"))
    read = read.withColumn("again", P.criteria(P.criteria_xml(F.col("c"))))
    shown = F.array_join(F.transform("c.conditions", lambda x: F.concat_ws(" ", x["Field"], x["Operator"], x["ValueLeft"], x["ValueRight"], x["ValueUnit"])), "; ")
    return read.select("id", F.col("c.LogicalOperator").alias("logic"), F.col("c.AutomaticUpdate").alias("automatic"), shown.alias("conditions"), F.coalesce(F.col("c") == F.col("again"), F.lit(False)).alias("same"))
