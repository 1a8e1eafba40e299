"""Operators on small cases of their own: nulls, garbage, ties and edges that the driver's tables lack."""

from __future__ import annotations

import struct
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from waxwing.functions import music, text
from waxwing.operators import hierarchy, joins, predicates, sequences, similarity, staging, stores
from waxwing.sources import catalog, sinks
from waxwing.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rules_with_nulls_and_garbage(spark):
    rows = [(1, "Deep", 5, "128.5", "2024-05-01", "Brand"), (2, None, None, "n/a", "", None), (3, "deep x", 0, None, "2023/01/01", ""), (4, "", 3, "120", "soon", "B")]
    tracks = spark.createDataFrame(rows, "id int, title string, rating int, bpm string, stock_date string, artist string")
    keep = lambda *rules, op="all", now=1717200000.0: [r.id for r in tracks.filter(predicates.smart({"LogicalOperator": op, "conditions": [dict(zip(("Field", "Operator", "ValueLeft", "ValueRight", "ValueUnit"), x, strict=False)) for x in rules]}, now=now)).orderBy("id").collect()]
    assert keep() == [1, 2, 3, 4] and [r.id for r in tracks.filter(predicates.smart(None)).collect()] == [1, 2, 3, 4]
    assert keep(("8", "2", "120")) == [1] and keep(("1", "6", "deep")) == [4] and keep(("1", "5", "")) == [1, 3, 4]
    assert keep(("8", "3", "x")) == [] and keep(("77", "1", "x")) == [] and keep(("7", "0", "1", None)) == []
    assert keep(("10", "3", "60", None, "1")) == [1] and keep(("10", "4", "60", None, "1")) == [3] and keep(("10", "0", "1", "24", "3")) == [1, 3]
    assert keep(("1", "1", "deep"), ("7", "1", "3"), op="any") == [1, 4] and keep(("1", "2", "deep")) == [3, 4]
    stored = lambda rules, both=True: [r.id for r in tracks.filter(predicates.stored(both, rules, {"title": ("title", "str"), "rating": ("rating", "float")})).orderBy("id").collect()]
    assert stored([]) == [1, 2, 3, 4] and stored([predicates.Rule("rating", 4, "5")]) == [3, 4] and stored([predicates.Rule("title", 2, "deep")]) == [4]
    assert predicates.parse_rules("<broken") is None and predicates.unsigned_id("-1") == "4294967295" and predicates.unsigned_id("x") == "x"


def test_search_and_scopes(spark):
    tracks = spark.createDataFrame([(1, "Red One", "A", 127.5, 4, "/M/a.mp3"), (2, None, "Two", None, None, ""), (3, "blue", None, 90.0, 0, None)], "id int, title string, artist string, bpm double, rating int, path string")
    find = lambda q: [r.id for r in tracks.filter(predicates.search(q, tracks.columns)).orderBy("id").collect()]
    assert find("") == [1, 2, 3] and find("bpm:128") == [1] and find("bpm:80-100") == [3] and find("rating:>3 red") == [1]
    assert find("one a") == [1] and find("bpm:") == [1, 2, 3] and find("bpm:<10") == [2] and find("x:y") == []
    assert [r.id for r in tracks.filter(predicates.scope("all")).collect()] == [1]
    assert [r.id for r in tracks.filter(predicates.under_path("\\m")).collect()] == [1]
    assert [r.id for r in tracks.filter(predicates.is_local()).orderBy("id").collect()] == [1, 2, 3]


def test_reconcile(spark):
    side = lambda rows: spark.createDataFrame(rows, "track_id string, play_count int, last_played double")
    left = side([("a", 3, 10.0), ("b", 5, 90.0), ("c", 1, 90.0), ("d", 2, 1.0), ("e", None, None), ("x", 1, 1.0)])
    right = side([("a", 3, 20.0), ("b", 4, 95.0), ("c", 9, 5.0), ("d", 7, 60.0), ("e", 0, None), ("d", 1, 2.0), (None, 1, 1.0)])
    found = {r.track_id: (r.source, r.resolved_count, r.resolved_last_played) for r in joins.reconcile(left, right, 50.0).collect()}
    assert found == {"a": ("equal", 3, 20.0), "b": ("conflict", None, None), "c": ("pc", 1, 90.0), "d": ("usb", 7, 60.0), "e": ("equal", 0, 0.0)}
    assert {r.track_id: r.source for r in joins.reconcile(left, right, 0.0).collect()}["d"] == "conflict"


def test_nearest_and_snap(spark):
    left = spark.createDataFrame([("g", 1.0), ("g", 5.0), ("g", 9.0), ("h", 1.0)], "g string, t double")
    right = spark.createDataFrame([("g", 3.0), ("g", 7.0), ("g", None)], "g string, t double")
    found = {(r.g, r.t): (r.nearest, r.gap) for r in joins.nearest(left, right, "g", "t", "t").collect()}
    assert found == {("g", 1.0): (3.0, 2.0), ("g", 5.0): (7.0, 2.0), ("g", 9.0): (7.0, 2.0), ("h", 1.0): (None, None)}
    assert one(spark, joins.snap(F.lit(5), F.array(F.lit(3), F.lit(7)))) == 3
    assert one(spark, joins.snap(F.lit(5), F.array().cast("array<int>"))) is None


def test_nested_keeps_childless_parents(spark):
    parents, children = spark.range(2).select(F.col("id").alias("p")), spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (9, 1, "z")], "k long, n int, v string")
    found = {r.p: [tuple(x) for x in r.items] for r in joins.nested(parents, children, "p", "k", ["v"], ["n"], "items").collect()}
    assert found == {0: [("a",), ("b",)], 1: []}


def test_titles(spark):
    tag = lambda t: one(spark, text.version_tag(F.lit(t)))
    assert tuple(tag("X (Amy Club Mix)")) == ("extended", "Amy", ["Club", "Mix"]) and tuple(tag("X [Bob Flip]")) == ("bootleg", "Bob", ["Flip"])
    assert tuple(tag("X (Acapella)")) == ("acapella", None, ["Acapella"]) and tag("X (live)") is None and tag("") is None
    assert one(spark, text.title_stem(F.lit("Some  Song (a) [b] feat. X"))) == "some song"
    assert one(spark, text.normalize_title(F.lit(" Café—Noir! "))) == "cafenoir"
    assert one(spark, text.split_artists(F.lit("1. DJ Ann, Ben vs. Cy; "))) == ["Ann", "Ben", "Cy"] and one(spark, text.split_artists(F.lit(None))) == []
    assert one(spark, text.clean_filename(F.lit("con"))) == "_con" and one(spark, text.clean_filename(F.lit(" ..."))) == "Unknown"
    assert one(spark, text.decode_path(F.lit("file://localhost/a%20b+c.mp3"))) == "/a b+c.mp3"
    assert one(spark, text.host_allowed(F.lit("https://u@a.example.com:8/x"), ["example.com"])) and not one(spark, text.host_allowed(F.lit("https://badexample.com"), ["example.com"]))
    fixes = one(spark, text.metadata_fixes(F.lit("Amy"), F.lit("19 - Naughty Forty")))
    assert fixes == [] and [f.rule_id for f in one(spark, text.metadata_fixes(F.lit(""), F.lit("03 - Tom &amp; Co (Ann)")))] == [1, 4, 5]
    assert one(spark, text.changed_comment("append", F.lit(None).cast("string"), put="x")) == "x"


def test_music(spark):
    assert one(spark, music.camelot(F.lit(" 12b "))) == (12, "B") and one(spark, music.camelot(F.lit("13A"))) is None
    assert [one(spark, music.key_relation(F.lit(a), F.lit(b))) for a, b in (("12A", "1A"), ("8A", "8B"), ("8A", "3B"), ("8A", ""))] == ["fifth", "relative", "clash", "unknown"]
    assert one(spark, music.bpm_relation(F.lit(85.0), F.lit(170.0)))["relation"] == "double" and one(spark, music.bpm_relation(F.lit(0.0), F.lit(1.0)))["relation"] == "other"
    assert [one(spark, music.octave_correct(F.lit(x))) for x in (65.0, 220.0, 10.0, 0.0, 1000.0)] == [130.0, 110.0, 80.0, 0.0, 125.0]
    assert one(spark, music.hamming_similarity(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [1, 2, 3])))) == 0.0
    assert one(spark, music.key_code(F.lit("a"), F.lit(True))) == "8A" and one(spark, music.key_code(F.lit("H"), F.lit(True))) is None


def test_sequences(spark):
    beats = spark.createDataFrame([("a", i) for i in range(20)], "g string, t int")
    assert sequences.phrase_cues(beats, "g", ["t"], 6).collect() == []
    assert [r.label for r in sequences.phrase_cues(beats, "g", ["t"], 8).orderBy("t").collect()] == ["P1", "B1", "P2", "B2", "P3"]
    rows = spark.createDataFrame([("a", float(t), s) for t, s in ((0, False), (5, False), (6, True), (11, False), (17, False), (30, False))], "g string, t double, s boolean")
    assert [r.t for r in sequences.thinned(rows, "g", "t", "s", 10, 4).orderBy("t").collect()] == [0, 6, 17, 30]
    curve = spark.createDataFrame([("a", t, v) for t, v in ((0.0, 100.0), (4.0, 103.0), (9.0, 103.0), (10.0, 90.0), (18.0, 90.0))] + [("b", float(t), 100 + t * 0.01) for t in range(9)], "g string, t double, v double")
    found = sequences.change_points(curve, "g", "t", "v", 1.5, 8, 0.5).collect()
    assert sorted((r.g, r.t) for r in found) == [("a", 0.0), ("a", 9.0), ("a", 18.0), ("b", 0.0)]
    assert sequences.matched_within([1, 2], [1.5, 9], 1) == [(1, 1.5)]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", "A", "ROOT", 0, 0), ("b", "B", "a", 0, 0), ("c", "C", "b", 1, 0), ("x", "X", "gone", 1, 0)], "id string, name string, parent_id string, type int, seq long")
    assert {r.id: r.path for r in hierarchy.paths(nodes).collect()} == {"a": "A", "b": "A/B", "c": "A/B/C"}
    entries = spark.createDataFrame([("c", 7), ("c", 7), ("x", 8)], "pid string, track_id int")
    assert [r.track_id for r in hierarchy.tracks_below(nodes, entries, "a").collect()] == [7]
    assert hierarchy.tracks_below(nodes, entries, "nope").collect() == []
    assert {r.id for r in hierarchy.without_subtree(nodes, "b").collect()} == {"a", "x"}
    moves = spark.createDataFrame([("a", "c"), ("c", "a"), ("b", "b")], "id string, new_parent string")
    assert {(r.id, r.allowed) for r in hierarchy.allowed_moves(nodes, moves).collect()} == {("a", False), ("c", True), ("b", False)}


def test_trees_of_any_depth_and_cycles(spark):
    chain = [(f"d{i}", f"D{i}", f"d{i - 1}" if i else "ROOT", 0, 0) for i in range(20)] + [("x", "X", "y", 0, 0), ("y", "Y", "x", 0, 0)]
    nodes = spark.createDataFrame(chain, "id string, name string, parent_id string, type int, seq long")
    found = {r.id: (r.depth, r.path) for r in hierarchy.paths(nodes).collect()}
    assert found == {f"d{i}": (i, "/".join(f"D{j}" for j in range(i + 1))) for i in range(20)}
    assert {r.id for r in hierarchy.without_subtree(nodes, "d3").collect()} == {"d0", "d1", "d2", "x", "y"}
    moves = spark.createDataFrame([("d0", "d19"), ("d19", "d0"), ("x", "y")], "id string, new_parent string")
    assert {(r.id, r.allowed) for r in hierarchy.allowed_moves(nodes, moves).collect()} == {("d0", False), ("d19", True), ("x", False)}


def test_numbering_in_order(spark):
    rows = spark.range(997).selectExpr("(id * 7919) % 997 AS v", "'x' AS place_part_").repartition(5)
    assert sorted((r.v, r.place) for r in staging.numbered_in_order(rows, ["v"]).collect()) == [(i, i + 1) for i in range(997)]
    assert staging.numbered_in_order(rows.limit(0), ["v"]).collect() == []


def test_merging_playlists(spark):
    sources = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 8, 1), (2, 9, 2)], "pid int, track_id int, pos int")
    target = spark.createDataFrame([(7,)], "track_id int")
    added = joins.merged_playlist(sources, target)
    assert {(r.track_id, tuple(r["first"])) for r in added.collect()} == {(8, (1, 2)), (9, (2, 2))}
    merged = target.unionByName(added.filter("track_id = 8").select("track_id"))
    assert {(r.pid, r.complete) for r in joins.complete_sources(sources, merged).collect()} == {(1, True), (2, False)}
    with pytest.raises(ValueError, match="no track"):
        joins.restricted(sources, sources.limit(0), "track_id")


def test_stores(spark):
    log = spark.createDataFrame([(1, 1, "first", "new", None), (1, 2, "second", "done", 7), (1, 3, "third", "failed", None)], "id int, at int, title string, status string, bpm int")
    assert tuple(stores.upserted(log, "id", ["at"], ["title"], ["status"], ["bpm"]).first()) == (1, "first", "failed", 7)
    reads = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 5), ("a", 4, 5), ("b", 1, 1), ("b", 2, 2)] + [("c", i, i if i < 8 else 7) for i in range(1, 10)], "p string, t int, s int")
    assert [tuple(r) for r in stores.stable_files(reads, "p", ["t"], "s").collect()] == [("a", 4)]


def test_fuzzy_matches_equal_brute_force(spark):
    names = ["red river song", "red rivers song", "blue night", "green day dance", "the night train", "zzz"]
    asked = spark.createDataFrame([(i, "A", x) for i, x in enumerate(["Red River Song!", "red riverr songs", "blue nights", "nothing alike here", "zzz"])], "id int, artist string, title string")
    known = spark.createDataFrame([(i, "A", x) for i, x in enumerate(names)], "id int, artist string, title string")
    found = {r.id: (r.match_id, r.score) for r in similarity.fuzzy_matches(asked, known).collect()}
    wanted = {0: (0, 1.0), 4: (5, 1.0)}
    for i, t in ((1, "a - red riverr songs"), (2, "a - blue nights"), (3, "a - nothing alike here")):
        score, at = max((round(SequenceMatcher(None, t, "a - " + x).ratio(), 12), -j) for j, x in enumerate(names))
        if score >= 0.65:
            wanted[i] = (-at, round(score, 3))
    assert found == wanted


def test_fingerprint_groups(spark):
    prints = spark.createDataFrame([(1, [7 << 29] * 16), (2, [7 << 29] * 15 + [3]), (3, [1] * 16), (4, [1] * 3), (5, [7 << 29] * 16)], "id long, w array<long>")
    pairs = similarity.fingerprint_pairs(prints, "w", 4, 0.9)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 5), (2, 5)}
    assert [(r.seed, r.members) for r in similarity.duplicate_groups(pairs).collect()] == [(1, [2, 5])]
    chain = spark.createDataFrame([(i, i + 1, 0.9) for i in range(30)], "a long, b long, similarity double")
    assert sorted((r.seed, r.members) for r in similarity.duplicate_groups(chain).collect()) == [(i, [i + 1]) for i in range(0, 30, 2)]


XML = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION>
<TRACK TrackID="1" Name="One &amp; Only" Artist="Ann" AverageBpm="128.5" Rating="x" TotalTime="5.9" PlayCount="5.9" Location="file://localhost/m/a%20b.mp3">
<TEMPO Inizio="0.1" Bpm="128.5" Battito="1" Metro="4/4"/><TEMPO Inizio="0.6" Bpm="bad" Battuta="2" Metro="4/4"/><POSITION_MARK Name="Drop" Type="0" Start="3.5" Num="0" Red="1" Green="2" Blue="3"/></TRACK>
<TRACK TrackID="2" Name="Two"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="F"><NODE Type="1" Name="P"><TRACK Key="2"/><TRACK Key="1"/></NODE></NODE><NODE Name="S" Type="1"><SmartList LogicalOperator="1"/></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""


def test_collection_xml(spark, tmp_path):
    (tmp_path / "in.xml").write_text(XML)
    tracks = catalog.read_tracks(spark, f"file://{tmp_path}/in.xml")
    a, b = tracks.orderBy("id").collect()
    assert (a.title, a.bpm, a.rating, a.play_count, a.path, b.artist, b.bpm) == ("One & Only", 128.5, 0, 5, "/m/a b.mp3", "", 0.0)
    assert [(x.time, x.bpm, x.beat) for x in a.beats] == [(0.1, 128.5, 1), (0.6, None, 2)] and a.position_marks[0].end is None
    nodes = catalog.read_playlists(spark, f"file://{tmp_path}/in.xml").orderBy("id").collect()
    assert [(n.name, n.type, list(n.track_keys)) for n in nodes] == [("F", 0, []), ("P", 1, ["2", "1"]), ("S", 4, [])]
    sinks.write_tracks(tracks, f"file://{tmp_path}/out")
    again = catalog.read_tracks(spark, f"file://{tmp_path}/out").orderBy("id").collect()
    assert [(r.id, r.title, r.path, r.bpm) for r in again] == [(r.id, r.title, r.path, r.bpm) for r in (a, b)] and again[0].beats[0] == a.beats[0]
    nodes = spark.createDataFrame([("f", "F & <x>", "ROOT", 0, 0), ("p", "P", "f", 1, 1), ("q", "Q", "f", 1, 0), ("o", "O", "gone", 1, 0)], "id string, name string, parent_id string, type int, seq int")
    sinks.write_playlists(nodes, spark.createDataFrame([("p", 9, 1), ("p", 8, 0), ("o", 1, 0)], "pid string, track_id int, pos int"), f"file://{tmp_path}/tree")
    written = "".join(x.read_text() for x in sorted((tmp_path / "tree").glob("part-*"))).replace("\n", "")
    assert written == '<DJ_PLAYLISTS Version="1.0.0"><PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="F &amp; &lt;x&gt;"><NODE Type="1" Name="Q"></NODE><NODE Type="1" Name="P"><TRACK Key="8"/><TRACK Key="9"/></NODE></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>'


def test_pages_grids_and_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "title": "T", "user": {"username": "U"}, "duration": 5}, null, {"id": 2}, {"title": "no id"}]')
    (tmp_path / "b.json").write_text('{"collection": [{"id": 3, "user": {"username": "V"}}], "next_href": null}')
    assert sorted((r.id, r.title, r.artist) for r in catalog.read_pages(spark, f"file://{tmp_path}/*.json").collect()) == [(1, "T", "U"), (3, "", "V")]
    grid = b"PMAI" + struct.pack(">II", 12, 0) + b"PQTZ" + struct.pack(">IIIII", 24, 40, 0, 0, 2) + struct.pack(">HHIHHI", 1, 12800, 500, 2, 12800, 969)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.dat").write_bytes(grid)
    (tmp_path / "sub/bad.dat").write_bytes(b"nope")
    (tmp_path / "sub/y.MP3").write_bytes(b"12")
    found = {r.path.rsplit("/", 1)[1]: (r.beats, r.error) for r in catalog.read_grids(spark, f"file://{tmp_path}/sub").collect()}
    assert found["x.dat"] == ([0.5, 0.969], None) and found["bad.dat"][0] is None and found["bad.dat"][1]
    assert [(r.path.rsplit("/", 1)[1], r["size"]) for r in catalog.audio_files(spark, f"file://{tmp_path}").collect()] == [("y.MP3", 2)]


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", 0.0, "new"), ("a", 1.0, "new"), ("a", 9.0, "done"), ("b", 2.0, "new"), ("c", 60.0, "new")]
    events = spark.createDataFrame(rows, "path string, t double, status string").withColumn("ts", F.col("t").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/in/day1")
    stream = ingest.watched(spark, f"file://{tmp_path}/in", events.schema)
    bursts = ingest.run_once(ingest.debounced(stream, "path", "ts", late="1 second"), "bursts", f"file://{tmp_path}/c1")
    batch = {(r.path, r.events) for r in stores.sessions(events, "path", "ts", "2.5 seconds").collect()}
    assert {(r.path, r.events) for r in bursts.collect()} == batch - {("c", 1)}  # the last is still open
    fresh = ingest.run_once(ingest.fresh(stream, spark.createDataFrame([("b",)], "path string"), "path", "ts"), "fresh", f"file://{tmp_path}/c2")
    assert sorted(r.path for r in fresh.collect()) == ["a", "c"]
    last = ingest.run_once(ingest.lifecycle(stream, "path", "t", "status"), "last", f"file://{tmp_path}/c3", "update")
    assert {(r.key, r.status, r.changes) for r in last.collect()} == {("a", "done", 2), ("b", "new", 1), ("c", "new", 1)}


def test_entry_works_without_the_llm_folder(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "title", "bpm", "rating"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
