"""Registered sources, sections, projects and outcomes against plain reading."""

from __future__ import annotations

import json
import stat
import struct

import pytest
from pyspark.sql import functions as F

from waxwing.operators import outcomes
from waxwing.sources import catalog, plugins, projects, sections, sinks


def write_pages(folder):
    pages = [
        [{"id": 1, "title": "T", "user": {"username": "U"}, "duration": 5}, None, {"id": 2}, {"title": "no id"}],
        {"collection": [{"id": 3, "user": {"username": "V"}}, {"id": 4, "title": "é漢", "user": None}], "next_href": None},
        {"collection": []},
    ]
    bodies = [json.dumps(p) for p in pages] + [json.dumps([{"id": i, "title": "x" * (i % 50)} for i in range(n, n + 20)]) for n in range(100, 900, 20)]
    (folder / "good").mkdir()
    for i in range(3):
        (folder / f"good/{i}.json").write_text("\n".join(bodies[i::3]) + ("\n" if i else ""))
    return bodies


def test_a_registered_source_reads_what_the_reader_reads(spark, tmp_path):
    plugins.register(spark, plugins.SavedPages)
    plugins.register(spark, plugins.SavedPages)
    bodies = write_pages(tmp_path)
    (tmp_path / "single").mkdir()
    for i, body in enumerate(bodies):
        (tmp_path / f"single/{i}.json").write_text(body)
    wanted = sorted(tuple(r) for r in catalog.read_pages(spark, f"file://{tmp_path}/single").collect())
    assert len(wanted) == 803
    for split in (1 << 25, 1000, 37):
        found = plugins.scan(spark, "saved_pages", path=f"{tmp_path}/good", split=str(split))
        assert sorted(tuple(r)[:4] for r in found.collect()) == wanted
        assert found.rdd.getNumPartitions() >= 3
    assert spark.read.format("saved_pages").load(f"file://{tmp_path}/good").filter("error is null").count() == 803
    assert plugins.registered() == sorted(plugins.registered()) and "saved_pages" in plugins.registered()
    with pytest.raises(plugins.NotRegistered):
        plugins.scan(spark, "unheard of")


def test_sources_that_take_a_name_replace_each_other(spark):
    class One(plugins.SavedPages):
        @classmethod
        def name(cls):
            return "mine"

    class Two(One):
        def schema(self):
            return "id int"

    plugins.register(spark, One)
    assert plugins.source("mine") is One
    plugins.register(spark, Two)
    assert plugins.source("mine") is Two and plugins.registered().count("mine") == 1
    assert spark.read.format("mine").option("path", "/tmp").load().columns == ["id"]


def test_bad_pages_give_typed_errors(spark, tmp_path):
    plugins.register(spark, plugins.SavedPages)
    lines = ["nonsense", '{"error": {"code": 429, "message": "slow down"}}', '{"error": {"code": 500}}', '{"id": 1}', '[{"id": 9, "title": "fine"}]', '[{"id": "x", "title": "t"}]', "[5]", ""]
    (tmp_path / "p.json").write_text("\n".join(lines))
    rows = plugins.scan(spark, "saved_pages", path=str(tmp_path)).collect()
    assert [r.id for r in rows if r.error is None] == [9]
    assert sorted(r.error.kind for r in rows if r.error) == ["parse", "parse", "parse", "parse", "quota", "transport"]
    assert all(str(tmp_path) in r.error.place for r in rows if r.error)
    with pytest.raises(Exception, match="ParseError"):
        plugins.scan(spark, "saved_pages", path=str(tmp_path), mode="FAILFAST").collect()
    (tmp_path / "none").mkdir()
    assert plugins.scan(spark, "saved_pages", path=f"{tmp_path}/none").collect() == []


def section(tag: bytes, body: bytes, head: int = 12) -> bytes:
    return tag + struct.pack(">II", head, 12 + len(body)) + body


def grid(times):
    return section(b"PQTZ", struct.pack(">III", 0, 0x80000, len(times)) + b"".join(struct.pack(">HHI", 1 + i % 4, 12800, t) for i, t in enumerate(times)), 24)


def tagged(*parts: bytes) -> bytes:
    body = b"".join(parts)
    return b"PMAI" + struct.pack(">II", 28, 28 + len(body)) + bytes(16) + body


def test_sections_are_read_by_offset(spark, tmp_path):
    wave = section(b"PWV5", bytes(300_000))
    files = {
        "a.DAT": tagged(section(b"PPTH", b"path"), wave, grid([969, 500]), wave),
        "b.dat": tagged(wave),
        "c.dat": b"nope",
        "d.dat": tagged(grid([1000]), section(b"PCOB", b"x"))[:-1],
        "e.dat": tagged(section(b"PQTZ", b"short"), grid([]), grid([7])),
        "f.dat": b"",
        "g.dat": tagged(grid([2000, 3000])[:-8] + bytes(8)),
        "h.ext": tagged(grid([1])),
    }
    (tmp_path / "x").mkdir()
    for name, data in files.items():
        (tmp_path / "x" / name).write_bytes(data)
    told = {r.path.rsplit("/", 1)[1]: (r.beats, r.error) for r in sections.read_beats(spark, f"file://{tmp_path}").collect()}
    assert set(told) == set(files) - {"h.ext"}
    assert told["a.DAT"] == ([0.5, 0.969], None) and told["b.dat"] == ([], None) and told["e.dat"] == ([], None)
    assert told["c.dat"] == (None, "not a tagged file") and told["f.dat"][1] == "not a tagged file"
    assert told["d.dat"][0] == [1.0] and "bytes" in told["d.dat"][1]
    assert told["g.dat"] == ([0.0, 2.0], None)
    some = sections.read_sections(spark, str(tmp_path), ["PQTZ"]).filter("path like '%a.DAT'").collect()
    assert len(some) == 1 and bytes(some[0].body) == grid([969, 500]) and some[0].bytes_read < 200
    every = sections.read_sections(spark, str(tmp_path)).filter("path like '%a.DAT'").orderBy("at").collect()
    assert [r.tag for r in every] == ["PPTH", "PWV5", "PQTZ", "PWV5"] and b"".join(bytes(r.body) for r in every) == files["a.DAT"][28:]


def test_filters_prune_sections(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(tagged(section(b"PWV5", bytes(300_000)), grid([1]), section(b"PCOB", b"c")))
    before = spark.conf.get(sections.PUSHDOWN, "false")
    spark.conf.set(sections.PUSHDOWN, "true")
    try:
        all_ = sections.read_sections(spark, str(tmp_path))
        for condition, tags in ((F.col("tag") == "PQTZ", {"PQTZ"}), (F.col("tag").isin("PQTZ", "PCOB"), {"PQTZ", "PCOB"})):
            rows = all_.filter(condition).collect()
            assert {r.tag for r in rows} == tags and max(r.bytes_read for r in rows) < 500
    finally:
        spark.conf.set(sections.PUSHDOWN, before)


NEW = """<?xml version="1.0" encoding="UTF-8"?><project><info><app>editor</app><version>6</version></info><tracks>
<track trackid="T1"><song id="S1" uuid="u-1"><title>Edited Cut</title><artist>DJ Test</artist><album>EP</album><filepath> /music/cut.wav </filepath></song>
<edit><volume><data><section start="0" end="4" vol="0.5"/><section start="4" end="8"/></data></volume><bpm><data><section start="0" end="8" bpm="128"/></data></bpm>
<prepared><hotcue><data><cue index="0" name="A" position="1.5" color="red"/></data></hotcue><memorycue><data><cue index="0" name="M" position="2.0"/></data></memorycue>
<activecensor><data><section start="1" end="2"/></data></activecensor></prepared>
<position><data><section start="0" end="16" songstart="0" songend="16"/><section start="16" end="32" songstart="0" songend="16"/></data></position></edit>
<songgrid bpm="128.0" length="4"><orggrid><data><beat index="0" bpm="128.0" position="0.0"/><beat index="1" bpm="128.0" position="0.46875"/></data></orggrid></songgrid></track>
<track trackid="T2"><song id="S9"><title>Two</title></song><edit/></track><track trackid="T3"/></tracks></project>"""
OLD = """<?xml version="1.0"?><project><tracks><track trackid="L1"><song id="S2"><title>Legacy</title><data><filepath>/old/legacy.mp3</filepath></data><edit/>
<position><section start="0" end="8" songstart="0" songend="8"/></position></song></track></tracks></project>"""
BAD = NEW.replace('end="4" vol="0.5"', 'end="four" vol="0.5"').replace('position="0.46875"', 'position="?"')


def test_projects(spark, tmp_path):
    texts = {"new": NEW, "old": OLD, "bad": BAD, "broken": "<project><tracks><track", "bare": "<project/>"}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / "sub" / f"{name}.rbep").write_text(text)
    (tmp_path / "other.xml").write_text(NEW)
    rows = {(r.path.rsplit("/", 1)[1][:-5], r.track_id): r for r in projects.read_projects(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {("new", "T1"), ("new", "T2"), ("old", "L1"), ("bad", "T1"), ("bad", "T2"), ("broken", None), ("bare", None)}
    r = rows["new", "T1"]
    assert (r.app, r.version, r.song_id, r.uuid, r.title, r.artist, r.album, r.file_path) == ("editor", "6", "S1", "u-1", "Edited Cut", "DJ Test", "EP", "/music/cut.wav")
    plain = lambda xs: [tuple(x) for x in xs]
    assert plain(r.volume) == [(0.0, 4.0, 0.5), (4.0, 8.0, 1.0)] and plain(r.bpm_map) == [(0.0, 8.0, 128.0)] and plain(r.active_censors) == [(1.0, 2.0)]
    assert plain(r.hotcues) == [(0, "A", 1.5, "red")] and plain(r.memory_cues) == [(0, "M", 2.0)]
    assert plain(r.positions) == [(0.0, 16.0, 0.0, 16.0), (16.0, 32.0, 0.0, 16.0)] and r.end_beats == 32.0
    assert plain(r.beat_grid) == [(0, 128.0, 0.0), (1, 128.0, 0.46875)] and (r.bpm, r.grid_length, r.errors) == (128.0, 4, {})
    r = rows["new", "T2"]
    assert r.volume == r.positions == r.beat_grid == [] and r.bpm is None and r.end_beats is None and r.file_path == ""
    r = rows["old", "L1"]
    assert (r.version, r.file_path, r.title, plain(r.positions), r.end_beats) == ("1", "/old/legacy.mp3", "Legacy", [(0.0, 8.0, 0.0, 8.0)], 8.0)
    r = rows["bad", "T1"]
    assert plain(r.volume) == [(4.0, 8.0, 1.0)] and plain(r.beat_grid) == [(0, 128.0, 0.0)] and plain(r.bpm_map) == [(0.0, 8.0, 128.0)]
    assert r.errors == {"volume": "end=four", "beat_grid": "position=?"}
    assert rows["broken", None].errors == {"project": "no XML"} and rows["bare", None].errors == {}
    odd = projects.parsed(spark.createDataFrame([("a", ""), ("b", None), ("c", "no xml")], "path string, text string")).collect()
    assert len(odd) == 3 and all(r.track_id is None and r.errors == {"project": "no XML"} for r in odd)


def test_outcomes_of_a_plan(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "0"), (5, "-2")], "id int, text string")
    number = F.col("text").try_cast("int")
    read = outcomes.outcome(number, ("Missing", F.col("text").isNull(), F.lit("no text")), ("Bad", number.isNull(), F.col("text")))
    half = outcomes.then(read, lambda v: F.lit(10) / F.nullif(v, F.lit(0)), ("Zero", number == 0, F.lit("no number of parts")))
    seen, counts = outcomes.observed(df.select("id", half.alias("half")), "half", ["Missing", "Bad", "Zero"])
    good, bad = outcomes.parted(seen, "half")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.0), (5, -5.0)]
    assert counts.get == {"rows": 5, "good": 2, "Missing": 1, "Bad": 1, "Zero": 1}
    assert sorted(tuple(r) for r in bad.collect()) == [(2, "Bad", "x"), (3, "Missing", "no text"), (4, "Zero", "no number of parts")]


def test_an_outside_program_fails_by_kind(spark, tmp_path):
    program = tmp_path / "printer"
    program.write_text('#!/bin/sh\ncase "$1" in *slow*) sleep 5;; *bad*) echo broken >&2; exit 3;; *mute*) echo DURATION=1;; *) echo FINGERPRINT=abc; echo DURATION=2.5;; esac\n')
    program.chmod(program.stat().st_mode | stat.S_IXUSR)
    names = ["one.wav", "slow.wav", "bad.wav", "mute.wav"]
    for n in names:
        (tmp_path / n).write_text("")
    files = spark.createDataFrame([(f"{tmp_path}/{n}", i) for i, n in enumerate(names)] + [("/etc/hostname", 9), (None, 10)], "path string, n int")
    told = {r.n: r.print for r in outcomes.fingerprints(files, "path", [str(program)], [str(tmp_path)], 1.0).collect()}
    assert (told[0].value.mark, told[0].value.seconds, told[0].error) == ("abc", 2.5, None)
    assert {n: t.error.kind for n, t in told.items() if t.error} == {1: "Timeout", 2: "DecodeError", 3: "DecodeError", 9: "DecodeError", 10: "DecodeError"}
    assert told[2].error.message == "status 3: broken" and told[2].value is None
    missing = outcomes.fingerprints(files.limit(2), "path", [f"{tmp_path}/nothing"], [str(tmp_path)]).collect()
    assert {r.print.error.kind for r in missing} == {"BinaryMissing"}


def test_tracks_are_written_in_files_of_bounded_size(spark, monkeypatch, tmp_path):
    """One part with many rows makes many files, as a file of XML is read by one task."""
    monkeypatch.setattr(sinks, "RECORDS", 10)
    tracks = spark.range(95).selectExpr("id", "concat('t', id) AS title", "concat('/m/', id) AS path").coalesce(1)
    sinks.write_tracks(tracks, f"file://{tmp_path}/xml")
    sizes = [x.read_text().count("<TRACK ") for x in (tmp_path / "xml").glob("part-*")]
    assert sum(sizes) == 95 and max(sizes) <= 10
    assert sorted(int(r.id) for r in catalog.read_tracks(spark, f"file://{tmp_path}/xml").collect()) == list(range(95))
