"""Catalogues of two kinds through one view."""

from __future__ import annotations

import pytest

from tests.conftest import DATA
from tests.test_operators import XML
from waxwing.sources import library


def test_xml_as_a_library(spark, tmp_path):
    (tmp_path / "in.xml").write_text(XML)
    held = library.opened(spark, "xml", f"file://{tmp_path}/in.xml")
    (one,) = held.track("1").collect()
    assert (one.title, one.artist, one.bpm, one.rating, one.play_count, one.duration_ms, one.path) == ("One & Only", "Ann", 128.5, 0, 5, 5900, "/m/a b.mp3")
    assert [(r.pos, r.track_id) for r in held.track_ids("ROOT_0_F_0_P").collect()] == [(0, "2"), (1, "1")]
    assert [(r.name, r.pos, r.title) for r in held.contents().orderBy("pos").collect()] == [("P", 0, "Two"), ("P", 1, "One & Only")]
    assert held.track("99").collect() == held.track_ids("99").collect() == []


def test_tables_as_a_library(spark):
    held = library.opened(spark, "tables", f"{DATA}/sf0.001")
    assert held.tracks.columns == list(library.TRACK) and held.track("3").count() == 1
    first = held.entries.first().pid
    assert held.track_ids(first).count() > 0
    assert library.modes() == ["tables", "xml"]
    with pytest.raises(ValueError, match="tables, xml"):
        library.opened(spark, "vinyl", "")


def test_garbage_never_fails(spark):
    rows = [("7", "124.0", "4", "200", None), ("1", "n/a", "", None, "300000"), (None, None, "5.9", "x", "y")]
    found = library.canonical(spark.createDataFrame(rows, "id string, bpm string, rating string, total_time string, duration_ms string")).collect()
    assert [(r.id, r.bpm, r.rating, r.duration_ms, r.title) for r in found] == [("7", 124.0, 4, 200000, ""), ("1", 0.0, 0, 300000, ""), ("", 0.0, 5, 0, "")]
