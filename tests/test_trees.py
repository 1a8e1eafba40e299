"""Playlist trees read in splits against the reader of whole files."""

from __future__ import annotations

import random
from xml.sax.saxutils import quoteattr

import pytest

from tests.test_operators import XML
from waxwing.sources import catalog, trees


def some_tree(pick, depth=0):
    name = pick.choice(["A & B", "x > y", 'say "so"', "é漢", "", "line\tbreak", "it's", "same", "same"])
    kind = pick.choice(["folder", "folder", "folder", "list", "smart", "alone"]) if depth else "folder"
    blank = pick.choice(["", "\n", "\n    "])
    if kind == "alone":
        return f"<NODE Name={quoteattr(name)} Type='1'/>{blank}"
    if kind == "smart":
        rules = "".join(f'<CONDITION Field="{i}" ValueLeft="a &lt; b > c"/>{blank}' for i in range(pick.randrange(3)))
        inner = f'<SmartList LogicalOperator="1">{rules}</SmartList>{blank}' if rules else f'<SmartList AutomaticUpdate="0"/>{blank}'
        return f'<NODE Type="1" Name={quoteattr(name)}>{inner}</NODE>{blank}'
    if kind == "list":
        return f'<NODE Type="1" Name={quoteattr(name)}>' + "".join(f'<TRACK Key="{pick.randrange(90)}"/>{blank}' for _ in range(pick.randrange(9))) + f"</NODE>{blank}"
    inner = "".join(some_tree(pick, depth + 1) for _ in range(12 if not depth else pick.randrange(1, 7 - depth) if depth < 6 else 0))
    return f'<NODE Type="0" Name={quoteattr(name)}>{blank}{inner}</NODE>{blank}'


def whole(pick):
    tracks = "".join(f'<TRACK TrackID="{i}" Name="t > {i}"><TEMPO Inizio="0.1" Bpm="120"/></TRACK>\n' for i in range(40))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0">\n<COLLECTION Entries="40">{tracks}</COLLECTION>\n<PLAYLISTS>\n{some_tree(pick)}<NODE Name="second root"><NODE Name="of no tree"/></NODE></PLAYLISTS>\n</DJ_PLAYLISTS>\n'


def small(rows):
    return sorted((r.id, r.name, r.parent_id, r.type, r.seq, tuple(r.track_keys), r.rules) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_file_in_splits_equals_the_whole(spark, tmp_path, seed):
    pick = random.Random(seed)
    text = max((whole(pick) for _ in range(30)), key=len)
    (tmp_path / "tree.xml").write_text(text, encoding="utf-8")
    path = f"file://{tmp_path}/tree.xml"
    wanted = small(catalog.read_playlists(spark, path).collect())
    assert len(wanted) > 50 and any(r[6] for r in wanted) and any(r[5] for r in wanted)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for parts in (1, 7, 50):
            spark.conf.set(name, str(-(-len(text.encode()) // parts)))
            nodes, entries = trees.read_tree(spark, path)
            assert small(trees.with_tracks(nodes, entries).collect()) == wanted
        raw = spark.read.option("lineSep", "<").text(path)
        assert raw.select("_metadata.file_block_start").distinct().count() == 50
    finally:
        spark.conf.set(name, before)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "broken.xml").write_text('<PLAYLISTS><NODE Name="ROOT"><NODE Name="lost" Type="1"/>')
    (tmp_path / "too_closed.xml").write_text('<PLAYLISTS><NODE Name="ROOT"/></NODE></NODE></PLAYLISTS>')
    (tmp_path / "none.xml").write_text("<DJ_PLAYLISTS/>")
    nodes, entries = trees.read_tree(spark, f"file://{tmp_path}")
    assert small(trees.with_tracks(nodes, entries).collect()) == small(catalog.read_playlists(spark, f"file://{tmp_path}/a.xml").collect())
    assert sorted((r.pid, r.pos, r.track_key) for r in entries.collect()) == [("ROOT_0_F_0_P", 0, "2"), ("ROOT_0_F_0_P", 1, "1")]
    (tmp_path / "comment.xml").write_text('<PLAYLISTS><!-- <NODE> --><NODE Name="ROOT"/></PLAYLISTS>')
    with pytest.raises(Exception, match="comments"):
        trees.read_tree(spark, f"file://{tmp_path}")


def test_any_cut_gives_the_same():
    """Summaries of the pieces of every cut of a list of tags, against walking it whole."""
    pick = random.Random(5)
    tags = [x for x in max((whole(pick) for _ in range(20)), key=len).split("<") if x and not x.startswith(("TEMPO", "/TRACK", "TRACK TrackID"))][:400]
    rows = trees.walked(tags, [trees.Frame(None)])
    assert len(rows) > 60
    for _ in range(60):
        cuts = sorted(pick.sample(range(1, len(tags)), pick.randrange(1, 12)))
        parts = [tags[a:b] for a, b in zip([0, *cuts], [*cuts, len(tags)], strict=True)]
        begun, _ = trees.begun_with([trees.walked(p) for p in parts])
        again = [r for p, (stack, inside) in zip(parts, begun, strict=True) for r in trees.walked(p, stack, inside)]
        assert again == rows
