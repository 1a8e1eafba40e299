"""Playlist trees of large XML files: one file is read in splits, and each split is resolved from the nodes open at its start."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as tree
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waxwing.operators.staging import folder, staged

_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(r"&(#x[0-9A-Fa-f]+|#\d+|amp|lt|gt|quot|apos);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: The tag to its end: a slash if it closes, its name and its attributes, in which quotes may hold the sign that ends a tag.
_TAG = re.compile(r"""(/?)([\w:.-]+)((?:[^"'>]+|"[^"]*"|'[^']*')*)>""")


def _plain(value: str) -> str:
    def one(found: re.Match) -> str:
        name = found[1]
        return _NAMED.get(name) or chr(int(name[2:], 16) if name[1] == "x" else int(name[1:]))

    return _REFERENCE.sub(one, re.sub(r"[\t\n\r]", " ", value))


def _attributes(text: str) -> dict[str, str]:
    return {m[1]: _plain(m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(text)}


@dataclass
class Frame:
    """An open node: how many nodes, tracks and rule lists it has had so far. ``id`` is None if it is of no tree."""

    id: str | None
    children: int = 0
    tracks: int = 0
    rules: int = 0
    name: str = ""
    nth: int = 0


@dataclass
class Summary:
    """What a split does to any nodes open before it: what it adds to the innermost and, with each one it closes, to the next;
    the nodes that it leaves open; and whether a rule list is open at its end, if it says."""

    added: list[Frame] = field(default_factory=lambda: [Frame(None)])
    opened: list[Frame] = field(default_factory=list)
    inside: bool | None = None


def walked(tags: list[str], begun: list[Frame] | None = None, inside: bool = False):
    """Walk a split's tags in order. Without ``begun`` the nodes open before are not known, and it gives a Summary; with
    them, the rows (kind, id, name, parent_id, type, nth, text) of what the split holds."""
    summary, rows = Summary(), []
    stack = [Frame(**vars(f)) for f in begun] if begun is not None else summary.opened
    top = lambda: stack[-1] if stack else summary.added[-1]

    def opened(attributes: dict[str, str]) -> None:
        parent, name = top(), attributes.get("Name", "")
        nth = parent.children
        parent.children += 1
        key = None
        if begun is not None:
            key = _key(parent, nth, name, len(stack) == 1)
            if key is not None and len(stack) > 1:
                kind = attributes.get("Type", "")
                rows.append(("node", key, name, parent.id, int(kind or 0), nth, None))
        stack.append(Frame(key, name=name, nth=nth))

    for tag in tags:
        found = _TAG.match(tag)
        if tag.startswith(("!--", "![CDATA[")) and "-->" not in tag:
            raise ValueError("comments and literal text that hold tags can't be read in splits")
        closing, name, rest = (found[1], found[2], found[3]) if found else ("", "", "")
        alone = rest.rstrip().endswith("/")
        if inside and begun is not None and not (closing and name == "SmartList"):
            rows.append(("rules", top().id, None, None, 0, top().rules - 1, "<" + tag))
        elif name == "NODE" and closing:
            if stack:
                stack.pop()
            elif begun is None:
                summary.added.append(Frame(None))
        elif name == "NODE":
            opened(_attributes(rest))
            if alone:
                stack.pop()
        elif name == "TRACK" and not closing:
            key = _attributes(rest).get("Key")
            if begun is not None:
                rows.append(("track", top().id, None, None, 0, top().tracks, key))
            top().tracks += 1
        elif name == "SmartList":
            if not closing:
                top().rules += 1
                inside = not alone
            else:
                inside = False
            summary.inside = inside
            if begun is not None:
                rows.append(("rules", top().id, None, None, 0, top().rules - 1, "<" + tag))
    return summary if begun is None else [r for r in rows if r[1] is not None and r[1] != "ROOT" or r[0] == "node"]


def _key(parent: Frame, nth: int, name: str, outermost: bool) -> str | None:
    """The first node of a file is the root, and only what it holds is of the tree."""
    if outermost:
        return "ROOT" if nth == 0 else None
    return None if parent.id is None else f"{parent.id}_{nth}_{name}"


def begun_with(summaries: list[Summary]) -> tuple[list[tuple[list[Frame], bool]], bool]:
    """The open nodes, and whether a rule list is open, at the start of each split; and whether all is closed at the end."""
    stack, inside, out = [Frame(None)], False, []
    for s in summaries:
        out.append(([Frame(**vars(f)) for f in stack], inside))
        for turn, more in enumerate(s.added):
            if turn:
                if len(stack) < 2:
                    return out, False
                stack.pop()
            base = stack[-1].children
            stack[-1].children += more.children
            stack[-1].tracks += more.tracks
            stack[-1].rules += more.rules
        for depth, f in enumerate(s.opened):
            nth = base + f.nth if depth == 0 else f.nth
            stack.append(Frame(_key(stack[-1], nth, f.name, len(stack) == 1), f.children, f.tracks, f.rules, f.name, nth))
        inside = inside if s.inside is None else s.inside
    return out, len(stack) == 1 and not inside


_SUMMARY = "file string, start long, summary string"
_ROWS = "kind string, id string, name string, parent_id string, type int, nth long, text string, start long, place long"


def _summarised(frame: pd.DataFrame) -> pd.DataFrame:
    s = walked(frame.sort_values("row")["tag"].tolist())
    told = json.dumps({"added": [vars(f) for f in s.added], "opened": [vars(f) for f in s.opened], "inside": s.inside})
    return pd.DataFrame({"file": [frame["file"].iloc[0]], "start": [frame["start"].iloc[0]], "summary": [told]})


def _resolved(key: tuple, frame: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in _ROWS.split(", ")]
    if not len(frame) or not len(states):
        return pd.DataFrame([], columns=names)
    state = json.loads(states["state"].iloc[0])
    rows = walked(frame.sort_values("row")["tag"].tolist(), [Frame(**f) for f in state["stack"]], state["inside"])
    return pd.DataFrame([(*r, key[1], i) for i, r in enumerate(rows)], columns=names)


@F.pandas_udf(T.StringType())
def _rules(texts: pd.Series) -> pd.Series:
    """Rule lists as one writer writes them, with the blanks that follow."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        whole = tree.fromstring(f"<x>{text}</x>")
        return tree.tostring(whole.find("SmartList"), "unicode")

    return pd.Series([one(x) for x in texts], dtype=object)


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries) of the playlist trees of XML files: nodes (id, name, parent_id, type, seq, rules) and entries
    (pid, pos, track_key), in splits of a file as large as ``spark.sql.files.maxPartitionBytes``.

    A file is cut at its tags. Each split tells what it closes and leaves open, as much as its nesting is deep; in order of the
    splits that gives the nodes that are open at the start of each, from which it is resolved by itself. Ids are made
    of the parent's id, the place among its nodes and the name, and the root is not told. A file whose nodes don't close is left out. Files are
    UTF-8; comments and literal text that hold tags raise an error. An entry of no playlist goes.
    """
    out = folder(spark)
    raw = spark.read.option("lineSep", "<").option("recursiveFileLookup", "true").text(path)
    tags = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("tag"))
    # What the collection holds is of no tree.
    kept = ~F.col("tag").rlike(r"^(?:TEMPO|POSITION_MARK|/TRACK)\b") & ~F.col("tag").rlike(r"^TRACK\s[^>]*\bTrackID\s*=") & (F.col("tag") != "")
    tags = staged(tags.filter(kept), f"{out}/tags")
    parts = tags.groupBy("file", "start").applyInPandas(_summarised, _SUMMARY).orderBy("file", "start").collect()
    files: dict[str, list] = {}
    for part in parts:
        files.setdefault(part["file"], []).append(part)
    states = []
    for name, own in files.items():
        read = [json.loads(p["summary"]) for p in own]
        summaries = [Summary([Frame(**f) for f in s["added"]], [Frame(**f) for f in s["opened"]], s["inside"]) for s in read]
        begun, closed = begun_with(summaries)
        if closed:
            states += [(name, p["start"], json.dumps({"stack": [vars(f) for f in stack], "inside": inside})) for p, (stack, inside) in zip(own, begun, strict=True)]
    given = spark.createDataFrame(states, "file string, start long, state string")
    rows = tags.groupBy("file", "start").cogroup(given.groupBy("file", "start")).applyInPandas(_resolved, _ROWS)
    rows = staged(rows, f"{out}/rows")
    lists = rows.filter("kind = 'rules' and nth = 0").groupBy(F.col("id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts"))
    lists = lists.select("of", _rules(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("rules"))
    nodes = rows.filter("kind = 'node'").join(lists, F.col("id") == F.col("of"), "left")
    nodes = nodes.select("id", "name", "parent_id", F.when(F.col("rules").isNotNull(), 4).otherwise(F.col("type")).alias("type"), F.col("nth").cast("int").alias("seq"), "rules")
    return nodes, rows.filter("kind = 'track'").select(F.col("id").alias("pid"), F.col("nth").alias("pos"), F.col("text").alias("track_key"))


def with_tracks(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """The nodes with ``track_keys`` in order, as the reader of small files gives them: a playlist's keys in one row."""
    held = entries.groupBy(F.col("pid").alias("of")).agg(F.array_sort(F.collect_list(F.struct("pos", "track_key"))).alias("held"))
    keys = F.transform(F.coalesce("held", F.array().cast("array<struct<pos: bigint, track_key: string>>")), lambda x: x["track_key"])
    return nodes.join(held, F.col("id") == F.col("of"), "left").select("id", "name", "parent_id", "type", "seq", keys.alias("track_keys"), "rules")
