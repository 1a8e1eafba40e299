"""Operators over a tree of nodes (id, name, parent_id, type, seq); roots have the parent ROOT.

Pointers to parents are doubled: after k turns each node points 2**k levels up, so a tree of any depth is walked in as many
turns as its depth has binary digits. Each turn is written. Cycles end, as a turn that finds nothing new is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxwing.operators.staging import folder, staged

ROOT = "ROOT"


def _reached(first: DataFrame, pointers: DataFrame, of: str, upwards: bool) -> DataFrame:
    """``first`` (of, id, level) and all that pointers (id, up) lead to, up or down, each id once for each ``of`` at its least level."""
    path, turn = folder(first.sparkSession), 0
    found = staged(first, f"{path}/found0")
    jump = staged(pointers.dropna().distinct(), f"{path}/jump0")
    while True:
        here, there = ("id", "up") if upwards else ("up", "id")
        steps = jump.select(F.col(here).alias("id"), F.col(there).alias("next"))
        # What was found lies less than 2**turn levels away, so this finds what lies below twice that.
        more = found.join(steps, "id").groupBy(of, F.col("next").alias("id")).agg((F.min("level") + (1 << turn)).alias("level"))
        more = staged(more.join(found, [of, "id"], "left_anti"), f"{path}/found{turn + 1}")
        if more.isEmpty():
            return found
        found, turn = found.unionByName(more), turn + 1
        jump = staged(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")).distinct(), f"{path}/jump{turn}")


def descendants(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(top, id, level) for each id of ``start`` and all below it; a node counts once for a top."""
    first = start.select(F.col("id").alias("top"), "id").distinct().withColumn("level", F.lit(0))
    return _reached(first, nodes.select("id", F.col("parent_id").alias("up")), "top", False)


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(of, id, level) for each id of ``start`` and all above it."""
    first = start.select(F.col("id").alias("of"), "id").distinct().withColumn("level", F.lit(0))
    return _reached(first, nodes.select("id", F.col("parent_id").alias("up")).filter(F.col("up") != ROOT), "of", True)


def paths(nodes: DataFrame, key: str = "name") -> DataFrame:
    """(id, depth, path) of each node that hangs on a root; orphans go. The path joins the keys from the root down."""
    out, turn = folder(nodes.sparkSession), 0
    now = nodes.select("id", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), F.concat_ws("/", F.col(key).cast("string")).alias("path")).dropDuplicates(["id"])
    open_, found = staged(now, f"{out}/open0"), None
    while True:
        done = open_.filter(F.col("up") == ROOT)
        if done.isEmpty():
            # A tree has nodes at all depths down to its deepest: the rest are orphans or cycles.
            return found.select("id", "depth", "path") if found is not None else done.select("id", "depth", "path")
        found = done if found is None else found.unionByName(done)
        above = found.unionByName(open_.filter(F.col("up") != ROOT)).select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("path").alias("before"))
        longer = open_.filter(F.col("up") != ROOT).join(above, "up").select("id", F.col("far").alias("up"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat_ws("/", "before", "path").alias("path"))
        turn += 1
        open_ = staged(longer, f"{out}/open{turn}")


def tracks_below(nodes: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """Different track ids in the folder's playlists at any depth; an unknown folder has none."""
    own = descendants(nodes, nodes.filter(F.col("id") == folder)).select("id")
    return entries.join(own, entries["pid"] == own["id"], "left_semi").select("track_id").distinct()


def without_subtree(nodes: DataFrame, top: str) -> DataFrame:
    """The nodes without one and all below it."""
    return nodes.join(descendants(nodes, nodes.filter(F.col("id") == top)).select("id"), "id", "left_anti")


def allowed_moves(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (id, new_parent) with ``allowed``: whether the new parent is neither the node nor below it."""
    above = ancestors(nodes, moves.select(F.col("new_parent").alias("id")))
    loops = above.select(F.col("of").alias("new_parent"), "id").withColumn("_loop", F.lit(True))
    return moves.join(loops, ["id", "new_parent"], "left").select("id", "new_parent", F.col("_loop").isNull().alias("allowed"))


def next_seq(nodes: DataFrame) -> DataFrame:
    """(parent_id, next): the number after a parent's last child, 0 for one without children."""
    last = nodes.groupBy(F.col("parent_id").alias("id")).agg(F.max("seq").alias("last"))
    return nodes.select("id").join(last, "id", "left").select(F.col("id").alias("parent_id"), (F.coalesce("last", F.lit(-1)) + 1).alias("next"))
