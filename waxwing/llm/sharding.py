"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import private, text_bytes

#: A region has so many racks, a rack so many shards. Shard n is in rack n // SHARDS of region n // (RACKS * SHARDS).
RACKS, SHARDS = 2, 5
SEED = "shard-1"

Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, racks: int = RACKS, per_rack: int = SHARDS, weights: dict[int, float] | None = None) -> Tree:
    """Regions of racks of (shard, weight); weights are 1 but where given."""
    weight = lambda n: float((weights or {}).get(n, 1.0))
    rack = [[(n, weight(n)) for n in range(at, min(at + per_rack, shards))] for at in range(0, shards, per_rack)]
    return [rack[at : at + racks] for at in range(0, len(rack), racks)]


def _draw(key: Column, level: str, node: Column, weight: Column, seed: str) -> Column:
    """An exponential draw of rate ``weight`` for the key at a node: the least of several wins in proportion to weight."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{level}"), node.cast("string"), key)), 1, 12), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(281474976710656.0)) / weight


def _choose(key: Column, level: str, nodes: Column, seed: str) -> Column:
    """The id of the winning one of an array of structs (id, weight)."""
    return F.array_min(F.transform(nodes, lambda x: F.struct(_draw(key, level, x["id"], x["weight"], seed).alias("draw"), x["id"].alias("id"))))["id"]


def placed(key: Column, nodes: Tree, seed: str = SEED) -> Column:
    """The shard of a string key: the region, then the rack, then the shard with the least draw.

    A node's draw depends on the key, the node and its subtree's weight only. When a weight changes, keys move only into
    the subtrees that grow or out of those that shrink; a shard that opens a new region moves keys into itself alone.
    """
    node = lambda n, w: F.struct(F.lit(n).alias("id"), F.lit(float(w)).alias("weight"))
    total = lambda rack: sum(w for _, w in rack)
    regions = F.array(*(node(i, sum(map(total, region))) for i, region in enumerate(nodes)))
    racks = F.array(*(F.array(*(node(j, total(rack)) for j, rack in enumerate(region))) for region in nodes))
    shards = F.array(*(F.array(*(F.array(*(node(n, w) for n, w in rack)) for rack in region)) for region in nodes))
    region = _choose(key, "region", regions, seed)
    rack = lambda r: _choose(F.concat_ws("/", key, r.cast("string")), "rack", F.element_at(racks, r + 1), seed)
    leaf = lambda r, k: _choose(key, "shard", F.element_at(F.element_at(shards, r + 1), k + 1), seed)
    # Each level is bound once, as the element of an array, so that no draw is made twice.
    with_rack = F.transform(F.array(region), lambda r: F.struct(r.alias("r"), rack(r).alias("k")))
    return F.element_at(F.transform(with_rack, lambda x: leaf(x["r"], x["k"])), 1).cast("int")


def sharded(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """``docs`` with _size, _crc32, _shard, _grown_shard and _slot.

    _size is the text's UTF-8 bytes and 16; a null text has no bytes and the crc32 of none. _shard follows from the id
    and the number of shards; a null id counts as the empty string. _grown_shard is the shard with one more, which takes
    rows only into itself where it opens a region (every RACKS * SHARDS shards), and else also re-deals the region's own.
    Slots number a shard's rows from 0 without gaps in the order of a hash of id and text: counts of (shard, first digits
    of the hash) are summed up, then rows are ordered within those, so no task holds a shard. Repeated rows each get a
    slot; an empty table gives no rows. Columns named like those added are replaced.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    body = text_bytes(text)
    order, cell, before = private(docs, "order", "cell", "before")
    rows = docs.withColumns({"_size": F.octet_length(body).cast("long") + 16, "_crc32": F.crc32(body), "_shard": placed(key, tree(shards), seed), "_grown_shard": placed(key, tree(shards + 1), seed)})
    rows = rows.withColumn(order, F.md5(F.concat_ws(":", key, F.col("_crc32").cast("string"))))
    rows = rows.withColumn(cell, F.substring(order, 1, 3))
    cells = rows.groupBy("_shard", cell).agg(F.count("*").alias("n"))
    cells = cells.select("_shard", cell, (F.sum("n").over(W.partitionBy("_shard").orderBy(cell)) - F.col("n")).alias(before))
    out = rows.join(cells, ["_shard", cell])
    slot = F.col(before) + F.row_number().over(W.partitionBy("_shard", cell).orderBy(order, "_size")) - 1
    return out.withColumn("_slot", slot.cast("long")).drop(order, cell, before)


def _draw_sql(level: str, node: str, key: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5('{SEED}:{level}:' || {node} || ':' || {key}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / {float(weight)}::DOUBLE"


def _least_sql(level: str, nodes: list[tuple[str, float]], key: str) -> str:
    drawn = ", ".join(f"{{'draw': {_draw_sql(level, n, key, w)}, 'id': {n}}}" for n, w in nodes)
    return f"list_sort([{drawn}])[1].id"


def sql() -> str:
    """The contract's rows for 40 shards as DuckDB SQL; 40 is four whole regions, and shard 40 a region of its own."""
    regions = [(str(i), RACKS * SHARDS) for i in range(4)]
    rack = lambda region: _least_sql("rack", [(str(j), SHARDS) for j in range(RACKS)], f"(key || '/' || {region})")
    shard = lambda region, rack: _least_sql("shard", [(f"({region} * {RACKS * SHARDS} + {rack} * {SHARDS} + {n})", 1) for n in range(SHARDS)], "key")
    return f"""
WITH crcs AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
given AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, string_split(hex(encode(coalesce(text, ''))), '') AS digits, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
data AS (SELECT doc_id, key, n, list_transform(range(n), lambda i: strpos('0123456789ABCDEF', digits[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 17) AS bytes FROM given),
summed AS (SELECT doc_id, key, n, xor(4294967295, list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) AS crc FROM data, crcs),
regioned AS (SELECT *, {_least_sql("region", regions, "key")} AS region, {_least_sql("region", [*regions, ("4", 1)], "key")} AS grown FROM summed),
racked AS (SELECT *, {rack("region")} AS rack, {rack("grown")} AS grown_rack FROM regioned),
placed AS (SELECT *, {shard("region", "rack")} AS shard, CASE WHEN grown = 4 THEN 40 ELSE {shard("grown", "grown_rack")} END AS grown_shard FROM racked)
SELECT doc_id, n + 16 AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || crc), n) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard FROM placed"""
