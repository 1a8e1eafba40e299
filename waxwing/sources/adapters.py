"""The driver's star-schema tables seen as a media catalogue."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxwing.plans.registry import table

#: The same adapters as SQL, for the queries' oracles.
TRACKS_SQL = (
    "(SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS genre, (p_size % 6) AS rating, "
    "(p_retailprice / 10)::DOUBLE AS bpm, p_size * 8 AS bitrate, (p_size % 9) AS color_id, "
    "'/music/' || p_brand || '/' || p_name || '.' || (CASE p_size % 5 WHEN 0 THEN 'mp3' WHEN 1 THEN 'm4a' WHEN 2 THEN 'flac' WHEN 3 THEN 'wav' ELSE 'ogg' END) AS path FROM part)"
)


def tracks(spark: SparkSession, directory: str) -> DataFrame:
    """Tracks from ``part``."""
    size = F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("mp3", "m4a", "flac", "wav", "ogg"))), size % 5 + 1)
    return table(spark, directory, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"),
        (size % 6).alias("rating"),
        (F.col("p_retailprice") / 10).alias("bpm"),
        (size * 8).alias("bitrate"),
        (size % 9).alias("color_id"),
        F.concat(F.lit("/music/"), "p_brand", F.lit("/"), "p_name", F.lit("."), kind).alias("path"),
    )


def entries(spark: SparkSession, directory: str) -> DataFrame:
    """Ordered playlist entries from ``lineitem``: a playlist is an order."""
    return table(spark, directory, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("track_id"), F.col("l_linenumber").alias("pos"))


def nodes(spark: SparkSession, directory: str) -> DataFrame:
    """The playlist tree: regions, nations and customers are folders (type 0), orders are playlists (type 1)."""
    level = lambda name, key, prefix, title, parent, kind, seq: table(spark, directory, name).select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(title).cast("string").alias("name"), parent.alias("parent_id"), F.lit(kind).alias("type"), F.col(seq).cast("long").alias("seq")
    )
    above = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    return (
        level("region", "r_regionkey", "r", "r_name", F.lit("ROOT"), 0, "r_regionkey")
        .unionByName(level("nation", "n_nationkey", "n", "n_name", above("r", "n_regionkey"), 0, "n_nationkey"))
        .unionByName(level("customer", "c_custkey", "c", "c_name", above("n", "c_nationkey"), 0, "c_custkey"))
        .unionByName(level("orders", "o_orderkey", "o", "o_orderkey", above("c", "o_custkey"), 1, "o_orderkey"))
    )


NODES_SQL = (
    "(SELECT 'r' || r_regionkey AS id, r_name AS name, 'ROOT' AS parent_id, 0 AS type, r_regionkey::BIGINT AS seq FROM region "
    "UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, 0, n_nationkey FROM nation "
    "UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey, 0, c_custkey FROM customer "
    "UNION ALL SELECT 'o' || o_orderkey, o_orderkey::VARCHAR, 'c' || o_custkey, 1, o_orderkey FROM orders)"
)


def titles(spark: SparkSession, directory: str) -> DataFrame:
    """(id, artist, title) with the version suffixes that catalogues have, one of eight shapes by id."""
    return table(spark, directory, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.expr(TITLE_EXPRESSION).alias("title"))


#: One expression for both engines.
TITLE_EXPRESSION = (
    "CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' (Original Mix)') WHEN 1 THEN concat(p_name, ' (', p_brand, ' Remix)') WHEN 2 THEN concat(p_name, ' [Radio Edit]') "
    "WHEN 3 THEN concat(p_name, ' - Extended Mix') WHEN 4 THEN concat(p_name, ' feat. ', p_brand) WHEN 5 THEN concat(p_name, ' (', p_brand, ' Extended Remix)') "
    "WHEN 6 THEN concat(p_name, ' (2019 Remaster)') ELSE p_name END"
)
TITLES_SQL = f"(SELECT p_partkey AS id, p_brand AS artist, {TITLE_EXPRESSION} AS title FROM part)"


#: Different words whose hashes a task keeps at most, and words of a text that are counted at once.
KNOWN, AT_ONCE = 1 << 18, 255 * 256


class _Hashes(dict):
    """Word -> its MD5, kept for when it comes again."""

    def __missing__(self, word: bytes) -> bytes:
        digest = self[word] = md5(word, usedforsecurity=False).digest()
        return digest


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with words, how many it has and in how many each bit of the MD5 is set, from the highest of the first
    byte on; two such counts to a number."""
    known = _Hashes()
    for batch in batches:
        at, counts, votes = [], [], []
        for row, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
            words = text.split() if text else []
            if not words:
                continue
            total = np.zeros(128, np.int64)
            for start in range(0, len(words), AT_ONCE):
                part = words[start : start + AT_ONCE]
                if len(known) + len(part) > KNOWN:
                    known.clear()
                bits = np.unpackbits(np.frombuffer(b"".join(map(known.__getitem__, part)), np.uint8)).view(np.uint64).reshape(-1, 16)
                # Eight bytes are added as one number; a byte holds the sum over 255 words.
                total += np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0).view(np.uint8).reshape(-1, 128).sum(axis=0, dtype=np.int64)
            at.append(row)
            counts.append(len(words))
            votes.append(total)
        if at:
            columns = np.stack(votes).T
            columns = columns[::2] << 32 | columns[1::2]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at)), pa.array(counts, pa.int64()), *map(pa.array, columns)], names=["doc_id", "n", *_BITS])


#: The columns of counts of ``_votes``.
_BITS = [f"b{i}" for i in range(64)]


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words whose bits are set in more than half of the n words."""
    for batch in batches:
        counts = np.stack([batch[x].to_numpy() for x in _BITS], axis=1)
        counts = np.stack([counts >> 32, counts & 0xFFFFFFFF], axis=2).reshape(-1, 128)
        words = np.packbits(counts * 2 > batch["n"].to_numpy()[:, None], axis=1).view(">u4").astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, 4, dtype=np.int32)), pa.array(words.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["id", "words"])


def prints(spark: SparkSession, directory: str) -> DataFrame:
    """(id, words) from ``documents``: a fingerprint of four 32-bit words, in which a bit is set if more than half of the
    text's words have it set in their MD5. Texts without words have none; texts of an id, of up to 2**31 words, are one."""
    texts = table(spark, directory, "documents").select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    counted = texts.mapInArrow(_votes, f"doc_id {kind}, n long, " + ", ".join(f"{x} long" for x in _BITS))
    votes = counted.groupBy("doc_id").agg(*(F.sum(x).alias(x) for x in ("n", *_BITS)))
    return votes.mapInArrow(_majority, f"id {kind}, words array<long>")


_BIT = "(CASE WHEN sum((h{j} >> {i}) & 1) * 2 > count(*) THEN {v} ELSE 0 END)"
_WORDS = ", ".join("(" + " + ".join(_BIT.format(j=j, i=i, v=1 << i) for i in range(32)) + ")::BIGINT" for j in range(4))
PRINTS_SQL = (
    f"(SELECT doc_id AS id, [{_WORDS}] AS words FROM (SELECT doc_id, "
    + ", ".join(f"('0x' || substring(md5(word), {8 * j + 1}, 8))::BIGINT AS h{j}" for j in range(4))
    + r" FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS word FROM documents)) GROUP BY doc_id)"
)
