"""N-gram Jaccard join by parity sketches.

Every document is the set of its 5-word shingles, each a 64-bit hash. A parity sketch has one bit for each possible
hash value and is held sparsely; two sketches differ in at most as many bits as the sets' symmetric difference, and so
do their folds to fewer bits. With Jaccard >= 3/4 the symmetric difference is at most d = (|A| + |B|) / 7.

1. Candidates (pigeonhole). Within the band of sizes 2**c up to 2**(c+1) the sketch is cut into k blocks of hash values.
   At most d blocks differ (d for the largest possible partner). A document emits its m non-empty blocks as 64-bit keys,
   so two linked documents share m - d keys or more. A set that fills d blocks or fewer also emits its d+1 smallest
   shingles, in a band of its own kind; so no pair is lost to an unlucky hash. A document that may have a partner in the
   next band emits for that too. Keys that a block of documents holds often leave it apart, so no group holds a hot key.
2. Of the keys that many documents share, each document drops its most frequent, up to m - d - 1. The least frequent
   key that two linked documents share is none of those, for either, so this loses no link. Keys of up to FEW documents
   give their pairs; in the rest each document is paired with a head of the key.
3. Verification. Sizes, then the Hamming distance of dense folded sketches, then the shingle sets themselves.
4. Documents of one key that are still in different components are compared by their dense sketches, in tiles of a
   bounded number of shingles. Near pairs of different components are verified one by one where they are fewer than half
   the tile's documents; in other tiles these documents meet once more with their shingle sets, and the tile links them
   itself, by at most one link for each. So each pair that shares a key is in one component or has been compared, and no
   step gives more pairs than documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waxwing.operators.components import components

from .textkit import U, mix, shingle_sets
from .work import folder, private, shuffle_partitions, small_side, staged, text_bytes

#: Keys that a task holds before it deals them to their buckets.
DEALT = 1 << 18
#: Keys of at most so many documents give all their pairs, which is at most 28 each.
FEW = 8
#: In larger keys each document is paired with one head; keys draw theirs in so many ways, so a group of near copies,
#: which has many keys in common, is tried against several heads.
HEADS = 12
#: Documents and shingles in a tile of a key's comparisons.
TILE, TILE_SHINGLES = 4096, 1 << 22
_KEY = np.dtype([("key", "u8"), ("cls", "i8"), ("cfg", "u1"), ("spare", "u2")])
#: The same as it is shuffled: 48 bits of a key, as keys that happen to be equal only cost a comparison, and a spare number
#: rounded down to five leading bits, which only drops fewer keys.
_PACKED = np.dtype([("low", "u4"), ("high", "u2"), ("cls", "i8"), ("cfg", "u1"), ("spare", "u1")])
_KEY_BITS = U((1 << 48) - 1)
_BAND = 0xD6E8FEB86659FD93
_BLOCK = U(0xA0761D6478BD642F)


def _band(number: int) -> U:
    return U(number * _BAND % (1 << 64))


def set_class(shingles: np.ndarray) -> int:
    """A 64-bit name of a shingle set; sets of one name count as equal."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def dense_sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch folded to a power of two of bits, four to eight for each member, 256 at least."""
    bits = max(256, 4 << (len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two dense sketches, the longer one folded down."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def pigeonhole_keys(shingles: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(keys, band, spare keys among them) for each band in which the set may have a partner."""
    n = len(shingles)
    own = n.bit_length() - 1
    for band in (own, own + 1):
        low = 1 << band
        if band > own and 4 * n < 3 * low:
            return
        d = (n + max(n, min(4 * n // 3, 2 * low - 1))) // 7
        blocks = 4 * low if low <= 32 else int(low / 1.3)
        block = (shingles >> U(32)) * U(blocks) >> U(32)  # ascends with the shingles
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        yield mix(mix(np.bitwise_xor.reduceat(shingles, first)) + block[first] * _BLOCK + _band(band)), band, max(0, min(len(first) - d - 1, 65535))
        if len(first) <= d:
            yield mix(shingles[: d + 1] + _band(64 + band)), 64 + band, 0


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), set_class(s) if len(s) else None, dense_sketch(s) if len(s) else None) for _, s in shingle_sets(batch.column("text"))]
        n, cls, sketch = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n", "cls", "sketch"])


def _keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task emit once
        apart = buckets + (TaskContext.get().partitionId() << 20)
        for batch in batches:
            made: list[np.ndarray] = []
            held = 0
            for _, s in shingle_sets(batch.column("text")):
                if not len(s) or (cls := set_class(s)) in seen:
                    continue
                seen.add(cls)
                for keys, cfg, spare in pigeonhole_keys(s):
                    part = np.empty(len(keys), _KEY)
                    part["key"], part["cls"], part["cfg"], part["spare"] = keys & _KEY_BITS, cls, cfg, spare
                    made.append(part)
                    held += len(part)
                if held > DEALT:
                    yield _dealt(made, buckets, apart)
                    made, held, apart = [], 0, apart + 1
            if made:
                yield _dealt(made, buckets, apart)
                apart += 1

    return run


def _dealt(made: list[np.ndarray], buckets: int, apart: int) -> pa.RecordBatch:
    """One row for each bucket of keys, with the packed keys.

    A key's rows beyond the first FEW + 1, which show its bucket that many share it, go to the bucket ``apart``, of this
    block of documents alone.
    """
    rows = np.concatenate(made)
    rows = rows[np.argsort(rows["key"], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
    nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    hot, rows = rows[nth > FEW], rows[nth <= FEW]
    bucket = (rows["key"] % U(buckets)).astype(np.int64)
    rows = rows[np.argsort(bucket, kind="stable")]
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    cut = [packed(rows[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([*range(buckets), apart], pa.int64()), pa.array([*cut, packed(hot)], pa.binary())], ["bucket", "keys"])


def packed(rows: np.ndarray) -> bytes:
    out = np.empty(len(rows), _PACKED)
    out["low"], out["high"], out["cls"], out["cfg"] = rows["key"] & U(0xFFFFFFFF), rows["key"] >> U(32) & U(0xFFFF), rows["cls"], rows["cfg"]
    spare = rows["spare"].astype(np.int64)
    shift = np.maximum(np.frexp(spare.astype(np.float64))[1] - 5, 0)
    out["spare"] = np.where(spare < 16, spare, (shift + 1) << 4 | (spare >> shift) & 15)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, _PACKED)
    out = np.empty(len(held), _KEY)
    out["key"], out["cls"], out["cfg"] = held["low"].astype(U) | held["high"].astype(U) << U(32), held["cls"], held["cfg"]
    code = held["spare"].astype(np.int64)
    out["spare"] = np.where(code < 16, code, (16 + (code & 15)) << np.maximum((code >> 4) - 1, 0))
    return out


def _groups(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Of the keys of a bucket that several classes share: all pairs for few classes, else the key's rows."""
        rows = unpacked(b"".join(table.column("keys").to_pylist()))
        if table.column("bucket")[0].as_py() >= buckets:
            return _shared(np.zeros((0, 2), np.int64), rows)
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        same = key[1:] == key[:-1]
        rows = rows[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(rows) else rows
        size = _sizes(rows)
        many = rows[np.repeat(size > FEW, size)]
        rows = rows[np.repeat(size <= FEW, size)]
        rows = rows[np.lexsort((rows["cls"], rows["key"]))]
        if len(rows):
            rows = rows[np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1])))]
        size = _sizes(rows)
        first = np.cumsum(size) - size
        a, b = [], []
        for k in range(2, FEW + 1):
            at = first[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    a.append(rows["cls"][at + i])
                    b.append(rows["cls"][at + j])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
        return _shared(pairs, many)

    return run


def _sizes(rows: np.ndarray) -> np.ndarray:
    """The lengths of the runs of one key."""
    first = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))) if len(rows) else np.zeros(0, int)
    return np.diff(np.concatenate((first, [len(rows)])))


def _shared(pairs: np.ndarray, many: np.ndarray) -> pa.Table:
    zeros = np.zeros(len(pairs), np.int64)
    return pa.table(
        {
            "key": pa.array(np.concatenate((zeros, many["key"].astype(np.int64)))),
            "a": pa.array(np.concatenate((pairs[:, 0], many["cls"]))),
            "b": pa.array(np.concatenate((pairs[:, 1], np.zeros(len(many), np.int64)))),
            "cfg": pa.array(np.concatenate((np.full(len(pairs), -1, np.int32), many["cfg"].astype(np.int32)))),
            "spare": pa.array(np.concatenate((zeros.astype(np.int32), many["spare"].astype(np.int32)))),
        }
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are within a seventh of both sizes together."""
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, 256):  # few sketches at a time, as those of long texts are long
            x = batch.slice(at, 256)
            keep += [7 * hamming(sa, sb) <= na + nb for na, nb, sa, sb in zip(*(x.column(k).to_pylist() for k in ("na", "nb", "sa", "sb")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_rows(sketches: list[bytes], sizes: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows) of ``left`` and ``right``, across, of different roots whose sizes and sketches allow a link.

    ``roots`` is read anew for each row, so the caller may join roots as it goes.
    """
    lengths = np.array([len(x) for x in sketches])
    matrix = {n: np.frombuffer(b"".join(x for x in sketches if len(x) == n), U).reshape(-1, n // 8) for n in np.unique(lengths).tolist()}
    place = np.zeros(len(lengths), np.int64)
    for n in matrix:
        place[lengths == n] = np.arange((lengths == n).sum())
    for m, rows in matrix.items():
        for n, others in matrix.items():
            if n not in (m, 2 * m):  # farther sizes can't link
                continue
            folded = others if n == m else others[:, : m // 8] ^ others[:, m // 8 :]
            ways = [(left, right)] if n == m or left is right else [(left, right), (right, left)]
            for ours, theirs in ways:
                at_a, at_b = ours[lengths[ours] == m], theirs[lengths[theirs] == n]
                for i in at_a.tolist():
                    near = at_b[(roots[at_b] != roots[i]) & (4 * np.minimum(sizes[i], sizes[at_b]) >= 3 * np.maximum(sizes[i], sizes[at_b]))]
                    if len(near):
                        gap = np.bitwise_count(folded[place[near]] ^ rows[place[i]]).sum(axis=1, dtype=np.int64)
                        near = near[7 * gap <= sizes[i] + sizes[near]]
                    if len(near):
                        yield i, near


def _tiles(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, those of the one tile, those of the other) for each key of a group."""
    key, tile = table.column("key").to_numpy(), table.column("tile").to_numpy()
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        left, right = np.flatnonzero(tile[rows] == lo), np.flatnonzero(tile[rows] == hi)
        yield rows, left, left if lo == hi else right


def _doubtful(table: pa.Table) -> pa.Table:
    """Near pairs (a, b) of different components, or instead, in tiles with many, their rows with b null."""
    cls, n, root, sketches = table.column("cls").to_numpy(), table.column("n").to_numpy(), table.column("root").to_numpy(), table.column("sketch").to_pylist()
    pairs: set[tuple[int, int]] = set()
    hit = np.zeros(table.num_rows, bool)
    for rows, left, right in _tiles(table):
        own, doubted, few = set(), np.zeros(len(rows), bool), True
        for i, near in near_rows([sketches[x] for x in rows.tolist()], n[rows], root[rows], left, right):
            doubted[i] = True
            doubted[near] = True
            few = few and len(own) <= len(rows)
            if few:
                own.update((min(a, b), max(a, b)) for a, b in ((int(cls[rows[i]]), int(cls[rows[j]])) for j in near[: len(rows) + 1].tolist()))
        if few and 2 * len(own) <= len(rows):
            pairs |= own
        else:
            hit[rows[doubted]] = True
    rows = table.filter(pa.array(hit)).select(["key", "cls", "root", "n", "sketch", "tile", "lo", "hi"])
    made = {name: pa.nulls(len(pairs), rows.schema.field(name).type) for name in rows.schema.names}
    made |= {"cls": pa.array([x[0] for x in pairs], pa.int64()), "b": pa.array([x[1] for x in pairs], pa.int64())}
    return pa.concat_tables([pa.table(made), rows.append_column("b", pa.nulls(rows.num_rows, pa.int64()))])


def _settled(table: pa.Table) -> pa.Table:
    """Links of the group that join components, from the shingle sets themselves."""
    cls, n, sketches, sets = table.column("cls").to_numpy(), table.column("n").to_numpy(), table.column("sketch").to_pylist(), table.column("shingles").combine_chunks()
    roots = table.column("root").to_numpy().copy()
    found: list[tuple[int, int]] = []
    for rows, left, right in _tiles(table):
        own = roots[rows]
        for i, near in near_rows([sketches[x] for x in rows.tolist()], n[rows], own, left, right):
            for j in near.tolist():
                if own[i] != own[j] and linked(sets[int(rows[i])], sets[int(rows[j])]):
                    found.append((int(cls[rows[i]]), int(cls[rows[j]])))
                    roots[roots == own[j]] = own[i]
                    own[own == own[j]] = own[i]
    return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(set_class(s), s.tobytes()) for _, s in shingle_sets(batch.column("text")) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["cls", "shingles"])


def linked(x: pa.Scalar, y: pa.Scalar) -> bool:
    """Whether 4 * intersection >= 3 * union of two packed sets."""
    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 4 * both >= 3 * (len(x) + len(y) - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(x, y) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _shingles(docs: DataFrame, wanted: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """(cls, shingles) of the classes in ``wanted`` (cls), from the text of one document each."""
    held = staged(wanted.join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("_rep")), path)
    texts = docs.join(small_side(held), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    return texts.mapInArrow(_sets, "cls long, shingles binary").dropDuplicates(["cls"])


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, path: str) -> DataFrame:
    """Those of the class pairs (a, b) that are links."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")
    near = staged(near.mapInArrow(_near, "a long, b long"), f"{path}/near")
    sets = _shingles(docs, near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, f"{path}/wanted")
    both = near.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(_linked, "u long, v long"), f"{path}/links")


def _mixed(many: DataFrame, roots: DataFrame, classes: DataFrame, buckets: int, path: str) -> DataFrame | None:
    """The rows of keys whose documents are in several components, dealt to each pair of tiles that they are in, if any."""
    rooted = many.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "cfg", F.coalesce("root", "cls").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"), F.first("cfg").alias("cfg")).filter("least <> most")
    # A set of band c has fewer than 2 ** (c + 1) shingles.
    tiles = F.ceil(F.col("size") * F.greatest(F.lit(1.0 / TILE), F.pow(F.lit(2.0), F.col("cfg") % 64 + 1) / TILE_SHINGLES)).cast("int")
    rest = rooted.select("key", "cls", "root").join(several.select("key", tiles.alias("tiles")), "key").join(classes.select("cls", "n", "sketch"), "cls")
    rest = staged(rest, path)
    if rest.isEmpty():
        return None
    dealt = rest.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("key", "cls", "root", "n", "sketch", "tile", F.pmod("key", F.lit(buckets)).alias("bucket"), F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``, linked at Jaccard >= 0.75 on 5-word shingles.

    component_id is the smallest doc_id reachable over links, its own included. Null and empty texts have no shingles and
    link to nothing. Repeated rows and ids come back as often as they are there and link by their texts; a null doc_id
    gets the component of its text like any other, but names none. Other columns are ignored.
    """
    return _members(docs, text, doc_id).select("doc_id", "n_shingles", "component_id")


def _members(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, cls, root, component_id) for every row; ``root`` tells components apart, which may share an id."""
    spark = docs.sparkSession
    path = folder(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    profiles = staged(docs.mapInArrow(_profiles, "doc_id long, n long, cls long, sketch binary"), f"{path}/profiles")
    classes = profiles.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    classes = staged(classes, f"{path}/classes")

    buckets = 4 * shuffle_partitions(spark)
    found = docs.select("text").mapInArrow(_keys(buckets), "bucket long, keys binary").filter("length(keys) > 0").groupBy("bucket").applyInArrow(_groups(buckets), "key long, a long, b long, cfg int, spare int")
    found = staged(found, f"{path}/found")
    many = found.filter("cfg >= 0").select("key", F.col("a").alias("cls"), "cfg", "spare")
    size = many.groupBy("key").agg(F.count("*").alias("size"))
    # Classes of several tasks repeat: their rows have one rank and are one row after that.
    hottest = W.partitionBy("cls", "cfg").orderBy(F.desc("size"), "key")
    many = many.join(size, "key").withColumn("nth", F.dense_rank().over(hottest)).filter("nth > spare").select("key", "cls", "cfg").distinct()
    many = staged(many, f"{path}/many")
    draw = F.struct(F.xxhash64("cls", F.pmod("key", F.lit(HEADS))), F.col("cls").alias("cls"))
    heads = many.groupBy("key").agg(F.min(draw)["cls"].alias("head"))
    stars = many.join(heads, "key").filter("head <> cls").select(F.least("head", "cls").alias("a"), F.greatest("head", "cls").alias("b"))
    pairs = found.filter("cfg < 0").select("a", "b").unionByName(stars).distinct()
    links = _verified(docs, pairs, classes, f"{path}/first")
    roots = components(links, f"{path}/first")

    mixed = _mixed(many, roots, classes, buckets, f"{path}/mixed")
    if mixed:
        shape = "key long, cls long, root long, n long, sketch binary, tile int, lo int, hi int, b long"
        doubtful = staged(mixed.groupBy("bucket", "lo", "hi").applyInArrow(_doubtful, shape), f"{path}/doubtful")
        more = _verified(docs, doubtful.filter("b is not null").select(F.col("cls").alias("a"), "b").distinct(), classes, f"{path}/pairs")
        crowded = doubtful.filter("b is null").drop("b")
        if not crowded.isEmpty():
            sets = _shingles(docs, crowded.select("cls").distinct(), classes, f"{path}/crowded")
            more = more.unionByName(staged(crowded.join(sets, "cls").groupBy("key", "lo", "hi").applyInArrow(_settled, "u long, v long"), f"{path}/settled"))
        if not more.isEmpty():
            roots = components(links.unionByName(more), f"{path}/last")

    grouped = classes.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    named = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = grouped.join(named, "root").select("cls", "root", "component_id")
    return profiles.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(member, "cls", "left").select("doc_id", "n_shingles", "cls", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classed(names: list[str], text: str, cls: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [set_class(s) if len(s) else None for _, s in shingle_sets(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(own, pa.int64())], [*names, cls])

    return run


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component of near duplicates: that of the smallest doc_id.

    Rows without shingles all stay, and so do rows with a null doc_id. Where an id repeats, its rows are told apart by their
    shingle sets: of a component's rows of the smallest id the least set stays, and of rows that repeat both one stays. So
    each component with an id keeps exactly one row that has one.
    """
    path = folder(docs.sparkSession)
    held = staged(_members(docs, text, doc_id).filter("doc_id is not null"), f"{path}/members")
    repeated = staged(held.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), f"{path}/repeated")
    gone = staged(held.filter("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct(), f"{path}/gone")
    away = lambda ids: small_side(ids.withColumnRenamed("doc_id", out))
    out, cls, data, component = private(docs, "gone_id", "set_class", "set_text", "set_component")
    left = docs.join(away(gone), F.col(doc_id) == F.col(out), "left_anti")
    # Seen from the ids alone; texts are read again only where an id repeats.
    if repeated.isEmpty():
        return left
    left = left.join(away(repeated), F.col(doc_id) == F.col(out), "left_anti")
    again = docs.join(away(repeated), F.col(doc_id) == F.col(out), "left_semi").withColumn(data, text_bytes(text))
    again = again.mapInArrow(_classed(docs.columns, data, cls), T.StructType([*docs.schema.fields, T.StructField(cls, T.LongType())]))
    keepers = held.filter("n_shingles > 0 and doc_id = component_id").groupBy("root").agg(F.any_value("component_id").alias(component), F.min("cls").alias(out)).drop("root")
    kept = again.join(small_side(staged(keepers, f"{path}/keepers")), (F.col(doc_id) == F.col(component)) & (F.col(cls) == F.col(out)), "left_semi").dropDuplicates([doc_id, cls])
    return left.unionByName(kept.drop(cls)).unionByName(again.filter(F.col(cls).isNull()).drop(cls))
