"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text becomes words and numbers. Numbers, units after a number and capitalised names inside a sentence become typed
placeholders; names or numbers that follow each other have one, whose value is the first. Windows of template words are
hashed and joined with those of the benchmark; so a question with other numbers or names still matches. As names are told by
their capitals, each text also has its windows without regard to case, in which names are words; so a copy in another case
matches too. Then the slots are held against each other: along one alignment of a document with an item, a value of the item stands for the value of the
document that it meets most often, and windows that say otherwise don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import folder, small_side, staged

#: Words in a window, and the share of an item's windows that must match in one alignment.
WINDOW, COVERED = 8, 0.4
#: Words by which the windows of one alignment may be shifted against each other, as by inserted or deleted words.
DRIFT = 8
#: Unit words, which count as units directly after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams lb lbs oz ounce ounces ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent "
    "mph kmh degrees celsius fahrenheit watt watts volt volts"
).split()
#: The blocks of Thai and Lao, Khmer, Kana and Han letters. Their scripts set no blanks between words, so they
#: count one by one.
_ALONE = r"\u0E00-\u0EFF\u1780-\u17FF\u3041-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3134F}"
_WORD = rf"[\p{{L}}&&[^{_ALONE}]]+[.!?:]?|[{_ALONE}]|\p{{N}}+(?:[.,]\p{{N}}+)*"
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def words(text: str) -> Column:
    """Words, with a full stop or the like directly after one, and numbers; null has none."""
    return F.coalesce(F.regexp_extract_all(F.col(text).cast("string"), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _plain(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".!?:")))


def _is_number(word: Column) -> Column:
    """Whether a word or number is the latter; only signs above the letters a to z need a look at their class."""
    first = F.substring(word, 1, 1)
    return ((first >= "0") & (first <= "9")) | ((first > "z") & word.rlike(r"^\p{N}"))


def template(tokens: Column) -> Column:
    """For each word ``type``, it in lower case without its stop or the placeholder of its type, and whether it is a ``name``."""

    def one(word: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        first = F.substring(word, 1, 1)
        inside = (i > 0) & ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
        number = _is_number(word)
        name = (first != F.lower(first)) & (F.length(word) > 1) & (word != F.upper(word)) & inside
        unit = (i > 0) & _is_number(before) & (F.length(word) <= 10) & _plain(word).isin(UNITS)
        return F.struct(F.when(number, NUMBER).when(unit, UNIT).otherwise(_plain(word)).alias("type"), name.alias("name"))

    return F.transform(tokens, one)


def canonical(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with ``shape``, its template, ``raw``, the words that it stands for, both without repeated placeholders, and
    ``names``: a text with names has a second row, in which they are words."""
    # In steps, so that no template is made twice. A number is no name, as it has no capital.
    typed = texts.withColumn("raw", words(text)).withColumn("typed", template(F.col("raw")))
    form = lambda shape, names: F.struct(shape.alias("shape"), F.lit(names).alias("names"))
    worded, named = F.transform("typed", lambda x: x["type"]), F.transform("typed", lambda x: F.when(x["name"], NAME).otherwise(x["type"]))
    forms = F.when(F.exists("typed", lambda x: x["name"]), F.array(form(named, True), form(worded, False))).otherwise(F.array(form(worded, True)))
    typed = typed.withColumn("form", F.explode(forms)).drop("typed").withColumn("shape", F.col("form.shape")).withColumn("names", F.col("form.names")).drop("form")
    first = lambda i: ~(F.get("shape", i).isin(NAME, NUMBER) & (F.get("shape", i) == F.coalesce(F.get("shape", i - 1), F.lit(""))))
    return typed.withColumns({c: F.filter(c, lambda _, i: first(i)) for c in ("shape", "raw")})


def _hashes(hashed: Column, length: int) -> Column:
    """The hash of each window of ``length`` hashed words, in order."""
    at = F.when(F.size(hashed) >= length, F.sequence(F.lit(1), F.size(hashed) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(hashed, i, length)))


def _slots(raw: Column, shape: Column) -> Column:
    """The lower-case values at a window's placeholders, in order."""
    both = F.filter(F.arrays_zip(raw.alias("raw"), shape.alias("shape")), lambda x: x["shape"].isin(NUMBER, UNIT, NAME))
    return F.transform(both, lambda x: _plain(x["raw"]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, form, length, ipos, windows, hash, literal, slots) for each window; a shorter item is one window of its length."""
    items = canonical(benchmark.select("item_id", "text"), "text").drop("text").withColumnRenamed("names", "form").filter(F.size("raw") > 0)
    items = items.withColumn("length", F.least(F.size("raw"), F.lit(window))).withColumn("windows", F.size("raw") - F.col("length") + 1)
    items = items.withColumn("hashed", F.transform("shape", lambda x: F.xxhash64(x))).withColumn("ipos", F.explode(F.sequence(F.lit(1), F.col("windows"))))
    part = lambda c: F.slice(c, F.col("ipos"), F.col("length"))
    slots = _slots(part("raw"), part("shape"))
    return items.select("item_id", "form", "length", "ipos", "windows", F.xxhash64(part("hashed")).alias("hash"), slots.alias("slots")).withColumn("literal", F.col("length") - F.size("slots"))


#: What tells alignments apart: document and item, which of their forms are held together, and the first of the shifts; an
#: alignment of one shift by itself is ``alone``.
_PAIR = ["doc_id", "item_id", "form", "names"]
_ALIGNED = [*_PAIR, "alone", "start"]


def _aligned(placed: DataFrame, drift: int, alone: bool = True) -> DataFrame:
    """Each matched window once for each alignment that it is in: those that begin with a shift up to ``drift`` before it, and,
    if ``alone``, that of its own shift alone, as its values may hold where a neighbour's contradict them."""
    placed = placed.withColumn("shift", (F.col("dpos") - F.col("ipos")).cast("long"))
    shifts = placed.select(*_PAIR, F.col("shift").alias("start")).distinct()
    chained = placed.withColumn("start", F.explode(F.sequence(F.col("shift") - drift, F.col("shift")))).join(shifts, [*_PAIR, "start"])
    chained = chained.withColumn("alone", F.lit(False)).drop("shift")
    return placed.withColumn("start", F.col("shift")).withColumn("alone", F.lit(True)).drop("shift").unionByName(chained) if alone else chained


def _judged(aligned: DataFrame) -> DataFrame:
    """``aligned`` without the windows that give a value of the item another counterpart than its most frequent one, the
    smallest of equally frequent ones. Pairs are counted by groups, so the work grows with the windows."""
    pairs = aligned.filter(F.size("pairs") > 0).select(*_ALIGNED, "ipos", "dpos", F.explode("pairs").alias("pair")).select(*_ALIGNED, "ipos", "dpos", "pair.i", "pair.d")
    counts = pairs.groupBy(*_ALIGNED, "i", "d").agg(F.count("*").alias("n"))
    most = counts.groupBy(*_ALIGNED, "i").agg(F.min(F.struct(-F.col("n"), "d"))["d"].alias("best"))
    bad = pairs.join(most, [*_ALIGNED, "i"]).filter("d <> best").select(*_ALIGNED, "ipos", "dpos").distinct()
    return aligned.join(bad, [*_ALIGNED, "ipos", "dpos"], "left_anti")


def _covering(aligned: DataFrame, covered: float) -> DataFrame:
    """(alignment, windows, matched) of those that hold enough of the item's windows."""
    held = aligned.groupBy(*_ALIGNED, "windows").agg(F.count_distinct("ipos").alias("matched"))
    return held.filter(F.col("matched") >= F.ceil(F.col("windows") * F.lit(covered)))


def _told(hit: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, windows) of the form and alignment with the largest share of windows."""
    best = F.max_by(F.struct(F.col("matched").cast("long").alias("matched"), F.col("windows").cast("long").alias("windows")), F.struct(F.col("matched") / F.col("windows"), "matched", "windows"))
    return hit.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.matched", "best.windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, covered: float = COVERED, drift: int = DRIFT) -> DataFrame:
    """(doc_id, item_id, matched, windows): documents that hold a benchmark item, as it is or with other slot values.

    One row for each document and item of which ``covered`` of the windows match in one alignment, with the most windows
    matched. An alignment adds the windows of shifts at most ``drift`` words apart, so words put in or left out cost only the
    windows that hold them. A window with slots matches if its values are those that the item's values mostly stand for
    along the alignment, the smallest of equally frequent ones; different values of the item may stand for one. A window
    with fewer literal words than slots matches only if its values are equal. Windows run over whole texts. Null, empty and
    wordless texts and items match nothing; rows with a null id are left out of the result; rows that repeat an id count
    as one document. Capitals tell names, but each text is also held without regard to case, so that copies in lower or
    upper case or in title case match; the form with the larger share of windows is told. Letters of scripts without blanks
    are words. The benchmark is broadcast only after a count of its windows, and shuffled beyond the bound.
    """
    path = folder(docs.sparkSession)
    windows = benchmark_windows(benchmark, window)
    lengths = sorted({window, *(r.length for r in windows.filter(F.col("length") < window).select("length").distinct().collect())})  # below ``window`` values
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull())
    # The arrays of hashes are made before they are exploded: the rows then carry the id, length, place and hash only.
    rows = canonical(texts, "text").select("doc_id", "names", F.transform("shape", lambda x: F.xxhash64(x)).alias("hashed"))
    rows = rows.select("doc_id", "names", F.explode(F.array(*(F.struct(F.lit(n).alias("length"), _hashes(F.col("hashed"), n).alias("hashes")) for n in lengths))).alias("cut"))
    rows = rows.select("doc_id", "names", F.col("cut.length").alias("length"), F.posexplode("cut.hashes").alias("at", "hash"))
    found = rows.join(small_side(windows), ["length", "hash"]).select(*_PAIR, "length", "windows", "ipos", (F.col("at") + 1).alias("dpos"), "slots", "literal").distinct()
    found = staged(found, f"{path}/found")

    exact = found.filter(F.size("slots") == 0).select(*_PAIR, "windows", "ipos", "dpos", F.array().cast("array<struct<i:string,d:string>>").alias("pairs"))
    slotted = found.filter(F.size("slots") > 0)
    if slotted.isEmpty():  # nothing to judge
        return _told(_covering(_aligned(exact, drift, False), covered))
    again = canonical(texts.join(small_side(slotted.select("doc_id").distinct()), "doc_id", "left_semi"), "text").drop("text").join(slotted, ["doc_id", "names"])
    part = lambda c: F.slice(c, F.col("dpos"), F.col("length"))
    again = again.withColumn("own", _slots(part("raw"), part("shape"))).filter(F.size("own") == F.size("slots"))
    again = again.filter((F.col("literal") >= F.size("slots")) | (F.col("own") == F.col("slots")))
    again = again.select(*_PAIR, "windows", "ipos", "dpos", F.zip_with("slots", "own", lambda i, d: F.struct(i.alias("i"), d.alias("d"))).alias("pairs"))

    placed = exact.unionByName(again).distinct()
    # Only alignments that could do if all their values held are judged.
    aligned = _aligned(placed, drift)
    wide = _covering(aligned, covered).select(*_ALIGNED)
    hit = _covering(_judged(staged(aligned.join(wide, _ALIGNED, "left_semi"), f"{path}/aligned")), covered)
    return _told(hit)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the contaminated ones; rows with a null id stay."""
    bad = staged(contaminated(docs, benchmark, doc_id=doc_id).select(F.col("doc_id").alias("bad")).distinct(), f"{folder(docs.sparkSession)}/bad")
    bad = small_side(bad)
    return docs.join(bad, docs[doc_id] == bad["bad"], "left_anti")
