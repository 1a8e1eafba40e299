"""Harmonic and tempo relations, loudness, quantising and array arithmetic as columns."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def camelot(code: Column) -> Column:
    """struct(number 1..12, letter A or B) of a key code; null for anything else."""
    text = F.upper(F.trim(code))
    number = F.regexp_extract(text, r"^\+?0*(\d{1,2})([AB])$", 1).try_cast("int")
    return F.when(number.between(1, 12), F.struct(number.alias("number"), F.substring(text, -1, 1).alias("letter")))


def key_relation(a: Column, b: Column) -> Column:
    """exact, relative (other letter), fifth (a step on the wheel of twelve), clash, or unknown."""
    x, y = camelot(a), camelot(b)
    step = F.abs(x["number"] - y["number"])
    same = x["letter"] == y["letter"]
    found = F.when(same & (step == 0), "exact").when(step == 0, "relative").when(same & step.isin(1, 11), "fifth").otherwise("clash")
    return F.when(x.isNull() | y.isNull(), "unknown").otherwise(found)


#: Tempo ratios that count as the same beat, in the order in which ties are decided.
RATIOS = (("match", 1.0), ("double", 2.0), ("half", 0.5), ("triple", 3.0), ("third", 1.0 / 3.0))


def bpm_relation(reference: Column, measured: Column, tolerance: float = 1.0) -> Column:
    """struct(relation, error): the ratio with the least error in percent, other beyond the tolerance."""
    errors = F.array(*(F.struct((F.abs(measured - reference * r) / (reference * r) * 100.0).alias("error"), F.lit(i).alias("at"), F.lit(name).alias("relation")) for i, (name, r) in enumerate(RATIOS)))
    best = F.array_min(errors)
    usable = (reference > 0) & (measured > 0)
    relation = F.when(best["error"] <= tolerance, best["relation"]).otherwise("other")
    return F.struct(F.when(usable, relation).otherwise("other").alias("relation"), F.when(usable, best["error"]).otherwise(F.lit(float("inf"))).alias("error"))


def octave_correct(bpm: Column, low: float = 80.0, high: float = 180.0, steps: int = 12) -> Column:
    """The tempo doubled until it is ``low`` or more, then halved until it is ``high`` or less; 0 and less stay.

    Doublings are exact, so powers of two up to ``steps`` cover all tempi from low / 2**steps to high * 2**steps.
    """
    powers = F.array(*(F.lit(2.0**i) for i in range(steps + 1)))
    raised = F.array_min(F.filter(F.transform(powers, lambda p: bpm * p), lambda x: x >= low))
    return F.when(bpm <= 0, bpm).otherwise(F.element_at(F.filter(F.transform(powers, lambda p: raised / p), lambda x: x <= high), 1))


def octave_window(coarse: Column, low: int, high: int, factor: float = 1.4, span: int = 10) -> Column:
    """struct(lo, hi) about a coarse tempo within bounds; the bounds themselves if it is unusable or too narrow."""
    lo, hi = F.greatest(F.lit(low), (coarse / factor).cast("int")), F.least(F.lit(high), F.bround(coarse * factor, 0).cast("int"))
    fits = (coarse > 0) & (hi - lo >= span)
    return F.struct(F.when(fits, lo).otherwise(low).alias("lo"), F.when(fits, hi).otherwise(high).alias("hi"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def pearson(a: Column, b: Column) -> Column:
    """Of two arrays of one length; 0 if one of them is constant."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    ma, mb = total(a) / n, total(b) / n
    spread = F.sqrt(dot(a, a) / n - ma * ma) * F.sqrt(dot(b, b) / n - mb * mb)
    return F.when(spread > 1e-12, (dot(a, b) / n - ma * mb) / spread).otherwise(0.0)


def hamming_similarity(a: Column, b: Column, least: int = 4) -> Column:
    """1 - differing bits / bits of two arrays of 32-bit words, over the shorter length; 0 below ``least`` words."""
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(n < least, 0.0).otherwise(1.0 - bits / (n * 32.0))


def words32(values: Column) -> Column:
    """An array of floats in -1..1 as 32-bit words, for fingerprints."""
    return F.transform(values, lambda x: F.floor((F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) + 1.0) * 2147483647.0).cast("long"))


def mel(hz: Column) -> Column:
    return F.log10(hz / 700.0 + 1.0) * 2595.0


def from_mel(value: Column) -> Column:
    return (F.pow(F.lit(10.0), value / 2595.0) - 1.0) * 700.0


def quantize_log(level: Column, top: int, gamma: float = 1.0) -> Column:
    """A level as decibels from -60 to 0, scaled to 0..top and rounded half to even."""
    db = F.log10(level + 1e-10) * 20.0
    share = F.least(F.greatest((db + 60.0) / 60.0, F.lit(0.0)), F.lit(1.0))
    return F.bround((F.pow(share, F.lit(gamma)) if gamma != 1.0 else share) * top, 0).cast("int")


def pack_height(bright: Column, height: Column) -> Column:
    """Three bits of brightness above five of height."""
    return F.shiftleft(bright.bitwiseAND(7), 5).bitwiseOR(height.bitwiseAND(31))


def pack_color(red: Column, green: Column, blue: Column, height: Column) -> Column:
    """Three bits each of three colours, then five of height, then two empty."""
    part = lambda x, by: F.shiftleft(x.bitwiseAND(7), by)
    return part(red, 13).bitwiseOR(part(green, 10)).bitwiseOR(part(blue, 7)).bitwiseOR(F.shiftleft(height.bitwiseAND(31), 2))


def rgb(color: Column) -> Column:
    part = lambda by: F.shiftright(color, by).bitwiseAND(255)
    return F.struct(part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"))


def replay_gain(lufs: Column, target: float = -18.0) -> Column:
    return F.when(lufs.isNull() | (lufs <= -100.0), 0.0).otherwise(F.round(target - lufs, 2))


def loudness(mean_square: Column) -> Column:
    """The fallback loudness of a mean square; -100 for silence."""
    return F.when(mean_square > 0, F.log10(mean_square) * 10.0 - 0.691).otherwise(-100.0)


def mood(bpm: Column, lufs: Column, brightness: Column, warmth: Column) -> Column:
    loud, fast, bright, warm = F.coalesce(lufs > -16.0, F.lit(False)), bpm > 130.0, brightness > 0.4, warmth > 0.55
    found = F.when(fast & loud & bright, "Energetic").when(fast & ~bright, "Driving").when(bright & ~fast, "Uplifting")
    return found.when(warm & ~loud, "Mellow").when(~bright & loud, "Dark").otherwise("Balanced")


#: Fixed values. Tempi below the slowest hint at nothing; up to each upper tempo, the measure's bound tells which of two
#: names it is.
SLOWEST, SLOW = 65, 95
GENRES = [
    # upper tempo, measure, bound, name above it, name otherwise
    (115, "texture", 0.07, "Hip-Hop", "Pop"),
    (130, "brightness", 0.35, "House", "Pop"),
    (145, "brightness", 0.4, "Techno", "Electro"),
    (165, "brightness", 0.5, "Trance", "Hard Dance"),
    (185, "brightness", 0.0, "Drum & Bass", "Drum & Bass"),
    (220, "brightness", 0.0, "Hardcore", "Hardcore"),
]


def genre_hint(bpm: Column, brightness: Column, texture: Column) -> Column:
    slow = F.when(brightness < 0.3, "Reggae").when(texture > 0.08, "Hip-Hop").otherwise("Downtempo")
    out = F.when(bpm.isNull() | (bpm < SLOWEST), "Unknown").when(bpm <= SLOW, slow)
    measures = {"brightness": brightness, "texture": texture}
    for top, measure, bound, above, otherwise in GENRES:
        out = out.when(bpm <= top, F.when(measures[measure] > bound, above).otherwise(otherwise))
    return out.otherwise("Unknown")


#: The wheel's codes by pitch class, C first.
MAJOR = ("8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B")
MINOR = ("5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A")
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def key_code(pitch: Column, minor: Column) -> Column:
    """The wheel's code of a pitch name and mode; null for other names."""
    at = F.array_position(F.array(*map(F.lit, PITCHES)), F.upper(F.trim(pitch))).cast("int")
    codes = lambda names: F.try_element_at(F.array(*map(F.lit, names)), F.nullif(at, F.lit(0)))
    return F.when(minor, codes(MINOR)).otherwise(codes(MAJOR))


def pvbr_index(n_frames: Column, points: int = 400) -> Column:
    """Evenly spaced frame positions of a constant-rate file."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * n_frames / points).cast("long"))


def resample_nearest(values: Column, rate: Column, wanted: int) -> Column:
    """Samples at another rate: each of the value at or before its time; as they are where the rates are equal."""
    ratio = rate.cast("double") / float(wanted)
    count = F.ceil(F.size(values) / ratio).cast("int")
    pick = lambda i: F.get(values, F.least(F.floor(i * ratio).cast("int"), F.size(values) - 1))
    return F.when(values.isNull() | (F.size(values) == 0), values).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), pick))


def resample_linear(values: Column, points: int) -> Column:
    """An array linearly interpolated at evenly spaced places from its first to its last value."""
    last = F.size(values) - 1
    at = lambda i: i * last.cast("double") / float(max(points - 1, 1))
    low = lambda i: F.floor(at(i)).cast("int")
    pick = lambda k: F.get(values, k)
    value = lambda i: pick(low(i)) + (pick(F.least(low(i) + 1, last)) - pick(low(i))) * (at(i) - low(i))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), value)


#: Two published families of key profiles, from the tonic up, each major then minor.
PROFILES = [
    ([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88], [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]),
    ([5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0], [5.0, 2.0, 3.5, 4.5, 2.0, 3.5, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0]),
]


def key_of(chroma: Column, minor_bias: float = 1.1) -> Column:
    """(pitch, mode, score) of the key whose profiles go best with twelve pitch energies, by the mean of their correlations.

    Minor scores are weighted by the bias. Of equal scores the lower pitch, then major, counts; silence is C major with 0,
    equal energies other than that with -2. Profiles of mean 0 and length 1 make each score one sum of twelve products.
    """
    values = [F.get(chroma, F.lit(i)).cast("double") for i in range(12)]

    def unit(profile: list[float]) -> list[float]:
        mean = sum(profile) / 12
        length = math.sqrt(sum((v - mean) ** 2 for v in profile))
        return [(v - mean) / length for v in profile]

    def each(pitch: int, mode: int) -> Column:
        units = [unit(family[mode]) for family in PROFILES]
        weights = [sum(u[(i - pitch) % 12] for u in units) / len(units) * (minor_bias if mode else 1.0) for i in range(12)]
        score = reduce(operator.add, (v * w for v, w in zip(values, weights, strict=True)))
        return F.struct(score.alias("score"), F.lit(-pitch * 2 - mode).alias("first"), F.lit(PITCHES[pitch]).alias("pitch"), F.lit(("major", "minor")[mode]).alias("mode"))

    best = F.array_max(F.array(*(each(pitch, mode) for pitch in range(12) for mode in (0, 1))))
    power, total = reduce(operator.add, (v * v for v in values)), reduce(operator.add, values)
    length = F.sqrt(F.greatest(power - total * total / 12.0, F.lit(0.0)))
    none = lambda score: F.struct(F.lit("C").alias("pitch"), F.lit("major").alias("mode"), F.lit(score).alias("score"))
    # Bound once, as the element of an array, so that the scores are not made anew for each field.
    found = F.get(F.transform(F.array(best), lambda b: F.struct(b["pitch"].alias("pitch"), b["mode"].alias("mode"), (b["score"] / length).alias("score"))), F.lit(0))
    return F.when(power < 1e-16, none(0.0)).when(length < 1e-12, none(-2.0)).otherwise(found)


def density_corrected(bpm: Column, onsets: Column, seconds: Column, low: float, high: float, most: float = 5.5, least: float = 0.4) -> Column:
    """The tempo doubled where onsets come more than ``most`` to a beat, halved below ``least``, while within the bounds."""
    ratio = F.try_divide(F.try_divide(onsets, seconds), bpm / 60.0)
    usable = (bpm > 0) & (seconds >= 5.0) & (onsets > 0) & (bpm / 60.0 >= 0.1)
    return F.when(usable & (ratio > most) & (bpm * 2 < high), bpm * 2).when(usable & (ratio < least) & (bpm / 2 > low), bpm / 2).otherwise(bpm)


def band_energy(frame: Column, hz: float, rate: float = 11025.0) -> Column:
    """The squared magnitude of a frame of samples at one frequency, by Goertzel's recurrence."""
    turn = 2.0 * math.cos(2.0 * math.pi * hz / rate)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    step = lambda s, x: F.struct((x.cast("double") + turn * s["a"] - s["b"]).alias("a"), s["a"].alias("b"))
    return F.aggregate(frame, zero, step, lambda s: s["a"] * s["a"] + s["b"] * s["b"] - turn * s["a"] * s["b"])


def mel_bands(frame: Column, bands: int = 32, low: float = 80.0, high: float = 4000.0, rate: float = 11025.0) -> Column:
    """The energies at frequencies that lie evenly between two bounds on the mel scale."""
    scale = lambda hz: 2595.0 * math.log10(1.0 + hz / 700.0)
    places = [scale(low) + (scale(high) - scale(low)) * k / (bands - 1) for k in range(bands)]
    return F.array(*(band_energy(frame, 700.0 * (10.0 ** (m / 2595.0) - 1.0), rate) for m in places))
