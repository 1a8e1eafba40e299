"""One-to-one matches, guarded exports and loudness against plain loops."""

from __future__ import annotations

import random

import pytest

from waxwing.operators import sequences
from waxwing.sources import catalog, sinks


@pytest.mark.parametrize("tolerance", [0.07, 0.5, 3.0, 0.0])
def test_matches_equal_the_greedy_loop(spark, tolerance):
    pick = random.Random(int(tolerance * 100))
    rows = [(g, round(pick.uniform(0, 30), pick.choice([0, 1, 3])), pick.random() < 0.5) for g in "abcd" for _ in range(90)]
    rows += [("only ours", 1.0, True), ("only theirs", 1.0, False), ("a", None, True), ("tie", 0.0, False), ("tie", 0.5, True), ("tie", -0.5, True), ("tie", 0.25, False)]
    df = spark.createDataFrame(rows, "g string, t double, ours boolean")
    found = {}
    for r in sequences.matched_pairs(df, "g", "t", "ours", tolerance).collect():
        found.setdefault(r.g, []).append((r.reference, r.found))
    scores = {r.g: (r.f_measure, r.median_error) for r in sequences.match_scores(df, "g", "t", "ours", tolerance).collect()}
    assert set(scores) == {r[0] for r in rows}
    for g in scores:
        theirs, mine = ([t for h, t, o in rows if h == g and o == side and t is not None] for side in (False, True))
        wanted = sequences.matched_within(theirs, mine, tolerance)
        assert sorted(found.get(g, [])) == sorted(wanted)
        assert scores[g][0] == pytest.approx(2 * len(wanted) / (len(theirs) + len(mine)))
        assert (scores[g][1] is None) == (not wanted)
    assert len(found) >= 4


def test_a_restricted_export_refuses_to_be_empty(spark, tmp_path):
    tracks = spark.createDataFrame([(i, f"T{i}", f"/m/{i}.mp3") for i in range(6)], "id int, title string, path string")
    entries = spark.createDataFrame([(1, 0), (1, 3), (2, 3), (3, 99), (4, None)], "pid int, track_id int")
    target = f"file://{tmp_path}/out"
    read = lambda: sorted(r.id for r in catalog.read_tracks(spark, target).collect())
    assert sinks.restricted_export(tracks, entries, [1, 2, 77], target) == 2 and read() == ["0", "3"]
    for none in ([3], [4], [77], []):
        with pytest.raises(sinks.EmptySelection):
            sinks.restricted_export(tracks, entries, none, target)
        assert read() == ["0", "3"] and [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["out"]
    assert sinks.restricted_export(tracks, entries, None, target) == 6 and read() == ["0", "1", "2", "3", "4", "5"]
    plain = lambda df, path: df.write.parquet(path)
    assert sinks.restricted_export(tracks, entries, [2], f"file://{tmp_path}/table", plain) == 1
    assert spark.read.parquet(f"file://{tmp_path}/table").first().id == 3


def plain_loudness(channels, rate):
    """The standard sample by sample, then block by block."""
    import math

    import numpy as np

    from waxwing.operators import loudness as L

    weighted = []
    for x in channels:
        for b, a in (L.shelf(rate), L.high_pass(rate)):
            out, p, q = [], 0.0, 0.0
            for v in x:
                y = b[0] * v + p
                p, q = b[1] * v - a[0] * y + q, b[2] * v - a[1] * y
                out.append(y)
            x = out
        weighted.append(np.array(x))
    hop = rate // 10
    size = len(weighted[0])
    powers = [sum(w * (x[i : i + 4 * hop] ** 2).sum() for w, x in zip(L.WEIGHTS, weighted, strict=False)) / (4 * hop) for i in range(0, size - 4 * hop + 1, hop)]
    if size < 4 * hop:
        powers = [sum(w * (x**2).sum() for w, x in zip(L.WEIGHTS, weighted, strict=False)) / size]
    loud = lambda p: -0.691 + 10 * math.log10(p) if p > 0 else -1000.0
    first = [p for p in powers if loud(p) > -70]
    if not first:
        return -100.0
    last = [p for p in first if loud(p) > loud(sum(first) / len(first)) - 10]
    return round(loud(sum(last) / len(last)), 2)


def chunked(signals, length):
    return [(t, c, i, [float(v) for v in x[i * length : (i + 1) * length]]) for t, channels in signals.items() for c, x in enumerate(channels) for i in range(max(1, -(-len(x) // length)))]


@pytest.mark.parametrize(("rate", "tenths"), [(8000, 1), (8000, 7), (4000, 10)])
def test_loudness_equals_the_plain_loop(spark, rate, tenths):
    import numpy as np

    from waxwing.operators import loudness

    rng = np.random.Generator(np.random.PCG64(3))
    t = np.arange(rate * 3) / rate
    fading = rng.standard_normal(rate * 4) * np.repeat([0.5, 0.01, 0.0, 0.3], rate)
    signals = {"sine": [np.sin(2 * np.pi * 997 * t)], "stereo": [0.3 * np.sin(2 * np.pi * 440 * t), 0.1 * rng.standard_normal(len(t))], "gated": [fading], "quiet": [np.full(rate, 1e-6)], "short": [rng.standard_normal(rate // 5) * 0.1], "odd": [rng.standard_normal(rate + 77) * 0.2], "five": [rng.standard_normal(rate) * 0.1 for _ in range(5)]}
    length = rate // 10 * tenths
    rows = [*chunked(signals, length), ("nothing", 0, 0, None), ("nothing", 0, None, [1.0])]
    given = spark.createDataFrame(rows, "track string, channel int, chunk int, samples array<double>").repartition(5)
    found = {r.track: r.lufs for r in loudness.integrated_loudness(given, rate, length).collect()}
    for track, channels in signals.items():
        assert found[track] == pytest.approx(plain_loudness(channels, rate), abs=0.011), track
    assert found["nothing"] == found["quiet"] == -100.0 and len(found) == len(signals) + 1


def test_loudness_of_known_signals(spark):
    """A full-scale sine of 997 Hz is -3.01 LUFS in one channel, 3.01 LU more in two; and the published coefficients."""
    import numpy as np

    from waxwing.operators import loudness

    rate = 48000
    wave = (np.sin(2 * np.pi * 997 * np.arange(rate * 2) / rate) * 32767).astype("<i2")
    cut = lambda t, c: [(t, c, i, bytearray(wave[i * rate : (i + 1) * rate].tobytes())) for i in range(2)]
    given = spark.createDataFrame(cut("one", 0) + cut("two", 0) + cut("two", 1), "track string, channel int, chunk int, samples binary")
    found = {r.track: r.lufs for r in loudness.integrated_loudness(given, rate, rate).collect()}
    assert found["one"] == pytest.approx(-3.01, abs=0.05) and found["two"] == pytest.approx(0.0, abs=0.05)
    b, a = loudness.shelf(48000)
    assert [*b, *a] == pytest.approx([1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585], abs=1e-9)
    assert loudness.high_pass(48000)[1] == pytest.approx([-1.99004745483398, 0.99007225036621], abs=1e-9)
    with pytest.raises(ValueError, match="tenths"):
        loudness.integrated_loudness(given, rate, 1000)
    gap = spark.createDataFrame([("x", 0, i, [0.1] * 800) for i in (0, 2)], "track string, channel int, chunk int, samples array<double>")
    with pytest.raises(Exception, match="without gaps"):
        loudness.integrated_loudness(gap, 8000, 800).collect()
