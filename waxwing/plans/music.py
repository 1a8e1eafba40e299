"""Queries of the harmonic, tempo, loudness and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from waxwing.functions import music as M
from waxwing.operators import loudness
from waxwing.plans.registry import query, table

_KEYS = "(SELECT p_partkey AS id, (p_partkey % 14) || (CASE WHEN p_size % 3 = 0 THEN 'a' WHEN p_size % 3 = 1 THEN 'B' ELSE 'C' END) AS a, ' ' || (p_partkey // 14 % 13) || (CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'b' END) AS b FROM part)"


def _keys(spark, d):
    first = F.concat((F.col("p_partkey") % 14).cast("string"), F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "B").otherwise("C"))
    second = F.concat(F.lit(" "), (F.floor(F.col("p_partkey") / 14) % 13).cast("string"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("b"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), first.alias("a"), second.alias("b"))


_C = "CASE WHEN regexp_matches(upper(trim({0})), '^\\d{{{{1,2}}}}[AB]$') AND TRY_CAST(regexp_extract({0}, '\\d+') AS INTEGER) BETWEEN 1 AND 12 THEN {1} END".replace("{{{{", "{{").replace("}}}}", "}}")
_num = lambda c: _C.format(c, f"regexp_extract({c}, '\\d+')::INTEGER")
_let = lambda c: _C.format(c, f"right(upper(trim({c})), 1)")


@query("camelot_parse", f"SELECT id, {_num('a')} AS number, {_let('a')} AS letter FROM {_KEYS}")
def camelot_parse(spark, d):
    return _keys(spark, d).select("id", M.camelot(F.col("a"))["number"].alias("number"), M.camelot(F.col("a"))["letter"].alias("letter"))


@query("key_relation", f"SELECT id, CASE WHEN na IS NULL OR nb IS NULL THEN 'unknown' WHEN na = nb AND la = lb THEN 'exact' WHEN na = nb THEN 'relative' WHEN la = lb AND abs(na - nb) IN (1, 11) THEN 'fifth' ELSE 'clash' END AS relation FROM (SELECT id, {_num('a')} AS na, {_let('a')} AS la, {_num('b')} AS nb, {_let('b')} AS lb FROM {_KEYS})")
def key_relation(spark, d):
    return _keys(spark, d).select("id", M.key_relation(F.col("a"), F.col("b")).alias("relation"))


_BPM = "(SELECT p_partkey AS id, p_retailprice / 10 AS rb, p_retailprice / 10 * [1.0, 2.01, 0.495, 3.2, 0.3333, 1.2][(p_partkey % 6 + 1)::INTEGER]::DOUBLE AS ours FROM part)"


def _bpms(spark, d):
    rb = F.col("p_retailprice") / 10
    factor = F.element_at(F.array(*map(F.lit, (1.0, 2.01, 0.495, 3.2, 0.3333, 1.2))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rb.alias("rb"), (rb * factor).alias("ours"))


_ERRORS = ", ".join(f"abs(ours - rb * {r!r}::DOUBLE) / (rb * {r!r}::DOUBLE) * 100.0::DOUBLE AS e_{n}" for n, r in M.RATIOS)
_BEST = "least(" + ", ".join(f"e_{n}" for n, _ in M.RATIOS) + ")"


@query("bpm_relation", f"SELECT id, CASE WHEN {_BEST} > 1.0 THEN 'other' {' '.join(f'WHEN e_{n} = {_BEST} THEN {chr(39)}{n}{chr(39)}' for n, _ in M.RATIOS)} END AS relation, round({_BEST}, 6) AS error FROM (SELECT *, {_ERRORS} FROM {_BPM})")
def bpm_relation(spark, d):
    found = M.bpm_relation(F.col("rb"), F.col("ours"))
    return _bpms(spark, d).select("id", found["relation"].alias("relation"), F.round(found["error"], 6).alias("error"))


@query("octave_correct", f"SELECT id, CASE WHEN up > 180 THEN up / 2 ELSE up END AS bpm FROM (SELECT id, CASE WHEN ours >= 80 THEN CASE WHEN ours > 360 THEN ours / 2 ELSE ours END WHEN ours * 2 >= 80 THEN ours * 2 ELSE ours * 4 END AS up FROM {_BPM})")
def octave_correct(spark, d):
    return _bpms(spark, d).select("id", M.octave_correct(F.col("ours")).alias("bpm"))


@query("octave_window", f"SELECT id, CASE WHEN hi - lo >= 10 THEN lo ELSE 60 END AS lo, CASE WHEN hi - lo >= 10 THEN hi ELSE 200 END AS hi FROM (SELECT id, greatest(60, trunc(ours / 1.4::DOUBLE)::INTEGER) AS lo, least(200, round_even(ours * 1.4::DOUBLE, 0)::INTEGER) AS hi FROM {_BPM})")
def octave_window(spark, d):
    found = M.octave_window(F.col("ours"), 60, 200)
    return _bpms(spark, d).select("id", found["lo"].alias("lo"), found["hi"].alias("hi"))


def _pairs(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


_PAIRS = "(SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(b.embedding, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query("cosine_distance", f"SELECT vec_id, round(1 - list_cosine_similarity(a, b), 6) AS distance FROM {_PAIRS}")
def cosine_distance(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(M.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("pearson", f"SELECT vec_id, round(corr(x, y), 5) AS r FROM (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM {_PAIRS}) GROUP BY 1")
def pearson(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(M.pearson(F.col("embedding"), F.col("other")), 5).alias("r"))


_WORDS = "list_transform({0}, lambda x: floor((greatest(least(x, 1.0::DOUBLE), -1.0::DOUBLE) + 1.0::DOUBLE) * 2147483647.0::DOUBLE)::BIGINT)"


@query("hamming_pairs", f"SELECT vec_id, round(1.0::DOUBLE - sum(bit_count(xor(x, y))) / 2048.0::DOUBLE, 6) AS similarity FROM (SELECT vec_id, unnest({_WORDS.format('a')}) AS x, unnest({_WORDS.format('b')}) AS y FROM {_PAIRS}) GROUP BY 1")
def hamming_pairs(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(M.hamming_similarity(M.words32(F.col("embedding")), M.words32(F.col("other"))), 6).alias("similarity"))


@query("fingerprint_pack", "SELECT vec_id, sum(CASE WHEN embedding[i + 1] - embedding[i] > embedding[i + 33] - embedding[i + 32] THEN 1 << (i - 1) ELSE 0 END)::BIGINT AS word FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, unnest(range(1, 32)) AS i FROM embeddings) GROUP BY 1")
def fingerprint_pack(spark, d):
    """One bit for each of 31 adjacent bands whose gradient is above that of the frame after."""
    rise = lambda i: F.element_at("embedding", i + 1).cast("double") - F.element_at("embedding", i).cast("double")
    word = F.lit(0).cast("long")
    for i in range(1, 32):
        word = word + F.when(rise(i) > rise(i + 32), F.lit(1 << (i - 1))).otherwise(F.lit(0)).cast("long")
    return table(spark, d, "embeddings").select("vec_id", word.alias("word"))


@query("mel_scale", "SELECT p_partkey AS id, round(2595.0::DOUBLE * log10(1.0 + p_retailprice / 700.0::DOUBLE), 6) AS mel, round(p_retailprice, 4) AS hz FROM part")
def mel_scale(spark, d):
    value = F.col("p_retailprice")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(M.mel(value), 6).alias("mel"), F.round(M.from_mel(M.mel(value)), 4).alias("hz"))


@query("quantize_log", "SELECT event_id AS id, round_even(pow(least(greatest((20 * log10(value / 500 + 1e-10::DOUBLE) + 60) / 60, 0), 1), 0.8::DOUBLE) * 31, 0)::INTEGER AS level FROM events")
def quantize_log(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), M.quantize_log(F.col("value") / 500, 31, 0.8).alias("level"))


@query("bit_pack", "SELECT p_partkey AS id, ((p_size & 7) << 5) | (p_size * 3 & 31) AS height, ((p_size & 7) << 13) | ((p_size * 2 & 7) << 10) | ((p_size * 5 & 7) << 7) | ((p_size * 3 & 31) << 2) AS color FROM part")
def bit_pack(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.pack_height(size, size * 3).alias("height"), M.pack_color(size, size * 2, size * 5, size * 3).alias("color"))


@query("rgb_split", "SELECT p_partkey AS id, (c >> 16) & 255 AS red, (c >> 8) & 255 AS green, c & 255 AS blue FROM (SELECT p_partkey, (p_partkey * 7919 + 123456) % 16777216 AS c FROM part)")
def rgb_split(spark, d):
    color = M.rgb((F.col("p_partkey") * 7919 + 123456) % 16777216)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *(color[c].alias(c) for c in ("red", "green", "blue")))


@query("stereo_features", "SELECT user_id, round(sqrt(avg((value - k) * (value - k))) / (sqrt(avg((value + k) * (value + k))) + 1e-9::DOUBLE), 6) AS width, round((sqrt(avg(k * k)) - sqrt(avg(value * value))) / (sqrt(avg(k * k)) + sqrt(avg(value * value))), 6) AS balance, round(corr(value, k), 6) AS phase FROM (SELECT user_id, value, (props->>'$.k')::DOUBLE AS k FROM events) GROUP BY 1")
def stereo_features(spark, d):
    left, right = F.col("value"), F.from_json("props", "k int")["k"].cast("double")
    rms = lambda x: F.sqrt(F.avg(x * x))
    rows = table(spark, d, "events").select("user_id", left.alias("l"), right.alias("r"))
    le, r = F.col("l"), F.col("r")
    return rows.groupBy("user_id").agg(F.round(rms(le - r) / (rms(le + r) + 1e-9), 6).alias("width"), F.round((rms(r) - rms(le)) / (rms(r) + rms(le)), 6).alias("balance"), F.round(F.corr("l", "r"), 6).alias("phase"))


@query("replay_gain", "SELECT event_id AS id, CASE WHEN lufs <= -100 THEN 0.0::DOUBLE ELSE round(-18.0::DOUBLE - lufs, 2) + 0.0::DOUBLE END AS gain FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -100.0::DOUBLE ELSE 10 * log10(value / 1000) - 0.691::DOUBLE END AS lufs FROM events)")
def replay_gain(spark, d):
    level = M.loudness(F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value") / 1000))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), M.replay_gain(level).alias("gain"))


_M = "(SELECT p_partkey AS id, 60 + (p_partkey % 170)::DOUBLE AS bpm, -(p_size % 30)::DOUBLE AS lufs, (p_size % 10) / 10.0::DOUBLE AS b, (p_partkey % 7) / 7.0::DOUBLE AS w, (p_size % 20) / 100.0::DOUBLE AS x FROM part)"


def _moods(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 170 + 60).cast("double").alias("bpm"), (-(F.col("p_size") % 30)).cast("double").alias("lufs"), ((F.col("p_size") % 10) / 10.0).alias("b"), ((F.col("p_partkey") % 7) / 7.0).alias("w"), ((F.col("p_size") % 20) / 100.0).alias("x"))


@query("mood_rules", f"SELECT id, CASE WHEN bpm > 130 AND lufs > -16 AND b > 0.4::DOUBLE THEN 'Energetic' WHEN bpm > 130 AND NOT b > 0.4::DOUBLE THEN 'Driving' WHEN b > 0.4::DOUBLE AND NOT bpm > 130 THEN 'Uplifting' WHEN w > 0.55::DOUBLE AND NOT lufs > -16 THEN 'Mellow' WHEN NOT b > 0.4::DOUBLE AND lufs > -16 THEN 'Dark' ELSE 'Balanced' END AS mood FROM {_M}")
def mood_rules(spark, d):
    return _moods(spark, d).select("id", M.mood(F.col("bpm"), F.col("lufs"), F.col("b"), F.col("w")).alias("mood"))


@query("genre_hint", f"""SELECT id, CASE WHEN bpm < 65 THEN 'Unknown' WHEN bpm <= 95 THEN CASE WHEN b < 0.3::DOUBLE THEN 'Reggae' WHEN x > 0.08::DOUBLE THEN 'Hip-Hop' ELSE 'Downtempo' END WHEN bpm <= 115 THEN CASE WHEN x > 0.07::DOUBLE THEN 'Hip-Hop' ELSE 'Pop' END WHEN bpm <= 130 THEN CASE WHEN b > 0.35::DOUBLE THEN 'House' ELSE 'Pop' END
    WHEN bpm <= 145 THEN CASE WHEN b > 0.4::DOUBLE THEN 'Techno' ELSE 'Electro' END WHEN bpm <= 165 THEN CASE WHEN b > 0.5::DOUBLE THEN 'Trance' ELSE 'Hard Dance' END WHEN bpm <= 185 THEN 'Drum & Bass' WHEN bpm <= 220 THEN 'Hardcore' ELSE 'Unknown' END AS genre FROM {_M}""")
def genre_hint(spark, d):
    return _moods(spark, d).select("id", M.genre_hint(F.col("bpm"), F.col("b"), F.col("x")).alias("genre"))


_WHEEL = f"[{', '.join(repr(x) for x in (*M.MAJOR, *M.MINOR))}]"


@query("key_maps", f"SELECT p_partkey AS id, {_WHEEL}[(p_partkey % 12 + 1 + 12 * (p_size % 2))::INTEGER] AS code FROM part")
def key_maps(spark, d):
    pitch = F.element_at(F.array(*map(F.lit, M.PITCHES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.key_code(F.lower(pitch), F.col("p_size") % 2 == 1).alias("code"))


@query("pvbr_linear", "SELECT p_partkey AS id, sum(floor(i * (1000 + p_partkey) / 400.0::DOUBLE))::BIGINT AS total FROM part, range(400) t(i) GROUP BY 1")
def pvbr_linear(spark, d):
    index = M.pvbr_index(F.col("p_partkey") + 1000)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.aggregate(index, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("resample_linear", "SELECT vec_id, i, round(e[k + 1] + (e[least(k + 1, 63) + 1] - e[k + 1]) * (p - k), 6) AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, i, i * 63.0::DOUBLE / 9.0 AS p, floor(i * 63.0::DOUBLE / 9.0)::INTEGER AS k FROM embeddings, range(10) t(i))")
def resample_linear(spark, d):
    points = M.resample_linear(F.col("embedding").cast("array<double>"), 10)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(points).alias("i", "value"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@query("unit_scaling", "SELECT p_partkey AS id, p_size % 6 * 51 AS stars, round_even(p_retailprice * 10, 0)::BIGINT AS bpm100, floor(p_partkey / 60)::BIGINT || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0') AS clock FROM part")
def unit_scaling(spark, d):
    clock = F.format_string("%d:%02d", F.floor(F.col("p_partkey") / 60), F.col("p_partkey") % 60)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 6 * 51).alias("stars"), F.bround(F.col("p_retailprice") * 10, 0).cast("long").alias("bpm100"), clock.alias("clock"))


@query("accuracy_summary", f"SELECT id % 5 AS band, count(*)::BIGINT AS n, avg(CASE WHEN abs(ours - rb) / rb <= 0.04::DOUBLE THEN 1.0 ELSE 0.0 END)::DOUBLE AS acc1, avg(CASE WHEN abs(ours - rb) / rb <= 0.04::DOUBLE OR abs(ours - 2 * rb) / (2 * rb) <= 0.04::DOUBLE OR abs(ours - rb / 2) / (rb / 2) <= 0.04::DOUBLE THEN 1.0 ELSE 0.0 END)::DOUBLE AS acc2 FROM {_BPM} GROUP BY 1")
def accuracy_summary(spark, d):
    near = lambda r: F.abs(F.col("ours") - F.col("rb") * r) / (F.col("rb") * r) <= 0.04
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return _bpms(spark, d).groupBy((F.col("id") % 5).alias("band")).agg(F.count("*").alias("n"), share(near(1.0)).alias("acc1"), share(near(1.0) | near(2.0) | near(0.5)).alias("acc2"))


@query("resample_nearest", "SELECT vec_id, list_transform(range(ceil(len(embedding) / (r / 16000.0::DOUBLE))::BIGINT), lambda i: embedding[least(floor(i * (r / 16000.0::DOUBLE))::BIGINT, len(embedding) - 1) + 1])::VARCHAR AS samples FROM (SELECT *, CASE vec_id % 4 WHEN 0 THEN 16000 WHEN 1 THEN 44100 WHEN 2 THEN 48000 ELSE 11025 END AS r FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(x * 1000)::INTEGER) AS embedding FROM embeddings))")
def resample_nearest(spark, d):
    """Vectors as samples of four rates, brought to one."""
    rate = F.element_at(F.array(*map(F.lit, (16000, 44100, 48000, 11025))), (F.col("vec_id") % 4 + 1).cast("int"))
    # A whole number would make the product a double, which falls on the other side of some whole numbers than a float.
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(1000).cast("float")).cast("int"))
    told = M.resample_nearest(whole, rate, 16000)
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(told, ", ", "NULL"), F.lit("]")).alias("samples"))


@query("loudness_lufs")
def loudness_lufs(spark, d):
    """The texts' bytes heard as 16-bit samples of 8 kHz, in chunks of a second."""
    size = 16000
    texts = table(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b"))
    last = F.floor(F.greatest(F.octet_length("b") - 1, F.lit(0)) / size).cast("int")
    chunks = texts.select(F.col("doc_id").alias("track"), F.lit(0).alias("channel"), "b", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    chunks = chunks.select("track", "channel", "chunk", F.substring("b", F.col("chunk") * size + 1, F.lit(size)).alias("samples"))
    return loudness.integrated_loudness(chunks, 8000, size // 2).withColumnRenamed("track", "doc_id")
