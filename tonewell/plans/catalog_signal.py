"""Registered queries: waveform tables, effects, spectral metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators import effects, signal
from tonewell.plans.catalog_metrics import V_SQL, vectors
from tonewell.plans.registry import joined, query, sql_u, table

CHUNK = 16


def waves(spark, sf):
    """A vector as a mono clip of 64 samples in chunks of 16."""
    return signal.from_arrays(vectors(spark, sf), "vec_id", "x", CHUNK)


def doubled(spark, sf):
    """The same clip with its negated half as second channel."""
    mono = waves(spark, sf)
    second = mono.withColumn("channel", F.lit(1)).withColumn("samples", A.scale(F.col("samples"), -0.5))
    return mono.unionByName(second)


def samples(df, digits: int = 9, channel: bool = False):
    long = signal.to_long(df)
    keep = ["clip_id", "channel", "t"] if channel else ["clip_id", "t"]
    return long.select(*keep, F.round("x", digits).alias("x"))


def sql_wave(expr: str, joins: str = "", digits: int = 9) -> str:
    return f"SELECT c.vec_id AS clip_id, c.i AS t, round({expr}, {digits}) AS x FROM cells c {joins}"


STATS_SQL = """
st AS (SELECT vec_id, max(abs(e)) AS peak, max(e) AS top, sqrt(avg(e * e)) AS rms FROM cells GROUP BY vec_id)
"""
WITH_STATS = f"WITH {V_SQL}, {STATS_SQL}"
JOIN_STATS = "JOIN st ON st.vec_id = c.vec_id"


@query(
    "channels_to_mono",
    f"WITH {V_SQL} {sql_wave('(e - 0.5 * e) / 2')}",
)
def channels_to_mono(spark, sf):
    return samples(signal.convert_channels(doubled(spark, sf), 1))


@query(
    "channels_to_stereo",
    f"""WITH {V_SQL} SELECT vec_id AS clip_id, CAST(ch AS INTEGER) AS channel, i AS t, round(e, 9) AS x
FROM cells, (SELECT unnest(range(2)) AS ch)""",
)
def channels_to_stereo(spark, sf):
    return samples(signal.convert_channels(waves(spark, sf), 2), channel=True)


@query("first_channels", f"WITH {V_SQL} {sql_wave('e')}")
def first_channels(spark, sf):
    three = doubled(spark, sf).unionByName(waves(spark, sf).withColumn("channel", F.lit(2)))
    return samples(signal.convert_channels(three, 2).filter(F.col("channel") == 0))


@query(
    "normalise_peak",
    f"""{WITH_STATS} SELECT c.vec_id AS clip_id, c.i AS t, round(e * power(10, -1 / 20.0) / peak, 9) AS x FROM cells c {JOIN_STATS}""",
)
def normalise_peak(spark, sf):
    return samples(signal.normalise_peak(waves(spark, sf), 1.0))


@query("normalise_clip", f"WITH {V_SQL} {sql_wave('least(greatest(e, -power(10, -14 / 20.0)), power(10, -14 / 20.0))')}")
def normalise_clip(spark, sf):
    return samples(signal.normalise_clip(waves(spark, sf), 14.0))


@query(
    "normalise_rms",
    f"""WITH {V_SQL}, st AS (SELECT vec_id, sqrt(avg(power((e - 0.5 * e) / 2, 2))) AS rms FROM cells GROUP BY vec_id)
SELECT c.vec_id AS clip_id, CAST(ch AS INTEGER) AS channel, c.i AS t,
  round(least(greatest(CASE WHEN ch = 0 THEN e ELSE -0.5 * e END * power(10, -6 / 20.0) / rms, -1), 1), 9) AS x
FROM cells c {JOIN_STATS}, (SELECT unnest(range(2)) AS ch)""",
)
def normalise_rms(spark, sf):
    return samples(signal.normalise_rms(doubled(spark, sf), 6.0), channel=True)


@query(
    "clip_report",
    f"""WITH {V_SQL} SELECT vec_id AS clip_id, round(avg(CAST(abs(e * 6) > 1 AS INTEGER)), 9) AS clipped_share, round(max(abs(e * 6)), 9) AS peak,
  max(abs(e * 6)) > 0.99 AS clipped, round(sqrt(avg(e * e * 36)), 9) AS rms FROM cells GROUP BY vec_id""",
)
def clip_report(spark, sf):
    loud = waves(spark, sf).withColumn("samples", A.scale(F.col("samples"), 6.0))
    out = signal.clip_report(loud).join(signal.is_clipped(loud), "clip_id").join(signal.clip_rms(loud), "clip_id")
    return out.select(
        "clip_id", F.round("clipped_share", 9).alias("clipped_share"), F.round("peak", 9).alias("peak"), "clipped",
        F.round("rms", 9).alias("rms"),
    )


@query(
    "pcm_round_trip",
    f"""{WITH_STATS}, f AS (SELECT vec_id, peak, CASE WHEN round_even(top / peak * 32768, 0) >= 32768 THEN 32767.0 ELSE 32768.0 END AS f FROM st)
SELECT c.vec_id AS clip_id, c.i AS t, CAST(round_even(e * (1.0 / peak) * f, 0) AS SMALLINT) AS code,
  round(CAST(round_even(e * (1.0 / peak) * f, 0) AS SMALLINT) / 32768.0, 9) AS x
FROM cells c JOIN f ON f.vec_id = c.vec_id""",
)
def pcm_round_trip(spark, sf):
    coded = signal.i16_pcm(signal.normalise_peak(waves(spark, sf), 0.0))
    back = signal.to_long(signal.f32_pcm(coded, 16))
    codes = signal.to_long(coded).select("clip_id", "t", F.col("x").alias("code"))
    return codes.join(back.select("clip_id", "t", F.round("x", 9).alias("x")), ["clip_id", "t"])


@query(
    "normalise_level",
    f"{WITH_STATS} {sql_wave('e * power(10, -25 / 20.0) / (rms + 1.1920928955078125e-07)', JOIN_STATS)}",
)
def normalise_level(spark, sf):
    return samples(signal.normalise_level(waves(spark, sf)))


@query(
    "volume_renormalised",
    f"""{WITH_STATS} SELECT c.vec_id AS clip_id, c.i AS t, round(e / (1e-8 + rms), 9) AS x, round(e, 6) AS back FROM cells c {JOIN_STATS}""",
)
def volume_renormalised(spark, sf):
    scaled, scales = signal.renormalise_volume(waves(spark, sf))
    back = signal.to_long(signal.restore_volume(scaled, scales)).select("clip_id", "t", F.round("x", 6).alias("back"))
    return samples(scaled).join(back, ["clip_id", "t"])


@query("boost_and_duck", f"WITH {V_SQL} {sql_wave('e * 1.2 * 0.7')}")
def boost_and_duck(spark, sf):
    ready = effects.available_effects({"duck_audio": {"amount": 30.0}})
    return samples(ready["duck_audio"](ready["boost_audio"](ready["identity"](waves(spark, sf)))))


def sql_normal(seed: str, *keys: str) -> str:
    return (
        f"(sqrt(-2.0 * ln(1.0 - {sql_u(f'{seed}:r', *keys)})) * cos(6.283185307179586 * {sql_u(f'{seed}:a', *keys)}))"
    )


@query("white_noise", f"WITH {V_SQL} {sql_wave('e + 0.05 * ' + sql_normal('white', 'c.vec_id', '0', 'c.i'))}")
def white_noise(spark, sf):
    return samples(signal.white_noise(waves(spark, sf), 0.05))


@query(
    "pink_noise",
    f"""WITH {V_SQL}, n AS (SELECT vec_id, i, sum({sql_normal('pink', 'vec_id', 'i')}) OVER (PARTITION BY vec_id, i // 5 ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM cells),
p AS (SELECT vec_id, max(abs(n)) AS peak FROM n GROUP BY vec_id)
SELECT c.vec_id AS clip_id, c.i AS t, round(e + 0.05 * n.n / peak, 9) AS x FROM cells c JOIN n ON n.vec_id = c.vec_id AND n.i = c.i JOIN p ON p.vec_id = c.vec_id""",
)
def pink_noise(spark, sf):
    return samples(signal.pink_noise(waves(spark, sf), CHUNK, 0.05))


@query(
    "moving_average",
    f"""WITH {V_SQL} SELECT vec_id AS clip_id, i AS t, CASE WHEN i <= 44 THEN round(avg(e) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), 9) ELSE 0.0 END AS x FROM cells""",
)
def moving_average(spark, sf):
    return samples(signal.moving_average(waves(spark, sf), 20, CHUNK))


@query(
    "echo",
    f"""{WITH_STATS}, y AS (SELECT vec_id, i, CASE WHEN i <= 64 - 37 THEN e + 0.4 * lead(e, 36) OVER (PARTITION BY vec_id ORDER BY i) ELSE 0.0 END AS y FROM cells),
p AS (SELECT vec_id, max(abs(y)) AS wet FROM y GROUP BY vec_id)
SELECT y.vec_id AS clip_id, y.i AS t, round(y * st.peak / wet, 9) AS x FROM y JOIN p ON p.vec_id = y.vec_id JOIN st ON st.vec_id = y.vec_id""",
)
def echo(spark, sf):
    return samples(signal.echo(waves(spark, sf), 0.4, 37, CHUNK))


@query(
    "selected_effects",
    f"""WITH n AS (SELECT * FROM (VALUES ('boost_audio', 0.5), ('duck_audio', 0.2), ('smooth', 1.0), ('echo', 0.4)) t(name, w)),
k AS (SELECT user_id, event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY {sql_u('fx:cap', 'event_id', 'name')}, name) AS r
  FROM events, n WHERE {sql_u('fx:pick', 'event_id', 'name')} < w AND name <> 'smooth')
SELECT e.event_id, coalesce(x.names, 'identity') AS names FROM events e LEFT JOIN (
  SELECT event_id, string_agg(name, ',' ORDER BY name) AS names FROM k WHERE r <= 2 GROUP BY event_id) x ON x.event_id = e.event_id""",
)
def selected_effects(spark, sf):
    chosen = effects.select_effects(
        ["boost_audio", "duck_audio", "echo"], "fx", F.col("event_id"),
        weights={"boost_audio": 0.5, "duck_audio": 0.2, "echo": 0.4}, mode="weighted", max_length=2,
    )
    return table(spark, sf, "events").select("event_id", joined(chosen).alias("names"))


@query(
    "effect_variants",
    f"""WITH {V_SQL},
k AS (SELECT vec_id, 'boost_audio' AS effect, 1.2 AS f FROM v WHERE {sql_u('fx:pick', 'vec_id', "'boost_audio'")} < 0.5
  UNION ALL SELECT vec_id, 'duck_audio', 0.8 FROM v WHERE {sql_u('fx:pick', 'vec_id', "'duck_audio'")} < 0.4),
e AS (SELECT * FROM k UNION ALL SELECT vec_id, 'identity', 1.0 FROM v WHERE vec_id NOT IN (SELECT vec_id FROM k))
SELECT effect, c.vec_id AS clip_id, c.i AS t, round(c.e * f, 9) AS x FROM cells c JOIN e ON e.vec_id = c.vec_id""",
)
def effect_variants(spark, sf):
    """Every clip under the effects drawn for it."""
    wave = waves(spark, sf)
    names = effects.select_effects(
        ["boost_audio", "duck_audio"], "fx", F.col("clip_id"), weights={"boost_audio": 0.5, "duck_audio": 0.4}, mode="weighted"
    )
    chosen = wave.select("clip_id").distinct().withColumn("names", names)
    known = effects.available_effects()
    made = effects.effect_variants(wave, chosen, {n: known[n] for n in ("boost_audio", "duck_audio", "identity")})
    rows = made.select("effect", "clip_id", "start_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select("effect", "clip_id", (F.col("start_frame") + F.col("i")).alias("t"), F.round("x", 9).alias("x"))


# The bits of a 32-bit float from its sign, exponent and fraction, lowest byte first.
@query(
    "reference_ids",
    f"""WITH {V_SQL}, p AS (SELECT vec_id, i, e, abs(e) AS a, CAST(floor(log2(nullif(abs(e), 0))) AS BIGINT) AS x FROM cells),
q AS (SELECT vec_id, i, e, a, x + CASE WHEN a / pow(2, x) >= 2 THEN 1 WHEN a / pow(2, x) < 1 THEN -1 ELSE 0 END AS x FROM p),
b AS (SELECT vec_id, i, CASE WHEN a = 0 THEN 0 ELSE (CASE WHEN e < 0 THEN 2147483648 ELSE 0 END) + (x + 127) * 8388608
  + CAST(round((a / pow(2, x) - 1) * 8388608) AS BIGINT) END AS n FROM q),
h AS (SELECT vec_id, sha1(unhex(string_agg(printf('%02x%02x%02x%02x', n % 256, (n // 256) % 256, (n // 65536) % 256, n // 16777216), '' ORDER BY i))) AS own
  FROM b GROUP BY vec_id)
SELECT vec_id AS clip_id, own, 's' || CAST(vec_id AS VARCHAR) AS reused FROM h""",
)
def reference_ids(spark, sf):
    """Ids of prompts by their own samples, and reused from the sample."""
    from tonewell.functions import text as X
    from tonewell.sources import wav

    found = wav.clip_digests(waves(spark, sf))
    name = F.concat(F.lit("s"), F.col("clip_id").cast("string"))
    return found.select(
        "clip_id", X.reference_id(F.col("digest"), name, False).alias("own"), X.reference_id(F.col("digest"), name, True).alias("reused")
    )


# Mixing: a vector is mixed with the vector of the next id.
EPS = "1.1920928955078125e-07"
# Samples of the mixes in ``pr`` (mix_id, source, target, snr, lvl, st).
MIXED_SQL = f"""
cs AS (SELECT vec_id, max(e) AS top, sqrt(avg(e * e)) AS rms FROM cells GROUP BY vec_id),
g AS (SELECT vec_id, 1.0 / (abs(top) + {EPS}) * power(10, -25 / 20.0) / (rms / (abs(top) + {EPS}) + {EPS}) AS g, rms FROM cs),
gp AS (SELECT pr.*, a.g AS a, b.g * (a.g * a.rms / power(10, snr / 20.0) / (b.g * b.rms + {EPS})) AS b
  FROM pr JOIN g a ON a.vec_id = source JOIN g b ON b.vec_id = target),
y AS (SELECT mix_id, lvl, x.i, a * x.e + b * coalesce(n.e, 0) AS y FROM gp JOIN cells x ON x.vec_id = source
  LEFT JOIN cells n ON n.vec_id = target AND n.i = x.i - st),
ys AS (SELECT mix_id, max(y) AS top, max(abs(y)) AS peak, power(10, max(lvl) / 20.0) / (sqrt(avg(y * y)) + {EPS}) AS s FROM y GROUP BY mix_id),
mixed AS (SELECT y.mix_id, y.i AS t, round(y * CASE WHEN peak * s > 0.99 THEN s / (abs(top * s) / (0.99 - {EPS})) ELSE s END, 6) AS x
  FROM y JOIN ys ON ys.mix_id = y.mix_id)"""


def drawn_sql(seed, key):
    """SNR, level and start of a mix."""
    return f"""floor({sql_u(f'{seed}:snr', key)} * 10) - 5 AS snr, floor({sql_u(f'{seed}:level', key)} * 20) - 35 AS lvl,
   CAST(floor({sql_u(f'{seed}:start', key)} * 33) AS BIGINT) AS st"""


MIX_SQL = f"""
WITH {V_SQL}, ids AS (SELECT vec_id AS source, lead(vec_id) OVER (ORDER BY vec_id) AS target FROM v),
pr AS (SELECT source || '>' || target AS mix_id, source, target, {drawn_sql('snr', "source || '>' || target")} FROM ids WHERE target IS NOT NULL),
{MIXED_SQL}
SELECT mix_id AS clip_id, t, x FROM mixed"""


def next_pairs(spark, sf):
    """Pairs of consecutive ids: the ids are the positions of a running count."""
    from tonewell.operators.scans import sorted_positions

    placed = sorted_positions(vectors(spark, sf).select("vec_id"), [], ["vec_id"])
    nxt = placed.select(F.col("vec_id").alias("target"), (F.col("pos") - 1).alias("pos"))
    pairs = placed.withColumnRenamed("vec_id", "source").join(nxt, "pos").drop("pos")
    return pairs.withColumn("mix_id", F.concat_ws(">", F.col("source").cast("string"), F.col("target").cast("string")))


@query("snr_mix", MIX_SQL)
def snr_mix(spark, sf):
    mixed = signal.snr_mix(waves(spark, sf), next_pairs(spark, sf), CHUNK, "snr", -5, 5, 0.5)
    return samples(mixed, 6)


@query(
    "mixed_batches",
    f"""WITH {V_SQL}, s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {sql_u('mb:source', 'label', 'vec_id')}, vec_id) - 1 AS rank,
   count(*) OVER (PARTITION BY label) AS n FROM embeddings),
t AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {sql_u('mb:target', 'label', 'vec_id')}, vec_id) - 1 AS rank FROM embeddings),
pairs AS (SELECT s.label, s.vec_id AS source, t.vec_id AS target, {sql_u('mb:mix', 's.label')} < 0.5 AS mixing
   FROM s JOIN t ON t.label = s.label AND t.rank = s.rank WHERE s.rank < floor(s.n * 0.5)),
pr AS (SELECT label, source || '+' || target AS mix_id, source, target, {drawn_sql('mb', 'label')} FROM pairs WHERE mixing),
{MIXED_SQL}
SELECT pr.label, pr.mix_id AS clip_id, CASE WHEN source <> target THEN 'd' || source || ' d' || target ELSE 'd' || source END AS description, t, x
FROM pr JOIN mixed USING (mix_id)
UNION ALL SELECT p.label, CAST(source AS VARCHAR), 'd' || source, c.i, round(c.e, 6) FROM pairs p JOIN cells c ON c.vec_id = p.source WHERE NOT mixing""",
)
def mixed_batches(spark, sf):
    items = vectors(spark, sf).select(
        "label", F.col("vec_id").alias("clip_id"), F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("description")
    )
    wave, texts = signal.mix_samples(waves(spark, sf), items, "label", CHUNK, "mb", 0.5, 0.5, -5, 5, 0.5)
    return texts.join(samples(wave, 6), "clip_id").select("label", "clip_id", "description", "t", "x")


@query(
    "si_snr",
    f"""WITH {V_SQL}, f AS (SELECT vec_id, CAST(unnest(range(4)) AS INTEGER) AS f FROM v),
p AS (SELECT f.vec_id, f.f, coalesce(c.e, 0.0) AS r, coalesce(c.e + 0.1 * c.e * c.e + 0.03, 0.0) AS e FROM f, (SELECT unnest(range(32)) AS k)
   LEFT JOIN cells c ON c.vec_id = f.vec_id AND c.i = f.f * 16 + k),
m AS (SELECT vec_id, f, avg(r) AS mr, avg(e) AS me FROM p GROUP BY 1, 2),
d AS (SELECT p.vec_id, p.f, sum((r - mr) * (e - me)) AS dot, sum((r - mr) * (r - mr)) AS rr FROM p JOIN m ON m.vec_id = p.vec_id AND m.f = p.f GROUP BY 1, 2),
s AS (SELECT p.vec_id, p.f, sum(power(dot * (r - mr) / (32 * {EPS} + rr), 2)) AS proj, sum(power(e - me - dot * (r - mr) / (32 * {EPS} + rr), 2)) AS noise
  FROM p JOIN m ON m.vec_id = p.vec_id AND m.f = p.f JOIN d ON d.vec_id = p.vec_id AND d.f = p.f GROUP BY 1, 2)
SELECT round(-avg(10 * (log10(32 * {EPS} + proj) - log10(32 * {EPS} + noise))), 6) AS si_snr, count(*) AS frames FROM s""",
)
def si_snr(spark, sf):
    reference = waves(spark, sf)
    estimate = reference.withColumn("samples", F.transform("samples", lambda x: x + 0.1 * x * x + 0.03))
    return signal.si_snr(estimate, reference, 32).withColumn("si_snr", F.round("si_snr", 6))


@query(
    "decibels",
    """SELECT event_id, round(20 * log10(greatest(value / 100.0, power(10, -20 / 20.0))), 9) AS db, round(power(10, -value / 20.0), 9) AS scale FROM events""",
)
def decibels(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.round(A.scale_to_db(F.col("value") / 100.0, -20.0), 9).alias("db"),
        F.round(A.db_to_scale(-F.col("value")), 9).alias("scale"),
    )


@query(
    "smoothed_counts",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, round((n + 1e-5) / (sum(n) OVER () + 5 * 1e-5), 12) AS smoothed FROM c""",
)
def smoothed_counts(spark, sf):
    from tonewell.operators.quantise import laplace_smooth

    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return laplace_smooth(counts, "n", 5).select("event_type", F.round("smoothed", 12).alias("smoothed"))


# Spectral frames: n_fft 16, hop 8, window 16 on clips of 64 samples.
def estimate(spark, sf):
    return waves(spark, sf).withColumn("samples", F.transform("samples", lambda x: x + 0.5 * x * x))


def dft(name: str, expr: str, n_fft: int, hop: int, win: int, centre: bool, floor: float = 0.0, scale: str = "1.0") -> str:
    """SQL of squared magnitudes (vec_id, f, k, s) of whole clips of 64 samples, step by step:
    mirrored positions, window, sums of cosines and sines."""
    pad = n_fft // 2 if centre else (n_fft - hop) // 2
    frames = 1 + 64 // hop if centre else -(-64 // hop)
    left = (n_fft - win) // 2
    return f"""
{name}_at AS (SELECT f, n, CASE WHEN q < 0 THEN -q WHEN q >= {64 + pad} THEN -1 WHEN q >= 64 THEN 126 - q ELSE q END AS at,
   CASE WHEN n >= {left} AND n < {left + win} THEN 0.5 - 0.5 * cos(2 * pi() * (n - {left}) / {win}) ELSE 0 END AS w
  FROM (SELECT f, n, f * {hop} - {pad} + n AS q FROM (SELECT unnest(range({frames})) AS f), (SELECT unnest(range({n_fft})) AS n))),
{name} AS (SELECT vec_id, f, k, greatest({scale} * (power(sum(v * cos(2 * pi() * k * n / {n_fft})), 2) + power(sum(v * sin(2 * pi() * k * n / {n_fft})), 2)), {floor}) AS s
  FROM (SELECT c.vec_id, p.f, p.n, ({expr}) * p.w AS v FROM {name}_at p JOIN cells c ON c.i = p.at),
   (SELECT unnest(range({n_fft // 2 + 1})) AS k) GROUP BY vec_id, f, k)"""


def mel_sql(name: str, source: str, n_fft: int, n_mels: int, rate: int) -> str:
    """SQL of mel values (vec_id, f, m, e): triangles between evenly spaced mel points."""
    step = f"(2595 * log10(1 + {rate / 2} / 700.0) / {n_mels + 1})"

    def edge(j: str) -> str:
        return f"(700 * (power(10, ({j}) * {step} / 2595) - 1))"

    freq = f"(k * {rate // 2 / (n_fft // 2)})"
    return f"""
{name} AS (SELECT vec_id, f, m, sum(s * greatest(least(({freq} - {edge('m')}) / ({edge('m + 1')} - {edge('m')}),
    ({edge('m + 2')} - {freq}) / ({edge('m + 2')} - {edge('m + 1')})), 0)) AS e
  FROM {source}, (SELECT unnest(range({n_mels})) AS m) GROUP BY vec_id, f, m)"""


EST = "e + 0.5 * e * e"


@query(
    "stft_frames",
    f"WITH {V_SQL}, {dft('d', 'e', 16, 8, 16, True, 1e-7)} SELECT vec_id AS clip_id, f AS frame, CAST(k AS INTEGER) AS bin, round(sqrt(s), 6) AS x FROM d",
)
def stft_frames(spark, sf):
    from tonewell.operators import spectral

    frames = spectral.stft_frames(waves(spark, sf), CHUNK, 16, 8, 16)
    return frames.select("clip_id", "frame", F.posexplode("values").alias("bin", "x")).withColumn("x", F.round("x", 6))


@query(
    "stft_losses",
    f"""WITH {V_SQL}, {dft('r', 'e', 16, 8, 16, True, 1e-7)}, {dft('s', EST, 16, 8, 16, True, 1e-7)},
j AS (SELECT vec_id, sqrt(s.s) AS e, sqrt(r.s) AS r FROM r JOIN s USING (vec_id, f, k))
SELECT round(sqrt(sum((e - r) * (e - r))) / (sqrt(sum(r * r)) + {EPS}), 6) AS convergence,
  round(avg(abs(ln({EPS} + r) - ln({EPS} + e))), 6) AS log_l1,
  round(0.1 * sqrt(sum((e - r) * (e - r))) / (sqrt(sum(r * r)) + {EPS}) + 0.1 * avg(abs(ln({EPS} + r) - ln({EPS} + e))), 6) AS loss FROM j""",
)
def stft_losses(spark, sf):
    from tonewell.operators import spectral

    out = spectral.multi_resolution_stft(estimate(spark, sf), waves(spark, sf), [CHUNK], [16], [8], [16])
    return out.withColumns({c: F.round(c, 6) for c in ("convergence", "log_l1", "loss")})



def _multi_resolution_sql() -> str:
    parts, rows = [V_SQL], []
    for i, (n_fft, hop, win) in enumerate(((16, 8, 12), (32, 16, 24), (8, 5, 6))):
        parts += [dft(f"r{i}", "e", n_fft, hop, win, True, 1e-7), dft(f"s{i}", EST, n_fft, hop, win, True, 1e-7)]
        rows.append(
            f"SELECT sqrt(sum(power(sqrt(s.s) - sqrt(r.s), 2))) / (sqrt(sum(r.s)) + {EPS}) AS c, "
            f"avg(abs(ln({EPS} + sqrt(r.s)) - ln({EPS} + sqrt(s.s)))) AS l FROM r{i} r JOIN s{i} s USING (vec_id, f, k)"
        )
    return (
        f"WITH {', '.join(parts)} SELECT round(avg(c), 6) AS convergence, round(avg(l), 6) AS log_l1, "
        f"round(0.1 * avg(c) + 0.1 * avg(l), 6) AS loss FROM ({' UNION ALL '.join(rows)})"
    )


@query("multi_resolution_stft", _multi_resolution_sql())
def multi_resolution_stft(spark, sf):
    from tonewell.operators import spectral

    out = spectral.multi_resolution_stft(
        estimate(spark, sf), waves(spark, sf), [32, 32, 15], [16, 32, 8], [8, 16, 5], [12, 24, 6], rechunk=spectral.rechunk
    )
    return out.withColumns({c: F.round(c, 6) for c in ("convergence", "log_l1", "loss")})


def _mel_losses_sql() -> str:
    parts, scales = [V_SQL], []
    for i in (4, 5):
        size = 2**i
        parts += [dft(f"r{i}", "e", size, size // 4, size, False), dft(f"s{i}", EST, size, size // 4, size, False)]
        parts += [mel_sql(f"mr{i}", f"r{i}", size, 6, 16000), mel_sql(f"ms{i}", f"s{i}", size, 6, 16000)]
        scales.append(
            f"SELECT avg(abs(s.e - r.e)) + sqrt({size - 1}) * avg(power(log10(s.e + 1e-5) - log10(r.e + 1e-5), 2)) AS loss "
            f"FROM mr{i} r JOIN ms{i} s USING (vec_id, f, m)"
        )
    return f"""WITH {', '.join(parts)} SELECT
 round((SELECT avg(abs(log10(s.e + 1e-5) - log10(r.e + 1e-5))) FROM mr4 r JOIN ms4 s USING (vec_id, f, m)), 6) AS mel_l1,
 round((SELECT sum(loss) FROM ({' UNION ALL '.join(scales)})) / (sqrt(15) + sqrt(31) + 2), 6) AS multi_scale"""


@query("mel_losses", _mel_losses_sql())
def mel_losses(spark, sf):
    from tonewell.operators import spectral

    est, ref = estimate(spark, sf), waves(spark, sf)
    plain = spectral.mel_l1(est, ref, CHUNK, n_fft=16, hop=4, n_mels=6, sample_rate=16000)
    scales = spectral.multi_scale_mel(est, ref, CHUNK, 16000, 4, 6, n_mels=6, normalised=True)
    one = F.lit(1).alias("k")
    return (
        plain.select(F.round("l1", 6).alias("mel_l1"), one)
        .join(scales.select(F.round("loss", 6).alias("multi_scale"), one), "k")
        .drop("k")
    )


# The scale of the reference cancels in the mel ratio only after the floors, so it is applied first.
RVM_SCALE = "(1.0 / 6.0 / (SELECT power(greatest(sqrt(avg(e * e)), power(10, -25 / 20.0)), 2) FROM cells))"


@query(
    "relative_volume_mel",
    f"""WITH {V_SQL}, {dft('r', 'e', 16, 8, 16, True, scale=RVM_SCALE)}, {dft('s', EST, 16, 8, 16, True, scale=RVM_SCALE)},
{mel_sql('mr', 'r', 16, 8, 16000)}, {mel_sql('ms', 's', 16, 8, 16000)},
b AS (SELECT m, avg(greatest(least(20 * log10(greatest(abs(sqrt(r.e) - sqrt(s.e)), power(10, -6))) - 20 * log10(greatest(sqrt(r.e), power(10, -25 / 20.0))), 25), -25)) AS v
  FROM mr r JOIN ms s USING (vec_id, f, m) GROUP BY m)
SELECT 'rvm_' || CAST(CAST(floor(m / 2) AS INTEGER) AS VARCHAR) AS band, round(avg(v), 5) AS rvm FROM b GROUP BY 1
UNION ALL SELECT 'rvm', round(avg(v), 5) FROM b""",
)
def relative_volume_mel(spark, sf):
    from tonewell.operators import spectral

    out = spectral.relative_volume_mel(
        estimate(spark, sf), waves(spark, sf), CHUNK, sample_rate=16000, n_mels=8, n_fft=16, hop=8, bands=4
    )
    return out.withColumn("rvm", F.round("rvm", 5))


def chroma_sql(name: str, source: str, n_fft: int, rate: int) -> str:
    """SQL of chroma values (vec_id, f, c, v) over the largest one of their frame."""
    return f"""
{name} AS (SELECT vec_id, f, c, e / greatest(max(abs(e)) OVER (PARTITION BY vec_id, f), 1e-6) AS v FROM (
  SELECT vec_id, f, c, sum(s * w) AS e FROM {source} JOIN bank USING (k) GROUP BY vec_id, f, c))"""


BANK_SQL = """
pitch AS (SELECT k, CASE WHEN k = 0 THEN 12 * log2(500 / 27.5) - 18 ELSE 12 * log2(k * 500 / 27.5) END AS p FROM (SELECT unnest(range(17)) AS k)),
width AS (SELECT k, p, greatest(12 * log2((k + 1) * 500 / 27.5) - p, 1.0) AS b FROM pitch),
raw AS (SELECT k, p, c, exp(-0.5 * power(2 * (((p - c + 126) - 12 * floor((p - c + 126) / 12)) - 6) / b, 2)) AS g FROM width, (SELECT unnest(range(12)) AS c)),
bank AS (SELECT k, (c + 9) % 12 AS c, g / sqrt(sum(g * g) OVER (PARTITION BY k)) * exp(-0.5 * power((p / 12 - 5) / 2, 2)) AS w FROM raw)
"""


@query(
    "chroma_cosine",
    f"""WITH {V_SQL}, {BANK_SQL}, {dft('r', 'e', 32, 8, 32, True, scale='(1.0 / 12.0)')}, {dft('s', EST, 32, 8, 32, True, scale='(1.0 / 12.0)')},
{chroma_sql('cr', 'r', 32, 16000)}, {chroma_sql('cs', 's', 32, 16000)},
d AS (SELECT vec_id, f, sum(r.v * s.v) / (sqrt(sum(r.v * r.v)) * sqrt(sum(s.v * s.v))) AS c FROM cr r JOIN cs s USING (vec_id, f, c) WHERE f < 8 GROUP BY vec_id, f)
SELECT round(sum(c) / (SELECT count(*) * 8 FROM v), 6) AS cosine, (SELECT count(*) * 8 FROM v) AS frames FROM d""",
)
def chroma_cosine(spark, sf):
    from tonewell.operators import metrics, spectral

    def chroma(wave):
        return spectral.chroma_frames(wave, CHUNK, 16000, 32, 8)

    pairs = spectral.pair_frames(chroma(estimate(spark, sf)), chroma(waves(spark, sf)))
    frames = pairs.select(
        F.col("clip_id").alias("item"), "frame", F.lit(64).alias("size"),
        F.col("est").alias("pred"), F.col("ref").alias("target"),
    )
    return metrics.frame_cosine(frames, 8).withColumn("cosine", F.round("cosine", 6))
