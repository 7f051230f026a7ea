import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewell.operators import effects, signal, spectral

RNG = np.random.default_rng(0)


def table(spark, clips, chunk):
    """Chunk table of {clip: (channels, frames) array}."""
    rows = []
    for clip, data in clips.items():
        for c, x in enumerate(np.atleast_2d(data)):
            for i, s in enumerate(range(0, len(x), chunk)):
                rows.append((clip, c, i, s, [float(v) for v in x[s : s + chunk]]))
    return spark.createDataFrame(rows, "clip_id int, channel int, chunk_idx int, start_frame bigint, samples array<double>")


def back(df):
    out = {}
    for r in df.orderBy("clip_id", "channel", "chunk_idx").collect():
        out.setdefault(r["clip_id"], {}).setdefault(r["channel"], []).extend(r["samples"])
    return {k: np.array([v[c] for c in sorted(v)], dtype=float) for k, v in out.items()}


@pytest.fixture(scope="module")
def clips():
    return {1: RNG.normal(size=(1, 50)), 2: RNG.normal(size=(1, 37)), 3: RNG.normal(size=(1, 16))}


def test_channels(spark):
    three = table(spark, {1: RNG.normal(size=(3, 20))}, 8)
    mono = table(spark, {1: RNG.normal(size=(1, 20))}, 8)
    data = back(three)[1]
    assert np.allclose(back(signal.convert_channels(three, 2))[1], data[:2])
    assert np.allclose(back(signal.convert_channels(three, 3))[1], data)
    assert np.allclose(back(signal.convert_channels(three, 1))[1], data.mean(0, keepdims=True))
    assert back(signal.convert_channels(mono, 3))[1].shape == (3, 20)
    two = signal.convert_channels(three, 2)
    with pytest.raises(Exception, match="fewer channels"):
        signal.convert_channels(two, 3).collect()


def test_normalisers_bound_loud_noise(spark):
    loud = table(spark, {1: 10 * RNG.normal(size=(2, 100)), 2: np.zeros((2, 10))}, 16)
    for ready in (signal.normalise_peak(loud), signal.normalise_clip(loud), signal.normalise_rms(loud)):
        out = back(ready)
        assert np.abs(out[1]).max() <= 1 and np.all(out[2] == 0)
    quiet = table(spark, {1: 0.1 * np.ones((1, 10))}, 16)
    assert np.allclose(back(signal.normalise_peak(quiet, normalise=False))[1], 0.1)


def test_pcm_is_the_identity_on_16_bits(spark):
    codes = RNG.integers(-(2**15), 2**15, size=(1, 64))
    df = table(spark, {1: codes}, 16).withColumn("samples", F.col("samples").cast("array<smallint>"))
    assert np.array_equal(back(signal.i16_pcm(signal.f32_pcm(df, 16)))[1], codes)
    full = table(spark, {1: np.array([[1.0, -1.0, 0.5]])}, 16)
    assert back(signal.i16_pcm(full))[1].tolist() == [[32767.0, -32767.0, 16384.0]]
    with pytest.raises(Exception, match="outside"):
        signal.i16_pcm(table(spark, {1: np.array([[1.5]])}, 16)).collect()
    with pytest.raises(ValueError):
        signal.f32_pcm(df, 24)


@pytest.mark.parametrize("window", [1, 5, 20])
def test_moving_average_over_chunk_borders(spark, clips, window):
    out = back(signal.moving_average(table(spark, clips, 8), window, 8))
    for clip, data in clips.items():
        x, expected = data[0], np.zeros(data.shape[1])
        for t in range(len(x) - window + 1):
            expected[t] = x[t : t + window].mean()
        assert np.allclose(out[clip][0], expected)


def test_echo(spark, clips):
    out = back(signal.echo(table(spark, clips, 8), 0.3, 12, 8))
    for clip, data in clips.items():
        x, wet = data[0], np.zeros(data.shape[1])
        valid = len(x) - 11
        wet[:valid] = x[:valid] + 0.3 * x[11 : 11 + valid]
        assert np.allclose(out[clip][0], wet / np.abs(wet).max() * np.abs(x).max())


def test_effects_keep_the_shape(spark, clips):
    params = {"echo": dict(volume=0.2, delay=5, chunk=8), "smooth": dict(window=3, chunk=8), "pink_noise": dict(chunk=8)}
    ready = effects.available_effects(params)
    for name, effect in ready.items():
        out = back(effect(table(spark, clips, 8)))
        assert {k: v.shape for k, v in out.items()} == {k: v.shape for k, v in clips.items()}, name


def test_effect_selection(spark):
    one = spark.range(1)
    pick = lambda *a, **k: one.select(effects.select_effects(*a, **k)).first()[0]
    assert pick([], 1) == ["identity"]
    assert pick(["b", "a"], 1) == ["a", "b"]
    assert pick(["a", "b"], 1, weights={"a": 0.0, "b": 2.0}, mode="weighted") == ["b"]
    assert pick(["a", "b"], 1, weights={"a": 0.0, "b": 0.0}, mode="weighted") == ["identity"]
    assert len(pick(["a", "b", "c"], 1, max_length=2)) == 2
    with pytest.raises(ValueError):
        effects.select_effects(["a"], 1, mode="other")


EPS = float(np.finfo(np.float32).eps)


def mixed(x, n, snr, start, level):
    n = np.pad(n, (0, max(0, len(x) - len(n))))[: len(x)]

    def levelled(v):
        v = v / (abs(v.max()) + EPS)
        return v * 10 ** (-25 / 20) / (np.sqrt((v**2).mean()) + EPS)

    x, n = levelled(x), levelled(n)
    rms = lambda v: np.sqrt((v**2).mean())
    n = n * (rms(x) / 10 ** (snr / 20) / (rms(n) + EPS))
    y = x.copy()
    y[start:] += n[: len(x) - start]
    y = y * 10 ** (level / 20) / (rms(y) + EPS)
    if (np.abs(y) > 0.99).any():
        y = y / (abs(y.max()) / (0.99 - EPS))
    return y


def test_snr_mix_of_unequal_lengths(spark, clips):
    pairs = spark.createDataFrame([("a", 1, 2), ("b", 3, 1), ("c", 2, 2)], "mix_id string, source int, target int")
    out = back(signal.snr_mix(table(spark, clips, 8), pairs, 8, "s", 3, 3, 0.4))
    from tonewell.functions.hashing import uniform, uniform_int

    for mix, source, target in (("a", 1, 2), ("b", 3, 1), ("c", 2, 2)):
        x, n = clips[source][0], clips[target][0]
        u, level = spark.range(1).select(uniform("s:start", F.lit(mix)), uniform_int(-35, -16, "s:level", F.lit(mix))).first()
        start = int(u * (int(len(x) * (1 - 0.4)) + 1))
        assert np.allclose(out[mix][0], mixed(x, n, 3, start, level), atol=1e-9)


def test_si_snr(spark, clips):
    est = {k: v + 0.1 * RNG.normal(size=v.shape) for k, v in clips.items()}
    frame, stride = 20, 10
    values = []
    for k in clips:
        r, e = clips[k][0], est[k][0]
        for f in range(-(-len(r) // stride)):
            cut = [np.pad(v[f * stride : f * stride + frame], (0, max(0, frame - len(v[f * stride : f * stride + frame])))) for v in (r, e)]
            g, h = (v - v.mean() for v in cut)
            proj = (g @ h) * g / (EPS * frame + g @ g)
            noise = h - proj
            values.append(10 * (np.log10(EPS * frame + proj @ proj) - np.log10(EPS * frame + noise @ noise)))
    got = signal.si_snr(table(spark, est, 8), table(spark, clips, 8), frame).first()
    assert got["frames"] == len(values) and abs(got["si_snr"] + np.mean(values)) < 1e-9


def whole_clip_frames(x, n_fft, hop, centre):
    """Magnitude frames of a whole clip by numpy padding."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    pad = n_fft // 2 if centre else (n_fft - hop) // 2
    padded = np.pad(x, pad, mode="reflect")
    if not centre:
        count = -(-len(x) // hop)
        padded = np.pad(padded, (0, max(0, (count - 1) * hop + n_fft - len(padded))))
    else:
        count = 1 + len(x) // hop
    return np.stack([np.abs(np.fft.rfft(padded[f * hop : f * hop + n_fft] * window)) for f in range(count)])


@pytest.mark.parametrize("centre", [True, False])
@pytest.mark.parametrize("chunk, n_fft, hop", [(8, 8, 4), (16, 16, 4), (4, 16, 4), (64, 32, 8)])
def test_frames_do_not_depend_on_chunks(spark, centre, chunk, n_fft, hop):
    clips = {1: RNG.normal(size=(1, 64)), 2: RNG.normal(size=(2, 51)), 3: RNG.normal(size=(1, 33))}
    out = spectral.spectral_frames(table(spark, clips, chunk), chunk, n_fft, hop, centre=centre)
    got = {}
    for r in out.orderBy("frame").collect():
        got.setdefault((r["clip_id"], r["channel"]), []).append(r["values"])
    for clip, data in clips.items():
        for c, x in enumerate(data):
            assert np.allclose(np.array(got[clip, c]), whole_clip_frames(x, n_fft, hop, centre)), (clip, c)


def test_identical_signals_have_no_loss(spark, clips):
    x = table(spark, {1: clips[1], 2: clips[2]}, 16)
    assert spectral.mel_l1(x, x, 16, n_fft=16, hop=4, n_mels=5, sample_rate=8000).first()[0] == 0
    assert spectral.multi_scale_mel(x, x, 16, 8000, 4, 6, n_mels=5).first()[0] == 0
    assert spectral.multi_resolution_stft(x, x, [16], [16], [8], [16]).first()["loss"] == 0
    volumes = spectral.relative_volume_mel(x, x, 16, 8000, n_mels=8, n_fft=16, hop=8).collect()
    assert {r["band"] for r in volumes} == {"rvm", "rvm_0", "rvm_1", "rvm_2", "rvm_3"}
    assert all(r["rvm"] == -25 for r in volumes)


def test_rechunk(spark, clips):
    out = signal.to_long(spectral.rechunk(table(spark, clips, 8), 5))
    plain = signal.to_long(table(spark, clips, 8))
    assert out.exceptAll(plain).count() == 0 and out.count() == plain.count()


def test_banks():
    mel = spectral.mel_bank(64, 6, 16000)
    assert mel.shape == (33, 6) and mel.min() >= 0 and mel.max() <= 1
    chroma = spectral.chroma_bank(4096, 16000)
    # Concert A is class 9 when counting from C, middle C is class 0.
    assert chroma.shape == (2049, 12)
    assert chroma[round(440 * 4096 / 16000)].argmax() == 9
    assert chroma[round(523.25 * 4096 / 16000)].argmax() == 0


def test_chroma_of_a_tone(spark):
    tone = {1: np.sin(2 * np.pi * 440 * np.arange(4096) / 16000)[None]}
    out = spectral.chroma_frames(table(spark, tone, 1024), 1024, 16000, 2048, 512, argmax=True).collect()
    assert len(out) == 9 and all(r["values"][9] == 1.0 and sum(r["values"]) == 1.0 for r in out)
