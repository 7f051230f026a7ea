"""Spectral frames of waveform tables and the metrics on them.

Each chunk carries a halo of neighbour samples, computes the frames that start
inside it, and never needs its whole clip: one shuffle for the halo, then Arrow
batches through numpy's FFT. Frames are rows (clip_id, channel, frame, values).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.operators.signal import EPS32, KEYS, with_halo
from tonewell.session import written

FRAME_KEYS = [*KEYS, "frame"]
# Window values held in memory before a task transforms and hands them on.
MAX_VALUES = 4_000_000
FRAME_SCHEMA = "clip_id {clip}, channel int, frame bigint, values array<double>"


def hann(size: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def mel_bank(n_fft: int, n_mels: int, sample_rate: float, f_min: float = 0.0, f_max: float | None = None) -> np.ndarray:
    """Triangular filters, evenly spaced in mel (2595 log10(1 + f / 700)): (n_fft // 2 + 1, n_mels)."""
    f_max = sample_rate / 2 if f_max is None else f_max
    low, high = (2595.0 * np.log10(1.0 + f / 700.0) for f in (f_min, f_max))
    edges = 700.0 * (10.0 ** (np.linspace(low, high, n_mels + 2) / 2595.0) - 1.0)
    bins = np.linspace(0, sample_rate // 2, n_fft // 2 + 1)[:, None]
    rising = (bins - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    falling = (edges[None, 2:] - bins) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rising, falling), 0.0, None)


def chroma_bank(n_fft: int, sample_rate: float, n_chroma: int = 12) -> np.ndarray:
    """Pitch-class filters (n_fft // 2 + 1, n_chroma), class 0 is C.

    A bin lies at n_chroma * log2(f / 27.5) pitch steps; its weight per class is
    a Gaussian of the circular distance, normalised per bin and damped away from
    octave 5 with a width of 2 octaves.
    """
    freqs = np.linspace(0, sample_rate, n_fft, endpoint=False)[1:]
    steps = n_chroma * np.log2(freqs / 27.5)
    steps = np.concatenate([[steps[0] - 1.5 * n_chroma], steps])
    width = np.concatenate([np.maximum(np.diff(steps), 1.0), [1.0]])
    half = round(n_chroma / 2)
    distance = np.mod(steps[:, None] - np.arange(n_chroma) + half + 10 * n_chroma, n_chroma) - half
    weights = np.exp(-0.5 * (2 * distance / width[:, None]) ** 2)
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    weights *= np.exp(-0.5 * ((steps / n_chroma - 5.0) / 2.0) ** 2)[:, None]
    # Pitch steps count from A; classes count from C.
    weights = np.roll(weights, -3 * (n_chroma // 12), axis=1)
    return weights[: n_fft // 2 + 1]


def _reflect(index: np.ndarray, length: int) -> np.ndarray:
    """Mirror positions outside of [0, length) once at each end."""
    index = np.abs(index)
    return np.where(index >= length, 2 * (length - 1) - index, index)


def spectral_frames(
    signal: DataFrame,
    chunk: int,
    n_fft: int,
    hop: int,
    win_length: int | None = None,
    power: float = 1.0,
    normalised: bool = False,
    floor: float = 0.0,
    bank: np.ndarray | None = None,
    centre: bool = True,
) -> DataFrame:
    """Magnitude (power 1) or power (2) frames, optionally through a filter bank.

    ``centre``: frame f is centred at f * hop with n_fft / 2 mirrored samples at
    the ends, 1 + length // hop frames. Otherwise (n_fft - hop) / 2 samples are
    mirrored and ceil(length / hop) frames start at f * hop, zeros after that.
    ``floor`` bounds the squared magnitude from below; ``normalised`` divides by
    the window's norm. The chunk size must be a multiple of the hop.
    """
    if chunk % hop:
        raise ValueError("the chunk size must be a multiple of the hop")
    win_length = win_length or n_fft
    pad = n_fft // 2 if centre else (n_fft - hop) // 2
    window = np.zeros(n_fft)
    left = (n_fft - win_length) // 2
    window[left : left + win_length] = hann(win_length)
    scale = 1.0 / np.sqrt((window**2).sum()) if normalised else 1.0

    # The halo ahead is one window: a chunk whose halo is not full sees the end of
    # its clip, any other chunk does not reach it.
    rows = with_halo(signal, n_fft, chunk, behind=pad).select(
        *KEYS,
        "start_frame",
        F.size("samples").alias("size"),
        F.size("before").alias("behind"),
        F.concat("before", "samples", "after").alias("around"),
    )

    def windows(row) -> tuple[np.ndarray, np.ndarray]:
        """Frame numbers of one chunk and their samples."""
        start, behind = int(row.start_frame), int(row.behind)
        around = np.asarray(row.around, dtype=np.float64)
        stop, end = start + int(row.size), start - behind + len(around)
        frames = np.arange(start // hop, -(-stop // hop))
        if centre and stop == end and stop % hop == 0:
            # The last frame is centred right behind the last sample.
            frames = np.append(frames, stop // hop)
        index = frames[:, None] * hop - pad + np.arange(n_fft)
        inside = _reflect(index, end) - (start - behind)
        # Past the mirrored part there are only zeros.
        real = (index < end + pad) & (inside >= 0) & (inside < len(around))
        return frames, np.where(real, around[np.clip(inside, 0, len(around) - 1)], 0.0)

    def transformed(keys, counts, frames, cuts) -> pd.DataFrame:
        squared = np.abs(np.fft.rfft(np.vstack(cuts) * window, axis=1) * scale) ** 2
        squared = np.maximum(squared, floor)
        values = squared if power == 2.0 else squared ** (power / 2.0)
        values = values if bank is None else values @ bank
        clips, channels = zip(*keys)
        return pd.DataFrame(
            {
                "clip_id": np.repeat(np.array(clips, dtype=object), counts),
                "channel": np.repeat(np.array(channels), counts),
                "frame": np.concatenate(frames),
                "values": list(values),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts, frames, cuts, held = [], [], [], [], 0
            for row in batch.itertuples():
                numbers, cut = windows(row)
                keys.append((row.clip_id, row.channel))
                counts.append(len(numbers))
                frames.append(numbers)
                cuts.append(cut)
                held += cut.size
                if held > MAX_VALUES:
                    yield transformed(keys, counts, frames, cuts)
                    keys, counts, frames, cuts, held = [], [], [], [], 0
            if held:
                yield transformed(keys, counts, frames, cuts)

    clip_type = signal.schema["clip_id"].dataType.simpleString()
    return rows.mapInPandas(run, FRAME_SCHEMA.format(clip=clip_type))


def stft_frames(signal: DataFrame, chunk: int, n_fft: int, hop: int, win_length: int) -> DataFrame:
    """STFT magnitudes, squared magnitude floored at 1e-7."""
    return spectral_frames(signal, chunk, n_fft, hop, win_length, floor=1e-7)


def mel_frames(
    signal: DataFrame,
    chunk: int,
    n_fft: int,
    hop: int,
    n_mels: int,
    sample_rate: float,
    log: bool = True,
    floor_level: float = 1e-5,
) -> DataFrame:
    """Mel power frames; ``log``: log10 of the value plus the floor."""
    bank = mel_bank(n_fft, n_mels, sample_rate)
    frames = spectral_frames(signal, chunk, n_fft, hop, power=2.0, bank=bank, centre=False)
    return log_values(frames, floor_level) if log else frames


def log_values(frames: DataFrame, floor_level: float) -> DataFrame:
    return frames.withColumn("values", F.transform("values", lambda v: F.log10(v + F.lit(floor_level))))


def chroma_frames(
    signal: DataFrame, chunk: int, sample_rate: float, n_fft: int, hop: int, n_chroma: int = 12, argmax: bool = False
) -> DataFrame:
    """Chroma frames over their largest value, or one-hot of it."""
    bank = chroma_bank(n_fft, sample_rate, n_chroma)
    frames = spectral_frames(signal, chunk, n_fft, hop, power=2.0, normalised=True, bank=bank)
    unit = A.inf_normalise(F.col("values"))
    if argmax:
        unit = A.let(
            unit,
            lambda u: A.let(A.argmax(u), lambda at: F.transform(u, lambda _, i: (i == at).cast("double"))),
        )
    return frames.withColumn("values", unit)


def pair_frames(estimate: DataFrame, reference: DataFrame) -> DataFrame:
    """(keys, est, ref) of frames with the same clip, channel and number."""
    right = reference.select(*FRAME_KEYS, F.col("values").alias("ref"))
    return estimate.select(*FRAME_KEYS, F.col("values").alias("est")).join(right, FRAME_KEYS)


def _agg(df: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def _convergence(eps: float = EPS32) -> Column:
    gap, ref = A.squared_distance(F.col("est"), F.col("ref")), A.dot(F.col("ref"), F.col("ref"))
    return F.sqrt(F.sum(gap)) / (F.sqrt(F.sum(ref)) + F.lit(eps))


def _mean_of(term) -> Column:
    """Mean over all values of all frames of a per-value term."""
    return F.sum(A.total(F.zip_with("est", "ref", term))) / F.sum(F.size("est"))


def _log_l1(eps: float = EPS32) -> Column:
    return _mean_of(lambda e, r: F.abs(F.log(F.lit(eps) + r) - F.log(F.lit(eps) + e)))


def _log_mse(floor_level: float) -> Column:
    def term(e, r):
        gap = F.log10(e + F.lit(floor_level)) - F.log10(r + F.lit(floor_level))
        return gap * gap

    return _mean_of(term)


def spectral_convergence(pairs: DataFrame, by: Sequence[str] = (), eps: float = EPS32) -> DataFrame:
    """Norm of the difference over the norm of the reference."""
    return _agg(pairs, by, _convergence(eps).alias("convergence"))


def log_magnitude_l1(pairs: DataFrame, by: Sequence[str] = (), eps: float = EPS32) -> DataFrame:
    return _agg(pairs, by, _log_l1(eps).alias("log_l1"))


def frame_l1(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(pairs, by, _mean_of(lambda e, r: F.abs(e - r)).alias("l1"))


def frame_mse(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(pairs, by, _mean_of(lambda e, r: (e - r) * (e - r)).alias("mse"))


def _settled(estimate: DataFrame, reference: DataFrame, times: int) -> tuple[DataFrame, DataFrame]:
    """Both signals, written if more than one scale reads them."""
    return (estimate, reference) if times < 2 else (written(estimate, "estimate"), written(reference, "reference"))


# Default sizes and factors of the losses are those of the published metric definitions.
def multi_resolution_stft(
    estimate: DataFrame,
    reference: DataFrame,
    chunks: Sequence[int],
    n_ffts: Sequence[int] = (1024, 2048, 512),
    hops: Sequence[int] = (120, 240, 50),
    wins: Sequence[int] = (600, 1200, 240),
    factor_sc: float = 0.1,
    factor_mag: float = 0.1,
    rechunk=None,
) -> DataFrame:
    """Weighted means over the resolutions of convergence and log magnitude distance.

    ``chunks`` gives the chunk size of the signals per resolution (a multiple of
    its hop); ``rechunk(signal, size)`` changes it where they differ. A resolution
    makes its frames once, for both terms.
    """
    estimate, reference = _settled(estimate, reference, len(n_ffts))
    parts = None
    for n_fft, hop, win, chunk in zip(n_ffts, hops, wins, chunks):
        est = rechunk(estimate, chunk) if rechunk else estimate
        ref = rechunk(reference, chunk) if rechunk else reference
        pairs = pair_frames(stft_frames(est, chunk, n_fft, hop, win), stft_frames(ref, chunk, n_fft, hop, win))
        row = pairs.agg(_convergence().alias("convergence"), _log_l1().alias("log_l1"))
        parts = row if parts is None else parts.unionByName(row)
    return parts.agg(
        F.avg("convergence").alias("convergence"), F.avg("log_l1").alias("log_l1")
    ).withColumn("loss", F.lit(factor_sc) * F.col("convergence") + F.lit(factor_mag) * F.col("log_l1"))


def rechunk(signal: DataFrame, size: int) -> DataFrame:
    """The same signal in chunks of another size; pieces are cut at the new borders."""
    first = F.floor(F.col("start_frame") / size)
    last = F.floor((F.col("start_frame") + F.size("samples") - 1) / size)
    cut = signal.withColumn("__c", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("__c") * size - F.col("start_frame"), F.lit(0)).cast("int")
    high = F.least((F.col("__c") + 1) * size - F.col("start_frame"), F.size("samples")).cast("int")
    pieces = cut.select(
        *KEYS,
        F.col("__c").cast("int").alias("chunk_idx"),
        (F.col("start_frame") + low).alias("at"),
        F.slice("samples", low + 1, high - low).alias("s"),
    )
    # The pieces of one new chunk hold at most ``size`` samples.
    whole = F.array_sort(F.collect_list(F.struct("at", "s")))
    return pieces.groupBy(*KEYS, "chunk_idx").agg(
        F.min("at").cast("bigint").alias("start_frame"), F.flatten(F.transform(whole, lambda p: p["s"])).alias("samples")
    )


def mel_l1(estimate: DataFrame, reference: DataFrame, chunk: int, **mel) -> DataFrame:
    """L1 of log mel frames."""
    return frame_l1(pair_frames(mel_frames(estimate, chunk, **mel), mel_frames(reference, chunk, **mel)))


def multi_scale_mel(
    estimate: DataFrame,
    reference: DataFrame,
    chunk: int,
    sample_rate: float,
    range_start: int = 6,
    range_end: int = 11,
    n_mels: int = 64,
    normalised: bool = False,
    alphas: bool = True,
    floor_level: float = 1e-5,
) -> DataFrame:
    """Sum over scales 2^i of L1 of the mel frames plus alpha times the error of the log ones.

    alpha is sqrt(2^i - 1), or 1. ``normalised`` divides by the sum of the weights.
    """
    weights = {i: float(np.sqrt(2**i - 1)) if alphas else 1.0 for i in range(range_start, range_end)}
    estimate, reference = _settled(estimate, reference, len(weights))
    parts = None
    for i, alpha in weights.items():
        size = dict(n_fft=2**i, hop=2**i // 4, n_mels=n_mels, sample_rate=sample_rate, log=False)
        pairs = pair_frames(mel_frames(estimate, chunk, **size), mel_frames(reference, chunk, **size))
        l1 = _mean_of(lambda e, r: F.abs(e - r))
        row = pairs.agg((l1 + F.lit(alpha) * _log_mse(floor_level)).alias("loss"))
        parts = row if parts is None else parts.unionByName(row)
    total = sum(weights.values()) + len(weights) if normalised else 1.0
    return parts.agg((F.sum("loss") / F.lit(total)).alias("loss"))


def relative_volume_mel(
    estimate: DataFrame,
    reference: DataFrame,
    chunk: int,
    sample_rate: float = 24000,
    n_mels: int = 80,
    n_fft: int = 512,
    hop: int = 128,
    min_relative: float = -25.0,
    max_relative: float = 25.0,
    max_initial_gain: float = 25.0,
    min_activity: float = -25.0,
    bands: int = 4,
) -> DataFrame:
    """Volume of the mel difference relative to the reference in dB, per band group and overall.

    Rows (band, rvm): ``rvm_0`` ... and ``rvm``. Both signals are scaled by the
    RMS of the whole reference table, with a gain of at most ``max_initial_gain`` dB.
    """
    floor = 10.0 ** (-max_initial_gain / 20.0)
    level = reference.agg(
        F.greatest(
            F.sqrt(F.sum(A.dot(F.col("samples"), F.col("samples"))) / F.sum(F.size("samples"))), F.lit(floor)
        ).alias("__std")
    ).withColumn("__one", F.lit(1))

    def mel(signal: DataFrame) -> DataFrame:
        joined = signal.withColumn("__one", F.lit(1)).join(F.broadcast(level), "__one")
        scaled = joined.withColumn("samples", A.scale(F.col("samples"), 1.0 / F.col("__std"))).drop("__one", "__std")
        bank = mel_bank(n_fft, n_mels, sample_rate)
        frames = spectral_frames(scaled, chunk, n_fft, hop, power=2.0, normalised=True, bank=bank)
        return frames.withColumn("values", F.transform("values", F.sqrt))

    pairs = pair_frames(mel(estimate), mel(reference))
    relative = F.zip_with(
        "est",
        "ref",
        lambda e, r: F.greatest(
            F.least(A.scale_to_db(F.abs(r - e), -120.0) - A.scale_to_db(r, min_activity), F.lit(max_relative)),
            F.lit(min_relative),
        ),
    )
    per_band = pairs.select(F.posexplode(relative).alias("mel", "v")).groupBy("mel").agg(F.avg("v").alias("v"))
    width = -(-n_mels // bands)
    group = F.concat(F.lit("rvm_"), F.floor(F.col("mel") / width).cast("string"))
    grouped = per_band.groupBy(group.alias("band")).agg(F.avg("v").alias("rvm"))
    return grouped.unionByName(per_band.agg(F.avg("v").alias("rvm")).withColumn("band", F.lit("rvm")))
