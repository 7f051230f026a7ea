"""Waveform tables: transforms and statistics on bounded chunks.

A signal is a table (clip_id, channel, chunk_idx, start_frame, samples) whose
chunks have one fixed size (the last one of a clip may be shorter). Sample work
is array expressions inside a chunk, clip statistics are aggregates of per-chunk
sums, and neighbours come from ``with_halo``; a clip is never one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewell.functions import arrays as A
from tonewell.functions import text as X
from tonewell.functions.arrays import let
from tonewell.functions.hashing import normal, uniform, uniform_int
from tonewell.operators.joins import random_pairs
from tonewell.operators.scans import bucket_count, row_positions, running, share_bucket, span_bucket
from tonewell.session import written

KEYS = ("clip_id", "channel")
EPS32 = 1.1920928955078125e-07


def from_arrays(df: DataFrame, clip: str, samples: str, chunk: int, channel: Column | None = None) -> DataFrame:
    """Chunk table of whole sample arrays."""
    starts = F.sequence(F.lit(0), F.size(samples) - 1, F.lit(chunk))
    rows = df.select(
        F.col(clip).alias("clip_id"),
        (F.lit(0) if channel is None else channel).alias("channel"),
        F.col(samples).alias("__x"),
        F.posexplode(starts).alias("chunk_idx", "start_frame"),
    )
    return rows.select(
        *KEYS,
        "chunk_idx",
        F.col("start_frame").cast("bigint").alias("start_frame"),
        F.slice("__x", F.col("start_frame") + 1, F.lit(chunk)).alias("samples"),
    )


def to_long(signal: DataFrame) -> DataFrame:
    """(clip_id, channel, t, x), for inspection and small results."""
    rows = signal.select(*KEYS, "start_frame", F.posexplode("samples").alias("i", "x"))
    return rows.select(*KEYS, (F.col("start_frame") + F.col("i")).cast("bigint").alias("t"), "x")


def _peak() -> Column:
    return F.max(F.array_max(F.transform("samples", F.abs)))


def clip_stats(signal: DataFrame, *by: str) -> DataFrame:
    """Per clip: top (largest sample), peak (largest absolute one), sum of squares, count."""
    return signal.groupBy(*(by or ("clip_id",))).agg(
        F.max(F.array_max("samples")).alias("top"),
        _peak().alias("peak"),
        F.sum(A.dot(F.col("samples"), F.col("samples"))).alias("energy"),
        F.sum(F.size("samples")).alias("n"),
    )


def _map(signal: DataFrame, body: Callable[[Column], Column]) -> DataFrame:
    return signal.withColumn("samples", F.transform("samples", body))


def _scaled(signal: DataFrame, factors: DataFrame, factor: Column, *by: str) -> DataFrame:
    """Multiply every sample by a clip-level factor.

    Factors from the statistics of ``signal`` make it run twice. Before a chain of such
    steps, or after an expensive one, give a signal that is ``written``.
    """
    keys = list(by or ("clip_id",))
    joined = signal.join(factors.select(*keys, factor.alias("__f")), keys)
    return joined.withColumn("samples", A.scale(F.col("samples"), F.col("__f"))).drop("__f")


def with_halo(signal: DataFrame, ahead: int, chunk: int, behind: int = 0) -> DataFrame:
    """Columns ``before`` and ``after``: the neighbour samples of each chunk.

    One scan and one shuffle: a chunk sends the needed head or tail to the chunks
    around it, as many as the halo spans.
    """
    def piece(to: Column, start: Column, off: int, samples: Column) -> Column:
        return F.struct(
            to.cast("bigint").alias("chunk_idx"), start.cast("bigint").alias("start_frame"),
            F.lit(off).alias("__off"), samples.alias("samples"),
        )

    here, none, size = F.col("chunk_idx"), F.lit(None), F.size("samples")
    pieces = [piece(here, F.col("start_frame"), 0, F.col("samples"))]
    for j in range(1, -(-ahead // chunk) + 1):
        need = min(chunk, ahead - (j - 1) * chunk)
        pieces.append(piece(here - j, none, j, F.slice("samples", 1, need)))
    for j in range(1, -(-behind // chunk) + 1):
        need = min(chunk, behind - (j - 1) * chunk)
        tail = F.slice("samples", F.greatest(size - F.lit(need - 1), F.lit(1)), F.lit(need))
        pieces.append(piece(here + j, none, -j, tail))
    kind = signal.schema["chunk_idx"].dataType
    rows = signal.select(*KEYS, F.inline(F.array(*pieces))).withColumn("chunk_idx", F.col("chunk_idx").cast(kind))
    # A list holds the chunk itself and its few neighbours.
    gathered = rows.groupBy(*KEYS, "chunk_idx").agg(
        F.max("start_frame").alias("start_frame"),
        F.array_sort(F.collect_list(F.struct(F.col("__off").alias("o"), F.col("samples").alias("s")))).alias("__g"),
    )

    def side(test) -> Column:
        return F.flatten(F.transform(F.filter("__g", lambda g: test(g["o"])), lambda g: g["s"]))

    return gathered.filter(F.col("start_frame").isNotNull()).select(
        *KEYS,
        "chunk_idx",
        "start_frame",
        side(lambda o: o == 0).alias("samples"),
        side(lambda o: o > 0).alias("after"),
        side(lambda o: o < 0).alias("before"),
    )


# Channels and levels -----------------------------------------------------------------


def convert_channels(signal: DataFrame, channels: int) -> DataFrame:
    """Same count: unchanged; 1: mean; mono: copied; more than wanted: the first ones.

    Fewer channels than wanted, but not mono, is an error.
    """
    if channels == 1:
        # A list has one entry per channel.
        rows = signal.groupBy("clip_id", "chunk_idx", "start_frame").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda r: r["samples"]
            ).alias("__c")
        )
        total = F.aggregate(
            F.slice("__c", F.lit(2), F.size("__c")), F.get("__c", F.lit(0)), lambda acc, s: A.add(acc, s)
        )
        mean = let(F.size("__c"), lambda n: F.transform(total, lambda x: x / n))
        return rows.select("clip_id", F.lit(0).alias("channel"), "chunk_idx", "start_frame", mean.alias("samples"))
    counts = signal.groupBy("clip_id").agg((F.max("channel") + 1).alias("__n"))
    joined = signal.join(counts, "clip_id")
    message = F.lit("the clip has fewer channels than asked for and is not mono")
    places = (
        F.when(F.col("__n") == 1, F.sequence(F.lit(0), F.lit(channels - 1)))
        .when(F.col("__n") < channels, F.raise_error(message).cast("array<int>"))
        .when(F.col("channel") < channels, F.array(F.col("channel")))
    )
    return joined.withColumn("channel", F.explode(places)).drop("__n")


def normalise_peak(signal: DataFrame, headroom_db: float = 1.0, normalise: bool = True) -> DataFrame:
    """Peak at -headroom dB; without ``normalise`` only when that attenuates. Silence stays."""
    target = 10.0 ** (-headroom_db / 20.0)
    factor = F.coalesce(F.try_divide(F.lit(target), F.col("peak")), F.lit(1.0))
    if not normalise:
        factor = F.least(factor, F.lit(1.0))
    return _scaled(signal, clip_stats(signal), factor)


def normalise_clip(signal: DataFrame, headroom_db: float = 1.0) -> DataFrame:
    """Clamp to the scale of -headroom dB."""
    limit = 10.0 ** (-headroom_db / 20.0)
    return _map(signal, lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))


def normalise_rms(signal: DataFrame, headroom_db: float = 18.0, normalise: bool = True) -> DataFrame:
    """RMS of the mono mix at -headroom dB, then clamped to 1. Silence stays."""
    stats = clip_stats(convert_channels(signal, 1))
    rms = F.sqrt(F.col("energy") / F.col("n"))
    factor = F.coalesce(F.try_divide(F.lit(10.0 ** (-headroom_db / 20.0)), rms), F.lit(1.0))
    if not normalise:
        factor = F.least(factor, F.lit(1.0))
    return normalise_clip(_scaled(signal, stats, factor), 0.0)


def clip_report(signal: DataFrame) -> DataFrame:
    """(clip_id, clipped_share, peak): share of samples above 1 in absolute value."""
    over = F.size(F.filter("samples", lambda x: F.abs(x) > 1))
    return signal.groupBy("clip_id").agg(
        (F.sum(over) / F.sum(F.size("samples"))).alias("clipped_share"), _peak().alias("peak")
    )


def f32_pcm(signal: DataFrame, bits: int) -> DataFrame:
    """Integer samples of 16 or 32 bits to [-1, 1)."""
    if bits not in (16, 32):
        raise ValueError(f"unsupported sample width {bits}")
    return _map(signal, lambda x: x.cast("double") / F.lit(float(2 ** (bits - 1))))


def i16_pcm(signal: DataFrame) -> DataFrame:
    """Samples to 16 bits, half to even; a clip that would overflow uses the factor 2^15 - 1."""
    stats = clip_stats(signal)
    message = F.lit("samples outside of [-1, 1]")
    overflow = F.rint(F.col("top") * F.lit(2.0**15)) >= F.lit(2.0**15)
    factor = (
        F.when(F.col("peak") > 1, F.raise_error(message).cast("double"))
        .when(overflow, F.lit(2.0**15 - 1))
        .otherwise(F.lit(2.0**15))
    )
    scaled = _scaled(signal, stats, factor)
    return _map(scaled, lambda x: F.rint(x).cast("smallint"))


def clip_rms(signal: DataFrame) -> DataFrame:
    return clip_stats(signal).select("clip_id", F.sqrt(F.col("energy") / F.col("n")).alias("rms"))


def normalise_level(signal: DataFrame, target_db: float = -25.0) -> DataFrame:
    """RMS at the target level."""
    rms = F.sqrt(F.col("energy") / F.col("n"))
    return _scaled(signal, clip_stats(signal), F.lit(10.0 ** (target_db / 20.0)) / (rms + F.lit(EPS32)))


def is_clipped(signal: DataFrame, threshold: float = 0.99) -> DataFrame:
    return clip_stats(signal).select("clip_id", (F.col("peak") > threshold).alias("clipped"))


def renormalise_volume(signal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signal over its mono RMS, scale per clip)."""
    stats = clip_stats(convert_channels(signal, 1))
    scales = stats.select("clip_id", (F.lit(1e-8) + F.sqrt(F.col("energy") / F.col("n"))).alias("scale"))
    return _scaled(signal, scales, F.lit(1.0) / F.col("scale")), scales


def restore_volume(signal: DataFrame, scales: DataFrame) -> DataFrame:
    return _scaled(signal, scales, F.col("scale"))


# Effects -----------------------------------------------------------------------------


def boost(signal: DataFrame, amount: float = 20.0) -> DataFrame:
    return _map(signal, lambda x: x * F.lit(1 + amount / 100))


def duck(signal: DataFrame, amount: float = 20.0) -> DataFrame:
    return _map(signal, lambda x: x * F.lit(1 - amount / 100))


def identity(signal: DataFrame) -> DataFrame:
    return signal


def white_noise(signal: DataFrame, std: float = 0.001, seed="white") -> DataFrame:
    """Add Gaussian noise; the draw depends on clip, channel and frame."""
    noisy = F.transform(
        "samples",
        lambda x, i: x + F.lit(std) * normal(seed, F.col("clip_id"), F.col("channel"), F.col("start_frame") + i),
    )
    return signal.withColumn("samples", noisy)


def pink_noise_table(clips: DataFrame, seed="pink", rows: int = 16, block: int = 65536) -> DataFrame:
    """(clip_id, t, noise): running sums of ``rows`` noise rows, one after the other.

    ``clips``: (clip_id, length). Each row is a running sum cut in blocks, so a
    long clip is spread over tasks; the clip peak is scaled to 1.
    """
    width = F.floor(F.col("length") / rows) + 1
    cells = clips.filter(F.col("length") > 0).select(
        "clip_id", width.alias("__w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("t")
    )
    placed = cells.withColumn("__row", F.floor(F.col("t") / F.col("__w"))).withColumn(
        "__col", F.col("t") % F.col("__w")
    )
    summed = running(
        placed,
        ["clip_id", "__row"],
        span_bucket(F.col("__col"), block),
        [F.col("__col")],
        {"noise": ("sum", normal(seed, F.col("clip_id"), F.col("t")))},
    )
    peaks = summed.groupBy("clip_id").agg(F.max(F.abs("noise")).alias("__peak"))
    return summed.join(peaks, "clip_id").select("clip_id", "t", (F.col("noise") / F.col("__peak")).alias("noise"))


def pink_noise(signal: DataFrame, chunk: int, std: float = 0.01, seed="pink") -> DataFrame:
    """Add pink noise, the same for all channels of a clip."""
    lengths = signal.groupBy("clip_id").agg(
        F.max(F.col("start_frame") + F.size("samples")).cast("bigint").alias("length")
    )
    noise = pink_noise_table(lengths, seed)
    # A list has one chunk of samples.
    chunks = noise.groupBy("clip_id", F.floor(F.col("t") / chunk).cast("int").alias("chunk_idx")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "noise"))), lambda r: r["noise"] * F.lit(std)).alias("__n")
    )
    joined = signal.join(chunks, ["clip_id", "chunk_idx"])
    return joined.withColumn("samples", A.add(F.col("samples"), F.col("__n"))).drop("__n")


def moving_average(signal: DataFrame, window: int, chunk: int) -> DataFrame:
    """Mean of the next ``window`` samples; the last window - 1 outputs are 0."""
    haloed = with_halo(signal, window - 1, chunk)

    def smooth(values: Column) -> Column:
        return F.transform(
            "samples",
            lambda _, i: F.when(
                i + F.lit(window) <= F.size(values),
                A.total(F.slice(values, i + 1, F.lit(window))) / F.lit(float(window)),
            ).otherwise(0.0),
        )

    smoothed = let(F.concat("samples", "after"), smooth)
    return haloed.withColumn("samples", smoothed).drop("after", "before")


def echo(signal: DataFrame, volume: float, delay: int, chunk: int) -> DataFrame:
    """x[t] + volume * x[t + delay - 1] while that exists, 0 after, at the input peak of the clip."""
    haloed = with_halo(signal, delay - 1, chunk)

    def overlay(values: Column) -> Column:
        return F.transform(
            "samples",
            lambda x, i: F.when(
                i + F.lit(delay) <= F.size(values), x + F.lit(volume) * F.get(values, i + F.lit(delay - 1))
            ).otherwise(0.0),
        )

    wet = haloed.withColumn("samples", let(F.concat("samples", "after"), overlay)).drop("after", "before")
    wet = written(wet, "echo")  # read twice: for the peak, and to scale it
    before = clip_stats(signal).select("clip_id", F.col("peak").alias("__in"))
    after = clip_stats(wet).select("clip_id", F.col("peak").alias("__out"))
    factors = before.join(after, "clip_id")
    return _scaled(wet, factors, F.coalesce(F.try_divide(F.col("__in"), F.col("__out")), F.lit(1.0)))


# Mixing ------------------------------------------------------------------------------


def snr_mix(
    signal: DataFrame,
    pairs: DataFrame,
    chunk: int,
    seed,
    snr_low: int,
    snr_high: int,
    min_overlap: float,
    draw_by: str = "mix_id",
    target_db: float = -25.0,
    clip_at: float = 0.99,
) -> DataFrame:
    """Mix the target clip of each pair into its source clip at a random SNR.

    ``signal`` is mono; ``pairs``: (mix_id, source, target) and the column
    ``draw_by`` the SNR, start and final level depend on. The target is cut or
    padded to the source length. All gains are clip scalars; the samples are
    touched once, when the shifted target chunks meet the source chunks.
    """
    key = F.col(draw_by)
    extra = [draw_by] if draw_by != "mix_id" else []
    snr = F.lit(snr_low) if snr_low == snr_high else uniform_int(snr_low, snr_high - 1, f"{seed}:snr", key)
    level = uniform_int(-35, -16, f"{seed}:level", key)

    # One pass over the signal gives the length and the statistics of every clip.
    whole = written(clip_stats(signal).select("clip_id", "n", "top", "energy"), "clips")

    def named(prefix: str, column: str) -> DataFrame:
        return whole.select(
            F.col("clip_id").alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "top", "energy")]
        )

    start = F.floor(uniform(f"{seed}:start", key) * (F.floor(F.col("src_n") * F.lit(1 - min_overlap)) + 1))
    plan = (
        pairs.select("mix_id", *extra, "source", "target")
        .join(named("src", "source"), "source")
        .join(named("dst", "target"), "target")
        .withColumns({"__snr": snr, "__level": level, "__start": start.cast("bigint")})
    )

    def chunks_of(mixes: DataFrame, frames: Column) -> DataFrame:
        """Signal chunks of the first ``frames`` frames of ``clip_id``, per mix.

        Joined on (clip, chunk), so a clip that many mixes use is spread out.
        """
        last = F.ceil(frames / chunk).cast("int") - 1
        wanted = mixes.withColumn("chunk_idx", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
        return signal.join(wanted, ["clip_id", "chunk_idx"])

    # Only a target longer than its source is cut, and then measured again.
    longer = plan.filter(F.col("dst_n") > F.col("src_n")).select("mix_id", F.col("target").alias("clip_id"), "src_n")
    left = F.least(F.col("src_n") - F.col("start_frame"), F.size("samples")).cast("int")
    cut = chunks_of(longer, F.col("src_n")).withColumn("samples", F.slice("samples", F.lit(1), left))
    shorter = clip_stats(cut, "mix_id").select("mix_id", F.col("top").alias("__top"), F.col("energy").alias("__energy"))
    plan = plan.join(shorter, "mix_id", "left")

    def gain(top: Column, rms: Column) -> Column:
        unit = F.lit(1.0) / (F.abs(top) + F.lit(EPS32))
        return unit * F.lit(10.0 ** (target_db / 20.0)) / (rms * unit + F.lit(EPS32))

    # A shorter target is completed by zeros, which count for its largest sample.
    dst_top = F.coalesce("__top", F.when(F.col("dst_n") < F.col("src_n"), F.greatest("dst_top", F.lit(0.0))).otherwise(F.col("dst_top")))
    src_rms = F.sqrt(F.col("src_energy") / F.col("src_n"))
    dst_rms = F.sqrt(F.coalesce("__energy", "dst_energy") / F.col("src_n"))
    plan = plan.withColumns({"__a": gain(F.col("src_top"), src_rms), "__g": gain(dst_top, dst_rms)})
    ratio = F.col("__a") * src_rms / F.pow(F.lit(10.0), F.col("__snr") / 20.0) / (F.col("__g") * dst_rms + F.lit(EPS32))
    plan = written(plan.withColumn("__b", F.col("__g") * ratio), "plan")

    source = chunks_of(
        plan.select("mix_id", F.col("source").alias("clip_id"), "src_n", "__a", "__b", "__level"), F.col("src_n")
    )
    heard = F.least(F.col("dst_n"), F.col("src_n") - F.col("__start"))
    target = chunks_of(
        plan.select("mix_id", F.col("target").alias("clip_id"), "src_n", "dst_n", "__start"), heard
    )

    # A target chunk, moved by the start, meets one or two source chunks.
    moved = target.withColumn("__at", F.col("start_frame") + F.col("__start"))
    last = F.col("__at") + F.size("samples") - 1
    reached = moved.withColumn(
        "chunk_idx",
        F.explode(
            F.sequence(
                F.floor(F.col("__at") / chunk).cast("int"),
                F.floor(F.least(last, F.col("src_n") - 1) / chunk).cast("int"),
            )
        ),
    )
    pieces = reached.groupBy("mix_id", "chunk_idx").agg(
        F.collect_list(F.struct(F.col("__at").alias("at"), F.col("samples").alias("s"))).alias("__pieces")
    )
    met = source.join(pieces, ["mix_id", "chunk_idx"], "left")
    none = F.array().cast("array<struct<at:bigint,s:array<double>>>")

    def summed(x: Column, i: Column) -> Column:
        frame = F.col("start_frame") + i
        other = F.aggregate(
            F.coalesce("__pieces", none),
            F.lit(0.0),
            lambda acc, p: acc
            + F.when(
                (frame >= p["at"]) & (frame < p["at"] + F.size(p["s"])),
                F.get(p["s"], (frame - p["at"]).cast("int")),
            ).otherwise(0.0),
        )
        return F.col("__a") * x + F.col("__b") * other

    mix = met.select(
        F.col("mix_id").alias("clip_id"),
        "channel",
        "chunk_idx",
        "start_frame",
        F.transform("samples", summed).alias("samples"),
        "__level",
    )
    # Final level, then the check for clipping, both from one pass of statistics.
    mix = written(mix, "mix")
    stats = clip_stats(mix, "clip_id", "__level")
    rms = F.sqrt(F.col("energy") / F.col("n"))
    scale = F.pow(F.lit(10.0), F.col("__level") / 20.0) / (rms + F.lit(EPS32))
    loud = F.col("peak") * scale > F.lit(clip_at)
    fixed = F.when(loud, scale / (F.abs(F.col("top") * scale) / F.lit(clip_at - EPS32))).otherwise(scale)
    return _scaled(mix.drop("__level"), stats, fixed)


def mix_samples(
    signal: DataFrame,
    items: DataFrame,
    batch: str,
    chunk: int,
    seed,
    aug_p: float,
    mix_p: float,
    snr_low: int,
    snr_high: int,
    min_overlap: float,
) -> tuple[DataFrame, DataFrame]:
    """(signal, items) after batch mixing; ``items``: (batch, clip_id, description).

    A batch either mixes int(mix_p * size) random pairs, with joined texts, or
    keeps as many random members. The id of a result is "source" or
    "source+target".
    """
    if mix_p == 0:
        return signal, items
    mixing = uniform(f"{seed}:mix", F.col(batch)) < F.lit(aug_p)
    paired = random_pairs(items, batch, "clip_id", mix_p, seed, ["description"]).filter(mixing)
    made = paired.select(
        batch,
        F.concat_ws("+", F.col("source_clip_id").cast("string"), F.col("target_clip_id").cast("string")).alias("mix_id"),
        F.col("source_clip_id").alias("source"),
        F.col("target_clip_id").alias("target"),
        X.mix_text(F.col("source_description"), F.col("target_description")).alias("description"),
    )
    mixed = snr_mix(signal, made, chunk, seed, snr_low, snr_high, min_overlap, draw_by=batch)

    u = uniform(f"{seed}:source", F.col(batch), F.col("clip_id"))
    placed = row_positions(
        items.withColumn("__u", u), [batch], share_bucket(F.col("__u"), bucket_count(items)), [F.col("__u"), F.col("clip_id")], "__rank"
    )
    sizes = items.groupBy(batch).agg(F.floor(F.count(F.lit(1)) * F.lit(mix_p)).alias("__k"))
    kept = placed.join(sizes, batch).filter((F.col("__rank") < F.col("__k")) & ~mixing)
    plain = signal.join(kept.select("clip_id"), "clip_id").withColumn("clip_id", F.col("clip_id").cast("string"))
    out_items = made.select(batch, F.col("mix_id").alias("clip_id"), "description").unionByName(
        kept.select(batch, F.col("clip_id").cast("string").alias("clip_id"), "description")
    )
    return mixed.unionByName(plain.select(*mixed.columns)), out_items


# Pair metric -------------------------------------------------------------------------


def si_snr_frames(estimate: DataFrame, reference: DataFrame, frame: int, stride: int) -> DataFrame:
    """Five sums per (clip, channel, frame), from chunk pieces that overlap the frame."""
    right = reference.select(*KEYS, "chunk_idx", F.col("samples").alias("__y"))
    joined = estimate.join(right, [*KEYS, "chunk_idx"])
    first = F.greatest(F.ceil((F.col("start_frame") - F.lit(frame - 1)) / F.lit(stride)), F.lit(0))
    last = F.floor((F.col("start_frame") + F.size("samples") - 1) / F.lit(stride))
    # A stride longer than a frame leaves some chunks without any frame.
    rows = joined.withColumn("frame", F.explode(F.when(last >= first, F.sequence(first, last))))
    low = F.greatest(F.col("frame") * stride - F.col("start_frame"), F.lit(0)).cast("int")
    high = F.least(F.col("frame") * stride + frame - F.col("start_frame"), F.size("samples")).cast("int")
    est = F.slice("samples", low + 1, F.greatest(high - low, F.lit(0)))
    ref = F.slice("__y", low + 1, F.greatest(high - low, F.lit(0)))
    return rows.groupBy(*KEYS, "frame").agg(
        F.sum(A.total(est)).alias("se"),
        F.sum(A.total(ref)).alias("sr"),
        F.sum(A.dot(est, est)).alias("see"),
        F.sum(A.dot(ref, ref)).alias("srr"),
        F.sum(A.dot(est, ref)).alias("ser"),
    )


def si_snr(
    estimate: DataFrame,
    reference: DataFrame,
    frame: int,
    overlap: float = 0.5,
    eps: float = EPS32,
) -> DataFrame:
    """Negated mean scale-invariant SNR over frames; the last frame is padded by zeros.

    Centring and projection follow from the five sums, so no second pass.
    """
    stride = int(frame * (1 - overlap))
    sums = si_snr_frames(estimate, reference, frame, stride)
    e, n = F.lit(eps * frame), F.lit(float(frame))
    rr = F.greatest(F.col("srr") - F.col("sr") * F.col("sr") / n, F.lit(0.0))
    ee = F.greatest(F.col("see") - F.col("se") * F.col("se") / n, F.lit(0.0))
    dot = F.col("ser") - F.col("se") * F.col("sr") / n
    shared = dot / (e + rr)
    proj = shared * shared * rr
    noise = F.greatest(ee - F.lit(2.0) * shared * dot + proj, F.lit(0.0))
    value = F.lit(10.0) * (F.log10(e + proj) - F.log10(e + noise))
    return sums.select(value.alias("v")).agg((-F.avg("v")).alias("si_snr"), F.count(F.lit(1)).alias("frames"))
