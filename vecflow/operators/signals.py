"""Signal features, one row per (series, frame).

A signal is a row with an array of samples. Framing unfolds it to frame rows without a
shuffle; spectra and filter banks are block products in Arrow batches; everything else is
a column expression. Only clip-level values (the loudest bin, the mean of a feature)
group by series, as plain aggregates with map-side partial sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from vecflow.functions.joins import null_safe_join
from vecflow.functions.vectors import array_sum, let
from vecflow.operators.reduction import transpose

# Defaults of the feature extraction (fixed values).
N_FFT = 2048
HOP = 512
N_MFCC = 20
N_MELS = 128
PRE_EMPHASIS = 0.97
ROLL_PERCENT = 0.85
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
DELTA_WEIGHTS = [n / 60 for n in (-4, -3, -2, -1, 0, 1, 2, 3, 4)]
DELTA2_WEIGHTS = [n / 462 for n in (28, 7, -8, -17, -20, -17, -8, 7, 28)]
DB_FLOOR = 80.0
LOWEST_A = 27.5
PEAK_HERTZ = (150.0, 4000.0)
PEAK_SHARE = 0.1

TUNING_STEPS = 100  # tunings told apart in a semitone


def slice_seconds(samples: Column, rate: Column, start: Column, duration: Column) -> Column:
    """Samples of [start, start + duration) seconds; the whole signal when the duration is 0 or null."""
    whole = duration.isNull() | (duration == 0)
    first = (start * rate).cast("int") + 1
    return F.when(whole, samples).otherwise(F.slice(samples, first, (duration * rate).cast("int")))


def pre_emphasis(samples: Column, coefficient: float = PRE_EMPHASIS) -> Column:
    """y[n] = x[n] - c * x[n-1]; the first sample is kept."""
    return F.transform(
        samples, lambda x, i: F.when(i == 0, x).otherwise(x - coefficient * F.get(samples, i - 1))
    )


def padded(samples: Column, kind: ArrayType, width: int, edge: bool = False) -> Column:
    """The samples with half a frame before and after them: zeros, or with ``edge`` copies of the first and last sample."""
    zero = F.lit(0).cast(kind.elementType)
    held = F.coalesce(samples, F.array().cast(kind))
    first, last = (F.coalesce(F.get(held, i), zero) if edge else zero for i in (F.lit(0), F.size(held) - 1))
    return F.concat(F.array_repeat(first, width // 2), held, F.array_repeat(last, width - width // 2))


def framed(df: DataFrame, samples: str, width: int = N_FFT, hop: int = HOP, edge: bool = False) -> DataFrame:
    """One row per frame: ``frame`` number and its ``x`` samples.

    Frames are centred: frame f has sample f * hop in its middle, and the signal is padded on both ends by half a frame, with
    zeros (spectra, energy) or its edge values (sign changes). A signal of n samples has 1 + n // hop frames; a null or empty
    one has one frame of zeros.
    """
    kind = df.schema[samples].dataType
    numbers = F.sequence(F.lit(0), F.floor(F.coalesce(F.size(samples), F.lit(0)) / hop).cast("int"))
    whole = df.withColumns({"frame_numbers": numbers, samples: padded(F.col(samples), kind, width, edge)})
    numbered = whole.withColumn("frame", F.explode("frame_numbers"))
    return numbered.withColumn("x", F.slice(samples, F.col("frame") * hop + 1, width)).drop(samples, "frame_numbers")


def rms(x: Column) -> Column:
    return F.sqrt(array_sum(F.transform(x, lambda v: v * v)) / F.size(x))


def zero_crossing_rate(x: Column) -> Column:
    """Share of samples whose sign differs from the one before (0 counts as positive)."""
    flips = F.transform(
        x, lambda v, i: F.when((i > 0) & ((v < 0) != (F.get(x, i - 1) < 0)), F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return array_sum(flips) / F.size(x)


def hann(width: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)


def frequencies(width: int, rate: float) -> list[float]:
    return [rate * b / width for b in range(width // 2 + 1)]


def power_spectrum(x: Column, width: int) -> Column:
    """Squared magnitudes of the Hann-windowed frame, one per frequency bin."""
    window = hann(width)

    @F.pandas_udf("array<double>")
    def spectrum(frames: pd.Series) -> pd.Series:
        if len(frames) == 0:
            return pd.Series([], dtype=object)
        bins = np.fft.rfft(np.stack(frames.to_numpy()) * window, axis=1)
        return pd.Series(list(bins.real**2 + bins.imag**2))

    return spectrum(x)


def weighted_rows(vector: Column, weights: np.ndarray) -> Column:
    """Product of a (rows x size) weight matrix with each vector."""
    table = np.asarray(weights).T.copy()

    @F.pandas_udf("array<double>")
    def product(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vectors.to_numpy()) @ table))

    return product(vector)


def mel_of(hertz: float) -> float:
    """Mel scale: linear below 1 kHz, logarithmic above."""
    step = 200.0 / 3
    return hertz / step if hertz < 1000 else 15.0 + math.log(hertz / 1000.0) / (math.log(6.4) / 27.0)


def hertz_of(mel: float) -> float:
    step = 200.0 / 3
    return mel * step if mel < 15.0 else 1000.0 * math.exp((mel - 15.0) * math.log(6.4) / 27.0)


def mel_filters(width: int, rate: float, n_mels: int = N_MELS) -> np.ndarray:
    """Triangles with edges equally spaced in mel from 0 to rate/2, scaled to unit area."""
    top = mel_of(rate / 2)
    edges = np.array([hertz_of(top * i / (n_mels + 1)) for i in range(n_mels + 2)])
    bins = np.array(frequencies(width, rate))
    rising = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    falling = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    area = 2.0 / (edges[2:] - edges[:-2])
    return np.maximum(0.0, np.minimum(rising, falling)) * area[:, None]


def dct_rows(n_out: int, size: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k, n = np.arange(n_out)[:, None], np.arange(size)[None, :]
    rows = np.sqrt(2.0 / size) * np.cos(np.pi * k * (2 * n + 1) / (2 * size))
    rows[0] /= np.sqrt(2.0)
    return rows


def clip_maximum(df: DataFrame, series: str, vector: str, out: str) -> DataFrame:
    """Adds the greatest value over all frames of the series."""
    top = df.groupBy(series).agg(F.max(F.array_max(vector)).alias(out))
    return df.join(top, series)


def amplitude_db(df: DataFrame, series: str, power: str = "power", out: str = "db") -> DataFrame:
    """Magnitudes in dB below the loudest of the series, at most ``DB_FLOOR`` below it."""
    marked = clip_maximum(df, series, power, "top_power")
    low = 1e-5
    top = F.greatest(F.sqrt("top_power"), F.lit(low))
    level = lambda p, t: F.greatest(20 * F.log10(F.greatest(F.sqrt(p), F.lit(low)) / t), F.lit(-DB_FLOOR))
    return marked.withColumn(out, let(top, lambda t: F.transform(power, lambda p: level(p, t)))).drop("top_power")


def log_mel(df: DataFrame, series: str, mel: str = "mel", out: str = "log_mel") -> DataFrame:
    """Mel powers in dB, at most ``DB_FLOOR`` below the loudest of the series."""
    low = 1e-10
    raised = df.withColumn(out, F.transform(mel, lambda p: 10 * F.log10(F.greatest(p, F.lit(low)))))
    marked = clip_maximum(raised, series, out, "top_db")
    return marked.withColumn(out, F.transform(out, lambda v: F.greatest(v, F.col("top_db") - DB_FLOOR))).drop("top_db")


def mel_spectrogram(df: DataFrame, width: int, rate: float, n_mels: int = N_MELS, power: str = "power") -> DataFrame:
    return df.withColumn("mel", weighted_rows(F.col(power), mel_filters(width, rate, n_mels)))


def mfcc(df: DataFrame, series: str, n_mfcc: int = N_MFCC, mel: str = "mel", n_mels: int = N_MELS) -> DataFrame:
    """Cepstral coefficients from a mel table."""
    if n_mfcc > n_mels:
        raise ValueError("more coefficients than mel bands")
    logged = log_mel(df, series, mel)
    return logged.withColumn("mfcc", weighted_rows(F.col("log_mel"), dct_rows(n_mfcc, n_mels))).drop("log_mel")


def spectral_centroid(power: Column, freqs: Sequence[float]) -> Column:
    """Mean frequency weighted by magnitude; 0 for a silent frame."""
    grid = F.array(*[F.lit(float(f)) for f in freqs])

    def centre(size: Column) -> Column:
        weighted = array_sum(F.zip_with(size, grid, lambda m, f: m * f))
        return F.coalesce(F.try_divide(weighted, array_sum(size)), F.lit(0.0))

    return let(F.transform(power, lambda p: F.sqrt(p)), centre)


def spectral_rolloff(power: Column, freqs: Sequence[float], percent: float = ROLL_PERCENT) -> Column:
    """Lowest frequency below which the given share of the magnitude lies."""
    grid = F.array(*[F.lit(float(f)) for f in freqs])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("bin"), F.lit(0).alias("seen"))

    def first_bin(size: Column, limit: Column) -> Column:
        def step(state: Column, m: Column) -> Column:
            total = state["sum"] + m
            hit = (state["bin"] < 0) & (total >= limit)
            return F.struct(
                total.alias("sum"),
                F.when(hit, state["seen"]).otherwise(state["bin"]).alias("bin"),
                (state["seen"] + 1).alias("seen"),
            )

        return F.aggregate(size, start, step, lambda s: F.get(grid, s["bin"]))

    sizes = F.transform(power, lambda p: F.sqrt(p))
    return let(sizes, lambda size: let(array_sum(size) * percent - 1e-12, lambda limit: first_bin(size, limit)))


def chroma_filters(width: int, rate: float, tuning: float = 0.0) -> np.ndarray:
    """Weight of each bin for each pitch class, C first: Gaussians as wide as the step to the next bin, at least a semitone.

    A bin's weights have length 1, times a Gaussian over the octaves around the sixth (A0 starts the first). ``tuning`` moves
    the scale by a share of a semitone.
    """
    semitones = 12 * np.log2(rate * np.arange(1, width) / width / (LOWEST_A * 2 ** (tuning / 12)))
    place = np.concatenate([[semitones[0] - 18], semitones])  # the bin at 0 Hz: an octave and a half below the next
    spread = np.concatenate([np.maximum(np.diff(place), 1.0), [1.0]])
    apart = (place - np.arange(12)[:, None] + 6) % 12 - 6
    weights = np.exp(-2 * (apart / spread) ** 2)
    weights /= np.sqrt((weights**2).sum(axis=0))
    weights *= np.exp(-0.5 * ((place / 12 - 5) / 2) ** 2)
    return np.roll(weights, -3, axis=0)[:, : width // 2 + 1]


def spectral_peaks(power: Column, width: int, rate: float) -> Column:
    """(pitch, size) of the local maxima between 150 and 4000 Hz above a tenth of the frame's largest power, by parabolas."""
    top = min(PEAK_HERTZ[1], rate / 2)
    bins = [b for b, f in enumerate(frequencies(width, rate)) if 0 < b < width // 2 and PEAK_HERTZ[0] <= f < top]
    if not bins:
        return F.expr("array()").cast("array<struct<pitch:double,size:double>>")

    def at(b: Column, least: Column) -> Column:
        left, here, right = (F.get(power, b + d) for d in (-1, 0, 1))
        slope, bend = (right - left) / 2, right + left - 2 * here
        moved = -slope / bend
        found = F.struct(((b + moved) * (rate / width)).alias("pitch"), (here + 0.5 * slope * moved).alias("size"))
        return F.when((here > least) & (here > left) & (here >= right), found)

    numbers = F.sequence(F.lit(bins[0]), F.lit(bins[-1]))
    return let(PEAK_SHARE * F.array_max(power), lambda least: F.array_compact(F.transform(numbers, lambda b: at(b, least))))


def tuning_of(pitches: np.ndarray, sizes: np.ndarray) -> float:
    """The share of a semitone, from -0.5 in steps of 0.01, by which most of the larger half of the peaks lies beside the scale."""
    if len(pitches) == 0:
        return 0.0
    semitones = 12 * np.log2(pitches[sizes >= np.median(sizes)] / LOWEST_A)
    beside = semitones - np.floor(semitones)
    beside = np.where(beside >= 0.5, beside - 1, beside)
    cells = np.floor((beside + 0.5) * TUNING_STEPS).astype(int)
    return (int(np.bincount(cells, minlength=TUNING_STEPS).argmax()) - TUNING_STEPS // 2) / TUNING_STEPS


def tunings(frames: DataFrame, series: str, width: int, rate: float, power: str = "power") -> DataFrame:
    """(series, tuning): how far each clip is out of tune; 0 without peaks. A clip is bounded, so its peaks are one row."""

    @F.pandas_udf("double")
    def estimate(peaks: pd.Series) -> pd.Series:
        return pd.Series([tuning_of(*np.array([(e["pitch"], e["size"]) for e in found], dtype=float).reshape(-1, 2).T) for found in peaks], dtype=float)

    gathered = frames.groupBy(series).agg(F.flatten(F.collect_list(spectral_peaks(F.col(power), width, rate))).alias("peaks"))
    return gathered.select(series, estimate("peaks").alias("tuning"))


def with_chroma(frames: DataFrame, series: str, width: int, rate: float, power: str = "power", out: str = "chroma") -> DataFrame:
    """Adds the power per pitch class, C first, divided by the largest class of the frame (0 for a silent one).

    The filter bank is that of the clip's tuning, one of ``TUNING_STEPS``.
    """

    @F.pandas_udf("array<double>")
    def shares(powers: pd.Series, tuning: pd.Series) -> pd.Series:
        made = np.zeros((len(powers), 12))
        for t in tuning.unique():
            rows = (tuning == t).to_numpy()
            made[rows] = np.stack(powers[rows].to_numpy()) @ chroma_filters(width, rate, t).T
        top = made.max(axis=1, initial=0, keepdims=True)
        return pd.Series(list(made / np.where(top > 0, top, 1)))

    tuned = null_safe_join(frames, tunings(frames, series, width, rate, power), [series])
    return tuned.withColumn(out, shares(power, "tuning")).drop("tuning")


def matrix_by_series(df: DataFrame, series: str, vector: str, out: str = "matrix") -> DataFrame:
    """The frames of a series gathered in order as one matrix (frames x values).

    A series is a clip of fixed length, so its matrix is one bounded row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col(vector).alias("v"))))
    return df.groupBy(series).agg(F.transform(ordered, lambda e: e["v"]).alias(out))


def delta(matrix: Column, order: int = 1) -> Column:
    """First or second derivative over a 9-frame window of a (frames x values) matrix.

    Edge frames take the value of the nearest full window.
    """
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    weights = DELTA_WEIGHTS if order == 1 else DELTA2_WEIGHTS
    frames = F.size(matrix)

    def at(centre: Column) -> Column:
        values = F.sequence(F.lit(0), F.size(F.get(matrix, F.lit(0))) - 1)

        def one(v: Column) -> Column:
            total = F.lit(0.0)
            for j, w in enumerate(weights):
                total = total + F.lit(w) * F.get(F.get(matrix, centre + (j - 4)), v)
            return total

        return F.transform(values, one)

    full = F.transform(
        F.sequence(F.lit(0), frames - 1), lambda t: at(F.least(F.greatest(t, F.lit(4)), frames - 5))
    )
    return F.when(frames < 9, F.raise_error(F.lit("delta needs at least 9 frames"))).otherwise(full)


def spectral_frames(df: DataFrame, series: str, samples: str, width: int, hop: int) -> DataFrame:
    """Frame rows with their power spectrum."""
    frames = framed(df.select(series, samples), samples, width, hop)
    return frames.withColumn("power", power_spectrum(F.col("x"), width))


def combined(
    df: DataFrame,
    series: str,
    samples: str,
    rate: float,
    width: int = N_FFT,
    hop: int = HOP,
    use_rms: bool = True,
    use_zcr: bool = True,
    use_centroid: bool = True,
    use_rolloff: bool = True,
    n_mfcc: int = 13,
    pitch_classes: Sequence[str] | None = tuple(PITCH_CLASSES),
    n_mels: int = N_MELS,
) -> DataFrame:
    """Per clip the means of the chosen frame features, one column each."""
    frames = spectral_frames(df, series, samples, width, hop)
    freqs = frequencies(width, rate)
    if n_mfcc:
        frames = mfcc(mel_spectrogram(frames, width, rate, n_mels), series, n_mfcc, n_mels=n_mels)
    if pitch_classes:
        frames = with_chroma(frames, series, width, rate)
    means = []
    if use_rms:
        means.append(F.avg(rms(F.col("x"))).alias("rms"))
    if use_centroid:
        means.append(F.avg(spectral_centroid(F.col("power"), freqs)).alias("spectral_centroid"))
    if use_rolloff:
        means.append(F.avg(spectral_rolloff(F.col("power"), freqs)).alias("spectral_rolloff"))
    means += [F.avg(F.get("mfcc", F.lit(i))).alias(f"mfcc_{i + 1}") for i in range(n_mfcc)]
    means += [F.avg(F.get("chroma", F.lit(i))).alias(f"chroma_{c}") for i, c in enumerate(pitch_classes or [])]
    if not means and not use_zcr:
        raise ValueError("no feature chosen")
    found = frames.groupBy(series).agg(*means) if means else None
    if not use_zcr:
        return found
    edges = framed(df.select(series, samples), samples, width, hop, edge=True)
    signs = edges.groupBy(series).agg(F.avg(zero_crossing_rate(F.col("x"))).alias("zcr"))
    if found is None:
        return signs
    order = [series, *(["rms"] if use_rms else []), "zcr", *[c for c in found.columns if c not in (series, "rms")]]
    return null_safe_join(found, signs, [series]).select(*order)


FEATURES = ("stft", "mel", "mfcc", "pe-mfcc", "mfcc2", "delta", "delta2", "zcr", "rms", "speccen", "specrol", "chroma")


def parse_feature(name: str) -> tuple[str, int | None]:
    """``mfcc_40`` -> ("mfcc", 40); an unknown feature is an error."""
    base, _, option = name.partition("_")
    if base not in FEATURES:
        raise ValueError(f"unknown feature {name!r}, expected one of {FEATURES}")
    return base, int(option) if option else None


def feature_matrix(
    df: DataFrame, series: str, samples: str, feature: str, rate: float, width: int = N_FFT, hop: int = HOP,
    n_mels: int = N_MELS,
) -> DataFrame:
    """The named feature of each series as a matrix (values x frames)."""
    base, option = parse_feature(feature)
    signal = df.select(series, F.col(samples).cast("array<double>").alias("samples"))
    if base == "pe-mfcc":
        signal = signal.withColumn("samples", pre_emphasis(F.col("samples")))
    freqs = frequencies(width, rate)
    if base in ("rms", "zcr"):
        frames = framed(signal, "samples", width, hop, edge=base == "zcr")
        value = rms(F.col("x")) if base == "rms" else zero_crossing_rate(F.col("x"))
        frames = frames.withColumn("v", F.array(value))
    else:
        frames = spectral_frames(signal, series, "samples", width, hop).drop("x")
        if base == "stft":
            frames = amplitude_db(frames, series, out="v")
        elif base == "speccen":
            frames = frames.withColumn("v", F.array(spectral_centroid(F.col("power"), freqs)))
        elif base == "specrol":
            frames = frames.withColumn("v", F.array(spectral_rolloff(F.col("power"), freqs)))
        elif base == "chroma":
            frames = with_chroma(frames, series, width, rate, out="v")
        elif base == "mel":
            frames = mel_spectrogram(frames, width, rate, option or n_mels).withColumnRenamed("mel", "v")
        else:
            count = N_MFCC if base == "mfcc2" else option or N_MFCC
            frames = mfcc(mel_spectrogram(frames, width, rate, n_mels), series, count, n_mels=n_mels)
            frames = frames.withColumnRenamed("mfcc", "v")
    gathered = matrix_by_series(frames, series, "v")
    if base in ("delta", "delta2"):
        gathered = gathered.withColumn("matrix", delta(F.col("matrix"), 1 if base == "delta" else 2))
    return gathered.select(F.col(series), F.lit(feature).alias("feature"), transpose(F.col("matrix")).alias("matrix"))
