"""Signal features at real frame sizes against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecflow.operators import signals

RATE = 8000.0


@pytest.fixture(scope="module")
def clip(spark):
    t = np.arange(16000) / RATE
    x = np.sin(2 * np.pi * 440 * t) + 0.3 * np.sin(2 * np.pi * 1500 * t) + 0.01 * np.cos(np.arange(16000) ** 1.3)
    return x, spark.createDataFrame([(1, [float(v) for v in x])], "id long, samples array<double>")


def frames_of(x, width=2048, hop=512, mode="constant"):
    x = np.pad(x, width // 2, mode=mode)
    return np.stack([x[s : s + width] for s in range(0, len(x) - width + 1, hop)])


def matrix(clip, feature):
    return np.array(signals.feature_matrix(clip[1], "id", "samples", feature, RATE).first()["matrix"])


def test_shapes(clip):
    frames = len(frames_of(clip[0]))
    assert frames == 32
    for feature, size in [("rms", 1), ("zcr", 1), ("stft", 1025), ("mel", 128), ("mel_40", 40), ("mfcc", 20), ("pe-mfcc_13", 13), ("mfcc2", 20), ("delta_13", 13), ("delta2", 20), ("speccen", 1), ("specrol", 1), ("chroma", 12)]:
        assert matrix(clip, feature).shape == (size, frames), feature


def test_time_features(clip):
    frames = frames_of(clip[0])
    assert matrix(clip, "rms")[0] == pytest.approx(np.sqrt((frames**2).mean(axis=1)))
    frames = frames_of(clip[0], mode="edge")
    flips = (np.signbit(frames[:, 1:]) != np.signbit(frames[:, :-1])).sum(axis=1) / 2048
    assert matrix(clip, "zcr")[0] == pytest.approx(flips)


def test_spectral_features(clip):
    frames = frames_of(clip[0])
    size = np.abs(np.fft.rfft(frames * signals.hann(2048), axis=1))
    freqs = np.arange(1025) * RATE / 2048
    assert matrix(clip, "speccen")[0] == pytest.approx((size * freqs).sum(axis=1) / size.sum(axis=1))
    run = np.cumsum(size, axis=1)
    assert matrix(clip, "specrol")[0] == pytest.approx([freqs[np.argmax(r >= 0.85 * r[-1] - 1e-12)] for r in run])
    assert matrix(clip, "stft").max() == pytest.approx(0) and matrix(clip, "stft").min() >= -80
    chroma = matrix(clip, "chroma")
    assert (chroma.argmax(axis=0) == signals.PITCH_CLASSES.index("A")).all()


def test_mel_filters_cover_the_band():
    filters = signals.mel_filters(2048, RATE, 40)
    assert filters.shape == (40, 1025) and (filters >= 0).all() and (filters.sum(axis=1) > 0).all()
    assert np.allclose(signals.dct_rows(40, 40) @ signals.dct_rows(40, 40).T, np.eye(40))


def test_delta_of_a_line(spark):
    line = F.array(*[F.array(F.lit(3.0 * i)) for i in range(12)])
    found = spark.range(1).select(signals.delta(line, 1).alias("a"), signals.delta(line, 2).alias("b")).first()
    assert [v[0] for v in found["a"]] == pytest.approx([3.0] * 12) and [v[0] for v in found["b"]] == pytest.approx([0.0] * 12, abs=1e-9)


def test_combined_options(clip):
    df = signals.combined(clip[1], "id", "samples", RATE, use_rms=False, n_mfcc=0, pitch_classes=None)
    assert df.columns == ["id", "zcr", "spectral_centroid", "spectral_rolloff"]
    assert len(signals.combined(clip[1], "id", "samples", RATE).columns) == 1 + 4 + 13 + 12
    with pytest.raises(ValueError):
        signals.combined(clip[1], "id", "samples", RATE, use_rms=False, use_zcr=False, use_centroid=False, use_rolloff=False, n_mfcc=0, pitch_classes=None)


def test_unknown_feature(clip):
    with pytest.raises(ValueError, match="unknown feature"):
        signals.feature_matrix(clip[1], "id", "samples", "tempo", RATE)


def test_slice(spark, clip):
    part = signals.slice_seconds(F.col("samples"), F.lit(8000), F.lit(0.5), F.lit(0.25))
    assert clip[1].select(part.alias("x")).first()["x"] == pytest.approx(list(clip[0][4000:6000]))
    whole = signals.slice_seconds(F.col("samples"), F.lit(8000), F.lit(0.5), F.lit(0))
    assert len(clip[1].select(whole.alias("x")).first()["x"]) == 16000


def test_centred_frames_by_hand(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0, 3.0, 4.0, -5.0]), (2, []), (3, None), (4, [7.0])], "id long, s array<double>")
    rows = lambda edge: {(r["id"], r["frame"]): r["x"] for r in signals.framed(df, "s", 4, 2, edge).collect()}
    zeros, edges = rows(False), rows(True)
    assert [zeros[1, f] for f in range(3)] == [[0, 0, 1, -2], [1, -2, 3, 4], [3, 4, -5, 0]]
    assert [edges[1, f] for f in range(3)] == [[1, 1, 1, -2], [1, -2, 3, 4], [3, 4, -5, -5]]
    assert zeros[2, 0] == zeros[3, 0] == edges[2, 0] == [0, 0, 0, 0] and zeros[4, 0] == [0, 0, 7, 0] and edges[4, 0] == [7, 7, 7, 7]
    assert len(zeros) == len(edges) == 6


def test_chroma_filters_by_hand():
    width, rate, tuning = 64, 4000.0, 0.2
    filters = signals.chroma_filters(width, rate, tuning)
    place = [12 * np.log2(rate * max(b, 1) / width / (27.5 * 2 ** (tuning / 12))) - (18 if b == 0 else 0) for b in range(width)]
    for b in range(width // 2 + 1):
        spread = max(place[b + 1] - place[b], 1)
        raw = [np.exp(-2 * (((place[b] - c + 6) % 12 - 6) / spread) ** 2) for c in range(12)]
        scale = np.exp(-0.5 * ((place[b] / 12 - 5) / 2) ** 2) / np.sqrt(sum(g * g for g in raw))
        assert filters[:, b] == pytest.approx([raw[(c + 3) % 12] * scale for c in range(12)])


@pytest.mark.parametrize("beside", [-0.3, 0.0, 0.25])
def test_tuning_of_a_clip(spark, beside):
    t = np.arange(16000) / RATE
    x = sum(np.sin(2 * np.pi * 440 * 2 ** ((n + beside) / 12) * t) for n in (0, 4, 7))
    df = spark.createDataFrame([(1, [float(v) for v in x]), (2, [0.0] * 4096), (None, [0.0])], "id long, samples array<double>")
    frames = signals.spectral_frames(df, "id", "samples", 2048, 512)
    found = {r["id"]: r["tuning"] for r in signals.tunings(frames, "id", 2048, RATE).collect()}
    assert found[1] == pytest.approx(beside, abs=0.06) and found[2] == found[None] == 0
    shares = signals.with_chroma(frames, "id", 2048, RATE).where("id = 1 AND frame = 16").first()["chroma"]
    assert sorted(np.argsort(shares)[-3:]) == sorted(signals.PITCH_CLASSES.index(c) for c in ("A", "C#", "E"))
    silent = signals.with_chroma(frames, "id", 2048, RATE).where("id = 2 OR id IS NULL").collect()
    assert len(silent) == 10 and all(r["chroma"] == [0.0] * 12 for r in silent)
