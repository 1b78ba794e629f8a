"""Queries on signal features and partition functions; a signal is the 64 values of a vector.

Frames have 16 samples and a hop of 8, the sampling rate is 1600 Hz.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vecflow.catalog.registry import Tables, cells, query, r6
from vecflow.functions.vectors import doubles
from vecflow.operators import partitions, signals
from vecflow.session import scratch_path
from vecflow.sources import stores

WIDTH, HOP, RATE, MELS, N_MFCC = 16, 8, 1600.0, 6, 4


def _signals(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", doubles(F.col("embedding")).alias("samples"))


def _frames(t: Tables) -> DataFrame:
    return signals.framed(_signals(t), "samples", WIDTH, HOP)


def _spectra(t: Tables) -> DataFrame:
    return signals.spectral_frames(_signals(t), "vec_id", "samples", WIDTH, HOP)


FREQS = signals.frequencies(WIDTH, RATE)

SAMPLES_SQL = """
WITH x AS (SELECT vec_id, i - 1 AS pos, v AS x FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
FRAMES_SQL = SAMPLES_SQL + """,
slot AS (SELECT vec_id, f.f AS frame, n.n AS n, 8 * f.f + n.n - 8 AS pos FROM (SELECT vec_id FROM embeddings), range(9) AS f(f), range(16) AS n(n)),
fr AS (SELECT slot.vec_id, frame, n, coalesce(x, 0) AS x FROM slot LEFT JOIN x ON x.vec_id = slot.vec_id AND x.pos = slot.pos),
ed AS (SELECT slot.vec_id, frame, n, x FROM slot JOIN x ON x.vec_id = slot.vec_id AND x.pos = least(greatest(slot.pos, 0), 63))"""


def power_sql(frames: str, out: str) -> str:
    return f"""
ri_{out} AS (SELECT vec_id, frame, b.b AS bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * b.b * n / 16)) AS re,
              sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * b.b * n / 16)) AS im FROM {frames}, range(9) AS b(b) GROUP BY ALL),
{out} AS (SELECT vec_id, frame, bin, re * re + im * im AS p FROM ri_{out})"""


def mel_sql(power: str, out: str, mels: int) -> str:
    """Triangular filters, written out as the formula of the mel scale."""
    return f"""
ed_{out} AS (SELECT i.i AS i, 12.0::DOUBLE * i.i / {mels + 1} * (200.0::DOUBLE / 3) AS hz FROM range({mels + 2}) AS i(i)),
fl_{out} AS (SELECT a.i AS mel, b.b AS bin, greatest(0, least((100.0 * b.b - a.hz) / (c.hz - a.hz), (d.hz - 100.0 * b.b) / (d.hz - c.hz))) * 2 / (d.hz - a.hz) AS w
       FROM ed_{out} a JOIN ed_{out} c ON c.i = a.i + 1 JOIN ed_{out} d ON d.i = a.i + 2, range(9) AS b(b)),
{out} AS (SELECT vec_id, frame, mel, sum(w * p) AS m FROM {power} JOIN fl_{out} USING (bin) GROUP BY ALL)"""


def mfcc_sql(mel: str, out: str, mels: int, count: int) -> str:
    return f"""
db_{out} AS (SELECT vec_id, frame, mel, 10 * log10(greatest(m, 1e-10)) AS d FROM {mel}),
cl_{out} AS (SELECT vec_id, frame, mel, greatest(d, max(d) OVER (PARTITION BY vec_id) - 80) AS d FROM db_{out}),
{out} AS (SELECT vec_id, frame, k.k AS k, sum(d * sqrt(2.0::DOUBLE / {mels}) * cos(pi() * k.k * (2 * mel + 1) / (2 * {mels})) * CASE WHEN k.k = 0 THEN 1 / sqrt(2.0::DOUBLE) ELSE 1 END) AS c
       FROM cl_{out}, range({count}) AS k(k) GROUP BY ALL)"""


POWER_SQL = FRAMES_SQL + "," + power_sql("fr", "pw")
MEL_SQL = POWER_SQL + "," + mel_sql("pw", "ml", MELS)
MFCC_SQL = MEL_SQL + "," + mfcc_sql("ml", "mf", MELS, N_MFCC)


@query("s21_signal_slice", SAMPLES_SQL + " SELECT vec_id, pos - 16 AS pos, round(x + 1e-9, 6) AS x FROM x WHERE pos >= 16 AND pos < 48")
def signal_slice(t: Tables) -> DataFrame:
    part = signals.slice_seconds(F.col("samples"), F.lit(16), F.lit(1), F.lit(2))
    return cells(_signals(t).withColumn("part", part), "vec_id", "part")


@query("f01_pre_emphasis", SAMPLES_SQL + """
SELECT vec_id, pos, round(x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY pos), 0) + 1e-9, 6) AS x FROM x""")
def pre_emphasis(t: Tables) -> DataFrame:
    return cells(_signals(t).withColumn("y", signals.pre_emphasis(F.col("samples"))), "vec_id", "y")


# signals of 4 to 64 samples: shorter than a frame, or with a tail
@query("f02_frames", """
WITH c AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 4 + vec_id % 61) AS v FROM embeddings),
f AS (SELECT vec_id, v, unnest(range(len(v) // 8 + 1)) AS frame FROM c),
n AS (SELECT *, unnest(range(16)) AS n FROM f)
SELECT vec_id, frame::INT AS frame, n::INT AS n, round(CASE WHEN 8 * frame + n >= 8 THEN coalesce(v[8 * frame + n - 7], 0) ELSE 0 END + 1e-9, 6) AS x FROM n""")
def frames(t: Tables) -> DataFrame:
    short = _signals(t).withColumn("samples", F.slice("samples", 1, (4 + F.col("vec_id") % 61).cast("int")))
    framed = signals.framed(short, "samples", WIDTH, HOP)
    return framed.select("vec_id", "frame", F.posexplode("x").alias("n", "x")).withColumn("x", r6(F.col("x")))


@query("f02_whole_frames", FRAMES_SQL + " SELECT vec_id, frame, n, round(x + 1e-9, 6) AS x FROM fr")
def whole_frames(t: Tables) -> DataFrame:
    return _frames(t).select("vec_id", "frame", F.posexplode("x").alias("n", "x")).withColumn("x", r6(F.col("x")))


@query("f03_rms", FRAMES_SQL + " SELECT vec_id, frame, round(sqrt(avg(x * x)) + 1e-9, 6) AS rms FROM fr GROUP BY ALL")
def rms(t: Tables) -> DataFrame:
    return _frames(t).select("vec_id", "frame", r6(signals.rms(F.col("x"))).alias("rms"))


@query("f04_zero_crossings", FRAMES_SQL + """
, l AS (SELECT *, lag(x) OVER (PARTITION BY vec_id, frame ORDER BY n) AS p FROM ed)
SELECT vec_id, frame, round(sum(CASE WHEN p IS NOT NULL AND (x < 0) <> (p < 0) THEN 1 ELSE 0 END) / 16 + 1e-9, 6) AS zcr FROM l GROUP BY ALL""")
def zero_crossings(t: Tables) -> DataFrame:
    edges = signals.framed(_signals(t), "samples", WIDTH, HOP, edge=True)
    return edges.select("vec_id", "frame", r6(signals.zero_crossing_rate(F.col("x"))).alias("zcr"))


@query("f05_power_spectrum", POWER_SQL + " SELECT vec_id, frame, bin, round(p + 1e-9, 6) AS power FROM pw")
def power_spectrum(t: Tables) -> DataFrame:
    return _spectra(t).select("vec_id", "frame", F.posexplode("power").alias("bin", "power")).withColumn("power", r6(F.col("power")))


@query("f05_spectrum_db", POWER_SQL + """
, a AS (SELECT *, sqrt(p) AS m, max(sqrt(p)) OVER (PARTITION BY vec_id) AS top FROM pw)
SELECT vec_id, frame, bin, round(greatest(20 * log10(greatest(m, 1e-5) / greatest(top, 1e-5)), -80) + 1e-9, 4) AS db FROM a""")
def spectrum_db(t: Tables) -> DataFrame:
    levels = signals.amplitude_db(_spectra(t), "vec_id")
    long = levels.select("vec_id", "frame", F.posexplode("db").alias("bin", "db"))
    return long.withColumn("db", F.round(F.col("db") + 1e-9, 4))


@query("f06_mel_spectrogram", MEL_SQL + " SELECT vec_id, frame, mel, round(m * 1000 + 1e-9, 6) AS power FROM ml")
def mel_spectrogram(t: Tables) -> DataFrame:
    rows = signals.mel_spectrogram(_spectra(t), WIDTH, RATE, MELS)
    long = rows.select("vec_id", "frame", F.posexplode("mel").alias("mel", "power"))
    return long.withColumn("power", r6(F.col("power") * 1000))


def _mfcc(t: Tables) -> DataFrame:
    rows = signals.mel_spectrogram(_spectra(t), WIDTH, RATE, MELS)
    return signals.mfcc(rows, "vec_id", N_MFCC, n_mels=MELS)


@query("f07_mfcc", MFCC_SQL + " SELECT vec_id, frame, k::INT AS k, round(c + 1e-9, 5) AS c FROM mf")
def mfcc(t: Tables) -> DataFrame:
    long = _mfcc(t).select("vec_id", "frame", F.posexplode("mfcc").alias("k", "c"))
    return long.withColumn("c", F.round(F.col("c") + 1e-9, 5))


def delta_sql(weights: str, alias: str) -> str:
    """Windows over the samples of each vector, read as 8 coefficients with ... 64 frames of one value."""
    return SAMPLES_SQL + f"""
, w AS (SELECT unnest([{weights}]) AS w, unnest(range(-4, 5)) AS j),
c AS (SELECT x.vec_id, x.pos AS centre, sum(w.w * y.x) AS d FROM x, w JOIN x y ON y.vec_id = x.vec_id AND y.pos = x.pos + w.j
      WHERE x.pos BETWEEN 4 AND 59 GROUP BY ALL)
SELECT x.vec_id, x.pos AS frame, round(d + 1e-9, 6) AS {alias} FROM x JOIN c ON c.vec_id = x.vec_id AND c.centre = least(greatest(x.pos, 4), 59)"""


def _delta(t: Tables, order: int, alias: str) -> DataFrame:
    matrix = _signals(t).withColumn("m", F.transform("samples", lambda x: F.array(x)))
    rows = matrix.select("vec_id", F.posexplode(signals.delta(F.col("m"), order)).alias("frame", "d"))
    return rows.select("vec_id", "frame", r6(F.get("d", F.lit(0))).alias(alias))


@query("f08_delta", delta_sql(", ".join(f"{n}.0::DOUBLE / 60" for n in range(-4, 5)), "delta"))
def delta(t: Tables) -> DataFrame:
    return _delta(t, 1, "delta")


@query("f08_delta2", delta_sql(", ".join(f"{n}.0::DOUBLE / 462" for n in (28, 7, -8, -17, -20, -17, -8, 7, 28)), "delta2"))
def delta2(t: Tables) -> DataFrame:
    return _delta(t, 2, "delta2")


def _mfcc_delta_sql() -> str:
    """Both derivatives of every coefficient over windows of 9 frames; edge frames take the nearest full window."""
    weights = ", ".join(f"({j}, {j}.0::DOUBLE / 60, {n}.0::DOUBLE / 462)" for j, n in zip(range(-4, 5), (28, 7, -8, -17, -20, -17, -8, 7, 28)))
    return MFCC_SQL + f""",
last AS (SELECT vec_id, max(frame) AS last FROM mf GROUP BY vec_id),
d AS (SELECT m.vec_id, m.frame, m.k, sum(w.a * y.c) AS d1, sum(w.b * y.c) AS d2 FROM mf m JOIN last USING (vec_id), (VALUES {weights}) AS w(j, a, b)
      JOIN mf y ON y.vec_id = m.vec_id AND y.k = m.k AND y.frame = least(greatest(m.frame, 4), last - 4) + w.j GROUP BY ALL)
SELECT vec_id, frame, k::INT AS k, round(d1 + 1e-9, 5) AS delta, round(d2 + 1e-9, 5) AS delta2 FROM d"""


@query("f08_mfcc_deltas", _mfcc_delta_sql())
def mfcc_deltas(t: Tables) -> DataFrame:
    # the frames of a clip, which has a fixed length
    clips = _mfcc(t).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "mfcc"))), lambda f: f["mfcc"]).alias("m"))
    both = clips.select("vec_id", signals.delta(F.col("m"), 1).alias("one"), signals.delta(F.col("m"), 2).alias("two"))
    frames = both.select("vec_id", F.posexplode(F.arrays_zip("one", "two")).alias("frame", "d")).select("vec_id", "frame", F.col("d.one").alias("a"), F.col("d.two").alias("b"))
    long = frames.select("vec_id", "frame", F.posexplode(F.arrays_zip("a", "b")).alias("k", "v"))
    return long.select("vec_id", "frame", "k", F.round(F.col("v.a") + 1e-9, 5).alias("delta"), F.round(F.col("v.b") + 1e-9, 5).alias("delta2"))


@query("f09_spectral_centroid", POWER_SQL + """
SELECT vec_id, frame, round(sum(100.0 * bin * sqrt(p)) / sum(sqrt(p)) + 1e-9, 6) AS centroid FROM pw GROUP BY ALL""")
def spectral_centroid(t: Tables) -> DataFrame:
    value = signals.spectral_centroid(F.col("power"), FREQS)
    return _spectra(t).select("vec_id", "frame", r6(value).alias("centroid"))


@query("f10_spectral_rolloff", POWER_SQL + """
, c AS (SELECT *, sum(sqrt(p)) OVER (PARTITION BY vec_id, frame ORDER BY bin) AS run, sum(sqrt(p)) OVER (PARTITION BY vec_id, frame) AS total FROM pw)
SELECT vec_id, frame, (100.0::DOUBLE * min(bin))::DOUBLE AS rolloff FROM c WHERE run >= 0.85::DOUBLE * total - 1e-12 GROUP BY ALL""")
def spectral_rolloff(t: Tables) -> DataFrame:
    value = signals.spectral_rolloff(F.col("power"), FREQS)
    return _spectra(t).select("vec_id", "frame", value.alias("rolloff"))


# peaks by parabolas, the tuning of a clip, and Gaussian weights of each bin for each pitch class
CHROMA_SQL = """
pk AS (SELECT vec_id, frame, bin, p, lag(p) OVER w AS l, lead(p) OVER w AS r, max(p) OVER (PARTITION BY vec_id, frame) AS top
       FROM pw WINDOW w AS (PARTITION BY vec_id, frame ORDER BY bin)),
pe AS (SELECT vec_id, 100.0::DOUBLE * (bin + s) AS pitch, p + 0.5::DOUBLE * ((r - l) / 2) * s AS size
       FROM (SELECT *, -((r - l) / 2) / (r + l - 2 * p) AS s FROM pk WHERE bin BETWEEN 2 AND 7 AND p > 0.1::DOUBLE * top AND p > l AND p >= r)),
md AS (SELECT vec_id, median(size) AS m FROM pe GROUP BY vec_id),
sm AS (SELECT vec_id, 12 * log2(pitch / 27.5::DOUBLE) AS s FROM pe JOIN md USING (vec_id) WHERE size >= m),
ce AS (SELECT vec_id, floor((CASE WHEN s - floor(s) >= 0.5::DOUBLE THEN s - floor(s) - 1 ELSE s - floor(s) END + 0.5::DOUBLE) * 100) AS cell FROM sm),
cn AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, cell) AS rn FROM ce GROUP BY vec_id, cell),
tu AS (SELECT e.vec_id, coalesce((cell - 50) / 100, 0)::DOUBLE AS tuning FROM embeddings e LEFT JOIN cn ON cn.vec_id = e.vec_id AND rn = 1),
pl AS (SELECT vec_id, b.b AS bin, 12 * log2(100.0::DOUBLE * greatest(b.b, 1) / (27.5::DOUBLE * power(2, tuning / 12))) - CASE b.b WHEN 0 THEN 18 ELSE 0 END AS place FROM tu, range(16) AS b(b)),
sp AS (SELECT *, greatest(1, coalesce(lead(place) OVER (PARTITION BY vec_id ORDER BY bin) - place, 1)) AS spread FROM pl),
ga AS (SELECT vec_id, bin, place, c.c AS c, exp(-2 * power((place - c.c + 6 - 12 * floor((place - c.c + 6) / 12) - 6) / spread, 2)) AS g FROM sp, range(12) AS c(c)),
cw AS (SELECT vec_id, bin, (c + 9) % 12 AS pitch, g / sqrt(sum(g * g) OVER (PARTITION BY vec_id, bin)) * exp(-0.5::DOUBLE * power((place / 12 - 5) / 2, 2)) AS w FROM ga),
ch AS (SELECT vec_id, frame, pitch, sum(w * p) AS p FROM pw JOIN cw USING (vec_id, bin) GROUP BY ALL),
cs AS (SELECT vec_id, frame, pitch, coalesce(p / nullif(max(p) OVER (PARTITION BY vec_id, frame), 0), 0) AS share FROM ch)"""


@query("f11_chroma", POWER_SQL + "," + CHROMA_SQL + """
SELECT vec_id, frame, pitch::INT AS pitch, round(share + 1e-9, 6) AS share FROM cs""")
def chroma(t: Tables) -> DataFrame:
    rows = signals.with_chroma(_spectra(t).select("vec_id", "frame", "power"), "vec_id", WIDTH, RATE)
    return rows.select("vec_id", "frame", F.posexplode("chroma").alias("pitch", "share")).withColumn("share", r6(F.col("share")))


@query("f11_tuning", POWER_SQL + "," + CHROMA_SQL + " SELECT vec_id, tuning FROM tu")
def tuning(t: Tables) -> DataFrame:
    return signals.tunings(_spectra(t), "vec_id", WIDTH, RATE)


# every column of the summary of a clip
@query("f12_combined", MFCC_SQL + "," + CHROMA_SQL + """
, a AS (SELECT vec_id, avg(v) AS rms FROM (SELECT vec_id, frame, sqrt(avg(x * x)) AS v FROM fr GROUP BY ALL) GROUP BY vec_id),
zl AS (SELECT *, lag(x) OVER (PARTITION BY vec_id, frame ORDER BY n) AS p FROM ed),
z AS (SELECT vec_id, avg(v) AS zcr FROM (SELECT vec_id, frame, sum(CASE WHEN p IS NOT NULL AND (x < 0) <> (p < 0) THEN 1 ELSE 0 END) / 16 AS v FROM zl GROUP BY ALL) GROUP BY vec_id),
b AS (SELECT vec_id, avg(v) AS cen FROM (SELECT vec_id, frame, sum(100.0 * bin * sqrt(p)) / sum(sqrt(p)) AS v FROM pw GROUP BY ALL) GROUP BY vec_id),
rr AS (SELECT *, sum(sqrt(p)) OVER (PARTITION BY vec_id, frame ORDER BY bin) AS run, sum(sqrt(p)) OVER (PARTITION BY vec_id, frame) AS total FROM pw),
r AS (SELECT vec_id, avg(v) AS roll FROM (SELECT vec_id, frame, 100.0::DOUBLE * min(bin) AS v FROM rr WHERE run >= 0.85::DOUBLE * total - 1e-12 GROUP BY ALL) GROUP BY vec_id),
""" + "c AS (SELECT vec_id, " + ", ".join(f"avg(c) FILTER (k = {k}) AS m{k}" for k in range(N_MFCC)) + " FROM mf GROUP BY vec_id),\n"
+ "h AS (SELECT vec_id, " + ", ".join(f"coalesce(sum(share) FILTER (pitch = {k}), 0) / 9 AS h{k}" for k in range(12)) + " FROM cs GROUP BY vec_id)\n"
+ "SELECT vec_id, round(rms + 1e-9, 6) AS rms, round(zcr + 1e-9, 6) AS zcr, round(cen + 1e-9, 6) AS spectral_centroid, round(roll + 1e-9, 6) AS spectral_rolloff, "
+ ", ".join(f"round(m{k} + 1e-9, 5) AS mfcc_{k + 1}" for k in range(N_MFCC)) + ", "
+ ", ".join(f'round(h{k} + 1e-9, 6) AS "chroma_{c}"' for k, c in enumerate(signals.PITCH_CLASSES))
+ " FROM a JOIN z USING (vec_id) JOIN b USING (vec_id) JOIN r USING (vec_id) JOIN c USING (vec_id) JOIN h USING (vec_id)")
def combined(t: Tables) -> DataFrame:
    rows = signals.combined(_signals(t), "vec_id", "samples", RATE, WIDTH, HOP, n_mfcc=N_MFCC, n_mels=MELS)
    digits = lambda c: 5 if c.startswith("mfcc") else 6
    return rows.select("vec_id", *[F.round(F.col(f"`{c}`") + 1e-9, digits(c)).alias(c) for c in rows.columns if c != "vec_id"])


JOB_FEATURES = {f: MELS for f in ("stft", "mel", "mfcc_4", "pe-mfcc_4", "delta_4", "delta2_4", "zcr", "rms", "speccen", "specrol", "chroma")} | {"mfcc2": 24}

FEATURE_JOB_SQL = MFCC_SQL + "," + ",".join([
    mel_sql("pw", "ml24", 24), mfcc_sql("ml24", "mf24", 24, signals.N_MFCC),
    f"""
xp AS (SELECT vec_id, pos, x - {signals.PRE_EMPHASIS}::DOUBLE * coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY pos), 0) AS x FROM x),
frp AS (SELECT slot.vec_id, frame, n, coalesce(x, 0) AS x FROM slot LEFT JOIN xp ON xp.vec_id = slot.vec_id AND xp.pos = slot.pos)""",
    power_sql("frp", "pwp"), mel_sql("pwp", "mlp", MELS), mfcc_sql("mlp", "mfp", MELS, N_MFCC), CHROMA_SQL,
    """
tp AS (SELECT vec_id, greatest(sqrt(max(p)), 1e-5) AS top FROM pw GROUP BY vec_id),
zl AS (SELECT *, lag(x) OVER (PARTITION BY vec_id, frame ORDER BY n) AS q FROM ed),
rr AS (SELECT *, sum(sqrt(p)) OVER (PARTITION BY vec_id, frame ORDER BY bin) AS run, sum(sqrt(p)) OVER (PARTITION BY vec_id, frame) AS total FROM pw),
de AS (SELECT vec_id, k, sum(c * (frame - 4) / 60) AS d1, sum(c * [28, 7, -8, -17, -20, -17, -8, 7, 28][frame + 1] / 462) AS d2 FROM mf GROUP BY ALL),
vals AS (SELECT 'stft' AS feature, vec_id, bin AS r, frame AS f, greatest(20 * log10(greatest(sqrt(p), 1e-5) / top), -80) AS v FROM pw JOIN tp USING (vec_id)
UNION ALL SELECT 'mel', vec_id, mel, frame, m FROM ml
UNION ALL SELECT 'mfcc_4', vec_id, k, frame, c FROM mf
UNION ALL SELECT 'mfcc2', vec_id, k, frame, c FROM mf24
UNION ALL SELECT 'pe-mfcc_4', vec_id, k, frame, c FROM mfp
UNION ALL SELECT 'delta_4', vec_id, k, g.g, d1 FROM de, range(9) AS g(g)
UNION ALL SELECT 'delta2_4', vec_id, k, g.g, d2 FROM de, range(9) AS g(g)
UNION ALL SELECT 'zcr', vec_id, 0, frame, sum(CASE WHEN q IS NOT NULL AND (x < 0) <> (q < 0) THEN 1 ELSE 0 END) / 16 FROM zl GROUP BY ALL
UNION ALL SELECT 'rms', vec_id, 0, frame, sqrt(avg(x * x)) FROM fr GROUP BY ALL
UNION ALL SELECT 'speccen', vec_id, 0, frame, sum(100.0 * bin * sqrt(p)) / sum(sqrt(p)) FROM pw GROUP BY ALL
UNION ALL SELECT 'specrol', vec_id, 0, frame, 100.0::DOUBLE * min(bin) FROM rr WHERE run >= 0.85::DOUBLE * total - 1e-12 GROUP BY ALL
UNION ALL SELECT 'chroma', vec_id, pitch, frame, share FROM cs)
SELECT feature, vec_id, max(r)::INT + 1 AS n_values, max(f)::INT + 1 AS frames, round(avg(v) + 1e-9, 4) AS average,
       round(avg(v * (1 + (7 * r + 3 * f) % 5)) + 1e-9, 4) AS placed FROM vals GROUP BY ALL""",
])


@query("f13_feature_job", FEATURE_JOB_SQL)
def feature_job(t: Tables) -> DataFrame:
    """Every feature of every clip, stored by feature; of each stored matrix its shape, mean and a mean weighted by place."""
    path = scratch_path(t.spark, "features")
    made = [signals.feature_matrix(_signals(t), "vec_id", "samples", f, RATE, WIDTH, HOP, mels) for f, mels in JOB_FEATURES.items()]
    stores.write_features(reduce(DataFrame.unionByName, made), path)
    rows = t.spark.read.parquet(path).select("feature", "vec_id", F.posexplode("matrix").alias("r", "values"))
    cells = rows.select("feature", "vec_id", "r", F.posexplode("values").alias("f", "v"))
    digits = lambda value: F.round(F.avg(value) + 1e-9, 4)
    return cells.groupBy("feature", "vec_id").agg(
        (F.max("r") + 1).alias("n_values"), (F.max("f") + 1).alias("frames"), digits(F.col("v")).alias("average"),
        digits(F.col("v") * (1 + (7 * F.col("r") + 3 * F.col("f")) % 5)).alias("placed"),
    )


# ---------------------------------------------------------------- user functions


@query("x1_row_function", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + 1e-9, 4) AS charged FROM lineitem""")
def row_function(t: Tables) -> DataFrame:
    charged = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + 1e-9, 4)
    rows = partitions.map_rows(t.lineitem, charged=charged)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "charged")


def _label_counts(batches, number):
    """One frame per partition, however many batches it has."""
    counts = Counter()
    for batch in batches:
        counts.update(batch["label"])
    yield pd.DataFrame({"label": list(counts), "size": list(counts.values()), "part": number})


@query("x2_partition_function", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def partition_function(t: Tables) -> DataFrame:
    parts = partitions.map_partitions(t.embeddings.select("label"), _label_counts, "label int, size bigint, part int")
    return parts.groupBy("label").agg(F.sum("size").alias("n"))


def _totals(batches, number):
    found = [(len(batch), batch["o_totalprice"].sum()) for batch in batches]
    yield pd.DataFrame({"n": [sum(n for n, _ in found)], "total": [float(sum(x for _, x in found))]})


@query("x3_table_function", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def table_function(t: Tables) -> DataFrame:
    parts = partitions.map_table(t.orders.select("o_totalprice"), _totals, "n bigint, total double")
    return parts.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def _large_orders(batches, number):
    for batch in batches:
        yield batch[batch["total"] > 100_000].assign(kind=batch["tags"].str[0])[["key", "total", "kind"]]


@query("x4_record_function", """
SELECT o_orderkey AS key, o_totalprice AS total, o_orderstatus AS kind FROM orders WHERE o_totalprice > 100000""")
def record_function(t: Tables) -> DataFrame:
    lines = t.orders.select(F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), F.array("o_orderstatus").alias("tags"))).alias("value"))
    return partitions.map_records(lines, "key bigint, total double, tags array<string>", _large_orders, "key bigint, total double, kind string")
