"""Filter, spectrum and detector queries; an embedding is a short trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators import signals as S
from pulsegrid.plans.registry import query

E = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"
PSD = E + """, u AS (SELECT vec_id, i - 1 AS n, b[i] - list_avg(b) AS x FROM e, (SELECT unnest(range(1, 65)) AS i)),
 w AS (SELECT vec_id, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS x FROM u),
 f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * n / 64)) AS re, sum(x * sin(2 * pi() * k * n / 64)) AS im FROM w, (SELECT unnest(range(0, 33)) AS k) GROUP BY 1, 2),
 p AS (SELECT vec_id, k, k * 1000 / 64.0 AS f, (re * re + im * im) / (1000 * 24.0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM f)"""


def traces(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def spectra(t):
    return traces(t).select("vec_id", S.spectrum(F.col("x"), 1000.0, 64).alias("psd"))


@query("welch_psd", PSD + " SELECT vec_id, CAST(k AS INTEGER) AS k, round(f, 4) AS f, round(p * 1000000, 5) AS p_micro FROM p")
def welch_psd(t):
    s = spectra(t).select("vec_id", F.posexplode("psd").alias("k", "s"))
    return s.select("vec_id", "k", F.round("s.f", 4).alias("f"), F.round(F.col("s.p") * 1000000, 5).alias("p_micro"))


@query("band_power", PSD + """, z AS (SELECT *, lead(f) OVER (PARTITION BY vec_id ORDER BY k) AS f2, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS p2 FROM p)
SELECT vec_id, round(1000 * sum(CASE WHEN f >= 40 AND f2 <= 120 THEN (f2 - f) * (p + p2) / 2 END), 6) AS cardiac, round(sum(CASE WHEN f >= 40 AND f2 <= 120 THEN (f2 - f) * (p + p2) / 2 END) / sum((f2 - f) * (p + p2) / 2), 6) AS snr FROM z GROUP BY 1""")
def band_power(t):
    return spectra(t).select("vec_id", F.round(1000 * S.band_power(F.col("psd"), 40, 120), 6).alias("cardiac"), F.round(S.cardiac_share(F.col("psd"), 40, 120), 6).alias("snr"))


@query("dominant_frequency", PSD + """, m AS (SELECT vec_id, list(f ORDER BY p DESC, f)[1] AS dom FROM p WHERE f BETWEEN 0.5 AND 150 GROUP BY 1),
 s AS (SELECT vec_id, list(f ORDER BY p DESC, f)[1] AS safe FROM p WHERE f BETWEEN 0.5 AND 150 AND abs(f - 47) > 2 AND abs(f - 94) > 2 GROUP BY 1),
 r AS (SELECT vec_id, max(CASE WHEN f BETWEEN 40 AND 65 THEN p END) / max(CASE WHEN f BETWEEN 10 AND 35 THEN p END) AS r FROM p GROUP BY 1)
SELECT vec_id, round(dom, 4) AS psd_dom_hz, round(1000 / dom, 5) AS psd_dom_period_ms, round(safe, 4) AS psd_dom_safe_hz, round(r, 4) AS mains_ratio, r > 5 AS mains_leak FROM m JOIN s USING (vec_id) JOIN r USING (vec_id)""")
def dominant_frequency(t):
    d = S.spectrum_diagnosis(F.col("psd"), (40, 65), (10, 35), skip=(47, 94))
    digits = {"psd_dom_period_ms": 5}
    return spectra(t).select("vec_id", *[(F.round(c, digits.get(k, 4)) if k != "mains_leak" else c).alias(k) for k, c in d.items()])


@query("mains_joint", E + """, u AS (SELECT vec_id, i - 1 AS n, b[i] AS x FROM e, (SELECT unnest(range(1, 65)) AS i)),
 c AS (SELECT vec_id, sum(x * cos(2 * pi() * 8 * n / 64)) / 32 AS c1, sum(x * sin(2 * pi() * 8 * n / 64)) / 32 AS s1, sum(x * cos(2 * pi() * 16 * n / 64)) / 32 AS c2, sum(x * sin(2 * pi() * 16 * n / 64)) / 32 AS s2 FROM u GROUP BY 1)
SELECT vec_id, CAST(n AS INTEGER) AS n, round(x - c1 * cos(2 * pi() * 8 * n / 64) - s1 * sin(2 * pi() * 8 * n / 64) - c2 * cos(2 * pi() * 16 * n / 64) - s2 * sin(2 * pi() * 16 * n / 64), 7) AS y FROM u JOIN c USING (vec_id)""")
def mains_joint(t):
    y = S.mains_removed(F.col("x"), 64.0, (8.0, 16.0))
    return traces(t).select("vec_id", F.posexplode(y).alias("n", "y")).withColumn("y", F.round("y", 7))


def tone_sql(i: int, before: str) -> str:
    """Least-squares removal of tone ``i`` from the samples of ``before``, by the two normal equations."""
    return f"""a{i} AS (SELECT vec_id, sum(x * c{i}) AS p, sum(x * s{i}) AS q FROM {before} JOIN w USING (n) GROUP BY 1),
 r{i} AS (SELECT vec_id, n, x - ((ss{i} * p - cs{i} * q) * c{i} + (cc{i} * q - cs{i} * p) * s{i}) / (cc{i} * ss{i} - cs{i} * cs{i}) AS x FROM {before} JOIN w USING (n) JOIN a{i} USING (vec_id), g)"""


@query("mains_sequential", E + f""", u AS (SELECT vec_id, i - 1 AS n, b[i] AS x FROM e, (SELECT unnest(range(1, 65)) AS i)),
 w AS (SELECT n, cos(2 * pi() * 7.5 * n / 64) AS c1, sin(2 * pi() * 7.5 * n / 64) AS s1, cos(2 * pi() * 15.2 * n / 64) AS c2, sin(2 * pi() * 15.2 * n / 64) AS s2 FROM (SELECT unnest(range(0, 64)) AS n)),
 g AS (SELECT sum(c1 * c1) AS cc1, sum(s1 * s1) AS ss1, sum(c1 * s1) AS cs1, sum(c2 * c2) AS cc2, sum(s2 * s2) AS ss2, sum(c2 * s2) AS cs2 FROM w),
 {tone_sql(1, "u")}, {tone_sql(2, "r1")} SELECT vec_id, round(stddev_samp(x), 7) AS sd FROM r2 GROUP BY 1""")
def mains_sequential(t):
    sd = A.sd(S.mains_removed(F.col("x"), 64.0, (7.5, 15.2), joint=False))
    return traces(t).select("vec_id", F.round(sd, 7).alias("sd"))


@query("filter_variants")
def filter_variants(t):
    """Residual of each cleaning variant against the plain band-pass."""
    out = traces(t)
    for m in ("none", "notch30", "notch60", "ls_joint", "ls_sequential"):
        out = out.withColumn(m, S.filtered(F.col("x"), method=m))
    return out.select("vec_id", *[A.rmse(F.col(m), F.col("none")).alias(f"rmse_{m}") for m in ("notch30", "notch60", "ls_joint", "ls_sequential")])


@query("peak_picking")
def peak_picking(t):
    """Spaced peaks by height and prominence, and the two detectors' counts."""
    return traces(t).select("vec_id", S.picked(F.col("x"), 6, 0.05, 0.02).alias("peaks"), S.picked(F.col("x"), 6, None, 0.1).alias("alt"))


@query("polarity_detection")
def polarity_detection(t):
    d = traces(t).select("vec_id", S.detected(F.col("x"), mains=None).alias("d"))
    return d.select("vec_id", "d.inverted", "d.hr", F.size("d.peaks").alias("n_peaks"), "d.error")
