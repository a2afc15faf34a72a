"""Recordings of thousands of samples: the embeddings of a label on end are one trace, and the largest value of each is a mark."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.operators import long_signals as LS, ordered as O
from pulsegrid.plans.registry import query

S = """WITH e AS (SELECT label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
 s AS (SELECT recording, p * 64 + i - 1 AS i, b[i] AS v FROM e, (SELECT unnest(range(1, 65)) AS i)),
 r AS (SELECT recording, p * 64 + list_position(b, list_max(b)) - 1 AS r, list_max(b) AS h FROM e)"""


def samples(t):
    placed = O.positions(t.embeddings.select("label", "vec_id", "embedding"), ["label"], "vec_id", [], "_p")
    return placed.select(F.col("label").alias("recording_id"), F.posexplode("embedding").alias("i", "mv"), "_p").select(
        "recording_id", ((F.col("_p") - 1) * 64 + F.col("i")).alias("sample_idx"), F.col("mv").cast("double").alias("mv"))


def marks(t):
    placed = O.positions(t.embeddings.select("label", "vec_id", "embedding"), ["label"], "vec_id", [], "_p")
    at = F.array_position("embedding", F.array_max("embedding")) - 1
    return placed.select(F.col("label").alias("recording"), ((F.col("_p") - 1) * 64 + at).alias("r"))


@query("half_height_width", S + """, c AS (SELECT r.recording, r.r, max(CASE WHEN i < r.r AND v < h / 2 THEN i END) AS a, min(CASE WHEN i >= r.r AND v < h / 2 THEN i END) AS b
 FROM r JOIN s ON s.recording = r.recording AND i BETWEEN r.r - 25 AND r.r + 24 GROUP BY 1, 2)
SELECT recording, CAST(r AS BIGINT) AS r, round(CAST(b - a AS DOUBLE), 4) AS qrs_ms FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def half_height_width(t):
    windows = LS.windows_at(LS.blocks_of(samples(t), size=256), marks(t), 25, 25, size=256)
    return LS.half_height_width(windows).withColumn("qrs_ms", F.round("qrs_ms", 4))


@query("return_to_baseline", S + """, w AS (SELECT r.recording, r.r, i - r.r AS o, v FROM r JOIN s ON s.recording = r.recording AND i BETWEEN r.r - 50 AND r.r + 139),
 l AS (SELECT recording, r, avg(v) + 0.01 AS level FROM w WHERE o < -20 GROUP BY 1, 2),
 m AS (SELECT recording, r, max(v) AS top FROM w WHERE o BETWEEN 30 AND 99 GROUP BY 1, 2),
 p AS (SELECT recording, r, min(o) AS t FROM w JOIN m USING (recording, r) WHERE o BETWEEN 30 AND 99 AND v = top GROUP BY 1, 2),
 q AS (SELECT recording, r, min(o) AS qt FROM w JOIN p USING (recording, r) JOIN l USING (recording, r) WHERE o >= t AND o < t + 40 AND v <= level GROUP BY 1, 2)
SELECT recording, CAST(r AS BIGINT) AS r, CAST(qt AS DOUBLE) AS qt_ms FROM q WHERE qt BETWEEN 30 AND 100""")
def return_to_baseline(t):
    windows = LS.windows_at(LS.blocks_of(samples(t), size=256), marks(t), 50, 140, size=256)
    return LS.return_to_baseline(windows).withColumn("qt_ms", F.round("qt_ms", 6))


@query("long_trace_filter")
def long_trace_filter(t):
    b, a = dsp.butter_band(2, 2.0, 120.0, 1000.0)
    return LS.zero_phase(samples(t), b, a, size=512).select("recording", F.posexplode("x").alias("i", "mv"), "first").select(
        "recording", (F.col("first") + F.col("i")).alias("sample_idx"), "mv")
