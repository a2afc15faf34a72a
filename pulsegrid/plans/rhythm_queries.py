"""Rhythm and window queries on events: a user is a recording, an event a beat, an event type a marker kind.

Time is microseconds; "milliseconds" of an ECG are minutes here, which keeps the numbers in a similar range.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import columns as X
from pulsegrid.operators import ordered as O, rhythm as H, windows as V
from pulsegrid.plans.registry import query

DAY = 86_400_000_000
HOUR = 3_600_000_000
MINUTE = 60_000_000

RR = """rr AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, event_type,
  lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
 r AS (SELECT *, (us - prev) / 60000000.0 AS rr_ms FROM rr)"""


def beats(t):
    return t.events.select("user_id", "event_id", "event_type", "value", X.micros("ts").alias("us"))


def width(t):
    """Block width on the time axis: a user may hold a third of all events."""
    return O.block_width(beats(t), ["user_id"], "us")


def rr(t, block=None):
    return H.rr_series(beats(t).select("user_id", "event_id", "us"), ["user_id"], "us", ["event_id"], block or width(t), MINUTE)


@query("rr_diff", f"WITH {RR} SELECT user_id, event_id, us - prev AS rr_us FROM r")
def rr_diff(t):
    return rr(t).select("user_id", "event_id", (F.col("us") - F.col("prev")).alias("rr_us"))


@query("rhythm_summary", f"""WITH {RR} SELECT user_id, count(*) AS n_beats, round(avg(rr_ms), 6) AS rr_mean_ms,
 round(CASE WHEN count(rr_ms) = 1 THEN 0.0 ELSE stddev_samp(rr_ms) END, 6) AS rr_std_ms, round(quantile_cont(rr_ms, 0.5), 3) AS median_rr_ms,
 round(100.0 * avg(CASE WHEN rr_ms <= 65 THEN 1.0 WHEN rr_ms IS NOT NULL THEN 0.0 END), 6) AS pct_near_floor,
 round(60000.0 / avg(rr_ms), 6) AS heart_rate_bpm, round(stddev_samp(rr_ms) / avg(rr_ms), 6) AS rr_cv FROM r GROUP BY 1""")
def rhythm_summary(t):
    s = H.rhythm_summary(rr(t), ["user_id"])
    # an interval is a multiple of 1/60000 ms, so a coarse rounding keeps exact ties out of the comparison
    return s.select("user_id", "n_beats", F.round("median_rr_ms", 3).alias("median_rr_ms"), *[F.round(c, 6).alias(c) for c in (
        "rr_mean_ms", "rr_std_ms", "pct_near_floor", "heart_rate_bpm", "rr_cv")])


@query("hrv", f"""WITH {RR}, k AS (SELECT * FROM r WHERE rr_ms IS NOT NULL), d AS (SELECT *, rr_ms - lag(rr_ms) OVER (PARTITION BY user_id ORDER BY us, event_id) AS d FROM k),
 a AS (SELECT user_id, count(*) AS n_rr, stddev_samp(rr_ms) AS sdnn, avg(rr_ms) AS m, sqrt(avg(d * d)) AS rmssd, var_samp(d) AS vd FROM d GROUP BY 1)
SELECT user_id, n_rr, round(CASE WHEN n_rr >= 5 THEN sdnn END, 5) AS sdnn, round(CASE WHEN n_rr >= 5 THEN rmssd END, 5) AS rmssd,
 round(CASE WHEN n_rr >= 5 THEN sdnn / m END, 6) AS cv, round(CASE WHEN n_rr >= 5 THEN sqrt(0.5 * vd) END, 5) AS sd1,
 round(CASE WHEN n_rr >= 5 THEN sqrt(greatest(2 * sdnn * sdnn - 0.5 * vd, 0)) END, 5) AS sd2 FROM a""")
def hrv(t):
    w = width(t)
    v = H.variability(rr(t, w), ["user_id"], "us", ["event_id"], w)
    return v.select("user_id", "n_rr", F.round("cv", 6).alias("cv"),
                    *[F.round(c, 5).alias(c) for c in ("sdnn", "rmssd", "sd1", "sd2")])


@query("rr_percentiles", f"""WITH {RR} SELECT user_id, count(*) AS n_peaks, round(min(rr_ms), 3) AS rr_min_ms, round(quantile_cont(rr_ms, 0.05), 3) AS rr_p5_ms,
 round(quantile_cont(rr_ms, 0.5), 3) AS rr_median_ms, round(quantile_cont(rr_ms, 0.95), 3) AS rr_p95_ms,
 round(100.0 * avg(CASE WHEN rr_ms <= 65 THEN 1.0 WHEN rr_ms IS NOT NULL THEN 0.0 END), 6) AS pct_near_floor,
 round(count(*) / 2592.0 * 60, 6) AS hr_count, round(60000.0 / avg(rr_ms), 6) AS hr_mean_rr, round(60000.0 / quantile_cont(rr_ms, 0.5), 6) AS hr_median_rr,
 abs(count(*) / 2592.0 * 60 - 60000.0 / quantile_cont(rr_ms, 0.5)) > 50 AS diverges FROM r GROUP BY 1""")
def rr_percentiles(t):
    d = H.interval_diagnosis(rr(t).withColumn("dur", F.lit(2592.0)), ["user_id"], "dur")
    return d.select("user_id", "n_peaks", "diverges", *[F.round(c, 6).alias(c) for c in ("pct_near_floor", "hr_count", "hr_mean_rr", "hr_median_rr")],
                    *[F.round(c, 3).alias(c) for c in ("rr_min_ms", "rr_p5_ms", "rr_median_ms", "rr_p95_ms")])


@query("range_peak_match", f"""WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
 b AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
 m AS (SELECT a.user_id, a.event_id, EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND abs(b.us - a.us) <= {6 * HOUR}) AS hit FROM a),
 n AS (SELECT user_id, count(*) AS n_alt FROM b GROUP BY 1)
SELECT user_id, count(*) AS n_mad, count(CASE WHEN hit THEN 1 END) AS n_matched, any_value(n_alt) AS n_alt,
 round(100.0 * count(CASE WHEN hit THEN 1 END) / count(*), 6) AS match FROM m JOIN n USING (user_id) GROUP BY 1 HAVING count(*) >= 5 AND any_value(n_alt) >= 5""")
def range_peak_match(t):
    b = beats(t)
    a = H.detector_agreement(b.where("event_type = 'view'").select("user_id", "us"),
                             b.where("event_type = 'purchase'").select("user_id", "us"), ["user_id"], "us", 6 * HOUR)
    return a.withColumn("match", F.round("match", 6))


@query("peak_matches", f"""SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id
 AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= {2 * HOUR}) AS matched FROM events a WHERE event_type = 'view'""")
def peak_matches(t):
    b = beats(t)
    return O.any_within(b.where("event_type = 'view'").select("user_id", "event_id", "us"),
                        b.where("event_type = 'purchase'").select("user_id", "us"), ["user_id"], "us", "us", 2 * HOUR
                        ).select("event_id", "matched")


MARKERS = """mk AS (SELECT user_id AS rec, epoch_us(ts) AS idx, event_type AS text, CASE WHEN value < 15 THEN '*' WHEN value < 40 THEN '1' WHEN value < 90 THEN '2' ELSE '3' END AS prefix,
  event_type = 'purchase' AS is_end, event_type IN ('view', 'purchase') AS is_bl, event_type = 'signup' AS hint, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord
  FROM events WHERE event_type <> 'error')"""


def markers(t):
    """Event types as annotations: purchase = end, error = excluded, view = baseline, signup = start hint."""
    k = F.col("event_type")
    v = F.col("value")
    return beats(t).where(k != "error").select(
        F.col("user_id").alias("recording_id"), F.col("us").alias("idx"), k.alias("text"),
        F.when(v < 15, "*").when(v < 40, "1").when(v < 90, "2").otherwise("3").alias("prefix"),
        (k == "purchase").alias("is_end"), k.isin("view", "purchase").alias("is_baseline"), (k == "signup").alias("is_start_hint"))


@query("baseline_tiers", f"""WITH {MARKERS},
 p AS (SELECT s.rec, s.idx AS s_idx, e.idx AS e_idx, s.prefix AS sp, e.prefix AS ep, s.is_bl AND e.is_bl AS bl, s.ord AS so, e.ord AS eo, s.text AS st, e.text AS et
   FROM mk s JOIN mk e ON s.rec = e.rec AND e.is_end AND NOT s.is_end AND e.idx - s.idx BETWEEN {10 * HOUR} AND {90 * HOUR}),
 c AS (SELECT rec, CASE sp WHEN '*' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 3 ELSE 4 END AS tier, 'A_same_' || sp AS rule, s_idx, e_idx, so, eo, st, et FROM p WHERE sp = ep AND e_idx - s_idx <= {12 * HOUR}
   UNION ALL SELECT rec, 10, 'B_cross', s_idx, e_idx, so, eo, st, et FROM p WHERE e_idx - s_idx <= {12 * HOUR}
   UNION ALL SELECT rec, 20, 'C_long_baseline', s_idx, e_idx, so, eo, st, et FROM p WHERE bl
   UNION ALL SELECT rec, CASE WHEN NOT is_end AND hint THEN 30 WHEN NOT is_end THEN 31 ELSE 32 END, 'D_single_30s', idx, NULL, ord, 0, text, NULL FROM mk),
 b AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY tier, so, eo) AS rn FROM c)
SELECT u.rec AS recording_id, u.n_samples, s_idx AS base_start,
  CASE WHEN s_idx IS NULL THEN NULL ELSE least(CASE WHEN tier < 20 THEN e_idx WHEN tier = 20 THEN least(s_idx + {60 * HOUR}, e_idx) ELSE s_idx + {30 * HOUR} END, u.n_samples) END AS base_end,
  coalesce(rule, 'no_markers') AS rule_used, st AS start_annotation, et AS end_annotation
FROM (SELECT user_id AS rec, max(epoch_us(ts)) AS n_samples FROM events GROUP BY 1) u LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON b.rec = u.rec""")
def baseline_tiers(t):
    recs = beats(t).groupBy(F.col("user_id").alias("recording_id")).agg(F.max("us").alias("n_samples"))
    return V.baseline_windows(markers(t), recs, scale=HOUR, gap=(10, 12), long_gap=90, long_use=60, single_use=30,
                              block=width(t))


@query("simple_baseline", f"""WITH {MARKERS}, p AS (SELECT s.rec, s.idx AS s_idx, e.idx AS e_idx FROM mk s JOIN mk e ON s.rec = e.rec AND e.is_end AND NOT s.is_end AND s.is_bl AND e.is_bl
   AND e.idx - s.idx BETWEEN {10 * HOUR} AND {90 * HOUR}), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s_idx, e_idx) AS rn FROM p)
SELECT rec AS recording_id, s_idx AS base_start, e_idx AS base_end FROM r WHERE rn = 1""")
def simple_baseline(t):
    return V.simple_baseline(markers(t), scale=HOUR, low=10, high=90, block=width(t))


@query("marker_predicates", """
SELECT conv_id, turn, lower(text) LIKE '%end%' OR lower(text) LIKE '%done%' OR lower(text) LIKE '%stop%' AS is_end,
 lower(text) LIKE '%oc 1%' OR lower(text) LIKE '%oc 2%' OR lower(text) LIKE '%oc1%' OR lower(text) LIKE '%oc2%' OR lower(text) LIKE '%jugular%' OR lower(text) LIKE '%jugcan%'
  OR lower(text) LIKE '%injection%' OR lower(text) LIKE '%inject%' AS is_excluded, replace(lower(text), 'basline', 'baseline') LIKE '%baseline%' AS is_baseline FROM conversations""")
def marker_predicates(t):
    x = F.col("text")
    return t.conversations.select("conv_id", "turn", V.is_end(x).alias("is_end"), V.is_excluded(x).alias("is_excluded"),
                                  V.is_baseline(x).alias("is_baseline"))


def _sweep_sql(width, step):
    return f"""WITH {RR}, o AS (SELECT user_id, min(us) AS origin, max(us) AS last FROM r GROUP BY 1),
 w AS (SELECT user_id, unnest(generate_series(origin, last, {step})) AS start FROM o),
 s AS (SELECT w.user_id, w.start, count(*) AS n_rr, avg(rr_ms) AS m, stddev_samp(rr_ms) AS sd, stddev_pop(rr_ms) AS sdp FROM w JOIN r ON r.user_id = w.user_id AND r.prev >= w.start AND r.us < w.start + {width}
   GROUP BY 1, 2)"""


def sweep(t, width, step, intervals=1):
    from pyspark.sql import Window as W
    r = rr(t)
    span = r.groupBy("user_id").agg(F.min("us").alias("origin"), F.max("us").alias("last"))
    return V.window_statistics(r.join(span, "user_id"), ["user_id"], "us", "origin", width, step, F.col("last"),
                               intervals=intervals)


@query("window_sweep_best", f"""{_sweep_sql(5 * DAY, DAY)}, p AS (SELECT *, 60000.0 / m BETWEEN 60 AND 130 AND sd <= 900 AND n_rr + 1 >= 10 AS ok FROM s),
 n AS (SELECT user_id, count(*) AS n_tried FROM w GROUP BY 1),
 a AS (SELECT user_id, count(CASE WHEN ok THEN 1 END) AS n_passing, min(CASE WHEN ok THEN start END) AS best_start, quantile_cont(CASE WHEN ok THEN sd END, 0.75) AS p75 FROM p GROUP BY 1)
SELECT a.user_id, a.best_start, round(60000.0 / p.m, 6) AS best_hr, round(p.sd, 5) AS best_rr_std, n_passing, n_tried,
 CASE WHEN n_passing = 0 THEN 'no_clean_window_found' WHEN n_passing / n_tried < 0.3 OR p.sd > p75 THEN 'marginal_' || n_passing || '/' || n_tried ELSE 'solid' END AS quality_flag
FROM a JOIN n USING (user_id) LEFT JOIN p ON p.user_id = a.user_id AND p.start = a.best_start""")
def window_sweep_best(t):
    r = rr(t)
    span = r.groupBy("user_id").agg(F.min("us").alias("origin"), F.max("us").alias("last"))
    w = V.window_statistics(r.join(span, "user_id"), ["user_id"], "us", "origin", 5 * DAY, DAY, F.col("last"))
    passes = F.col("hr").between(60, 130) & (F.col("rr_std") <= 900) & (F.col("n_rr") + 1 >= 10)
    tried = span.select("user_id", (F.floor((F.col("last") - F.col("origin")) / DAY) + 1).alias("tried"))
    q = V.quality_choice(w.join(tried, "user_id"), ["user_id"], passes, F.col("tried"))
    return q.withColumns({"best_hr": F.round("best_hr", 6), "best_rr_std": F.round("best_rr_std", 5)})


@query("window_sweep_min", f"""{_sweep_sql(5 * DAY, DAY)}
SELECT user_id, round(min(sdp / m), 6) AS best_cv, min(sdp / m) <= 0.6 AS recoverable FROM s WHERE n_rr >= 5 GROUP BY 1""")
def window_sweep_min(t):
    return V.lowest_cv(sweep(t, 5 * DAY, DAY, 5), ["user_id"], 0.6).withColumn("best_cv", F.round("best_cv", 6))


@query("first_clean_window", f"""{_sweep_sql(4 * DAY, DAY)}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS rn FROM s WHERE n_rr >= 5 AND sdp / m <= 0.7)
SELECT user_id, start, round(sdp / m, 6) AS cv_pop, n_rr FROM k WHERE rn = 1""")
def first_clean_window(t):
    return V.first_clean(sweep(t, 4 * DAY, DAY, 5), ["user_id"], 0.7).withColumn("cv_pop", F.round("cv_pop", 6))


@query("multi_width_recovery", f"""WITH {RR}, o AS (SELECT user_id, min(us) AS origin, max(us) AS last FROM r GROUP BY 1),
 w AS (SELECT user_id, width, unnest(generate_series(origin, last, {DAY})) AS start FROM o, (VALUES (10), (5), (3)) v(width)),
 s AS (SELECT w.user_id, width, start, stddev_pop(rr_ms) / avg(rr_ms) AS cv FROM w JOIN r ON r.user_id = w.user_id AND r.prev >= w.start AND r.us < w.start + width * {DAY} GROUP BY 1, 2, 3 HAVING count(*) >= 5),
 m AS (SELECT user_id, round(min(CASE WHEN width = 10 THEN cv END), 3) AS cv_10s, round(min(CASE WHEN width = 5 THEN cv END), 3) AS cv_5s, round(min(CASE WHEN width = 3 THEN cv END), 3) AS cv_3s FROM s GROUP BY 1)
SELECT *, CASE WHEN cv_5s <= 0.45 THEN 'recoverable @5s' WHEN cv_3s <= 0.45 THEN 'recoverable @3s only' ELSE 'still not recoverable' END AS verdict FROM m""")
def multi_width_recovery(t):
    r = rr(t)
    span = r.groupBy("user_id").agg(F.min("us").alias("origin"), F.max("us").alias("last"))
    r = r.join(span, "user_id").where("rr_ms IS NOT NULL")
    x = F.col("rr_ms")
    w = (r.select("user_id", "rr_ms", F.inline(V.windows_of_widths(
            F.col("prev"), F.col("us"), F.col("origin"), [d * DAY for d in (10, 5, 3)], DAY, F.col("last"))))
         .groupBy("user_id", (F.col("width") / DAY).cast("int").alias("width"), "start")
         .agg(F.count(x).alias("n"), (F.stddev_pop(x) / F.avg(x)).alias("cv")).where("n >= 5"))
    best = w.groupBy("user_id").agg(*[F.round(F.min(F.when(F.col("width") == d, F.col("cv"))), 3).alias(f"cv_{d}s")
                                      for d in (10, 5, 3)])
    return best.withColumn("verdict", V.recovery_verdict(F.col("cv_5s"), F.col("cv_3s"), 0.45))


@query("column_gate", """
SELECT event_type, round(quantile_cont(abs(value), 0.5), 6) AS median_abs, quantile_cont(abs(value), 0.5) > 32.5 AS wrong_column FROM events GROUP BY 1""")
def column_gate(t):
    return V.column_gate(t.events, ["event_type"], "value", 32.5).withColumn("median_abs", F.round("median_abs", 6))


@query("median_exceeds", "SELECT user_id, quantile_cont(abs(value), 0.5) > 32.5 AS wrong_column FROM events GROUP BY 1")
def median_exceeds(t):
    return V.median_exceeds(t.events, ["user_id"], "value", 32.5)


@query("gap_interpolation", """
WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
 n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv,
   first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni, first_value(v IGNORE NULLS) OVER f AS nv FROM s
   WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, i AS sample_idx, round(CASE WHEN v IS NOT NULL THEN v WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) / (ni - pi) * (i - pi) END, 6) AS mv FROM n""")
def gap_interpolation(t):
    b = beats(t)
    placed = O.positions(b, ["user_id"], "us", ["event_id"], "_p", block=F.floor(F.col("us") / width(t)))
    s = placed.select("user_id", (F.col("_p") - 1).alias("sample_idx"),
                      F.when(F.col("event_type") != "error", F.col("value")).alias("mv"))
    return V.fill_gaps(s, ["user_id"], "sample_idx", "mv", block=4096).select(
        "user_id", "sample_idx", F.round("mv", 6).alias("mv"))


@query("segment_mean_fill", """
WITH s AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), m AS (SELECT user_id, avg(v) AS m FROM s GROUP BY 1)
SELECT event_id, user_id, round(coalesce(v, m), 6) AS mv FROM s JOIN m USING (user_id)""")
def segment_mean_fill(t):
    s = t.events.select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("mv"))
    return V.fill_with_segment_mean(s, ["user_id"], "mv").withColumn("mv", F.round("mv", 6))


@query("fixed_segmentation", """
SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'pre' WHEN ts < TIMESTAMP '2024-01-20' THEN 'baseline' ELSE 'post' END AS part, count(*) AS n, round(stddev_pop(value), 6) AS sd
FROM events GROUP BY 1, 2""")
def fixed_segmentation(t):
    part = V.part_of_recording(F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return t.events.groupBy("user_id", part.alias("part")).agg(
        F.count("*").alias("n"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("status_gates", f"""WITH {RR}, u AS (SELECT user_id, count(*) AS n_peaks, 60000.0 / avg(rr_ms) AS hr, median(value) AS med, count(CASE WHEN event_type = 'signup' THEN 1 END) AS n_mark,
   count(CASE WHEN event_type = 'view' THEN 1 END) AS n_view FROM r GROUP BY 1)
SELECT user_id, n_peaks, round(hr, 6) AS hr, CASE WHEN n_view < 5 THEN 'FAILED_FILE' WHEN med > 42 THEN 'FAILED_COLUMN' WHEN n_mark < 10 THEN 'FAILED_ANNOTATION' WHEN n_peaks < 10 THEN 'FAILED_PEAKS'
  WHEN hr BETWEEN 300 AND 700 THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status FROM u""")
def status_gates(t):
    base = H.rr_series(beats(t), ["user_id"], "us", ["event_id"], width(t), MINUTE).groupBy("user_id").agg(
        F.count("*").alias("n_peaks"), (60000.0 / F.avg("rr_ms")).alias("hr"),
        F.count_if(F.col("event_type") == "signup").alias("n_mark"), F.count_if(F.col("event_type") == "view").alias("n_view"))
    u = base.join(V.column_gate(t.events, ["user_id"], "value", 42), "user_id")
    status = V.recording_status(F.col("n_view") < 5, F.col("wrong_column"), F.col("n_mark") < 10, F.col("n_peaks"), F.col("hr"))
    return u.select("user_id", "n_peaks", F.round("hr", 6).alias("hr"), status.alias("status"))
