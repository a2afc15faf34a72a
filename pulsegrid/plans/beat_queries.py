"""Beat, morphology and template queries on embeddings: an embedding is a 64-sample beat, its label the animal.

R sits at sample 16, so t runs from -16 to 47; windows are scaled down accordingly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A, columns as X
from pulsegrid.operators import beats as B, morphology as M, ordered as O, template as T, windows as V
from pulsegrid.plans.registry import query

PRE, N = 16, 64
WAVES = (("P", -13, -8, 1), ("Q", -4, -1, -1), ("S", 2, 9, -1), ("J", 3, 9, 1), ("T", 10, 25, 1))
LANDMARKS = (("P", -10, -7, 1), ("Q", -4, -1, -1), ("S", 0, 3, -1), ("J", 2, 8, 1), ("T", 9, 20, -1))
KW = dict(waves=WAVES, r_window=(-4, 8), quiet=-10, return_from=20)
QT = dict(base=(-12, -5), start=8, fallback=40, accept=(5, 45))
E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"


def s(first, last):
    """SQL slice for first <= t <= last."""
    return f"list_slice(b, {first + PRE + 1}, {last + PRE + 1})"


def beats(t):
    return t.embeddings.select("vec_id", F.col("label").alias("animal_id"), F.col("embedding").cast("array<double>").alias("beat"))


def rounded(df, keys, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) if dict(df.dtypes)[c] in ("double",) else F.col(c)
                              for c in df.columns if c not in keys])


ORDERED = E + """, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM e),
 u AS (SELECT label, b FROM o WHERE k < (n // 4) * 4 OR n < 4),
 p AS (SELECT label, i, avg(b[i]) AS v FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)"""


@query("beat_template", ORDERED + "SELECT label AS animal_id, CAST(i - 17 AS INTEGER) AS t, round(v, 7) AS mv FROM p")
def beat_template(t):
    tpl = B.template(B.numbered(beats(t), ["animal_id"], "vec_id"), ["animal_id"], count="_n")
    return tpl.select("animal_id", F.posexplode("template").alias("i", "v")).select(
        "animal_id", (F.col("i") - PRE).alias("t"), F.round("v", 7).alias("mv"))


@query("local_maxima", E + """, p AS (SELECT vec_id, i, b[i] AS v, b[i - 1] AS l, b[i + 1] AS r FROM e, (SELECT unnest(range(2, 64)) AS i))
SELECT vec_id, list(i - 1 ORDER BY i) AS peaks FROM p WHERE v > l AND v > r AND v >= 0.1 GROUP BY 1""")
def local_maxima(t):
    b = F.col("beat")
    inner = F.sequence(F.lit(1), F.lit(N - 2))
    peaks = F.filter(inner, lambda i: (F.get(b, i) > F.get(b, i - 1)) & (F.get(b, i) > F.get(b, i + 1)) & (F.get(b, i) >= 0.1))
    return beats(t).select("vec_id", F.transform(peaks, lambda i: i.cast("bigint")).alias("peaks")).where(F.size("peaks") > 0)


@query("beat_slices", E + """, p AS (SELECT vec_id, b, i, b[i] AS v, b[i - 1] AS l, b[i + 1] AS r FROM e, (SELECT unnest(range(2, 64)) AS i)),
 k AS (SELECT vec_id, b, i - 1 AS pk FROM p WHERE v > l AND v > r AND v >= 0.1 AND i - 1 >= 6 AND i - 1 + 10 <= 64)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY pk) - 1 AS beat_no, round(list_sum(list_slice(b, pk - 5, pk + 10)), 6) AS area, round(list_max(list_slice(b, pk - 5, pk + 10)), 6) AS top FROM k""")
def beat_slices(t):
    b = F.col("beat")
    peaks = F.filter(F.sequence(F.lit(1), F.lit(N - 2)), lambda i: (F.get(b, i) > F.get(b, i - 1)) & (F.get(b, i) > F.get(b, i + 1)) & (F.get(b, i) >= 0.1))
    seg = beats(t).select("vec_id", F.col("beat").alias("filtered"), peaks.alias("peaks"))
    cut = B.explode_beats(seg, ["vec_id"], pre=6, post=10)
    return cut.select("vec_id", F.col("beat_no").cast("long").alias("beat_no"), F.round(A.total(F.col("beat")), 6).alias("area"),
                      F.round(F.array_max("beat"), 6).alias("top"))


QUIET = "list_slice(b, 1, 6)"
MEASURES_SQL = f"""l AS (SELECT *, (list_sort({QUIET})[3] + list_sort({QUIET})[4]) / 2 AS lev, list_aggregate({QUIET}, 'stddev_pop') AS noise, list_max(b) AS pk, list_position(b, list_max(b)) AS loc FROM e),
 m AS (SELECT vec_id, label, b, lev, list_max({s(-4, 8)}) - list_min({s(-4, 8)}) AS r_amplitude_mv,
  CAST(coalesce(list_position(list_transform(list_reverse(list_slice(b, 1, loc)), lambda x: x <= pk / 2), true) - 1, loc - 1)
     + coalesce(list_position(list_transform(list_slice(b, loc, 64), lambda x: x <= pk / 2), true) - 1, 64 - loc) AS DOUBLE) AS qrs_duration_ms,
  list_max({s(3, 9)}) AS j_wave_amplitude_mv, list_max({s(10, 25)}) AS t_wave_amplitude_mv,
  greatest(abs(list_max({s(10, 25)}) - lev), abs(list_min({s(10, 25)}) - lev)) AS t_wave_excursion_mv,
  CAST(list_position({s(10, 25)}, list_max({s(10, 25)})) - 1 + 10 AS DOUBLE) AS rt_interval_ms,
  CAST(list_position(list_transform({s(20, 47)}, lambda x: abs(x - lev) <= 0.05 * pk), true) - 1 + 20 AS DOUBLE) AS qt_template_ms,
  CASE WHEN list_max({s(-13, -8)}) - lev > greatest(0.008, 2 * noise) THEN list_max({s(-13, -8)}) - lev END AS p_wave_amplitude_mv,
  CASE WHEN list_max({s(-13, -8)}) - lev > greatest(0.008, 2 * noise) THEN CAST(-(list_position({s(-13, -8)}, list_max({s(-13, -8)})) - 1 - 13) AS DOUBLE) END AS pr_interval_ms,
  list_min({s(-4, -1)}) - lev AS q_wave_amplitude_mv, list_min({s(2, 9)}) - lev AS s_wave_amplitude_mv FROM l)"""
M_COLS = ["r_amplitude_mv", "qrs_duration_ms", "j_wave_amplitude_mv", "t_wave_amplitude_mv", "t_wave_excursion_mv", "rt_interval_ms",
          "qt_template_ms", "p_wave_amplitude_mv", "pr_interval_ms", "q_wave_amplitude_mv", "s_wave_amplitude_mv"]


@query("beat_measures", f"{E}, {MEASURES_SQL} SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in M_COLS)} FROM m")
def beat_measures(t):
    m = M.measures(M.Beat("beat", PRE, N), **KW)
    return beats(t).select("vec_id", *[F.round(c, 6).alias(k) for k, c in m.items()])


QT_SQL = f"""q AS (SELECT vec_id, label, b, list_avg({s(-12, -5)}) AS base, least(48, CAST(floor((36 + 4 * label) * 0.5) AS BIGINT)) - 8 AS len FROM e),
 x AS (SELECT *, list_transform(list_slice(b, 25, 24 + len), lambda v: abs(v - base)) AS exc FROM q),
 y AS (SELECT *, list_max(exc) AS pk, list_position(exc, list_max(exc)) AS loc FROM x),
 z AS (SELECT vec_id, label, len, pk, CAST(loc - 1 + list_position(list_transform(list_slice(exc, loc, len), lambda v: v <= 0.3 * pk), true) - 1 + 8 AS DOUBLE) AS qt FROM y),
 w AS (SELECT vec_id, label, CASE WHEN len > 0 AND pk > 0 AND qt BETWEEN 5 AND 45 THEN qt END AS qt_ms FROM z)"""


@query("per_beat_qt", f"{E}, {QT_SQL} SELECT vec_id, qt_ms FROM w")
def per_beat_qt(t):
    rr = F.lit(36.0) + 4 * F.col("animal_id")
    return beats(t).select("vec_id", M.Beat("beat", PRE, N).qt(rr, **QT).alias("qt_ms"))


OLD_QT_SQL = f"""a AS (SELECT vec_id, label, b, list_avg({s(-12, -5)}) AS base, list_position({s(8, 29)}, list_max({s(8, 29)})) AS loc FROM e),
 c AS (SELECT vec_id, label, CAST(loc - 1 + 8 + list_position(list_transform(list_slice(b, loc + 24, loc + 24 + 13), lambda v: v <= base + 0.01), true) - 1 AS DOUBLE) AS qt FROM a),
 old AS (SELECT vec_id, CASE WHEN qt BETWEEN 8 AND 45 THEN qt END AS qt_old_ms FROM c)"""
OLD = dict(base=(-12, -5), start=8, stop=30, reach=14, level_mv=0.01, accept=(8, 45))


def both_qt(t):
    b = M.Beat("beat", PRE, N)
    return beats(t).select("vec_id", "animal_id", b.qt(F.lit(36.0) + 4 * F.col("animal_id"), **QT).alias("qt_new_ms"),
                           b.qt_absolute(**OLD).alias("qt_old_ms"))


@query("qt_old_new_audit", f"""{E}, {QT_SQL}, {OLD_QT_SQL} SELECT label AS animal_id, count(*) AS n_beats, round(avg(qt_old_ms), 6) AS qt_old_ms, round(avg(qt_ms), 6) AS qt_new_ms,
 round(avg(qt_ms) - avg(qt_old_ms), 6) AS qt_delta_ms, round(100.0 * count(qt_ms) / count(*), 6) AS qt_yield_pct FROM w JOIN old USING (vec_id) GROUP BY 1""")
def qt_old_new_audit(t):
    g = both_qt(t).groupBy("animal_id").agg(
        F.count("*").alias("n_beats"), F.avg("qt_old_ms").alias("qt_old_ms"), F.avg("qt_new_ms").alias("qt_new_ms"),
        (100.0 * F.count("qt_new_ms") / F.count("*")).alias("qt_yield_pct"))
    return rounded(g.withColumn("qt_delta_ms", F.col("qt_new_ms") - F.col("qt_old_ms")), ["animal_id"])


@query("qt_old_new_summary", f"""{E}, {QT_SQL}, {OLD_QT_SQL}, j AS (SELECT * FROM w JOIN old USING (vec_id) WHERE qt_ms IS NOT NULL AND qt_old_ms IS NOT NULL)
SELECT count(*) AS n, round(quantile_cont(qt_old_ms, 0.5), 6) AS median_old, round(quantile_cont(qt_ms, 0.5), 6) AS median_new, round(avg(qt_old_ms), 6) AS mean_old, round(avg(qt_ms), 6) AS mean_new,
 round(avg(qt_old_ms - qt_ms), 6) AS mean_reduction, round(100.0 * avg(CASE WHEN qt_ms < qt_old_ms THEN 1.0 ELSE 0.0 END), 6) AS pct_lower FROM j""")
def qt_old_new_summary(t):
    j = both_qt(t).where("qt_new_ms IS NOT NULL AND qt_old_ms IS NOT NULL")
    new, old = F.col("qt_new_ms"), F.col("qt_old_ms")
    base = j.agg(F.count("*").alias("n"), F.avg(old).alias("mean_old"), F.avg(new).alias("mean_new"),
                 F.avg(old - new).alias("mean_reduction"), (100.0 * F.avg((new < old).cast("int"))).alias("pct_lower"))
    long = j.unpivot([], ["qt_old_ms", "qt_new_ms"], "which", "value")
    q = O.exact_quantiles(long, ["which"], "value", {"q": .5}).agg(
        F.max(F.when(F.col("which") == "qt_old_ms", F.col("q"))).alias("median_old"),
        F.max(F.when(F.col("which") == "qt_new_ms", F.col("q"))).alias("median_new"))
    out = O.attach_one_row(base, q)
    return rounded(out, ["n"])


@query("feature_assembly", f"""{ORDERED}, tp AS (SELECT label AS vec_id, label, list(v ORDER BY i) AS b FROM p GROUP BY label),
 pb AS (SELECT * FROM ({E} , {MEASURES_SQL} SELECT * FROM m)), pq AS (SELECT * FROM ({E}, {QT_SQL} SELECT * FROM w)),
 tm AS (SELECT * FROM ({E.replace("WITH e AS (", "WITH e0 AS (")}, e AS (SELECT * FROM tp), {MEASURES_SQL} SELECT * FROM m)),
 st AS (SELECT pb.label, avg(r_amplitude_mv) AS r, stddev_samp(r_amplitude_mv) AS rs, stddev_samp(qrs_duration_ms) AS qs, avg(qt_ms) AS q, stddev_samp(qt_ms) AS qts FROM pb JOIN pq USING (vec_id) GROUP BY 1)
SELECT tm.label AS animal_id, round(r, 6) AS r_amplitude_mv, qrs_duration_ms, round(j_wave_amplitude_mv, 6) AS j_wave_amplitude_mv, round(t_wave_amplitude_mv, 6) AS t_wave_amplitude_mv,
 round(t_wave_excursion_mv, 6) AS t_wave_excursion_mv, rt_interval_ms, round(coalesce(q, qt_template_ms), 6) AS qt_ms, round(qts, 6) AS qt_std_ms, round(qs, 6) AS qrs_std_ms, round(rs, 6) AS r_amplitude_std_mv,
 round(p_wave_amplitude_mv, 6) AS p_wave_amplitude_mv, pr_interval_ms, round(q_wave_amplitude_mv, 6) AS q_wave_amplitude_mv, round(s_wave_amplitude_mv, 6) AS s_wave_amplitude_mv FROM tm JOIN st USING (label)""")
def feature_assembly(t):
    b = B.numbered(beats(t), ["animal_id"], "vec_id").withColumn("rr", F.lit(36.0) + 4 * F.col("animal_id"))
    tpl = B.template(b, ["animal_id"], count="_n")
    return rounded(M.assemble(tpl, b, ["animal_id"], PRE, N, rr_ms="rr", qt_args=QT, **KW), ["animal_id"])


@query("beat_overlay", f"""{E}, sdp AS (SELECT label, i, stddev_samp(b[i]) AS sd FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
 env AS (SELECT label, avg(sd) AS m, max(sd) AS pk, CAST(list(i ORDER BY sd DESC, i)[1] - 17 AS BIGINT) AS loc FROM sdp GROUP BY 1),
 r AS (SELECT label, count(*) AS n, avg(b[17]) AS rm, stddev_samp(b[17]) AS rs, stddev_samp(list_position({s(-5, 5)}, list_max({s(-5, 5)}))) AS ps FROM e GROUP BY 1)
SELECT label AS animal_id, n AS n_beats, round(rm, 6) AS r_amp_mean, round(rs, 6) AS r_amp_sd, round(rs / abs(rm), 4) AS r_amp_cv, round(ps, 6) AS r_pos_sd, round(m, 6) AS sd_env_mean, round(pk, 6) AS sd_env_peak, loc AS sd_peak_t FROM r JOIN env USING (label)""")
def beat_overlay(t):
    b = beats(t)
    o = M.overlay(b, B.elementwise(b, ["animal_id"]), ["animal_id"], PRE, N, half=5)
    cv = F.round("r_amp_cv", 4).alias("r_amp_cv")
    return rounded(o.drop("r_amp_cv"), ["animal_id"]).join(o.select("animal_id", cv), "animal_id")


@query("beat_spread", f"""{E}, sdp AS (SELECT label, i, stddev_pop(b[i]) AS sd FROM e, (SELECT unnest(range(13, 26)) AS i) GROUP BY 1, 2)
SELECT label AS animal_id, round(avg(sd), 6) AS spread FROM sdp GROUP BY 1""")
def beat_spread(t):
    e = B.elementwise(beats(t), ["animal_id"])
    pop = F.transform(M.Beat("sd", PRE, N).window(-4, 8), lambda x: x * F.sqrt((F.col("n") - 1) / F.col("n")))
    return e.select("animal_id", F.round(A.mean(pop), 6).alias("spread"))


@query("landmark_times", f"{E} SELECT vec_id, " + ", ".join(
    f"CAST(list_position({s(a, z)}, {'list_max' if g > 0 else 'list_min'}({s(a, z)})) - 1 + {a} AS BIGINT) AS t_{w.lower()}" for w, a, z, g in LANDMARKS) + " FROM e")
def landmark_times(t):
    b = M.Beat("beat", PRE, N)
    return beats(t).select("vec_id", *[b.landmark(a, z, g).alias(f"t_{w.lower()}") for w, a, z, g in LANDMARKS])


@query("landmark_consistency", f"{E}, l AS (SELECT label, b, (list_sort(list_slice(b, 1, 5))[3]) AS lev, list_aggregate(list_slice(b, 1, 5), 'stddev_pop') AS noise FROM e), x AS (" + " UNION ALL ".join(
    f"SELECT label, '{w}' AS wave, {(z - a)} / sqrt(12.0) AS rnd, list_position({s(a, z)}, {'list_max' if g > 0 else 'list_min'}({s(a, z)})) - 1 + {a} AS t, abs({'list_max' if g > 0 else 'list_min'}({s(a, z)}) - lev) AS amp, noise FROM l"
    for w, a, z, g in LANDMARKS) + """)
SELECT label AS animal_id, wave, round(avg(t), 6) AS pos, round(stddev_pop(t), 6) AS sd, round(any_value(rnd), 6) AS rand_sd, round(avg(amp) / avg(noise), 5) AS snr, round(stddev_pop(t) / any_value(rnd), 6) AS ratio,
 CASE WHEN stddev_pop(t) / any_value(rnd) < 0.45 THEN 'ok' WHEN stddev_pop(t) / any_value(rnd) < 0.75 THEN '~' ELSE 'NOISE' END AS verdict FROM x GROUP BY 1, 2""")
def landmark_consistency(t):
    c = M.landmark_consistency(beats(t), ["animal_id"], PRE, N, waves=LANDMARKS, quiet=-11)
    snr = c.select("animal_id", "wave", F.round("snr", 5).alias("snr"))
    return rounded(c.drop("snr"), ["animal_id", "wave"]).join(snr, ["animal_id", "wave"])


@query("qtc_family", """
WITH x AS (SELECT l_returnflag AS study, l_quantity + 15 AS qt, 80 + l_extendedprice / 1000 AS rr, 60000.0 / (80 + l_extendedprice / 1000) AS hr FROM lineitem),
 f AS (SELECT study, rr, unnest(['Raw', 'Bazett', 'Fridericia', 'Framingham', 'Hodges', 'Mitchell']) AS formula,
   unnest([qt, qt / sqrt(rr / 1000), qt / cbrt(rr / 1000), qt + 154 * (1 - rr / 1000), qt + 1.75 * (hr - 60), qt / sqrt(rr / 100)]) AS qtc FROM x),
 a AS (SELECT study, formula, avg(qtc) AS mean, stddev_pop(qtc) AS sd, abs(corr(qtc, rr)) AS abs_r FROM f GROUP BY 1, 2),
 b AS (SELECT study, formula FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY abs(mean - 41), formula) AS rn FROM a WHERE abs_r < 0.85 AND formula <> 'Raw') WHERE rn = 1)
SELECT a.study, a.formula, round(mean, 5) AS mean, round(sd, 5) AS sd, round(abs_r, 6) AS abs_r, round(abs(mean - 41), 5) AS distance, coalesce(a.formula = b.formula, false) AS best FROM a LEFT JOIN b USING (study)""")
def qtc_family(t):
    rr = 80 + F.col("l_extendedprice") / 1000
    x = t.lineitem.select(F.col("l_returnflag").alias("study"), (F.col("l_quantity") + 15).alias("qt"), rr.alias("rr"), (60000.0 / rr).alias("hr"))
    c = M.qtc_comparison(x, ["study"], "qt", "rr", "hr", max_r=0.85)
    return c.select("study", "formula", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"),
                    F.round("abs_r", 6).alias("abs_r"), F.round("distance", 5).alias("distance"), "best")


@query("qtc_mitchell", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / sqrt(l_extendedprice / 1000 / 100), 6) AS qtc FROM lineitem""")
def qtc_mitchell(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(X.qtc_mitchell(F.col("l_quantity"), F.col("l_extendedprice") / 1000), 6).alias("qtc"))


SMOOTH_SQL = "list_transform(range(1, 65), lambda i: (b[greatest(i - 1, 1)] + b[i] + b[least(i + 1, 64)]) / 3)"


def smoothed(b):
    return F.transform(b, lambda x, i: (F.get(b, F.greatest(i - 1, F.lit(0))) + x + F.get(b, F.least(i + 1, F.lit(N - 1)))) / 3)


@query("raw_filtered_metrics", f"""{E}, f AS (SELECT vec_id, b, {SMOOTH_SQL} AS f FROM e), m AS (SELECT *, list_avg(b) AS mb, list_avg(f) AS mf FROM f),
 u AS (SELECT vec_id, unnest(b) AS r, unnest(f) AS f, mb, mf FROM m)
SELECT vec_id, round(corr(r, f), 6) AS corr, round(100 * sqrt(avg(((r - mb) - (f - mf)) ** 2)) / sqrt(avg((r - mb) ** 2)), 5) AS pct_removed FROM u GROUP BY 1""")
def raw_filtered_metrics(t):
    m = M.raw_filtered_metrics(F.col("beat"), smoothed(F.col("beat")))
    return beats(t).select("vec_id", F.round(m["corr"], 6).alias("corr"), F.round(m["pct_removed"], 5).alias("pct_removed"))


@query("template_filter_table", f"""{E}, f AS (SELECT label, b, {SMOOTH_SQL} AS f FROM e), p AS (SELECT label, i, avg(b[i]) AS r, avg(f[i]) AS f FROM f, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
 l AS (SELECT label, median(CASE WHEN i <= 6 THEN r END) AS lr, median(CASE WHEN i <= 6 THEN f END) AS lf FROM p GROUP BY 1),
 w AS (SELECT * FROM (VALUES ('P', -9, -4), ('R', -2, 2), ('J', 3, 8), ('T', 9, 20)) v(wave, lo, hi)),
 x AS (SELECT label, wave, max(r - lr) AS raw_mv, max(f - lf) AS filt_mv FROM p JOIN l USING (label) JOIN w ON i - 17 BETWEEN lo AND hi GROUP BY 1, 2)
SELECT label AS animal_id, wave, round(raw_mv, 6) AS raw_mv, round(filt_mv, 6) AS filt_mv, round(filt_mv - raw_mv, 6) AS delta_mv, round(100 * (filt_mv - raw_mv) / raw_mv, 3) AS delta_pct FROM x""")
def template_filter_table(t):
    b = beats(t)
    raw = B.elementwise(b, ["animal_id"]).select("animal_id", F.col("mean").alias("raw"))
    filt = B.elementwise(b.withColumn("beat", smoothed(F.col("beat"))), ["animal_id"]).select("animal_id", F.col("mean").alias("filt"))
    r, f = M.Beat("raw", PRE, N), M.Beat("filt", PRE, N)
    rows = F.array(*[F.struct(F.lit(w).alias("wave"), (r.top(a, z) - r.level(-10)).alias("raw_mv"), (f.top(a, z) - f.level(-10)).alias("filt_mv"))
                     for w, a, z in (("P", -9, -4), ("R", -2, 2), ("J", 3, 8), ("T", 9, 20))])
    x = raw.join(filt, "animal_id").select("animal_id", F.inline(rows))
    d = F.col("filt_mv") - F.col("raw_mv")
    return x.select("animal_id", "wave", F.round("raw_mv", 6).alias("raw_mv"), F.round("filt_mv", 6).alias("filt_mv"),
                    F.round(d, 6).alias("delta_mv"), F.round(100 * d / F.col("raw_mv"), 3).alias("delta_pct"))


@query("recovered_features", f"""{E}, x AS (SELECT vec_id, b, 40.0 + label AS rr, list_sort({s(-15, -10)}) AS qs, least(CAST(floor((40.0 + label) * 0.9) AS BIGINT), 40) AS stop FROM e),
 y AS (SELECT *, list_slice(b, 21, stop + 17) AS tail FROM x), z AS (SELECT *, CAST(list_position(tail, list_min(tail)) - 1 + 4 + 5 AS DOUBLE) AS qt FROM y)
SELECT vec_id, round(list_max({s(-5, 5)}) - list_min({s(-5, 5)}), 6) AS "R_amp_mV", round(list_max({s(-12, -3)}) - list_min({s(-12, -3)}), 6) AS "P_amp_mV",
 round((qs[3] + qs[4]) / 2 - list_min({s(5, 30)}), 6) AS "T_amp_mV", qt AS "QT_ms", round(qt / sqrt(rr / 100), 6) AS "QTc_ms" FROM z""")
def recovered_features(t):
    m = M.recovered_features(M.Beat("beat", PRE, N), F.lit(40.0) + F.col("animal_id"), r=(-5, 5), p=(-12, -3), t=(5, 30), quiet=(-15, -10),
                             qt_from=4, qt_cap=40, qt_add=5)
    return beats(t).select("vec_id", *[F.round(c, 6).alias(k) for k, c in m.items()])


@query("denoise_metrics", f"""{E}, f AS (SELECT 'Raw' AS method, label, b FROM e UNION ALL SELECT 'Smooth', label, {SMOOTH_SQL} FROM e UNION ALL SELECT 'Damped', label, list_transform(b, lambda x: x * 0.9) FROM e),
 p AS (SELECT method, i, avg(b[i]) AS v FROM f, (SELECT unnest(range(1, 65)) AS i) WHERE label = 3 OR label = 4 GROUP BY 1, 2),
 m AS (SELECT method, max(CASE WHEN i - 17 BETWEEN -2 AND 2 THEN v END) AS r_amp, max(CASE WHEN i - 17 BETWEEN 3 AND 8 THEN v END) AS j_amp, min(CASE WHEN i - 17 BETWEEN 1 AND 4 THEN v END) AS s_amp FROM p GROUP BY 1),
 b AS (SELECT * FROM m WHERE method = 'Raw')
SELECT m.method, round(m.r_amp, 6) AS r_amp, round(m.j_amp, 6) AS j_amp, round(m.s_amp, 6) AS s_amp, round(m.r_amp - b.r_amp, 6) AS r_amp_delta, round(100 * (m.r_amp - b.r_amp) / abs(b.r_amp), 3) AS r_amp_pct,
 round(m.j_amp - b.j_amp, 6) AS j_amp_delta, round(100 * (m.j_amp - b.j_amp) / abs(b.j_amp), 3) AS j_amp_pct FROM m, b""".replace("WHERE label = 3 OR label = 4 ", ""))
def denoise_metrics(t):
    from pulsegrid.operators.relational import percent_change
    b = F.col("beat")
    rows = F.array(F.struct(F.lit("Raw").alias("method"), b.alias("x")), F.struct(F.lit("Smooth").alias("method"), smoothed(b).alias("x")),
                   F.struct(F.lit("Damped").alias("method"), F.transform(b, lambda v: v * 0.9).alias("x")))
    tpl = B.elementwise(beats(t).select(F.inline(rows)), ["method"], "x")
    m = M.Beat("mean", PRE, N)
    out = percent_change(tpl.select("method", m.top(-2, 2).alias("r_amp"), m.top(3, 8).alias("j_amp"), m.bottom(1, 4).alias("s_amp")),
                         "method", "Raw", ["r_amp", "j_amp"])
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("r_amp", "j_amp", "s_amp", "r_amp_delta", "j_amp_delta")],
                      *[F.round(c, 3).alias(c) for c in ("r_amp_pct", "j_amp_pct")])


# ---- template distance --------------------------------------------------------------------------------------
POINTS = 40
NORM_SQL = f"""{E}, h AS (SELECT vec_id, label, b, list_avg(list_slice(b, 1, 6)) AS base, list_max({s(-3, 3)}) AS top FROM e),
 n AS (SELECT vec_id, label, CASE WHEN top - base > 0 THEN list_transform(b, lambda x: (x - base) / (top - base)) END AS f FROM h),
 w AS (SELECT vec_id, label, f, CASE WHEN f IS NOT NULL THEN list_transform(range(0, {POINTS}), lambda k: (lambda_x(k, label))) END AS wb FROM n)"""
POS = "greatest(0.0, least((-0.15 + k * (0.75 / 39)) * (44.0 + 2 * label) + 16, 63.0))"
INTERP = (f"f[CAST(least(floor({POS}), 62) AS BIGINT) + 1] + (f[CAST(least(floor({POS}), 62) AS BIGINT) + 2] - f[CAST(least(floor({POS}), 62) AS BIGINT) + 1])"
          f" * ({POS} - least(floor({POS}), 62))")
NORM_SQL = NORM_SQL.replace("(lambda_x(k, label))", INTERP)
PREP = dict(pre=PRE, n=N, quiet=-10, r_half=3, points=POINTS)


def prepared(t):
    r = beats(t).withColumn("rr", (44 + 2 * F.col("animal_id")).cast("double"))
    return T.prepare(r, "beat", "rr", **PREP)


@query("beat_warp", f"""{NORM_SQL} SELECT vec_id, CAST(i - 1 AS INTEGER) AS k, round(wb[i], 5) AS v FROM w, (SELECT unnest(range(1, {POINTS + 1})) AS i) WHERE wb IS NOT NULL""")
def beat_warp(t):
    return prepared(t).where("warp IS NOT NULL").select("vec_id", F.posexplode("warp").alias("k", "v")).withColumn("v", F.round("v", 5))


SEED_SQL = f"""{NORM_SQL}, seed AS (SELECT i, avg(f[i]) AS sf, avg(wb[i]) AS sw, stddev_samp(f[i]) AS df, stddev_samp(wb[i]) AS dw FROM w, (SELECT unnest(range(1, 65)) AS i) WHERE label IN (1, 6) AND f IS NOT NULL GROUP BY 1)"""


@query("seed_template", f"""{SEED_SQL} SELECT CAST(i - 1 AS INTEGER) AS i, round(sf, 5) AS fms_mean, round(df, 5) AS fms_sd, round(sf - df, 5) AS fms_low, round(sf + df, 5) AS fms_high FROM seed""")
def seed_template(t):
    ref = T.reference_template(prepared(t).where(F.col("animal_id").isin(1, 6)))
    z = ref.select(F.posexplode(F.arrays_zip("fms_ref", "fms_sd")).alias("i", "z"))
    m, d = F.col("z.fms_ref"), F.col("z.fms_sd")
    return z.select("i", F.round(m, 5).alias("fms_mean"), F.round(d, 5).alias("fms_sd"), F.round(m - d, 5).alias("fms_low"), F.round(m + d, 5).alias("fms_high"))


SCORE_SQL = f"""{SEED_SQL}, x AS (SELECT vec_id, label, i, f[i] AS f, wb[i] AS wb FROM w, (SELECT unnest(range(1, 65)) AS i) WHERE f IS NOT NULL),
 sc AS (SELECT vec_id, corr(f, sf) AS corr_fms, sqrt(avg((f - sf) ** 2)) AS rmse_fms, corr(wb, sw) AS corr_warp, sqrt(avg((wb - sw) ** 2)) AS rmse_warp FROM x JOIN seed USING (i) GROUP BY 1),
 al AS (SELECT n.vec_id, n.label, n.f IS NULL AS bad, sc.* EXCLUDE (vec_id) FROM n LEFT JOIN sc USING (vec_id))"""


@query("template_distance", f"""{SCORE_SQL} SELECT vec_id, round(corr_fms, 4) AS corr_fms, round(rmse_fms, 4) AS rmse_fms, round(corr_warp, 4) AS corr_warp, round(rmse_warp, 4) AS rmse_warp,
 CASE WHEN bad THEN 'normalise_failed' ELSE '' END AS null_reason, CASE WHEN label = 9 THEN 'HARD_EXCLUDE' WHEN bad THEN 'normalise_failed' ELSE 'scored' END AS note,
 label > 4 AND corr_warp IS NOT NULL AS rr_cv_flag, CAST(row_number() OVER (ORDER BY rmse_warp ASC NULLS LAST, vec_id) AS INTEGER) AS rank FROM al""")
def template_distance(t):
    p = prepared(t)
    scored = T.score(p, T.reference_template(p.where(F.col("animal_id").isin(1, 6))))
    c = F.col
    out = T.ranked(scored.withColumns({
        "null_reason": T.null_reason(c("beat"), F.lit(9), c("fms"), c("corr_warp"), c("warp")),
        "note": T.score_note(c("animal_id") == 9, c("beat"), c("fms"), c("rr")),
        "rr_cv_flag": T.rhythm_flag(c("animal_id") / 30.0, c("corr_warp"), 4.5 / 30)}), ties="vec_id")
    return out.select("vec_id", *[F.round(k, 4).alias(k) for k in ("corr_fms", "rmse_fms", "corr_warp", "rmse_warp")],
                      "null_reason", "note", "rr_cv_flag", "rank")


@query("inter_seed_correlation", f"""{NORM_SQL}, s AS (SELECT label, i, avg(f[i]) AS f, avg(wb[i]) AS wb FROM w, (SELECT unnest(range(1, 65)) AS i) WHERE label IN (1, 6) AND f IS NOT NULL GROUP BY 1, 2)
SELECT round(corr(a.f, b.f), 5) AS corr_fms, round(corr(a.wb, b.wb), 5) AS corr_warp FROM s a JOIN s b ON a.i = b.i AND a.label = 1 AND b.label = 6""")
def inter_seed_correlation(t):
    p = prepared(t).where(F.col("animal_id").isin(1, 6)).where("fms IS NOT NULL")
    f = B.elementwise(p, ["animal_id"], "fms").select("animal_id", F.col("mean").alias("f"))
    w = B.elementwise(p, ["animal_id"], "warp").select("animal_id", F.col("mean").alias("w"))
    one = f.join(w, "animal_id").agg(*[F.max(F.when(F.col("animal_id") == k, F.col(c))).alias(f"{c}{k}") for c in "fw" for k in (1, 6)])
    return one.select(F.round(A.pearson(F.col("f1"), F.col("f6")), 5).alias("corr_fms"), F.round(A.pearson(F.col("w1"), F.col("w6")), 5).alias("corr_warp"))
