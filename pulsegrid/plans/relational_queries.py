"""Relational queries of the study reports, on the driver tables.

Roles: orders = animals with a treatment arm (priority), customer and nation = metadata, events = samples,
an ``error`` event = a missing sample.
"""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from pulsegrid.functions import columns as X
from pulsegrid.operators import ordered as O, relational as R
from pulsegrid.plans.registry import query

ARMS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
STATUSES = {"F": "n_f", "O": "n_o", "P": "n_p"}


def _arm_sql(digits=4):
    return ", ".join(
        f"round(avg(CASE WHEN arm='{a}' THEN value END),{digits}) AS {p}_mean, "
        f"round(stddev_samp(CASE WHEN arm='{a}' THEN value END),{digits}) AS {p}_sd, "
        f"count(CASE WHEN arm='{a}' THEN value END) AS {p}_n" for a, p in ARMS.items())


@query("group_summary", f"""
WITH m AS (SELECT o.o_orderpriority AS arm, r.r_name AS study, o.o_totalprice, c.c_acctbal
           FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
           LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
           WHERE o.o_orderstatus <> 'P' AND c.c_acctbal >= 0),
 long AS (SELECT study, arm, 'o_totalprice' AS parameter, o_totalprice AS value FROM m
          UNION ALL SELECT study, arm, 'c_acctbal', c_acctbal FROM m)
SELECT study, parameter, {_arm_sql()} FROM long GROUP BY study, parameter""")
def group_summary(t):
    master = (t.orders.where(F.col("o_orderstatus") != "P")
              .join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
              .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
              .where(F.col("c_acctbal") >= 0)
              .select(F.col("r_name").alias("study"), F.col("o_orderpriority").alias("arm"), "o_totalprice", "c_acctbal"))
    return R.arm_summary(R.measurements(master, ["study", "arm"], ["o_totalprice", "c_acctbal"]),
                         ["study", "parameter"], "arm", ARMS)


@query("left_join_meta", """
SELECT o_orderkey, o_totalprice, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def left_join_meta(t):
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("o_orderkey", "o_totalprice", "c_mktsegment", "c_acctbal"))


@query("inner_join_audit", """
SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def inner_join_audit(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")


@query("semi_join", """
SELECT c_custkey, c_acctbal FROM customer WHERE EXISTS
 (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_join(t):
    return (t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
            .select("c_custkey", "c_acctbal"))


@query("anti_join", """
SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def anti_join(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left_anti")


@query("lookup_join", """
SELECT s_suppkey, s_acctbal, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")
def lookup_join(t):
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "s_acctbal", "n_name", "r_name"))


@query("conjunctive_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_returnflag = 'A' AND l_quantity <= 10 AND l_discount > 0.05""")
def conjunctive_filter(t):
    return (t.lineitem.where("l_returnflag = 'A' AND l_quantity <= 10 AND l_discount > 0.05D")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


@query("isin_null_filter", """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_acctbal IS NOT NULL GROUP BY 1""")
def isin_null_filter(t):
    return (t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"))
            .na.drop(subset=["c_acctbal"]).groupBy("c_mktsegment").agg(F.count("*").alias("n")))


ROLES_SQL = """SELECT o_orderkey AS animal_id, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS dox,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 1.6 WHEN '3-MEDIUM' THEN 16.0
       WHEN '4-NOT SPECIFIED' THEN 160.0 ELSE 5.0 END AS etn, o_totalprice AS value FROM orders"""
GROUP_SQL = """SELECT animal_id, value, CASE WHEN dox IS NULL OR dox = 0 THEN 'Control' WHEN etn = 0 THEN 'Dox' WHEN etn = 1.6 THEN 'Dox+Etn1.6'
  WHEN etn = 16 THEN 'Dox+Etn16' WHEN etn = 160 THEN 'Dox+Etn160' END AS grp FROM roles"""


def with_groups(t):
    p = F.col("o_orderpriority")
    etn = (F.when(p == "1-URGENT", 0.0).when(p == "2-HIGH", 1.6).when(p == "3-MEDIUM", 16.0)
            .when(p == "4-NOT SPECIFIED", 160.0).otherwise(5.0))
    s = F.col("o_orderstatus")
    dox = F.when(s == "F", F.lit(None).cast("double")).when(s == "O", 1.0).otherwise(0.0)
    return t.orders.select(F.col("o_orderkey").alias("animal_id"), F.col("o_totalprice").alias("value"),
                           X.treatment_group(dox, etn).alias("grp"), "o_orderdate", "o_orderstatus")


@query("treatment_group", f"""
WITH roles AS ({ROLES_SQL}), g AS ({GROUP_SQL})
SELECT grp, CASE grp WHEN 'Control' THEN 0 WHEN 'Dox' THEN 0 WHEN 'Dox+Etn1.6' THEN 1.6 WHEN 'Dox+Etn16' THEN 16 WHEN 'Dox+Etn160' THEN 160 END::DOUBLE AS dose,
  CASE grp WHEN 'Control' THEN 0 WHEN 'Dox' THEN 0 WHEN 'Dox+Etn1.6' THEN 1 WHEN 'Dox+Etn16' THEN 2 WHEN 'Dox+Etn160' THEN 3 END::INTEGER AS dose_rank,
  count(*) AS n, round(avg(value), 4) AS mean FROM g GROUP BY 1""")
def treatment_group(t):
    return (with_groups(t).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
            .withColumn("dose", X.dose_of_group(F.col("grp"))).withColumn("dose_rank", X.dose_rank(F.col("grp"))))


@query("labelling_variants", f"""
WITH roles AS ({ROLES_SQL}), g AS ({GROUP_SQL}), v AS (
 SELECT 'five_groups' AS kind, grp AS label, value FROM g
 UNION ALL SELECT 'any_dox_vs_control', CASE WHEN grp = 'Control' THEN 'Control' ELSE 'Dox' END, value FROM g
 UNION ALL SELECT 'dox_vs_any_etn', CASE WHEN grp = 'Dox' THEN 'Dox' WHEN grp LIKE 'Dox+Etn%' THEN 'DoxEtn' END, value FROM g
 UNION ALL SELECT 'high_etn_vs_rest', CASE WHEN grp IN ('Dox+Etn16', 'Dox+Etn160') THEN 'highEtn' ELSE 'rest' END, value FROM g
 UNION ALL SELECT 'control_vs_dox', CASE WHEN grp IN ('Control', 'Dox') THEN grp END, value FROM g)
SELECT kind, label, count(*) AS n, round(avg(value), 4) AS mean FROM v WHERE label IS NOT NULL GROUP BY 1, 2""")
def labelling_variants(t):
    kinds = ["five_groups", "any_dox_vs_control", "dox_vs_any_etn", "high_etn_vs_rest", "control_vs_dox"]
    wide = with_groups(t).select("value", *[X.labelling(F.col("grp"), k).alias(k) for k in kinds])
    return (wide.unpivot(["value"], kinds, "kind", "label").where("label IS NOT NULL").groupBy("kind", "label")
            .agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")))


@query("value_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("value_counts_domain", """
SELECT n_name, n FROM nation LEFT JOIN (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (n_name)""")
def value_counts_domain(t):
    found = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return R.counts_over_domain(found, "n_name", t.nation.select("n_name"))


@query("crosstab_pivot", """
SELECT o_orderpriority, count(CASE WHEN o_orderstatus='F' THEN 1 END) AS n_f, count(CASE WHEN o_orderstatus='O' THEN 1 END) AS n_o,
 count(CASE WHEN o_orderstatus='P' THEN 1 END) AS n_p FROM orders GROUP BY 1""")
def crosstab_pivot(t):
    return R.cross_tab(t.orders, "o_orderpriority", "o_orderstatus", STATUSES)


@query("count_distinct_guard", """
SELECT l_returnflag, count(DISTINCT l_linestatus) AS n_status, count(DISTINCT l_suppkey) AS n_supp, count(*) AS n,
 count(DISTINCT l_linestatus) >= 2 AND count(*) >= 12 AS testable FROM lineitem GROUP BY 1""")
def count_distinct_guard(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.countDistinct("l_linestatus").alias("n_status"), F.countDistinct("l_suppkey").alias("n_supp"),
        F.count("*").alias("n")).withColumn("testable", (F.col("n_status") >= 2) & (F.col("n") >= 12))


@query("argmin_group", """
SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1 ORDER BY avg(c_acctbal), 1 LIMIT 1""")
def argmin_group(t):
    means = t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))
    return means.agg(F.min_by("c_mktsegment", F.struct("mean", "c_mktsegment")).alias("c_mktsegment"),
                     F.round(F.min("mean"), 4).alias("mean"))


@query("conditional_rates", """
SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
 avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) < 0.20 AS below FROM events GROUP BY 1""")
def conditional_rates(t):
    rate = F.avg((F.col("event_type") == "error").cast("int"))
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(rate, 6).alias("error_rate"), (rate < 0.20).alias("below"))


@query("conditional_counts", """
SELECT c_mktsegment, count(*) AS n, count(CASE WHEN c_acctbal >= 0 THEN 1 END) AS n_ok, count(CASE WHEN NOT c_acctbal >= 0 THEN 1 END) AS n_not,
 count(CASE WHEN c_acctbal BETWEEN 400 AND 5000 THEN 1 END) AS n_band, min(c_acctbal) AS lo, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS hi
FROM customer GROUP BY 1""")
def conditional_counts(t):
    b = F.col("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count_if(b >= 0).alias("n_ok"), F.count_if(~(b >= 0)).alias("n_not"),
        F.count_if(b.between(400, 5000)).alias("n_band"), F.min(b).alias("lo"), F.round(F.avg(b), 4).alias("mean"),
        F.max(b).alias("hi"))


@query("null_counts", """
WITH m AS (SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
 c AS (SELECT 'quality' AS column_name, count(CASE WHEN quality IS NULL THEN 1 END) AS n_null FROM m
 UNION ALL SELECT 'toxic', count(CASE WHEN toxic IS NULL THEN 1 END) FROM m
 UNION ALL SELECT 'n_chars', count(CASE WHEN n_chars IS NULL THEN 1 END) FROM m)
SELECT * FROM c WHERE n_null > 0""")
def null_counts(t):
    m = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return R.null_counts(m, ["quality", "toxic", "n_chars"])


@query("median_impute", """
WITH long AS (SELECT event_id, event_type AS kind, CASE WHEN event_type <> 'error' THEN value END AS value,
   CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parameter FROM events),
 med AS (SELECT parameter, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1)
SELECT event_id, parameter, round(coalesce(value, med), 6) AS value, value IS NULL AS imputed FROM long JOIN med USING (parameter)""")
def median_impute(t):
    long = t.events.select("event_id", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("parameter"),
                           F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return R.impute_median(long).select("event_id", "parameter", F.round("value", 6).alias("value"), "imputed")


@query("quantiles", """
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25,
 round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1""")
def quantiles(t):
    q = O.exact_quantiles(t.events, ["event_type"], "value", {"p5": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95})
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ["p5", "p25", "p50", "p75", "p95"]])


@query("histogram", """
SELECT CAST(least(floor((value - 0.0) / 10.0), 19) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1""")
def histogram(t):
    return R.histogram(t.events, "value", 0.0, 200.0, 20)


@query("topk", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("dense_rank_dose", """
WITH m AS (SELECT l_returnflag AS study, l_discount AS dose, avg(l_extendedprice) AS mean, count(*) AS n,
  stddev_samp(l_extendedprice) / sqrt(count(*)) AS sem FROM lineitem GROUP BY 1, 2)
SELECT study, dose, round(mean, 4) AS mean, n, round(sem, 4) AS sem, CAST(dense_rank() OVER (PARTITION BY study ORDER BY dose) AS INTEGER) AS dose_rank FROM m""")
def dense_rank_dose(t):
    long = t.lineitem.select(F.col("l_returnflag").alias("study"), F.col("l_discount").alias("dose"),
                             F.col("l_extendedprice").alias("value"))
    return R.dose_means(long, ["study"], "dose").select(
        "study", "dose", F.round("mean", 4).alias("mean"), "n", F.round("sem", 4).alias("sem"), "dose_rank")


@query("cum_variance", """
WITH v AS (SELECT p_size, var_samp(p_retailprice) AS share FROM part GROUP BY 1 HAVING var_samp(p_retailprice) IS NOT NULL)
SELECT p_size, round(share, 4) AS share, round(sum(share) OVER (ORDER BY p_size) / sum(share) OVER (), 6) AS cumulative FROM v""")
def cum_variance(t):
    shares = t.part.groupBy("p_size").agg(F.var_samp("p_retailprice").alias("share")).where("share IS NOT NULL")
    return R.cumulative_share(shares, "p_size", "share").select(
        "p_size", F.round("share", 4).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("variance_cut", """
WITH v AS (SELECT p_size, var_samp(p_retailprice) AS share FROM part GROUP BY 1 HAVING var_samp(p_retailprice) IS NOT NULL),
 o AS (SELECT row_number() OVER (ORDER BY share DESC, p_size) AS k, sum(share) OVER (ORDER BY share DESC, p_size) / sum(share) OVER () AS cum FROM v)
SELECT min(CASE WHEN cum >= 0.8 THEN k END) AS k80, min(CASE WHEN cum >= 0.9 THEN k END) AS k90, min(CASE WHEN cum >= 0.95 THEN k END) AS k95 FROM o""")
def variance_cut(t):
    shares = t.part.groupBy("p_size").agg(F.var_samp("p_retailprice").alias("share")).where("share IS NOT NULL")
    ranked = shares.withColumn("k", F.row_number().over(W.orderBy(F.desc("share"), "p_size")).cast("long"))
    cum = R.cumulative_share(ranked, "k", "share")
    return cum.agg(*[F.min(F.when(F.col("cumulative") >= v, F.col("k"))).alias(n)
                     for n, v in (("k80", .8), ("k90", .9), ("k95", .95))])


@query("union_tagged", """
WITH u AS (SELECT c_nationkey AS nation, c_acctbal AS bal, 'clean' AS src FROM customer
 UNION ALL SELECT s_nationkey, s_acctbal, 'recovered' FROM supplier)
SELECT nation, src, count(*) AS n, round(avg(bal), 4) AS mean FROM u GROUP BY 1, 2""")
def union_tagged(t):
    u = R.tag_and_union({
        "clean": t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")),
        "recovered": t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))})
    return u.groupBy("nation", "src").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 4).alias("mean"))


def balance_day():
    """A sparse day: one for every whole unit of a customer's balance."""
    return F.date_add(F.lit("2000-01-01").cast("date"), F.floor("c_acctbal").cast("int"))


@query("largest_gap_split", """
WITH d AS (SELECT DISTINCT DATE '2000-01-01' + CAST(floor(c_acctbal) AS INTEGER) AS day FROM customer),
 g AS (SELECT day, date_diff('day', day, lead(day) OVER (ORDER BY day)) AS gap, count(*) OVER () AS n_days FROM d)
SELECT CAST(day AS VARCHAR) AS split_day, CAST(gap AS INTEGER) AS gap_days, n_days FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, day LIMIT 1""")
def largest_gap_split(t):
    return O.largest_gap_split(t.customer.select(balance_day().alias("day")), "day").select(F.col("split_day").cast("string").alias("split_day"), "gap_days", "n_days")


@query("study_by_gap", """
WITH e AS (SELECT DATE '2000-01-01' + CAST(floor(c_acctbal) AS INTEGER) AS day, c_acctbal AS value FROM customer), d AS (SELECT DISTINCT day FROM e),
 g AS (SELECT day, date_diff('day', day, lead(day) OVER (ORDER BY day)) AS gap FROM d),
 s AS (SELECT day AS split FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, day LIMIT 1)
SELECT CASE WHEN day <= (SELECT split FROM s) THEN 'acute' ELSE 'chronic' END AS study, count(*) AS n, round(sum(value), 2) AS total
FROM e GROUP BY 1""")
def study_by_gap(t):
    from pulsegrid.plans.features import assign_study
    e = t.customer.select(F.col("c_acctbal").alias("value"), balance_day().alias("day"))
    return (assign_study(e, "day").groupBy("study")
            .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))


@query("triage_tier", """
WITH u AS (SELECT user_id, avg(value) * 10 AS hr, stddev_pop(value) / avg(value) - 0.7 AS cv,
  CASE WHEN count(CASE WHEN event_type='error' THEN 1 END) > 20 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status FROM events GROUP BY 1)
SELECT user_id, status, round(hr, 4) AS hr, round(cv, 6) AS cv,
 CASE WHEN status <> 'OK' OR NOT coalesce(hr BETWEEN 300 AND 700, false) OR coalesce(cv, 99) > 0.60 THEN 'DROP' WHEN coalesce(cv, 99) <= 0.25 THEN 'KEEP' ELSE 'REVIEW' END AS tier FROM u""")
def triage_tier(t):
    u = t.events.groupBy("user_id").agg(
        (F.avg("value") * 10).alias("hr"), (F.stddev_pop("value") / F.avg("value") - 0.7).alias("cv"),
        F.when(F.count_if(F.col("event_type") == "error") > 20, "NEEDS_REVIEW").otherwise("OK").alias("status"))
    return u.select("user_id", "status", F.round("hr", 4).alias("hr"), F.round("cv", 6).alias("cv"),
                    X.triage_tier(F.col("status"), F.col("hr"), F.col("cv")).alias("tier"))


@query("null_rules", """
WITH u AS (SELECT user_id, avg(value) AS rr_mean, stddev_samp(value) / avg(value) AS rr_cv, min(value) AS excursion, median(value) AS qt FROM events GROUP BY 1)
SELECT user_id, CASE WHEN coalesce(rr_cv > 1.0, false) THEN NULL ELSE round(rr_mean, 6) END AS rr_mean,
 CASE WHEN coalesce(rr_cv > 1.0, false) OR coalesce(excursion < 0.5, false) THEN NULL ELSE round(qt, 6) END AS qt,
 CASE WHEN rr_cv <= 1.0 THEN 1 ELSE 0 END AS rhythm_regular, CASE WHEN excursion >= 0.5 THEN 1 ELSE 0 END AS twave_isolated FROM u""")
def null_rules(t):
    base = t.events.groupBy("user_id").agg(
        F.avg("value").alias("rr_mean"), (F.stddev_samp("value") / F.avg("value")).alias("rr_cv"),
        F.min("value").alias("excursion"))
    u = base.join(O.exact_quantiles(t.events, ["user_id"], "value", {"qt": 0.5}), "user_id")
    u = u.withColumn("rhythm_regular", X.flag(F.col("rr_cv") <= 1.0)).withColumn(
        "twave_isolated", X.flag(F.col("excursion") >= 0.5))
    u = X.null_where(u, F.col("rr_cv") > 1.0, ["rr_mean", "qt"])
    u = X.null_where(u, F.col("excursion") < 0.5, ["qt"])
    return u.select("user_id", F.round("rr_mean", 6).alias("rr_mean"), F.round("qt", 6).alias("qt"),
                    "rhythm_regular", "twave_isolated")


@query("quality_split", """
WITH u AS (SELECT user_id, CASE WHEN count(*) > 55 THEN 1 ELSE 0 END AS beats_detected, CASE WHEN stddev_samp(value) / avg(value) <= 1.0 THEN 1 ELSE 0 END AS rhythm_regular,
  CASE WHEN min(value) >= 0.5 THEN 1 ELSE 0 END AS twave_isolated, CASE WHEN max(value) < 400 THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status FROM events GROUP BY 1)
SELECT CASE WHEN status = 'OK' AND beats_detected = 1 AND rhythm_regular = 1 AND twave_isolated = 1 THEN 'clean' ELSE 'flagged' END AS quality, count(*) AS n,
 count(CASE WHEN status <> 'OK' THEN 1 END) AS bad_status, count(CASE WHEN beats_detected = 0 THEN 1 END) AS no_beats,
 count(CASE WHEN rhythm_regular = 0 THEN 1 END) AS irregular, count(CASE WHEN twave_isolated = 0 THEN 1 END) AS no_twave FROM u GROUP BY 1""")
def quality_split(t):
    v = F.col("value")
    u = t.events.groupBy("user_id").agg(
        X.flag(F.count("*") > 55).alias("beats_detected"), X.flag(F.stddev_samp(v) / F.avg(v) <= 1.0).alias("rhythm_regular"),
        X.flag(F.min(v) >= 0.5).alias("twave_isolated"), F.when(F.max(v) < 400, "OK").otherwise("NEEDS_REVIEW").alias("status"))
    flags = ["beats_detected", "rhythm_regular", "twave_isolated"]
    clean = X.is_clean_strict(F.col("status"), *[F.col(c) for c in flags])
    return u.groupBy(F.when(clean, "clean").otherwise("flagged").alias("quality")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "OK").alias("bad_status"),
        F.count_if(F.col("beats_detected") == 0).alias("no_beats"),
        F.count_if(F.col("rhythm_regular") == 0).alias("irregular"), F.count_if(F.col("twave_isolated") == 0).alias("no_twave"))


@query("gap_at_threshold", """
SELECT r_name, min(CASE WHEN c_acctbal > 5000 THEN c_acctbal END) - max(CASE WHEN c_acctbal <= 5000 THEN c_acctbal END) AS gap_raw,
 count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def gap_at_threshold(t):
    b = F.col("c_acctbal")
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name")
            .agg((F.min(F.when(b > 5000, b)) - F.max(F.when(b <= 5000, b))).alias("gap_raw"), F.count("*").alias("n")))


@query("rank_of_row", """
SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS pos FROM customer""")
def rank_of_row(t):
    return O.positions(t.customer, [], "c_acctbal", ["c_custkey"]).select("c_custkey", "pos")


@query("percent_change", """
WITH m AS (SELECT l_returnflag AS method, avg(l_extendedprice) AS price, avg(l_discount) AS disc FROM lineitem GROUP BY 1),
 b AS (SELECT * FROM m WHERE method = 'N')
SELECT m.method, round(m.price, 4) AS price, round(m.price - b.price, 4) AS price_delta, round(100.0 * (m.price - b.price) / abs(b.price), 6) AS price_pct,
 round(m.disc - b.disc, 8) AS disc_delta, round(100.0 * (m.disc - b.disc) / abs(b.disc), 6) AS disc_pct FROM m, b""")
def percent_change(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("method")).agg(
        F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"))
    r = R.percent_change(m, "method", "N", ["price", "disc"])
    return r.select("method", F.round("price", 4).alias("price"), F.round("price_delta", 4).alias("price_delta"),
                    F.round("price_pct", 6).alias("price_pct"), F.round("disc_delta", 8).alias("disc_delta"),
                    F.round("disc_pct", 6).alias("disc_pct"))


@query("systematic_sample", """
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 j AS (SELECT unnest(range(0, 15)) AS j), p AS (SELECT DISTINCT user_id, CASE WHEN n <= 15 THEN i ELSE NULL END AS i0, n FROM o)
SELECT DISTINCT o.user_id, o.event_id FROM o JOIN j ON o.n <= 15 OR o.i = (j.j * (o.n - 1)) // 14""")
def systematic_sample(t):
    e = t.events.select("user_id", "event_id", X.micros("ts").alias("us"))
    block = F.floor(F.col("us") / O.block_width(e, ["user_id"], "us"))
    return R.systematic_sample(e, ["user_id"], "us", ["event_id"], 15, block=block).select("user_id", "event_id")


@query("wide_report", f"""
WITH s AS (SELECT o_orderstatus AS study, o_orderpriority AS arm, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT study, {", ".join(f"max(CASE WHEN arm = '{a}' THEN printf('%.0f +/- %.0f', m, s) END) AS {p}" for a, p in ARMS.items())} FROM s GROUP BY 1""")
def wide_report(t):
    s = t.orders.groupBy(F.col("o_orderstatus").alias("study"), F.col("o_orderpriority").alias("arm")).agg(
        X.mean_sd_text(F.avg("o_totalprice"), F.stddev_samp("o_totalprice"), 0).alias("cell"))
    return s.groupBy("study").agg(*[F.max(F.when(F.col("arm") == a, F.col("cell"))).alias(p) for a, p in ARMS.items()])


@query("sorted_report", """
WITH m AS (SELECT p_type AS formula, avg(p_retailprice) AS mean, corr(p_retailprice, p_size) AS r FROM part GROUP BY 1)
SELECT formula, round(mean, 4) AS mean, round(abs(r), 6) AS abs_r, row_number() OVER (ORDER BY CASE WHEN abs(r) < 0.02 THEN 0 ELSE 1 END, abs(mean - 1400), formula) AS pos FROM m""")
def sorted_report(t):
    m = t.part.groupBy(F.col("p_type").alias("formula")).agg(
        F.avg("p_retailprice").alias("mean"), F.abs(F.corr("p_retailprice", "p_size")).alias("abs_r"))
    order = W.orderBy((F.col("abs_r") >= 0.02).cast("int"), F.abs(F.col("mean") - 1400), "formula")
    return m.select("formula", F.round("mean", 4).alias("mean"), F.round("abs_r", 6).alias("abs_r"),
                    F.row_number().over(order).cast("long").alias("pos"))


@query("sex_normalise", """
SELECT lower(c_mktsegment) AS sex, count(*) AS n FROM customer GROUP BY 1""")
def sex_normalise(t):
    return t.customer.groupBy(F.lower("c_mktsegment").alias("sex")).agg(F.count("*").alias("n"))


@query("plausibility_flag", """
SELECT s_suppkey, coalesce(s_acctbal / 10000.0 BETWEEN 0.1 AND 1.2 AND s_nationkey * 50 BETWEEN 250 AND 800, false) AS plausible FROM supplier""")
def plausibility_flag(t):
    return t.supplier.select("s_suppkey", X.plausible(F.col("s_acctbal") / 10000.0, F.col("s_nationkey") * 50).alias("plausible"))


@query("column_patch", """
SELECT c_custkey, c_name, n_orders, median_price, c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer) LEFT JOIN
 (SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(quantile_cont(o_totalprice, 0.5), 4) AS median_price FROM orders GROUP BY 1) USING (c_custkey)""")
def column_patch(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    patch = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders")).join(
        O.exact_quantiles(o, ["c_custkey"], "o_totalprice", {"median_price": 0.5}), "c_custkey")
    patch = patch.withColumn("median_price", F.round("median_price", 4))
    return R.patch_columns(t.customer.select("c_custkey", "c_name", "c_acctbal"), patch, "c_custkey", "c_name",
                           ["n_orders", "median_price"])


@query("filename_parse", r"""
WITH p AS (SELECT page_id, regexp_extract_all(url, '[0-9]+') AS nums FROM pages)
SELECT page_id, CAST(len(nums) AS INTEGER) AS n_runs, CASE WHEN len(nums) >= 4 THEN nums[4] WHEN len(nums) = 3 THEN nums[3] END AS id_text FROM p""")
def filename_parse(t):
    from pulsegrid.sources.filenames import digit_runs, id_run
    nums = digit_runs(F.col("url"))
    return t.pages.select("page_id", F.size(nums).alias("n_runs"), id_run(nums).alias("id_text"))


@query("recording_name_dates", r"""
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '2' ELSE '' END || strftime(o_orderdate, '%Y') || '_' || CAST(month(o_orderdate) + CASE WHEN o_orderkey % 7 = 0 THEN 6 ELSE 0 END AS VARCHAR)
   || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || CAST(day(o_orderdate) AS VARCHAR) END || '_' || CAST(o_custkey AS VARCHAR) AS stem FROM orders),
 r AS (SELECT o_orderkey, stem, regexp_extract_all(stem, '[0-9]+') AS g FROM n),
 d AS (SELECT o_orderkey, stem, try_cast(right(g[1], 4) || '-' || lpad(g[2], 2, '0') || '-' || CASE WHEN len(g) >= 4 THEN lpad(g[3], 2, '0') ELSE '01' END AS DATE) AS dt,
   CAST(CASE WHEN len(g) >= 4 THEN g[4] ELSE g[3] END AS BIGINT) AS aid FROM r)
SELECT o_orderkey, CASE WHEN dt IS NOT NULL THEN aid END AS animal_id, CAST(dt AS VARCHAR) AS recording_date FROM d""")
def recording_name_dates(t):
    from pulsegrid.sources.filenames import parse_name
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    stem = F.concat_ws("_", F.concat(F.when(k % 5 == 0, "2").otherwise(""), F.year(d).cast("string")),
                       (F.month(d) + F.when(k % 7 == 0, 6).otherwise(0)).cast("string"),
                       F.when(k % 3 != 0, F.dayofmonth(d).cast("string")), F.col("o_custkey").cast("string"))
    p = parse_name(stem)
    return t.orders.select("o_orderkey", p["animal_id"].alias("animal_id"), p["recording_date"].cast("string").alias("recording_date"))


@query("json_text_scan", r"""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(regexp_extract(props, '([a-z]+)', 1) AS DOUBLE) IS NULL AS bad_number FROM events""")
def json_text_scan(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"),
                           F.regexp_extract("props", "([a-z]+)", 1).try_cast("double").isNull().alias("bad_number"))
