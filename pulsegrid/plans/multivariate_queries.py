"""Matrix, clustering, classification and resampling queries on embeddings, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import constants as C
from pulsegrid.operators import (beats as BT, classify as L, clusters as K, inference as S, matrix as M, pairwise as PW, permutation as P,
                                 relational as R, resampling as B, ward as WD)
from pulsegrid.plans.registry import query
from pulsegrid.session import cut_lineage

E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"
LONG = E + ", u AS (SELECT vec_id, label, i, b[i] AS v FROM e, (SELECT unnest(range(1, 65)) AS i))"


def points(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("zscore", LONG + ", s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY 1) SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round((v - m) / s, 6) AS z FROM u JOIN s USING (i)")
def zscore(t):
    return M.standardised(points(t)).select("vec_id", F.posexplode("z").alias("dim", "z")).withColumn("z", F.round("z", 6))


@query("feature_matrix", """
WITH p AS (SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN CAST(p_size AS DOUBLE) END AS a, p_retailprice AS b, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS f FROM part),
 m AS (SELECT median(a) AS ma, median(b) AS mb FROM p), i AS (SELECT p_partkey, coalesce(a, ma) AS a, coalesce(b, mb) AS b, f FROM p, m),
 s AS (SELECT avg(a) AS ua, stddev_pop(a) AS sa, avg(b) AS ub, stddev_pop(b) AS sb FROM i)
SELECT p_partkey, round((a - ua) / sa, 6) AS z_a, round((b - ub) / sb, 6) AS z_b, round(f * 1.0::DOUBLE, 6) AS f FROM i, s""")
def feature_matrix(t):
    p = t.part.select("p_partkey", F.when(F.col("p_type") != "ECONOMY", F.col("p_size")).alias("a"), F.col("p_retailprice").alias("b"),
                      (F.col("p_size") > 25).cast("int").alias("f"))
    x = M.feature_matrix(p, ["p_partkey"], ["a", "b"], ["f"])
    return x.select("p_partkey", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(("z_a", "z_b", "f"))])


@query("cov_matrix", LONG + ", m AS (SELECT i, avg(v) AS m FROM u GROUP BY 1), c AS (SELECT vec_id, i, v - m AS v FROM u JOIN m USING (i)) SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, round(sum(a.v * b.v) / ((SELECT count(*) FROM e) - 1), 9) AS cov FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def cov_matrix(t):
    return M.covariance(points(t)).withColumn("cov", F.round("cov", 9))


@query("outlier_rule", LONG + ", s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM u WHERE i <= 2 GROUP BY 1), z AS (SELECT vec_id, max(CASE WHEN i = 1 THEN (v - m) / s END) AS pc1, max(CASE WHEN i = 2 THEN (v - m) / s END) AS pc2 FROM u JOIN s USING (i) GROUP BY 1) SELECT vec_id, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM z WHERE pc1 > 2 OR abs(pc2) > 1.5")
def outlier_rule(t):
    z = M.standardised(points(t)).select("vec_id", F.col("z")[0].alias("pc1"), F.col("z")[1].alias("pc2"))
    return z.where((F.col("pc1") > 2) | (F.abs("pc2") > 1.5)).select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


DIST = E + ", d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.b, b.b)) AS total, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL)"


@query("silhouette", DIST + ", s AS (SELECT vec_id, own AS label, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY ALL) SELECT vec_id, label, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) AS silhouette FROM s")
def silhouette(t):
    s = PW.silhouette_rows(points(t), "vec_id", "x", "label")
    return s.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("a", "b", "silhouette")])


@query("silhouette_mean", DIST + ", s AS (SELECT vec_id, own, max(CASE WHEN own = other THEN total / n END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM d GROUP BY ALL) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, CASE WHEN avg((b - a) / greatest(a, b)) > 0.5 THEN 'REAL' WHEN avg((b - a) / greatest(a, b)) > 0.35 THEN 'weak' ELSE 'noise' END AS verdict FROM s")
def silhouette_mean(t):
    s = K.silhouette(points(t), "vec_id", "x", "label")
    return s.select(F.round("silhouette", 6).alias("silhouette"), K.separation_verdict(F.col("silhouette")).alias("verdict"))


@query("permdisp_deviation", DIST + " SELECT vec_id, own AS label, round(total / n, 6) AS deviation FROM d WHERE own = other")
def permdisp_deviation(t):
    return PW.own_group_dispersion(points(t), "vec_id", "x", "label").withColumn("deviation", F.round("deviation", 6))


@query("permdisp_f", DIST + ", v AS (SELECT own, total / n AS dev FROM d WHERE own = other), g AS (SELECT own, count(*) AS n, avg(dev) AS m, var_pop(dev) AS s FROM v GROUP BY 1), t AS (SELECT avg(dev) AS gm FROM v) SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 5) AS f_stat FROM g, t")
def permdisp_f(t):
    dev = cut_lineage(PW.own_group_dispersion(points(t), "vec_id", "x", "label").withColumn("d", F.array("deviation")))  # read several times
    f = P.pseudo_f(P.permuted_sums(dev, "vec_id", "label", "d"))
    return f.select("k", "n", F.round("f_stat", 5).alias("f_stat"))


@query("permanova_f", LONG + ", c AS (SELECT label, i, count(*) AS n, sum(v * v) AS q, sum(v) AS s FROM u GROUP BY 1, 2), w AS (SELECT sum(q - s * s / n) AS ssw, count(DISTINCT label) AS k FROM c), t AS (SELECT sum(q - s * s / n) AS sst, any_value(n) AS n FROM (SELECT i, count(*) AS n, sum(v * v) AS q, sum(v) AS s FROM u GROUP BY 1)) SELECT k, n, round(((sst - ssw) / (k - 1)) / (ssw / (n - k)), 6) AS f_stat, round(1 - ssw / sst, 6) AS r2 FROM w, t")
def permanova_f(t):
    f = P.pseudo_f(P.permuted_sums(points(t), "vec_id", "label"))
    return f.select("k", "n", F.round("f_stat", 6).alias("f_stat"), F.round("r2", 6).alias("r2"))


@query("adjusted_rand", """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
 x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS sa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS sb, (SELECT sum(n) FROM c) AS n)
SELECT CAST(n AS BIGINT) AS n, round((ab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 8) AS ari FROM x""")
def adjusted_rand(t):
    return K.adjusted_rand(t.orders, "o_orderstatus", "o_orderpriority").withColumn("ari", F.round("ari", 8))


@query("consensus_pac", E + ", l AS (SELECT vec_id, [label % 2, CASE WHEN vec_id % 5 <> 0 THEN label % 3 END, CASE WHEN b[1] > 0 THEN 1 ELSE 0 END, CASE WHEN vec_id % 3 <> 1 THEN CAST(floor((b[2] + 5) * 4) AS INTEGER) END] AS r FROM e), "
       "p AS (SELECT a.vec_id AS i, c.vec_id AS j, list_sum(list_transform(range(1, 5), lambda k: CASE WHEN a.r[k] = c.r[k] THEN 1 ELSE 0 END)) AS same, list_sum(list_transform(range(1, 5), lambda k: CASE WHEN a.r[k] IS NOT NULL AND c.r[k] IS NOT NULL THEN 1 ELSE 0 END)) AS seen FROM l a JOIN l c ON a.vec_id < c.vec_id), "
       "q AS (SELECT CASE WHEN seen > 0 THEN same / seen ELSE 0 END AS m FROM p) SELECT count(*) AS pairs, count(CASE WHEN m > 0.1 AND m < 0.9 THEN 1 END) AS ambiguous, round(avg(m), 6) AS mean_rate, round(count(CASE WHEN m > 0.1 AND m < 0.9 THEN 1 END) / count(*), 6) AS pac FROM q")
def consensus_pac(t):
    x = F.col("x")
    runs = F.array(F.col("label") % 2, F.when(F.col("vec_id") % 5 != 0, F.col("label") % 3), F.when(x[0] > 0, 1).otherwise(0),
                   F.when(F.col("vec_id") % 3 != 1, F.floor((x[1] + 5) * 4).cast("int")))
    c = PW.ambiguous_share(points(t).select("vec_id", runs.alias("runs")), "vec_id", "runs")
    return c.select("pairs", "ambiguous", F.round("mean_rate", 6).alias("mean_rate"), F.round("pac", 6).alias("pac"))


@query("drop_minority_cluster", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id, label FROM embeddings WHERE label = (SELECT label FROM n ORDER BY n DESC, label LIMIT 1)")
def drop_minority_cluster(t):
    return K.largest_cluster(t.embeddings.select("vec_id", "label"), "label")


@query("relabel_by_mean", "WITH m AS (SELECT o_orderstatus, row_number() OVER (ORDER BY avg(o_totalprice) DESC, o_orderstatus DESC) AS place FROM orders GROUP BY 1) SELECT o_orderkey, chr(CAST(64 + place AS INTEGER)) AS phenotype FROM orders JOIN m USING (o_orderstatus)")
def relabel_by_mean(t):
    return K.relabel_by_mean(t.orders, "o_orderstatus", "o_totalprice").select("o_orderkey", "phenotype")


@query("cluster_flag_scan", "WITH f AS (SELECT l_returnflag AS cluster, CASE WHEN l_quantity > 8 THEN 1.0 ELSE 0.0 END AS beats, CASE WHEN l_discount > 0.08 THEN 1.0 ELSE 0.0 END AS regular FROM lineitem), u AS (SELECT cluster, 'beats' AS flag, beats AS v FROM f UNION ALL SELECT cluster, 'regular', regular FROM f) SELECT cluster, flag, round(avg(v), 6) AS rate, count(*) AS n, avg(v) < 0.2 AS defining FROM u GROUP BY 1, 2")
def cluster_flag_scan(t):
    f = t.lineitem.select(F.col("l_returnflag").alias("cluster"), (F.col("l_quantity") > 8).cast("int").alias("beats"), (F.col("l_discount") > F.lit(0.08)).cast("int").alias("regular"))
    return K.flag_rates(f, "cluster", ["beats", "regular"]).withColumn("rate", F.round("rate", 6))


@query("missingness_matrix", "WITH m AS (SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS cluster, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), r AS (SELECT *, row_number() OVER (ORDER BY cluster, doc_id) AS row FROM m) SELECT doc_id, CAST(cluster AS INTEGER) AS cluster, CAST(quality IS NOT NULL AS INTEGER) AS quality, CAST(toxic IS NOT NULL AS INTEGER) AS toxic, row, row = min(row) OVER (PARTITION BY cluster) AS boundary FROM r")
def missingness_matrix(t):
    lang = F.col("lang")
    m = t.documents.select("doc_id", F.when(lang == "en", 0).when(lang == "de", 1).when(lang == "fr", 2).otherwise(3).alias("cluster")).join(t.labels, "doc_id", "left")
    return K.missingness(m, "doc_id", "cluster", ["quality", "toxic"])


@query("balanced_accuracy", "WITH x AS (SELECT l.doc_id % 5 AS fold, l.quality AS code, CASE WHEN d.n_chars > 700 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT fold, code, avg(CASE WHEN guess = code THEN 1.0 ELSE 0.0 END) AS recall FROM x GROUP BY 1, 2), f AS (SELECT fold, avg(recall) AS a FROM r GROUP BY 1) SELECT 0 AS p, round(avg(a), 6) AS acc FROM f")
def balanced_accuracy(t):
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        (F.col("doc_id") % 5).alias("fold"), F.col("quality").alias("code"), (F.col("n_chars") > 700).cast("int").alias("guess"))
    counts = x.groupBy(F.lit(0).alias("p"), "fold", "code").agg(F.sum((F.col("guess") == F.col("code")).cast("double")).alias("hits"), F.count("*").alias("seen"))
    return L.balanced_accuracy(counts).withColumn("acc", F.round("acc", 6))


@query("phenotype_profile", "SELECT l_linestatus || l_returnflag AS phenotype, round(avg(l_quantity), 5) AS l_quantity, round(avg(l_extendedprice), 3) AS l_extendedprice, round(avg(l_discount), 7) AS l_discount, count(*) AS n FROM lineitem GROUP BY 1")
def phenotype_profile(t):
    df = t.lineitem.withColumn("phenotype", F.concat("l_linestatus", "l_returnflag"))
    digits = {"l_quantity": 5, "l_extendedprice": 3, "l_discount": 7}
    return K.profile(df, "phenotype", list(digits)).select("phenotype", *[F.round(c, d).alias(c) for c, d in digits.items()], "n")


@query("phenotype_enrichment", """
WITH b AS (SELECT l_returnflag AS r, l_linestatus AS a, CAST(l_linenumber AS VARCHAR) AS b, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS c FROM lineitem WHERE l_returnflag <> 'N'),
 u AS (SELECT 'status' AS labelling, r, a AS v FROM b UNION ALL SELECT 'line', r, b FROM b UNION ALL SELECT 'dose', r, c FROM b),
 o AS (SELECT labelling, r, v, count(*) AS o FROM u GROUP BY ALL), rs AS (SELECT labelling, r, sum(o) AS nr FROM o GROUP BY ALL), cs AS (SELECT labelling, v, sum(o) AS nc FROM o GROUP BY ALL),
 n AS (SELECT labelling, sum(o) AS n, CAST((count(DISTINCT r) - 1) * (count(DISTINCT v) - 1) AS INTEGER) AS dof FROM o GROUP BY 1),
 g AS (SELECT rs.labelling, rs.r, cs.v, coalesce(o.o, 0) AS o, nr * nc / n AS e, n, dof FROM rs JOIN cs USING (labelling) JOIN n USING (labelling) LEFT JOIN o ON o.labelling = rs.labelling AND o.r = rs.r AND o.v = cs.v)
SELECT labelling, CAST(any_value(n) AS BIGINT) AS n, round(sum((abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e), 6) AS chi2, any_value(dof) AS dof FROM g GROUP BY labelling""")
def phenotype_enrichment(t):
    df = t.lineitem.where("l_returnflag <> 'N'").select("l_returnflag", F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"),
                                                        F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("dose"))
    return K.enrichment(df, "l_returnflag", ["status", "line", "dose"]).select("labelling", "n", F.round("chi2", 6).alias("chi2"), "dof")


@query("cluster_mean_template", E + """, u AS (SELECT label, vec_id, b[i] AS v, i - 1 AS i FROM e, (SELECT unnest(range(1, 65)) AS i) WHERE i <= 64 - vec_id % 7)
SELECT label, CAST(i AS INTEGER) AS i, round(avg(v), 7) AS mean, round(stddev_samp(v), 7) AS sd, count(*) AS n FROM u GROUP BY 1, 2""")
def cluster_mean_template(t):
    ragged = t.embeddings.select("label", F.slice("embedding", F.lit(1), (64 - F.col("vec_id") % 7).cast("int")).alias("x"))
    m = BT.elementwise_ragged(ragged, ["label"], "x").select("label", F.posexplode(F.arrays_zip("mean", "sd", "counts")).alias("i", "e"))
    return m.select("label", "i", F.round("e.mean", 7).alias("mean"), F.round("e.sd", 7).alias("sd"), F.col("e.counts").alias("n"))


@query("gallery_summary", "WITH b AS (SELECT p_retailprice / 20 AS qt_ms, p_retailprice / 20 / sqrt(p_size / 10.0) AS qtc_ms FROM part WHERE p_partkey IN (211, 206, 239, 247, 208, 218, 248, 142, 230, 136)), u AS (SELECT 'qt_ms' AS measure, qt_ms AS v FROM b UNION ALL SELECT 'qtc_ms', qtc_ms FROM b) SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM u GROUP BY 1")
def gallery_summary(t):
    f = t.part.select("p_partkey", (F.col("p_retailprice") / 20).alias("qt_ms"), (F.col("p_retailprice") / 20 / F.sqrt(F.col("p_size") / 10.0)).alias("qtc_ms"))
    return BT.gallery_summary(f, "p_partkey", C.GALLERY, ["qt_ms", "qtc_ms"]).select("measure", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("template_status", """WITH r AS (SELECT l_orderkey, 85 + l_quantity * 3 AS rr_ms FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, avg(rr_ms) AS m, stddev_samp(rr_ms) AS s FROM r GROUP BY 1)
SELECT l_orderkey, n + 1 AS n_beats, round(CASE WHEN n > 1 THEN s / m END, 6) AS rr_cv, CASE WHEN n + 1 < 2 THEN 'FAILED_PEAKS' WHEN 60000.0 / m BETWEEN 300 AND 700 THEN 'OK' ELSE 'NEEDS_REVIEW' END AS status FROM g""")
def template_status(t):
    from pulsegrid.operators import windows as WN
    rr = t.lineitem.select("l_orderkey", (85 + F.col("l_quantity") * 3).alias("rr_ms"))
    return WN.template_rhythm(rr, ["l_orderkey"]).withColumn("rr_cv", F.round("rr_cv", 6))


# ---- fits and random draws: row checks only, tested on fixtures ---------------------------------------------
@query("pca_scores")
def pca_scores(t):
    p = M.Components(points(t), 10)
    return p.scores(points(t)).select("vec_id", "label", F.posexplode("scores").alias("component", "score"))


@query("pca_shift")
def pca_shift(t):
    old = points(t)
    new = old.withColumn("x", F.transform("x", lambda v, i: F.when(i < 8, v * 0.8).otherwise(v)))
    return M.pca_shift(old, new, "vec_id")


@query("kmeans_clusters")
def kmeans_clusters(t):
    return K.kmeans(points(t), 5).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query("gmm_clusters")
def gmm_clusters(t):
    scores = leading_scores(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return K.mixture(scores, 2, "scores").groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query("pam_clusters")
def pam_clusters(t):
    return K.pam(points(t), "vec_id", 3).groupBy("cluster", "label").agg(F.count("*").alias("n"))


def leading_scores(t):
    """Scores on the components that carry 90 % of the variance."""
    p = M.Components(points(t), 64)
    return p.scores(points(t)).select("vec_id", F.slice("scores", 1, p.components_for(0.9)).alias("scores"))


@query("silhouette_sweep")
def silhouette_sweep(t):
    return K.silhouette_sweep(leading_scores(t), "vec_id", range(2, 9), "scores", ("kmeans", "gmm"))


@query("consensus_runs")
def consensus_runs(t):
    lab = K.subsampled_labels(leading_scores(t), "vec_id", 3, "scores", algorithms=("kmeans", "gmm", "pam"))
    return PW.ambiguous_share(lab, "vec_id", "labels")


@query("consensus_choice")
def consensus_choice(t):
    return K.consensus_choice(leading_scores(t), "vec_id", x="scores")


@query("recluster_inner")
def recluster_inner(t):
    return K.recluster_inner(leading_scores(t), "vec_id", "scores", range(2, 4), ("kmeans",))


@query("ward_clusters")
def ward_clusters(t):
    labels, _ = WD.ward(points(t).select(F.lit(1).alias("r"), F.col("vec_id").alias("id"), "x"), (2, 3, 4, 5, 6))
    return labels.select(F.col("id").alias("vec_id"), "k", "label")


@query("permanova")
def permanova(t):
    return P.permanova(points(t), "vec_id", "label")


@query("permdisp")
def permdisp(t):
    return P.permdisp(points(t), "vec_id", "label")


@query("lda_classification")
def lda_classification(t):
    return L.cross_validated(points(t), "vec_id", "label")


@query("pls_classification")
def pls_classification(t):
    return L.cross_validated(points(t), "vec_id", "label", model="pls")


@query("label_fold_sizes", """
WITH c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS code, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(p AS INTEGER) AS p, CAST(fold AS INTEGER) AS fold, CAST(code AS INTEGER) AS code, CAST(n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM c, range(0, 61) AS r(p), range(0, 5) AS f(fold)""")
def label_fold_sizes(t):
    lab = L.fold_labellings(points(t), "vec_id", "label", "x", 60, 5, 0, 2)
    return L.cell_counts(lab).groupBy("p", "fold", "code").agg(F.sum("n").alias("n"))


@query("classification_tasks")
def classification_tasks(t):
    arms = {0: "control", 1: "dox", 2: "dox+low", 3: "dox+mid", 4: "dox+high"}
    pooled = {1: "dox", 2: "dox+any", 3: "dox+any", 4: "dox+any"}
    tasks = {"five arms [lda]": (arms, "lda"), "five arms [pls]": (arms, "pls"), "control vs dox [lda]": ({0: "control", 1: "dox"}, "lda"),
             "dox vs pooled [lda]": (pooled, "lda")}
    return L.task_list(points(t), "vec_id", "label", tasks)


@query("forest_classification")
def forest_classification(t):
    return L.forest(points(t), "vec_id", "label", permutations=60)


def arms(t):
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("study"), F.col("o_orderpriority").alias("arm"), F.col("o_totalprice").alias("value"))


@query("bootstrap_ci")
def bootstrap_ci(t):
    return B.bootstrap_interval(arms(t), ["study"], "arm", "1-URGENT", "5-LOW", ["o_orderkey"])


@query("gibbs_arm_means")
def gibbs_arm_means(t):
    draws = B.hierarchical_means(S.arm_moments(arms(t), ["study"], "arm"), ["study"], "arm")
    return B.posterior_summary(draws, ["study"]).unionByName(B.posterior_summary(B.posterior_contrast(draws, ["study"], "1-URGENT", "5-LOW"), ["study"]))


@query("gibbs_slope")
def gibbs_slope(t):
    rank = F.substring("arm", 1, 1).cast("int")
    return B.posterior_summary(B.slope_posterior(arms(t).withColumn("rank", rank - 1), ["study"], "rank"), ["study"])


@query("dose_response_sets", """
WITH b AS (SELECT o_orderkey, o_orderstatus AS src, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) - 1 AS level, o_totalprice AS value FROM orders),
 s AS (SELECT 'clean' AS set_name, level, value FROM b WHERE src = 'F' UNION ALL SELECT 'clean+recovered', level, value FROM b WHERE src IN ('F', 'O') UNION ALL SELECT 'all', level, value FROM b),
 g AS (SELECT set_name, level, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM s GROUP BY 1, 2), gm AS (SELECT set_name, avg(value) AS gm, count(*) AS nt FROM s GROUP BY 1)
SELECT set_name, CAST(any_value(nt) AS BIGINT) AS n, round((sum(g.n * (m - gm) ** 2) / (count(*) - 1)) / (sum((g.n - 1) * v) / (any_value(nt) - count(*))), 6) AS f_stat,
 round(max(CASE WHEN level = 0 THEN m END), 4) AS mean_0, round(max(CASE WHEN level = 4 THEN m END), 4) AS mean_4 FROM g JOIN gm USING (set_name) GROUP BY set_name""")
def dose_response_sets(t):
    from pulsegrid.plans.study_report import dose_response
    b = t.orders.select("o_orderstatus", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"), F.col("o_totalprice").alias("value"))
    sets = R.tag_and_union({"clean": b.where("o_orderstatus = 'F'"), "clean+recovered": b.where("o_orderstatus IN ('F', 'O')"), "all": b}, "set_name")
    r = dose_response(sets, ["set_name"], "level", 5)
    return r.select("set_name", "n", F.round("f_stat", 6).alias("f_stat"), F.round("mean_0", 4).alias("mean_0"), F.round("mean_4", 4).alias("mean_4"))
