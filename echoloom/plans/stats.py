"""Queries of discrimination, correlation, selection and metrics. lineitem's numbers are features, its flags classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import discrimination as D
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import selection as SL
from ..operators import stability as SB
from .tables import FEATURES, LONG, long_lineitem, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sided(spark, sf_dir):
    """Long features with side 1 for returned lines, 0 for the rest."""
    return long_lineitem(spark, sf_dir).withColumn("side", (F.col("l_returnflag") == "R").cast("int"))


SIDED = f"(SELECT *, (l_returnflag = 'R')::INT AS side FROM {LONG})"
RANKED = f"(SELECT feature, side, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM {SIDED})"
AUC = f"(SELECT feature, sum(side) AS n_pos, count(*) - sum(side) AS n_neg, (sum(r) FILTER (WHERE side = 1) - sum(side) * (sum(side) + 1) / 2.0) / (sum(side) * (count(*) - sum(side))) AS auc FROM {RANKED} GROUP BY feature)"


@query(f"SELECT feature, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS cliff_delta FROM {AUC}")
def rank_auc_cliff(spark, sf_dir):
    """#128."""
    t = D.rank_auc(sided(spark, sf_dir), ["feature"])
    return t.select("feature", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("cliff_delta", 6).alias("cliff_delta"))


WASS = f"""(WITH v AS (SELECT feature, value, sum(side) AS p, count(*) - sum(side) AS q FROM {SIDED} GROUP BY feature, value),
 c AS (SELECT feature, lead(value) OVER w - value AS gap, sum(p) OVER w / sum(p) OVER (PARTITION BY feature) - sum(q) OVER w / sum(q) OVER (PARTITION BY feature) AS d FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)) SELECT feature, sum(gap * abs(d)) AS wasserstein FROM c GROUP BY feature)"""


@query(f"SELECT feature, round(wasserstein, 5) AS wasserstein FROM {WASS}")
def wasserstein(spark, sf_dir):
    """#129."""
    return D.wasserstein(sided(spark, sf_dir), ["feature"]).select("feature", F.round("wasserstein", 5).alias("wasserstein"))


@query(f"""WITH l AS (SELECT feature, l_returnflag AS d, value FROM {LONG}), p AS (SELECT DISTINCT a.d AS a, b.d AS b FROM (SELECT DISTINCT d FROM l) a JOIN (SELECT DISTINCT d FROM l) b ON a.d < b.d),
 v AS (SELECT feature, a, b, value, sum((d = a)::INT) AS x, sum((d = b)::INT) AS y FROM l JOIN p ON d = a OR d = b GROUP BY ALL),
 c AS (SELECT feature, a, b, lead(value) OVER w - value AS gap, abs(sum(x) OVER w / sum(x) OVER (PARTITION BY feature, a, b) - sum(y) OVER w / sum(y) OVER (PARTITION BY feature, a, b)) AS d FROM v WINDOW w AS (PARTITION BY feature, a, b ORDER BY value)),
 s AS (SELECT feature, a, b, sum(gap * d) AS w FROM c GROUP BY ALL), sd AS (SELECT feature, stddev_pop(value) AS sd FROM l GROUP BY feature)
 SELECT s.feature, round(1 / (1 + avg(w) / (any_value(sd) + 1e-12)), 6) AS stability FROM s JOIN sd USING (feature) GROUP BY s.feature""")
def domain_stability(spark, sf_dir):
    """#130: return flags stand for domains."""
    return D.domain_stability(long_lineitem(spark, sf_dir), ["feature"], "l_returnflag").select("feature", F.round("stability", 6).alias("stability"))


MI = f"""(WITH s AS (SELECT feature, min(value) AS lo, max(value) AS hi, least(16, greatest(2, floor(sqrt(count(*)))))::INT AS bins FROM {SIDED} GROUP BY feature),
 b AS (SELECT feature, side, least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS b FROM {SIDED} JOIN s USING (feature)),
 j AS (SELECT feature, b, side, count(*) AS c FROM b GROUP BY ALL), p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, b) AS x, sum(c) OVER (PARTITION BY feature, side) AS y FROM j)
 SELECT feature, sum(c / t * ln(c * t / (x * y))) AS mi FROM p GROUP BY feature)"""


@query(f"SELECT feature, round(mi, 8) AS mi FROM {MI}")
def binned_mi(spark, sf_dir):
    """#131."""
    return D.binned_mutual_information(sided(spark, sf_dir), ["feature"]).select("feature", F.round("mi", 8).alias("mi"))


@query(f"""WITH g AS (SELECT feature, l_returnflag, avg(value) AS m, var_pop(value) AS v FROM {LONG} GROUP BY ALL) SELECT feature, round(var_pop(m) / (avg(v) + 1e-12), 9) AS f_ratio FROM g GROUP BY feature""")
def f_ratio(spark, sf_dir):
    """#127."""
    return D.f_ratio(long_lineitem(spark, sf_dir), ["feature"], "l_returnflag").select("feature", F.round("f_ratio", 9).alias("f_ratio"))


@query(f"""WITH g AS (SELECT feature, l_returnflag, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM {LONG} GROUP BY ALL), t AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM g)
 SELECT feature, round((sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS anova_f FROM t GROUP BY feature""")
def anova_f(spark, sf_dir):
    """#161."""
    return D.anova_f(long_lineitem(spark, sf_dir), ["feature"], "l_returnflag").select("feature", F.round("anova_f", 5).alias("anova_f"))


@query(f"""SELECT a.feature, round(a.auc, 6) AS auc, round(w.wasserstein, 5) AS wasserstein, round(m.mi, 8) AS mi, round(0.55 * 2 * abs(a.auc - 0.5) + 0.3 * abs(2 * a.auc - 1) + 0.15 * m.mi / (1 + m.mi), 6) AS score,
 round(s.mp, 4) AS mean_pos, round(s.mn, 4) AS mean_neg, round(s.dp, 4) AS median_pos FROM {AUC} a JOIN {WASS} w USING (feature) JOIN {MI} m USING (feature) JOIN (SELECT feature, avg(value) FILTER (WHERE side = 1) AS mp, avg(value) FILTER (WHERE side = 0) AS mn, quantile_cont(value, 0.5) FILTER (WHERE side = 1) AS dp FROM {SIDED} GROUP BY feature) s USING (feature)""")
def discrimination_table(spark, sf_dir):
    """#133: the comparison of returned lines with all others (the catalogue's nine run in one scan the same way)."""
    comparisons = {"R_vs_rest": (["R"], ["A", "N"]), "A_vs_N": (["A"], ["N"]), "R_vs_N": (["R"], ["N"])}
    t = D.discrimination_table(long_lineitem(spark, sf_dir), "l_returnflag", comparisons).where(F.col("comparison") == "R_vs_rest")
    digits = {"auc": 6, "wasserstein": 5, "mi": 8, "score": 6, "mean_pos": 4, "mean_neg": 4, "median_pos": 4}
    return t.select("feature", *[F.round(c, d).alias(c) for c, d in digits.items()])


_PAIRS = [(a, b) for i, a in enumerate(sorted(FEATURES)) for b in sorted(FEATURES)[i + 1 :]]
PEARSON = "(" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM lineitem" for a, b in _PAIRS) + ")"
_RANKS = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in FEATURES) + " FROM lineitem)"
SPEARMAN = "(" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM {_RANKS}" for a, b in _PAIRS) + ")"


@query(f"SELECT feature_a, feature_b, round(corr, 6) AS corr FROM {PEARSON}")
def pearson_matrix(spark, sf_dir):
    """#135."""
    return C.pairs(table(spark, sf_dir, "lineitem"), FEATURES).withColumn("corr", F.round("corr", 6))


def _ranks(spark, sf_dir):
    return C.with_ranks(table(spark, sf_dir, "lineitem"), FEATURES, ["l_orderkey"])


@query(f"SELECT feature_a, feature_b, round(corr, 6) AS corr FROM {SPEARMAN}")
def spearman_matrix(spark, sf_dir):
    """#135 on average ranks."""
    return C.pairs(_ranks(spark, sf_dir), FEATURES).withColumn("corr", F.round("corr", 6))


@query(f"SELECT feature_a, feature_b, round(corr, 6) AS corr FROM {PEARSON} WHERE abs(corr) >= 0.005")
def corr_pairs(spark, sf_dir):
    """#136."""
    return C.high(C.pairs(table(spark, sf_dir, "lineitem"), FEATURES), 0.005).withColumn("corr", F.round("corr", 6))


@query(f"""SELECT coalesce(p.feature_a, s.feature_a) AS feature_a, coalesce(p.feature_b, s.feature_b) AS feature_b, round(p.corr, 6) AS pearson, round(s.corr, 6) AS spearman, CASE WHEN p.corr IS NOT NULL AND s.corr IS NOT NULL THEN 'both' WHEN p.corr IS NOT NULL THEN 'pearson' ELSE 'spearman' END AS found_by
 FROM (SELECT * FROM {PEARSON} WHERE abs(corr) >= 0.004) p FULL JOIN (SELECT * FROM {SPEARMAN} WHERE abs(corr) >= 0.004) s ON p.feature_a = s.feature_a AND p.feature_b = s.feature_b""")
def corr_method_compare(spark, sf_dir):
    """#136, full outer join of both methods' pairs."""
    t = C.compare_methods(C.pairs(table(spark, sf_dir, "lineitem"), FEATURES), C.pairs(_ranks(spark, sf_dir), FEATURES), 0.004)
    return t.withColumns({"pearson": F.round("pearson", 6), "spearman": F.round("spearman", 6)})


_PART = "(SELECT p_size::DOUBLE AS value, (p_brand = (SELECT min(p_brand) FROM part))::INT AS side FROM part)"


@query(f"""WITH q AS (SELECT quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM (SELECT c_acctbal AS value FROM customer))
 SELECT 'acctbal' AS feature, round(avg((s_acctbal >= lo AND s_acctbal <= hi)::INT), 6) AS coverage, round(avg((s_acctbal < lo)::INT), 6) AS lower_ratio, round(avg((s_acctbal > hi)::INT), 6) AS upper_ratio FROM supplier, q""")
def coverage(spark, sf_dir):
    """#151, #184: suppliers against customers."""
    real = table(spark, sf_dir, "customer").select(F.lit("acctbal").alias("feature"), F.col("c_acctbal").alias("value"))
    other = table(spark, sf_dir, "supplier").select(F.lit("acctbal").alias("feature"), F.col("s_acctbal").alias("value"))
    t = D.coverage(real, other, ["feature"])
    return t.select("feature", *[F.round(c, 6).alias(c) for c in ("coverage", "lower_ratio", "upper_ratio")])


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi, min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)
 SELECT 'acctbal' AS feature, count(*) AS n, sum((s_acctbal < lo OR s_acctbal > hi)::INT)::BIGINT AS n_ood, round(avg((s_acctbal < lo OR s_acctbal > hi)::INT), 6) AS ood_ratio, round(avg((s_acctbal < a OR s_acctbal > b)::INT), 6) AS extreme_ratio FROM supplier, q""")
def ood_ratio(spark, sf_dir):
    """#152."""
    real = table(spark, sf_dir, "customer").select(F.lit("acctbal").alias("feature"), F.col("c_acctbal").alias("value"))
    other = table(spark, sf_dir, "supplier").select(F.lit("acctbal").alias("feature"), F.col("s_acctbal").alias("value"))
    t = D.ood_ratio(real, other, ["feature"])
    return t.select("feature", "n", "n_ood", F.round("ood_ratio", 6).alias("ood_ratio"), F.round("extreme_ratio", 6).alias("extreme_ratio"))


@query("""WITH x AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS v FROM supplier WHERE s_suppkey % 2 = 0), y AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS v FROM supplier WHERE s_suppkey % 2 = 1),
 g AS (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM (SELECT v FROM x UNION ALL SELECT v FROM y)), s AS (SELECT median(d) AS s FROM g WHERE d > 0), n AS (SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM y) AS m),
 xx AS (SELECT sum(exp(-power(a.v - b.v, 2) / (2 * s * s))) AS k FROM x a, x b, s WHERE a.i <> b.i), yy AS (SELECT sum(exp(-power(a.v - b.v, 2) / (2 * s * s))) AS k FROM y a, y b, s WHERE a.i <> b.i), xy AS (SELECT avg(exp(-power(a.v - b.v, 2) / (2 * s * s))) AS k FROM x a, y b, s)
 SELECT 'acctbal' AS feature, round(greatest(0, xx.k / (n * (n - 1)) + yy.k / (m * (m - 1)) - 2 * xy.k), 6) AS mmd2 FROM xx, yy, xy, n""")
def mmd_exact(spark, sf_dir):
    """#150: odd against even suppliers, bounded samples."""
    t = table(spark, sf_dir, "supplier").select(F.lit("acctbal").alias("feature"), (F.col("s_suppkey") % 2 == 0).cast("int").alias("side"), (F.col("s_acctbal") / 1000).alias("value"))
    return D.mmd_by_feature(t, ["feature"]).select("feature", F.round("mmd2", 6).alias("mmd2"))


@query()
def kde_overlap(spark, sf_dir):
    """#146."""
    t = D.kde_overlap_table(sided(spark, sf_dir).select("feature", "side", "value"), ["feature"])
    return t.withColumn("overlap", F.round("overlap", 6))


_SCORED = "(SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS y, (o_totalprice - lo) / (hi - lo) AS p, o_orderstatus FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders))"


def _scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lo, hi = o.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return o.select("o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"), ((F.col("o_totalprice") - lo) / (hi - lo)).alias("p"))


@query(f"""WITH c AS (SELECT o_orderstatus, sum((p >= 0.5 AND y = 1)::INT) AS tp, sum((p >= 0.5 AND y = 0)::INT) AS fp, sum((p < 0.5 AND y = 1)::INT) AS fn, sum((p < 0.5 AND y = 0)::INT) AS tn FROM {_SCORED} GROUP BY 1),
 r AS (SELECT o_orderstatus, y, rank() OVER (PARTITION BY o_orderstatus ORDER BY p) + (count(*) OVER (PARTITION BY o_orderstatus, p) - 1) / 2.0 AS r FROM {_SCORED}), a AS (SELECT o_orderstatus, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1)
 SELECT o_orderstatus, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS "precision", round(fp / (fp + tn), 6) AS fpr, round(auc, 6) AS auc FROM c JOIN a USING (o_orderstatus)""")
def binary_metrics(spark, sf_dir):
    """#155."""
    t = M.binary_metrics(_scores(spark, sf_dir), ["o_orderstatus"], "y", "p", 0.5)
    return t.select("o_orderstatus", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "recall", "precision", "fpr", "auc")])


@query(f"""WITH v AS (SELECT o_orderstatus, p, sum(y) AS a, count(*) - sum(y) AS b FROM {_SCORED} GROUP BY ALL), t AS (SELECT o_orderstatus, p, sum(a) OVER w / sum(a) OVER (PARTITION BY o_orderstatus) AS tpr, sum(b) OVER w / sum(b) OVER (PARTITION BY o_orderstatus) AS fpr FROM v WINDOW w AS (PARTITION BY o_orderstatus ORDER BY p DESC))
 SELECT o_orderstatus, round(p, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM t WHERE tpr >= 0.9 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY fpr, p DESC) = 1""")
def roc_threshold(spark, sf_dir):
    """#156."""
    t = M.roc_threshold(_scores(spark, sf_dir), ["o_orderstatus"], "y", "p", 0.9)
    return t.select("o_orderstatus", *[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(f"""WITH l AS (SELECT feature, l_linestatus || l_returnflag AS k, value FROM {LONG}), s AS (SELECT * FROM (VALUES ('a', 'FR', 'FA'), ('b', 'OR', 'OA')) v(c, p, q)),
 d AS (SELECT feature, c, (k = p)::INT AS side, value FROM l JOIN s ON k = p OR k = q), r AS (SELECT feature, c, side, value, rank() OVER (PARTITION BY feature, c ORDER BY value) + (count(*) OVER (PARTITION BY feature, c, value) - 1) / 2.0 AS r FROM d),
 a AS (SELECT feature, c, (sum(r) FILTER (WHERE side = 1) - sum(side) * (sum(side) + 1) / 2.0) / (sum(side) * (count(*) - sum(side))) AS auc, quantile_cont(value, 0.5) FILTER (WHERE side = 1) AS med, stddev_pop(value) FILTER (WHERE side = 1) AS sd FROM r GROUP BY ALL),
 j AS (SELECT x.feature, x.auc AS auc_a, y.auc AS auc_b, abs(x.med - y.med) / ((x.sd + y.sd) / 2 + 1e-12) AS shift FROM a x JOIN a y ON x.feature = y.feature AND x.c = 'a' AND y.c = 'b')
 SELECT feature, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, (auc_a - 0.5) * (auc_b - 0.5) > 0 AS same_direction, round(shift, 6) AS shift, round(CASE WHEN (auc_a - 0.5) * (auc_b - 0.5) > 0 THEN 2 * least(abs(auc_a - 0.5), abs(auc_b - 0.5)) ELSE 0 END / (1 + shift), 6) AS score FROM j""")
def cross_flow(spark, sf_dir):
    """#143: line status stands for the flow condition."""
    long = long_lineitem(spark, sf_dir).withColumn("k", F.concat("l_linestatus", "l_returnflag"))
    t = D.cross_flow(long, "k", {"a": ("FR", "FA"), "b": ("OR", "OA")})
    return t.select("feature", "same_direction", *[F.round(c, 6).alias(c) for c in ("auc_a", "auc_b", "shift", "score")])


@query(f"""WITH s AS (SELECT a.feature, 2 * abs(a.auc - 0.5) AS disc, m.mi AS mi FROM {AUC} a JOIN {MI} m USING (feature)), t AS (SELECT feature, 0.6 * disc + 0.4 * mi AS total FROM s), q AS (SELECT quantile_cont(total, 0.75) AS a, quantile_cont(total, 0.45) AS b FROM t)
 SELECT feature, round(total, 8) AS total, row_number() OVER (ORDER BY total DESC, feature)::INT AS rank, CASE WHEN total >= a THEN 'A' WHEN total >= b THEN 'B' ELSE 'C' END AS grade FROM t, q""")
def final_ranking(spark, sf_dir):
    """#144."""
    s = sided(spark, sf_dir)
    disc = D.rank_auc(s, ["feature"]).select("feature", (2 * F.abs(F.col("auc") - 0.5)).alias("score"))
    mi = D.binned_mutual_information(s, ["feature"]).select("feature", F.col("mi").alias("score"))
    return SL.final_ranking({"disc": disc, "mi": mi}, {"disc": 0.6, "mi": 0.4}).select("feature", F.round("total", 8).alias("total"), "rank", "grade")


@query("""WITH g AS (SELECT p_brand, p_type, sum(p_retailprice) AS v FROM part GROUP BY p_brand, p_type), r AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, p_type) AS k FROM g), t AS (SELECT p_brand, list(p_type) AS m FROM r WHERE k <= 10 GROUP BY p_brand)
 SELECT x.p_brand AS a, y.p_brand AS b, len(list_intersect(x.m, y.m))::INT AS n_common, (len(x.m) - len(list_intersect(x.m, y.m)))::INT AS only_a, (len(y.m) - len(list_intersect(x.m, y.m)))::INT AS only_b, round(len(list_intersect(x.m, y.m)) / len(list_distinct(x.m || y.m)), 6) AS jaccard FROM t x JOIN t y ON x.p_brand < y.p_brand""")
def jaccard_selected(spark, sf_dir):
    """#145: overlaps of each brand's ten best types."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("v"))
    top = p.withColumn("k", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("v"), "p_type"))).where("k <= 10")
    sets = top.groupBy(F.col("p_brand").alias("name")).agg(F.collect_list("p_type").alias("members"))
    return SL.overlap(sets).withColumn("jaccard", F.round("jaccard", 6))


@query("""SELECT s_suppkey, round(least(1, greatest(0, 0.45 * least(1, greatest(0, psr / 20)) + 0.35 * exp(-rmse / 1e-3) + 0.2 * v / 20))::DOUBLE, 6) AS confidence, CASE WHEN v < 4 OR rmse > 5e-3 THEN 'rejected' WHEN least(1, greatest(0, 0.45 * least(1, greatest(0, psr / 20)) + 0.35 * exp(-rmse / 1e-3) + 0.2 * v / 20)) < 0.5 THEN 'low_confidence' ELSE 'ok' END AS status
 FROM (SELECT s_suppkey, abs(s_acctbal) / 300 AS psr, (s_suppkey % 61) / 10000.0::DOUBLE AS rmse, s_suppkey % 21 AS v FROM supplier)""")
def confidence_status(spark, sf_dir):
    """#173."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 300).alias("psr"), ((F.col("s_suppkey") % 61) / 10000.0).alias("rmse"), (F.col("s_suppkey") % 21).alias("v"))
    s = s.withColumn("confidence", M.confidence(F.col("psr"), F.col("rmse"), F.col("v") / 20))
    return s.select("s_suppkey", F.round("confidence", 6).alias("confidence"), M.location_status(F.col("confidence"), F.col("rmse"), F.col("v")).alias("status"))


@query("""WITH r AS (SELECT c_nationkey, c_acctbal AS x, c_acctbal + (c_custkey % 7) - 3 AS truth, CASE c_custkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'low_confidence' ELSE 'ok' END AS status, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 50) / 1000.0::DOUBLE END AS rmse FROM customer)
 SELECT c_nationkey, count(*) AS n, round(avg((status = 'ok')::INT), 6) AS ok_rate, round(avg((status = 'rejected')::INT), 6) AS reject_rate, round(avg(rmse), 6) AS mean_rmse, round(avg(abs(x - truth)), 5) AS mae_x, round(sqrt(avg(power(x - truth, 2))), 5) AS rmse_x FROM r GROUP BY 1""")
def localisation_metrics(spark, sf_dir):
    """#154, an infinite fit error counts as none."""
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("source_x"), (F.col("c_acctbal") + k % 7 - 3).alias("truth"), F.when(k % 4 == 0, "rejected").when(k % 4 == 1, "low_confidence").otherwise("ok").alias("status"), F.when(k % 9 == 0, float("inf")).otherwise((k % 50) / 1000.0).alias("rmse_tdoa"))
    t = M.location_metrics(r, ["c_nationkey"], "truth")
    return t.select("c_nationkey", "n", *[F.round(c, d).alias(c) for c, d in (("ok_rate", 6), ("reject_rate", 6), ("mean_rmse", 6), ("mae_x", 5), ("rmse_x", 5))])


_Z = "1 / (1 + exp(-(-1.5 + 0.05 * l_quantity + 8.0 * l_discount - 3.0 * l_tax)))"


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(({_Z} >= 0.5)::INT)::BIGINT AS n_alarm, round(avg({_Z}), 6) AS mean_probability, round(max({_Z}), 6) AS max_probability FROM lineitem GROUP BY ALL""")
def batch_scoring_summary(spark, sf_dir):
    """#167: a stored linear model over the feature table."""
    t = M.scored(table(spark, sf_dir, "lineitem"), {"l_quantity": 0.05, "l_discount": 8.0, "l_tax": -3.0}, -1.5, 0.5)
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("alarm").cast("long")).alias("n_alarm"), F.round(F.avg("probability"), 6).alias("mean_probability"), F.round(F.max("probability"), 6).alias("max_probability"))


@query("""WITH a AS (SELECT user_id, ts, event_id, 1 / (1 + exp(-(value - 80) / 20)) AS p FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS far FROM a WHERE p >= 0.5 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts) AS segment FROM g)
 SELECT user_id, segment::BIGINT AS segment, min(ts) AS "start", max(ts) AS "end", count(*) AS n, round(max(p), 6) AS peak FROM s GROUP BY ALL""")
def alarm_segments(spark, sf_dir):
    """#167, #100: alarms within a day of each other are one segment."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = M.scored(e, {"value": 1 / 20}, -4.0, 0.5)
    t = M.alarm_segments(s, ["user_id"], "ts", 86400.0)
    return t.select("user_id", "segment", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("peak", 6).alias("peak"))


@query()
def stage_scores(spark, sf_dir):
    """#140."""
    l = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    t = SL.stage_scores(l, ["l_orderkey", "l_linenumber"], FEATURES, "y", "l_linestatus")
    return t.select("feature", F.round("score", 5).alias("score"), "kept", "rank")


@query()
def mrmr_ranking(spark, sf_dir):
    """#137-#139, #141: relevance and the correlation matrix, then the greedy order."""
    auc = {r["feature"]: 2 * abs(r["auc"] - 0.5) for r in D.rank_auc(sided(spark, sf_dir), ["feature"]).collect()}
    corr = C.matrix(C.pairs(table(spark, sf_dir, "lineitem"), FEATURES))
    chosen = SL.mrmr(FEATURES, auc, corr, len(FEATURES))
    kept = {r["feature"]: r for r in C.redundancy_components(FEATURES, corr, auc, 0.9)}
    rows = [(f, k + 1, float(s), kept[f]["component"], kept[f]["keep"]) for k, (f, s) in enumerate(chosen)]
    return spark.createDataFrame(rows, "feature string, rank int, score double, component int, keep boolean")


@query()
def bootstrap_stability(spark, sf_dir):
    """#117, #142: ranks over 200 rounds."""
    s = sided(spark, sf_dir).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return SL.bootstrap_stability(s, "key", 200, 2)


@query()
def bootstrap_errors(spark, sf_dir):
    """#103, #147: relative errors of five statistics by sample size, and their summary over features."""
    t = long_lineitem(spark, sf_dir).select("l_returnflag", "feature", "value")
    return SB.error_summary(SB.bootstrap_errors(t, ["l_returnflag", "feature"], [20, 50, 100, 200], 40), ["l_returnflag"])


@query()
def paired_mean_gaps(spark, sf_dir):
    """#148."""
    return SB.paired_gaps(long_lineitem(spark, sf_dir).select("l_returnflag", "feature", "value"), ["l_returnflag", "feature"], [20, 100, 400], 40)


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in FEATURES])


@query()
def distance_convergence(spark, sf_dir):
    """#149: distance of growing samples to all rows of a label, by Fourier features."""
    return SB.distance_curve(_labelled(spark, sf_dir), "l_returnflag", ["l_orderkey", "l_linenumber"], FEATURES, [50, 200, 800, 3200], 5)


_SAMPLED = "(SELECT l_returnflag, r, row_number() OVER (PARTITION BY l_returnflag, r ORDER BY md5(l_orderkey || '|' || l_linenumber || '|' || r || '|42'), l_orderkey, l_linenumber, {0}) AS place, {0} FROM lineitem, (SELECT unnest(range(0, 5)) AS r))".format(", ".join(FEATURES))
_MEANS = ", ".join(f"avg({c}) FILTER (WHERE place <= size) AS m{k}" for k, c in enumerate(FEATURES))
_WHOLE = ", ".join(f"avg({c}) AS a{k}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS d{k}" for k, c in enumerate(FEATURES))
_APART = " + ".join(f"power((m{k} - a{k}) / d{k}, 2)" for k in range(len(FEATURES)))


@query(f"""WITH z AS (SELECT unnest([50, 200, 800, 3200])::BIGINT AS size), m AS (SELECT l_returnflag, r, size, {_MEANS} FROM {_SAMPLED}, z GROUP BY ALL), w AS (SELECT l_returnflag, count(*) AS n, {_WHOLE} FROM lineitem GROUP BY 1)
 SELECT l_returnflag, size, round(avg(sqrt({_APART})), 6) AS l2 FROM m JOIN w USING (l_returnflag) WHERE size <= n GROUP BY ALL""")
def mean_convergence(spark, sf_dir):
    """#153: distance of sample means to the mean of all rows of a label, on scaled columns."""
    t = SB.mean_errors(_labelled(spark, sf_dir), "l_returnflag", ["l_orderkey", "l_linenumber"], FEATURES, [50, 200, 800, 3200], 5)
    return t.withColumn("l2", F.round("l2", 6))


def _psi_sql(x: str) -> str:
    y = f"({x} + 6.0)"
    return f"(ln{y} - 0.5 / {y} - 1 / {y} ** 2 / 12 + 1 / {y} ** 4 / 120 - 1 / {y} ** 6 / 252 - " + " - ".join(f"1 / ({x} + {i}.0)" for i in range(6)) + ")"


# neighbours by lists of the three values on both sides, places inside by as-of joins on cumulative counts
_NEAR = ", ".join(f"{{'gap': abs({f}(value, {i}) OVER w - value), 'at': {f}(value, {i}) OVER w, 'n': {f}(n, {i}) OVER w}}" for f in ("lag", "lead") for i in (1, 2, 3))
_TAKEN = "list_sum(list_transform(list_filter(near, lambda x: x.gap {} r), lambda x: x.n))"


@query(f"""WITH d AS (SELECT feature, side, value, count(*) AS n FROM {SIDED} GROUP BY ALL),
 a AS (SELECT feature, value, sum(n) AS here, sum(sum(n)) OVER (PARTITION BY feature ORDER BY value) AS upto FROM d GROUP BY feature, value),
 b AS (SELECT feature, side, value, n, sum(n) OVER (PARTITION BY feature, side) AS size, list_filter([{_NEAR}], lambda x: x.at IS NOT NULL) AS near FROM d WINDOW w AS (PARTITION BY feature, side ORDER BY value)),
 e AS (SELECT *, least(3, size - 1) AS k FROM b WHERE size > 1),
 g AS (SELECT *, CASE WHEN n <= k THEN list_min(list_filter(list_transform(near, lambda y: CASE WHEN n - 1 + list_sum(list_transform(list_filter(near, lambda x: x.gap <= y.gap), lambda x: x.n)) >= k THEN y.gap END), lambda z: z IS NOT NULL)) END AS r FROM e),
 h AS (SELECT *, list_filter(near, lambda x: x.gap = r)[1].at AS side_at, coalesce({_TAKEN.format('<')}, 0) AS inside, coalesce({_TAKEN.format('=')}, 0) AS shell FROM g),
 i AS (SELECT *, k - (n - 1) - inside AS ord, CASE WHEN side_at < value THEN side_at ELSE value - r END AS lo, CASE WHEN side_at < value THEN value + r ELSE side_at END AS hi FROM h),
 j AS (SELECT i.*, coalesce(x.upto, 0) AS upto_lo, coalesce(y.upto, 0) AS below_hi FROM i ASOF LEFT JOIN a x ON i.feature = x.feature AND i.lo >= x.value ASOF LEFT JOIN a y ON i.feature = y.feature AND i.hi > y.value),
 l AS (SELECT j.*, coalesce(x.here, 0) + coalesce(y.here, 0) - shell AS others, z.here FROM j LEFT JOIN a x ON j.feature = x.feature AND j.lo = x.value LEFT JOIN a y ON j.feature = y.feature AND j.hi = y.value JOIN a z ON j.feature = z.feature AND j.value = z.value),
 m AS (SELECT *, CASE WHEN n > k THEN {_psi_sql('k')} + {_psi_sql('here')} - {_psi_sql('n')} ELSE {_psi_sql('greatest(1.0, below_hi - upto_lo + ord - 1 + greatest(0, others) * ord / (shell + 1.0))')} END AS q FROM l)
 SELECT feature, round(greatest(0.0, {_psi_sql('sum(n)')} + sum(n * {_psi_sql('k')}) / sum(n) - sum(n * {_psi_sql('size')}) / sum(n) - sum(n * q) / sum(n)), 6) AS mi_knn FROM m GROUP BY feature""")
def neighbour_information(spark, sf_dir):
    """#132."""
    t = SB.neighbour_information_table(sided(spark, sf_dir).select("feature", "side", "value"), ["feature"])
    return t.withColumn("mi_knn", F.round("mi_knn", 6))


@query(f"""WITH n AS (SELECT feature, side, count(*) AS n FROM {SIDED} GROUP BY ALL), c AS (SELECT feature, CASE WHEN max(n) >= 1.2 * min(n) THEN min(n) ELSE max(n) END AS cap FROM n GROUP BY feature),
 d AS (SELECT s.feature, r, side, value, row_number() OVER (PARTITION BY s.feature, side, r ORDER BY md5(l_orderkey || '-' || l_linenumber || '|' || r || '|42'), l_orderkey || '-' || l_linenumber, value) AS k FROM {SIDED} s, (SELECT unnest(range(0, 3)) AS r) t),
 k AS (SELECT d.* FROM d JOIN c USING (feature) WHERE k <= cap), q AS (SELECT feature, r, side, rank() OVER (PARTITION BY feature, r ORDER BY value) + (count(*) OVER (PARTITION BY feature, r, value) - 1) / 2.0 AS rk FROM k),
 a AS (SELECT feature, r, (sum(rk) FILTER (WHERE side = 1) - sum(side) * (sum(side) + 1) / 2.0) / (sum(side) * (count(*) - sum(side))) AS auc FROM q GROUP BY ALL)
 SELECT feature, round(avg(auc), 6) AS auc, round(stddev_pop(auc), 6) AS auc_std FROM a GROUP BY feature""")
def balanced_repeats(spark, sf_dir):
    """#116."""
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    wide = table(spark, sf_dir, "lineitem").withColumns({"key": key, "side": (F.col("l_returnflag") == "R").cast("int")})
    long = Q.long_features(wide.withColumn("hashes", SB.repeat_hashes("key", 3)), ["key", "side", "hashes"], FEATURES)
    t = SB.balanced_repeats(long, "key", 3, hashes="hashes")
    return t.select("feature", F.round("auc", 6).alias("auc"), F.round("auc_std", 6).alias("auc_std"))
