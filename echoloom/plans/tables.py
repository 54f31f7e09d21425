"""Queries of table algebra: labels, times, splits, quality, gates. lineitem stands for a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.values import seeded_order
from ..operators import gates as G
from ..operators import quality as Q
from ..operators import splits as SP

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Long feature table for the SQL side.
LONG = "(UNPIVOT (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.long_features(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], FEATURES)


@query("""SELECT p_type, ((SELECT sum(i * ascii(upper(trim(p_type))[i])) FROM (SELECT unnest(range(1, length(trim(p_type)) + 1)) AS i) t) % 10000)::INT AS type_code FROM (SELECT DISTINCT p_type FROM part)""")
def type_code(spark, sf_dir):
    """#39."""
    return table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", L.type_code(F.col("p_type")).alias("type_code"))


@query("""SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 3 WHEN 7 THEN 1 ELSE 0 END AS label FROM supplier""")
def label_normalise(spark, sf_dir):
    """#44, #49: spellings of both classes, and a number as it is."""
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Positive", "NOISE", "bk", "flow_noise ", "1", "0", "3.7", "断丝", "流噪声")]), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", L.normalize_label(raw).alias("label"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'FL00' WHEN 1 THEN 'FL05' WHEN 2 THEN 'BK00' WHEN 3 THEN 'QJ05' WHEN 4 THEN 'BK05' WHEN 5 THEN 'QJ00' WHEN 6 THEN 'FL05' ELSE 'QJ00' END AS source_label FROM supplier)
 SELECT s_suppkey, source_label, CASE WHEN source_label LIKE 'BK%' THEN 'BK' ELSE 'Other' END AS target_label FROM s""")
def source_label_alias(spark, sf_dir):
    """#49: spellings by the alias table, then the folder's class for missing, general and unknown ones."""
    raw = F.element_at(F.array(*[F.lit(x) for x in ("flow-v0", " V0.5-Flow ", "bk", "v05-qj", "BK05", "v0-qj", "flow", None)]), (F.col("s_suppkey") % 8 + 1).cast("int"))
    fallback = F.when(F.col("s_suppkey") % 8 == 6, "FL05").otherwise("QJ00")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", L.source_label(raw, fallback).alias("source_label"))
    return t.withColumn("target_label", L.target_label(F.col("source_label")))


@query(r"""WITH n AS (SELECT n_nationkey, '/data/' || lower(n_name) || CASE n_nationkey % 4 WHEN 0 THEN '/BK14_' WHEN 1 THEN '/bk14-' WHEN 2 THEN '/FL14_' ELSE '/BK14_BK14-' END || n_name || CASE n_nationkey % 3 WHEN 0 THEN '_tr' WHEN 1 THEN '_test' ELSE '' END || '.csv' AS path FROM nation)
 SELECT n_nationkey, upper(regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', ''), '(?i)_(train|test|tr|te)$', ''), '(?i)^(BK14_)?(BK14-)?', '')) AS domain FROM n""")
def path_domain_token(spark, sf_dir):
    """#45: one set's prefix goes, in either spelling, other sets keep theirs."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("/BK14_", "/bk14-", "/FL14_", "/BK14_BK14-")]), F.col("n_nationkey") % 4 + 1)
    path = F.concat(F.lit("/data/"), F.lower("n_name"), prefix, F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "_tr").when(F.col("n_nationkey") % 3 == 1, "_test").otherwise(""), F.lit(".csv"))
    return table(spark, sf_dir, "nation").select("n_nationkey", L.base_domain(path).alias("domain"))


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'train' WHEN 3 THEN 'train' WHEN 4 THEN 'test' ELSE 'unknown' END AS split FROM nation""")
def split_infer(spark, sf_dir):
    """#46."""
    k = F.col("n_nationkey") % 6
    return table(spark, sf_dir, "nation").select("n_nationkey", L.infer_split(F.when(k == 0, "Train").when(k == 3, " training").when(k == 4, "TESTING"), F.when(k == 1, "x_te").when(k == 2, "y_train").otherwise("z")).alias("split"))


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'BK00' WHEN 1 THEN 'BK05' WHEN 2 THEN 'FL00' WHEN 3 THEN 'FL05' WHEN 4 THEN 'QJ00' ELSE 'zz' END AS label FROM part)
 SELECT label, (label LIKE 'BK%')::INT AS binary_label, CASE WHEN label LIKE '%00' THEN '00' WHEN label LIKE '%05' THEN '05' ELSE 'unknown' END AS flow_condition, CASE WHEN left(label, 2) IN ('BK', 'FL', 'QJ') THEN left(label, 2) ELSE 'OTHER' END AS family, count(*) AS n FROM l GROUP BY ALL""")
def label_maps(spark, sf_dir):
    """#47."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("BK00", "BK05", "FL00", "FL05", "QJ00", "zz")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    t = table(spark, sf_dir, "part").select(label.alias("label"))
    return t.groupBy("label", L.binary_label(F.col("label")).alias("binary_label"), L.flow_condition(F.col("label")).alias("flow_condition"), L.signal_family(F.col("label")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS stem, 'W' || (page_id % 5) || '::' || CASE WHEN page_id % 5 < 3 THEN regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') ELSE page_id::VARCHAR END AS group_id FROM pages""")
def event_group_ids(spark, sf_dir):
    """#48: rows of some labels are grouped by their source, those of others stand alone."""
    stem = L.source_stem(F.col("url"))
    k = F.col("page_id") % 5
    return table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"), F.concat(F.lit("W"), k.cast("string"), F.lit("::"), F.when(k < 3, stem).otherwise(F.col("page_id").cast("string"))).alias("group_id"))


@query("""SELECT event_id, ts AS parsed, strftime(ts, '%Y%m%dT%H%M%S.') || lpad((date_part('microsecond', ts)::BIGINT % 1000000 // 1000)::VARCHAR, 3, '0') AS text FROM events""")
def time_parse(spark, sf_dir):
    """#40, #41: three spellings of each time, and the compact text with milliseconds."""
    t = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss.SSSSSS")).when(k == 1, F.date_format("ts", "yyyyMMddHHmmss.SSSSSS")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return t.select("event_id", L.parse_time(text).cast("timestamp_ntz").alias("parsed"), L.format_time(F.col("ts")).alias("text"))


@query("""SELECT event_id, round(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 6) AS offset_s, ts + to_microseconds((value * 1000)::BIGINT * 1000) AS shifted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def arrival_offsets(spark, sf_dir):
    """#42, #43: seconds since the user's last event, and a time moved by value seconds."""
    from pyspark.sql import Window as W

    t = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    # cast to a whole number of milliseconds rounds half to even in the SQL below, so here too
    return t.select("event_id", F.round(L.seconds_between(before, F.col("ts")), 6).alias("offset_s"), L.add_seconds(F.col("ts"), F.rint(F.col("value") * 1000) / 1000).cast("timestamp_ntz").alias("shifted"))


@query("""SELECT o_orderkey, (o_orderkey % 5 = 0)::INT + (o_orderkey % 7 = 0)::INT + (o_orderkey % 11 = 0)::INT AS issue_count, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'npts_mismatch' END, CASE WHEN o_orderkey % 11 = 0 THEN 'arrival_outside' END, CASE WHEN o_orderkey % 7 = 0 THEN 'label_mismatch' END], lambda x: x IS NOT NULL), ';') AS issues FROM orders""")
def header_audit(spark, sf_dir):
    """#56 on headers derived from orders, with faults at known places."""
    k = F.col("o_orderkey")
    h = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(20000).alias("npts"), F.lit(20000 - 0).alias("comm_count"), F.lit(20000).alias("rows0"), F.lit(1e6).alias("rate"), F.lit(0.02).alias("duration"),
        F.when(k % 11 == 0, 0.5).otherwise(0.01).alias("arrival_offset"), F.lit("BK00").alias("label"), F.when(k % 7 == 0, "FL00").otherwise("BK00").alias("folder_label"),
    ).withColumn("npts", F.when(k % 5 == 0, 20001).otherwise(20000)).withColumnRenamed("rows0", "rows").withColumn("duration", F.col("npts") / F.col("rate"))
    return G.audit_headers(h).select("o_orderkey", "issue_count", F.array_join("issues", ";").alias("issues"))


@query("""WITH t AS (SELECT n_name, 'QJ_' || (n_nationkey % 20) || '.npz' AS name FROM nation), r AS (SELECT n_name, replace(name, 'QJ_', 'QJ00_') AS target FROM t) SELECT n_name, target, count(*) OVER (PARTITION BY target) > 1 AS conflict FROM r""")
def header_rename_plan(spark, sf_dir):
    """#38."""
    t = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("QJ_"), (F.col("n_nationkey") % 20).cast("string"), F.lit(".npz")).alias("name"))
    return G.rename_plan(t, "name", "QJ_", "QJ00_").select("n_name", "target", "conflict")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || '|42'), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
 SELECT c_custkey, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.7, 0))) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_stratified(spark, sf_dir):
    """#109."""
    return SP.stratified_split(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.7).select("c_custkey", "split")


@query("""WITH g AS (SELECT l_orderkey, min(l_linestatus) AS label FROM lineitem GROUP BY l_orderkey),
 r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY label ORDER BY md5(l_orderkey::VARCHAR || '|42'), l_orderkey) AS k, count(*) OVER (PARTITION BY label) AS n FROM g),
 s AS (SELECT l_orderkey, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.6, 0))) THEN 'train' ELSE 'test' END AS split FROM r)
 SELECT split, count(*) AS n, count(DISTINCT l_orderkey) AS n_groups, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN s USING (l_orderkey) GROUP BY split""")
def split_grouped(spark, sf_dir):
    """#111: order is the leakage group."""
    t = SP.group_split(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_orderkey", 0.6)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("n_groups"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH t AS (SELECT event_id, (user_id % 3 + 1) * 500000 AS rate, (row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1) // 50 AS block FROM events),
 g AS (SELECT *, 'flow_sr' || (rate // 1000) || '_g' || CASE WHEN block < 1000 THEN lpad(block::VARCHAR, 3, '0') ELSE block::VARCHAR END AS group_id FROM t),
 r AS (SELECT group_id, row_number() OVER (PARTITION BY rate ORDER BY md5(group_id || '|42'), group_id) AS k, count(*) OVER (PARTITION BY rate) AS n FROM (SELECT DISTINCT rate, group_id FROM g)),
 s AS (SELECT group_id, CASE WHEN n > 1 AND k <= greatest(1, least(n - 1, round_even(n * 0.5, 0))) THEN 'train' ELSE 'test' END AS split FROM r)
 SELECT event_id, group_id, split FROM g JOIN s USING (group_id)""")
def split_time_blocks(spark, sf_dir):
    """#110: blocks of fifty events in time order at each rate."""
    t = table(spark, sf_dir, "events").withColumn("rate", ((F.col("user_id") % 3 + 1) * 500000).cast("double"))
    return SP.time_block_split(t, "rate", ["ts", "event_id"], 50, 0.5).select("event_id", "group_id", "split")


@query("""SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || '|42'), c_custkey) <= 40""")
def class_cap(spark, sf_dir):
    """#113."""
    return SP.class_cap(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 40).select("c_mktsegment", "c_custkey")


@query("""WITH t AS (SELECT doc_id, toxic AS label FROM labels), n AS (SELECT least(round_even(sum(label) * 2.0, 0), 500) AS m FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS k FROM t) SELECT doc_id, label FROM r, n WHERE label = 1 OR k <= m""")
def balanced_subset(spark, sf_dir):
    """#114."""
    t = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return SP.balanced_subset(t, "label", "doc_id", 2.0, 500)


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE k <= greatest(1, ceil(n * 0.05))""")
def sample_per_root(spark, sf_dir):
    """#22, #23."""
    return SP.sample_per_root(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 0.05, up=True).select("o_orderkey", "o_orderpriority")


@query("""WITH g AS (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey::VARCHAR || '|42'), l_orderkey) - n AS before FROM g)
 SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_groups, count(*) AS n_rows FROM lineitem JOIN p USING (l_returnflag, l_orderkey) WHERE before < 500 GROUP BY l_returnflag""")
def group_bootstrap_draw(spark, sf_dir):
    """#115."""
    t = SP.group_draw(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", 500)
    return t.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_events, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY l_returnflag""")
def dataset_summary(spark, sf_dir):
    """#124."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l_orderkey").alias("n_events"), F.countDistinct("l_suppkey").alias("n_groups"))


@query(f"""WITH l AS (SELECT feature, value FROM {LONG}), q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY feature)
 SELECT l.feature, round(avg((value IS NULL)::INT), 6) AS missing_rate, count(DISTINCT value) AS n_unique, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(any_value(q2), 4) AS median, round(any_value(q3 - q1), 4) AS iqr, min(value) AS min, max(value) AS max,
 round(avg((value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1))::INT), 6) AS outlier_rate FROM l JOIN q USING (feature) GROUP BY l.feature""")
def feature_quality(spark, sf_dir):
    """#125, #126."""
    t = Q.feature_quality(long_lineitem(spark, sf_dir).select("feature", "value"))
    digits = {"missing_rate": 6, "mean": 4, "std": 4, "median": 4, "iqr": 4, "outlier_rate": 6}
    return t.select("feature", "n_unique", "min", "max", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"""WITH l AS (SELECT feature, CASE WHEN l_orderkey % 97 = 0 AND feature = 'l_tax' THEN NULL ELSE value END AS value, l_orderkey % 89 = 0 AND feature = 'l_discount' AS inf FROM {LONG})
 SELECT feature, count(value) FILTER (WHERE NOT inf) AS count, min(value) FILTER (WHERE NOT inf) AS min, max(value) FILTER (WHERE NOT inf) AS max, round(avg(value) FILTER (WHERE NOT inf), 4) AS mean, round(stddev_samp(value) FILTER (WHERE NOT inf), 4) AS std, round(log10(max(abs(value)) FILTER (WHERE NOT inf) + 1e-12), 6) AS log10_max_abs,
 max((value IS NULL)::INT) AS has_nan, max(inf::INT) AS has_inf FROM l GROUP BY feature""")
def feature_validate(spark, sf_dir):
    """#123, with missing and infinite values put in."""
    t = long_lineitem(spark, sf_dir)
    v = F.when((F.col("l_orderkey") % 97 == 0) & (F.col("feature") == "l_tax"), float("nan")).when((F.col("l_orderkey") % 89 == 0) & (F.col("feature") == "l_discount"), float("inf")).otherwise(F.col("value"))
    out = Q.validate_features(t.select("feature", v.alias("value")))
    return out.select("feature", "count", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("log10_max_abs", 6).alias("log10_max_abs"), "has_nan", "has_inf")


@query("""WITH m AS (SELECT median(c_acctbal) FILTER (WHERE c_custkey % 10 <> 0) AS m FROM customer) SELECT c_custkey, round(CASE WHEN c_custkey % 10 = 0 THEN m ELSE c_acctbal END, 4) AS c_acctbal FROM customer, m""")
def median_impute(spark, sf_dir):
    """#53."""
    t = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).otherwise(float("nan")).alias("c_acctbal"))
    return Q.median_impute(t, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query(f"""SELECT feature, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, max(value) AS max FROM {LONG} GROUP BY feature""")
def describe_percentiles(spark, sf_dir):
    """#181."""
    t = Q.describe(long_lineitem(spark, sf_dir))
    return t.select("feature", "count", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p25", "p50", "p75", "p90")])


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def histogram(spark, sf_dir):
    """#182."""
    return Q.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)


@query(f"SELECT feature, round(stddev_samp(value), 4) AS std FROM {LONG} GROUP BY feature ORDER BY stddev_samp(value) DESC LIMIT 2")
def top_deviation(spark, sf_dir):
    """#177: a top-k report."""
    return Q.top_by_deviation(long_lineitem(spark, sf_dir), 2).select("feature", F.round("std", 4).alias("std"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS total, count(*) FILTER (WHERE l_linenumber = 1) AS "1", count(*) FILTER (WHERE l_linenumber = 2) AS "2", count(*) FILTER (WHERE l_linenumber = 3) AS "3" FROM lineitem GROUP BY ALL""")
def label_crosstab(spark, sf_dir):
    """#120, #178."""
    return Q.crosstab(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", [1, 2, 3])


@query("""SELECT o_orderstatus, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 4) AS low FROM orders GROUP BY o_orderstatus""")
def metric_pivot(spark, sf_dir):
    """#179."""
    t = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.avg("o_totalprice"))
    return t.select("o_orderstatus", F.round("1-URGENT", 4).alias("urgent"), F.round("5-LOW", 4).alias("low"))


@query("SELECT o_orderkey AS path FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 4)")
def resume_antijoin(spark, sf_dir):
    """#24."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return G.unprocessed(files, table(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("path")))


@query("""WITH e AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n_expected FROM orders),
 t AS (SELECT l_orderkey AS file, count(DISTINCT l_linenumber) AS n, count(*) AS r, sum((l_orderkey % 17 = 0)::INT) AS miss, sum((l_orderkey % 19 = 0)::INT) AS bad FROM lineitem GROUP BY 1)
 SELECT file, coalesce(n, 0) AS n_windows, n_expected, array_to_string(list_filter([CASE WHEN coalesce(n, 0) <> n_expected THEN 'window_ids' END, CASE WHEN coalesce(r, 0) <> coalesce(n, 0) THEN 'duplicate_windows' END, CASE WHEN miss > 0 THEN 'missing_features:b__rms' END, CASE WHEN bad > 0 THEN 'invalid_values:b__crest' END], lambda x: x IS NOT NULL), ';') AS errors FROM e LEFT JOIN t USING (file)""")
def completion_gate(spark, sf_dir):
    """#26: orders stand for files and lines for their windows, with faults at known places."""
    l = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    rows = l.select(k.alias("file"), F.col("l_linenumber").alias("window_id"), F.when(k % 17 != 0, F.col("l_quantity").cast("double")).alias("b__rms"), F.when(k % 19 == 0, float("inf")).otherwise(F.col("l_tax").cast("double")).alias("b__crest"), F.lit(float("nan")).alias("b__T_half_high"))
    counts = l.groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"))
    expected = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 13 == 0, 9).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_expected"))
    return G.completion_gate(rows, expected, ["b__rms", "b__crest", "b__T_half_high"]).select("file", "n_windows", "n_expected", F.array_join("errors", ";").alias("errors"))


@query("""SELECT c_mktsegment AS dataset, n_name AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY ALL""")
def build_report(spark, sf_dir):
    """#33, #120: counts by data set and split over joined manifests."""
    region = table(spark, sf_dir, "region")
    first = region.agg(F.min("r_name")).first()[0]
    n = table(spark, sf_dir, "nation").join(region.where(F.col("r_name") == first), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("n_name").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, 'b_' || l_returnflag || '__feat' || l_linenumber AS name FROM lineitem) SELECT split_part(name, '__', 1) AS band, split_part(name, '__', 2) AS feature, count(*) AS n FROM n GROUP BY ALL""")
def feature_name_split(spark, sf_dir):
    """#50."""
    name = F.concat(F.lit("b_"), F.col("l_returnflag"), F.lit("__feat"), F.col("l_linenumber").cast("string"))
    band, feature = L.split_feature(F.col("name"))
    return table(spark, sf_dir, "lineitem").select(name.alias("name")).groupBy(band.alias("band"), feature.alias("feature")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT p_partkey, 'dev-' || (p_size * 64) || 'pt-' || (p_size * 1000) || 'Hz-a.bin' AS a, 'x-FIP-' || (p_size * 10) || 'K-20260101T000000.0.npz' AS b, 'run_' || p_size || 'MHz.tdms' AS c FROM part) SELECT p_partkey, (regexp_extract(a, '-(\\d+)pt-', 1))::INT AS points, regexp_extract(a, '-(\\d+)Hz-', 1)::DOUBLE AS rate_a, regexp_extract(b, '-FIP-(\\d+)K-', 1)::DOUBLE * 1000 AS rate_b, regexp_extract(c, '(\\d+)MHz', 1)::DOUBLE * 1000000 AS rate_c FROM f""".replace("\\\\", "\\"))
def filename_metadata(spark, sf_dir):
    """#12."""
    s = F.col("p_size")
    a = F.concat(F.lit("dev-"), (s * 64).cast("string"), F.lit("pt-"), (s * 1000).cast("string"), F.lit("Hz-a.bin"))
    b = F.concat(F.lit("x-FIP-"), (s * 10).cast("string"), F.lit("K-20260101T000000.0.npz"))
    c = F.concat(F.lit("run_"), s.cast("string"), F.lit("MHz.tdms"))
    return table(spark, sf_dir, "part").select("p_partkey", L.points_per_frame(a).alias("points"), L.rate_from_name(a).alias("rate_a"), L.rate_from_name(b).alias("rate_b"), L.rate_from_name(c).alias("rate_c"))


@query("""SELECT user_id, upper(coalesce(props ->> '$.k', '')) AS k, count(*) AS n FROM events GROUP BY ALL""")
def property_lookup(spark, sf_dir):
    """#13, #14: a property by name whatever its case, from JSON text."""
    m = F.from_json("props", "map<string,string>")
    t = table(spark, sf_dir, "events").select("user_id", F.upper(F.coalesce(L.first_property(m, "K"), F.lit(""))).alias("k"))
    return t.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT spec, noise, event, round(w1, 2) AS w1 FROM (SELECT k AS spec, 1 + ('0x' || left(md5(k || '|n|42'), 7))::BIGINT % (SELECT count(*) FROM customer) AS noise, 1 + ('0x' || left(md5(k || '|e|42'), 7))::BIGINT % (SELECT count(*) FROM supplier) AS event, 0.5 + (('0x' || left(md5(k || '|w|42'), 7))::BIGINT % 101) / 100.0 AS w1 FROM (SELECT unnest(range(0, 200)) AS k))""")
def mixture_specs(spark, sf_dir):
    """#118: draws of noise, event and weight for each mixed sample."""
    from ..operators.mixtures import draw_specs

    return draw_specs(spark, 200, table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "supplier").count()).select("spec", "noise", "event", "w1")


@query("""WITH r AS (SELECT p_brand, p_type, rank() OVER (PARTITION BY p_brand ORDER BY max(p_retailprice) DESC) AS rk FROM part GROUP BY p_brand, p_type), a AS (SELECT p_type, rk FROM r WHERE p_brand = (SELECT min(p_brand) FROM part) AND rk <= 30), b AS (SELECT p_type, rk FROM r WHERE p_brand = (SELECT max(p_brand) FROM part) AND rk <= 30),
 j AS (SELECT coalesce(a.p_type, b.p_type) AS feature, a.rk AS rank_a, b.rk AS rank_b FROM a FULL JOIN b ON a.p_type = b.p_type)
 SELECT feature, rank_a, rank_b, (rank_a IS NOT NULL)::INT + (rank_b IS NOT NULL)::INT AS appearances, round((coalesce(rank_a, 0) + coalesce(rank_b, 0)) / ((rank_a IS NOT NULL)::INT + (rank_b IS NOT NULL)::INT), 4) AS mean_rank FROM j""")
def rank_matrix(spark, sf_dir):
    """#180: full outer join of rank lists."""
    from pyspark.sql import Window as W

    p = table(spark, sf_dir, "part")
    lo, hi = p.agg(F.min("p_brand"), F.max("p_brand")).first()
    best = p.groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("v"))
    r = best.withColumn("rk", F.rank().over(W.partitionBy("p_brand").orderBy(F.desc("v")))).where("rk <= 30")
    from ..operators.selection import rank_matrix as matrix

    return matrix({"a": r.where(F.col("p_brand") == lo).select(F.col("p_type").alias("feature"), "rk"), "b": r.where(F.col("p_brand") == hi).select(F.col("p_type").alias("feature"), "rk")}).select("feature", F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b"), "appearances", F.round("mean_rank", 4).alias("mean_rank"))
