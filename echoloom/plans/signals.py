"""Queries of the Arrow kernels, models and streams; embeddings stand for short records, events for recordings."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import features_engine as E
from ..kernels import features as K
from ..kernels import filters, spectra
from ..ml import many as MY
from ..ml import models as ML
from ..ml import nearest as NR
from ..ml import subset as SB
from ..operators import localize as LO
from ..operators import mixtures as MX
from ..operators import records as R
from ..operators import selection as SL
from ..operators import splits as SP
from ..session import new_path, shared_dir, spread
from ..sources import decode as DC
from ..sources import files as SF
from ..sources import ranges as RG
from ..sources import records as RC
from ..streaming import stateful as SW
from ..streaming import windows as ST
from .stats import FEATURES
from .tables import table
from .wave import _waves

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Nominal rate of the stand-in waveforms.
RATE = 64_000.0
BANDS = {"b_full": (100.0, 30_000.0), "b_low": (1_000.0, 10_000.0)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per vector: its values eight times over with a decay, 512 samples. The vectors are dealt to all tasks before."""
    x = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform("x", lambda v: v * F.exp(-0.3 * k))))
    return spread(_waves(spark, sf_dir)).select("vec_id", "label", x.alias("signal"), F.lit(RATE).alias("rate"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per label: the label's vectors end to end. Groups are bounded by the recording's own length."""
    w = _waves(spark, sf_dir).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("xs"))
    return w.select(F.col("label").cast("string").alias("path"), F.flatten(F.transform("xs", lambda v: v["x"])).alias("signal"))


@query()
def window_feature_rows(spark, sf_dir):
    """#93, #103-#108, F1-F43: sliding windows of every recording, all families in the widest band."""
    return E.recording_features(recordings(spark, sf_dir), BANDS, RATE, 0.008, 0.5, chunks=4)


@query()
def record_feature_rows(spark, sf_dir):
    """F18-F43 of single records."""
    plans = K.plan_bands(BANDS, RATE, {"b_full": ("classic", "time", "spectral", "entropy", "background")})
    return E.record_features(tiled(spark, sf_dir), plans, "vec_id", "signal", "rate")


@query()
def event_feature_rows(spark, sf_dir):
    """#96, #97, #107: windows about the onset of each record."""
    t = tiled(spark, sf_dir).withColumn("arrival", F.array_position(F.transform("signal", F.abs), F.array_max(F.transform("signal", F.abs))) - 1)
    plans = K.plan_bands({"b_full": (100.0, 30_000.0)}, RATE, {"b_full": ("classic", "time", "background")})
    return E.event_features(t, plans, {"0_4": (0.0, 4.0), "-2_4": (-2.0, 4.0)}, "vec_id", "signal", "rate", "arrival")


@query()
def wavelet_energies(spark, sf_dir):
    """#86: shares of the packet nodes at level three."""

    def run(frames):
        for f in frames:
            rows = []
            for k, x in zip(f["vec_id"], f["signal"], strict=True):
                e = [(p, float(v @ v)) for p, v in spectra.wavelet_packet(np.asarray(x), 3)]
                total = sum(v for _, v in e)
                rows += [(k, i, p, v / total) for i, (p, v) in enumerate(e)]
            yield pd.DataFrame(rows, columns=["vec_id", "node", "path", "share"])

    return tiled(spark, sf_dir).select("vec_id", "signal").mapInPandas(run, "vec_id long, node int, path string, share double")


@query()
def ridge_features(spark, sf_dir):
    """#73-#76: ridge and harmonic row of each record."""
    return R.ridge_features(tiled(spark, sf_dir), "vec_id", "signal", "rate", band=(500.0, 30_000.0), search=(1_000.0, 12_000.0), window_ms=1.0, jump_hz=1_000.0)


@query()
def event_method_curves(spark, sf_dir):
    """#81-#85, #122, #183: spectra of events on a common grid, summarised by method."""
    grid = np.linspace(0, RATE / 2, 64).tolist()
    t = tiled(spark, sf_dir).select("vec_id", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("method"), "signal", "rate", F.lit(0).alias("arrival"))
    return R.curve_summary(R.event_table(t, "vec_id", "method", "signal", "rate", "arrival", grid), "method", "psd", grid)


def _array_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pulse of each supplier's shape that travels past eleven channels: window, frame, channels. The true source is at 4."""
    v, n, rate = 1500.0, 11, 4000.0
    delays = [(float(np.hypot(x - 4.0, 3.0)) - 3.0) / v for x in range(n)]
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("window"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("frame"), ((F.col("s_suppkey") % 13) / 20 + 0.5).alias("a"))

    def sample(d: float):
        u = (F.col("frame") / rate - 0.02 - d) * 600.0
        noise = (F.pmod(F.xxhash64("window", "frame", F.lit(d)), F.lit(1000)) / 1000.0 - 0.5) * 0.02
        return F.col("a") * (1 - 2 * u * u) * F.exp(-u * u) + noise

    return t.select("window", "frame", F.array(*[sample(d) for d in delays]).alias("channels"))


@query()
def gcc_phat_locations(spark, sf_dir):
    """#169-#174: delays by phase transform, hyperbola by consensus, status."""
    c = LO.LocateConfig(spacing=1.0, velocity=1500.0, max_tau=0.02, least_psr=3.0, z_bounds=(0.5, 20.0))
    return LO.locate_windows(_array_frames(spark, sf_dir), "window", "frame", "channels", 4000.0, c)


@query()
def location_sweep(spark, sf_dir):
    """#175: methods and losses over the same windows."""
    base = dict(max_tau=0.02, least_psr=3.0, z_bounds=(0.5, 20.0), use_ransac=False)
    configs = {"ncc": LO.LocateConfig(method="ncc", **base), "huber": LO.LocateConfig(loss="huber", **base), "parabola": LO.LocateConfig(model="parabola", **base)}
    return LO.sweep(_array_frames(spark, sf_dir), "window", "frame", "channels", 4000.0, configs).select("config", "window", "source_x", "rmse_tdoa", "status")


_GRID_SQL = """WITH p AS (SELECT s_suppkey AS k, c AS x, (sqrt(power(c - (2 + s_suppkey % 7), 2) + 9) - sqrt(power(0 - (2 + s_suppkey % 7), 2) + 9)) / 1500 AS t FROM supplier, (SELECT unnest(range(0, 11)) AS c)),
 g AS (SELECT a AS xs, b AS z FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(1, 7)) AS b)),
 e AS (SELECT k, xs, z, avg(power((sqrt(power(x - xs, 2) + z * z) - sqrt(power(0 - xs, 2) + z * z)) / 1500 - t, 2)) AS e FROM p, g GROUP BY ALL)
 SELECT k, xs::DOUBLE AS xs, z::DOUBLE AS z, round(sqrt(e), 8) AS rmse FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY e, xs, z) = 1"""


@query(_GRID_SQL)
def coarse_grid_fit(spark, sf_dir):
    """#172: best grid source of each event, as expressions."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("x"))
    xs = 2 + F.col("k") % 7
    t = (F.sqrt(F.pow(F.col("x") - xs, 2) + 9) - F.sqrt(F.pow(0 - xs, 2) + 9)) / 1500
    return LO.grid_errors(s, "k", F.col("x"), t, F.lit(0.0), 1500.0, [float(a) for a in range(11)], [float(b) for b in range(1, 7)]).withColumn("rmse", F.round("rmse", 8))


@query()
def mixture_build(spark, sf_dir):
    """#88, #118, #119: seeded mixtures of vectors of even labels (noise) and odd ones (events), with a manifest."""
    w = _waves(spark, sf_dir)
    noise = MX.numbered(w.where(F.col("label") % 2 == 0).select("vec_id", F.col("x").alias("signal")), "vec_id")
    event = MX.numbered(w.where(F.col("label") % 2 == 1).select("vec_id", F.col("x").alias("signal")), "vec_id")
    specs = MX.draw_specs(spark, 300, noise.count(), event.count(), [0.0, 0.5, 1.0])
    mixed = MX.mix_samples(specs, noise, event)
    return MX.manifest(mixed, "mix", "train").join(mixed.select(F.format_string("%s_%05d_%s.npz", F.lit("mix"), "spec", "suffix").alias("source_file_name"), F.round("rms", 6).alias("rms")), "source_file_name")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table for models: line numbers with a class that depends on two of them."""
    l = table(spark, sf_dir, "lineitem")
    y = (F.col("l_quantity") / 50 + 6 * F.col("l_discount") + F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(100)) / 250.0 > 0.95).cast("int")
    return l.select("l_orderkey", "l_linestatus", *[F.col(c).cast("double").alias(c) for c in FEATURES], y.alias("label"))


@query()
def model_search(spark, sf_dir):
    """#156, #158: two candidates under grouped cross validation."""
    pool = [c for c in ML.candidates(len(FEATURES), 10) if c.name in ("lr_c1", "rf")]
    rows, _ = ML.search(_labelled(spark, sf_dir), FEATURES, "l_orderkey", 2, pool)
    return spark.createDataFrame(pd.DataFrame(rows))


@query()
def rfecv(spark, sf_dir):
    """#157."""
    rows = ML.eliminate(_labelled(spark, sf_dir), FEATURES, "l_orderkey", 2, 2)
    return spark.createDataFrame([(r["n"], ";".join(r["features"]), r["f1"], r["dropped"]) for r in rows], "n int, features string, f1 double, dropped string")


@query()
def classification_tests(spark, sf_dir):
    """#164: comparisons of classes made of line status and label, by a fixed order of features."""
    t = _labelled(spark, sf_dir).withColumns({"cls": F.concat("l_linestatus", F.col("label").cast("string")), "k": F.xxhash64("l_orderkey", *FEATURES)}).drop("label")
    tests = {"F1_vs_F0": (("F1",), ("F0",)), "1_vs_0": (("F1", "O1"), ("F0", "O0"))}
    order = dict.fromkeys(tests, ["l_quantity", "l_discount", "l_tax"])
    return ML.classification_tests(t, tests, order, "cls", "l_orderkey", "k", (3,))[0]


@query()
def cross_condition(spark, sf_dir):
    """#156-#159: every set of training domains (return flags) with three numbers of leading features, elimination, the grid of
    logistic and kernel machines, thresholds, and the test rows of every domain."""
    l = table(spark, sf_dir, "lineitem")
    y = (F.col("l_quantity") / 50 + 6 * F.col("l_discount") + F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(100)) / 250.0 > 0.95).cast("int")
    price, part = F.col("l_extendedprice"), F.col("l_discount")
    made = {"net": price * (1 - part), "unit": price / F.col("l_quantity"), "day": F.dayofweek("l_shipdate").cast("double"), "rest": F.pmod("l_partkey", F.lit(97)).cast("double")}
    t = SP.fold_split(l.select("l_orderkey", "l_returnflag", *[F.col(c).cast("double").alias(c) for c in FEATURES], *[e.alias(n) for n, e in made.items()], y.alias("label")), "l_orderkey", 0.7)
    features = [*FEATURES, *made]
    sets = ML.experiments(sorted(r[0] for r in t.select("l_returnflag").distinct().collect()))  # a row per domain
    train = t.where("split = 'train'")
    orders = SL.stage_orders(train, features, "label", "l_returnflag", {"+".join(s): list(s) for s in sets})
    return MY.cross_condition(t, features, "l_returnflag", "l_orderkey", {s: orders["+".join(s)] for s in sets if orders["+".join(s)]}, top=(4, 6, 8), folds=3, least=3, points=48)


@query()
def l1_stability(spark, sf_dir):
    """#161: selection frequencies and weights of L1 logistic regression over seeded halves along a path of penalties, ranked by mean
    less deviation at the loosest."""
    t = _labelled(spark, sf_dir).withColumn("noise", F.pmod(F.xxhash64("l_orderkey", F.lit(5)), F.lit(1000)) / 1000.0)
    found = MY.stability_selection(t, [*FEATURES, "noise"], "l_orderkey")
    # a row per feature and penalty
    order = W.partitionBy("C").orderBy(F.desc(F.col("mean") - F.col("std")), "feature")
    return found.withColumn("rank", F.row_number().over(order)).select("feature", "C", "frequency", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "rank")


@query()
def importance_rankings(spark, sf_dir):
    """#160."""
    return ML.importance(_labelled(spark, sf_dir), FEATURES, 20, 3)


@query()
def multi_model_metrics(spark, sf_dir):
    """#168: metrics of three models at their own thresholds, with the area under the precision-recall curve."""
    pool = [c for c in ML.candidates(len(FEATURES), 10) if c.name in ("lr_c1", "svm_linear", "rf")]
    return ML.multi_model(_labelled(spark, sf_dir), FEATURES, "l_orderkey", 2, pool)["metrics"]


@query()
def pca2(spark, sf_dir):
    """#165."""
    t = ML.project(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), (F.col("c_nationkey") * 1.0).alias("b"), (F.col("c_acctbal") * 0.5 + F.col("c_custkey") % 10).alias("c")), ["a", "b", "c"])
    return t.select("c_custkey", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


@query("""WITH t AS (SELECT c_custkey, c_mktsegment AS y, c_acctbal / 1000.0 AS a, c_nationkey / 5.0 AS b, (c_custkey % 11) / 3.0 AS c FROM customer)
 SELECT t.c_custkey, round(min(sqrt((t.a - o.a) ** 2 + (t.b - o.b) ** 2 + (t.c - o.c) ** 2)) FILTER (WHERE t.y = o.y), 6) AS hit, round(min(sqrt((t.a - o.a) ** 2 + (t.b - o.b) ** 2 + (t.c - o.c) ** 2)) FILTER (WHERE t.y <> o.y), 6) AS miss
 FROM t JOIN t o ON t.c_custkey <> o.c_custkey GROUP BY t.c_custkey""")
def nearest_customers(spark, sf_dir):
    """#163: exact nearest row of the same and of another segment, for every customer."""
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000.0).alias("a"), (F.col("c_nationkey") / 5.0).alias("b"), ((F.col("c_custkey") % 11) / 3.0).alias("c"))
    found = NR.nearest_rows(t, ["a", "b", "c"], "c_mktsegment", cell_points=200)
    points = t.withColumn("x", F.array("a", "b", "c")).select("c_custkey", "c_mktsegment", "x")
    return points.join(found, ["c_mktsegment", "x"]).select("c_custkey", F.round("hit", 6).alias("hit"), F.round("miss", 6).alias("miss"))


@query()
def feature_relevance(spark, sf_dir):
    """#163: nearest hit and miss relevance of all rows."""
    return NR.relevance(_labelled(spark, sf_dir), FEATURES, "label").withColumn("relief", F.round("relief", 6))


@query()
def subset_search(spark, sf_dir):
    """#162, #163: prefixes scored by a discriminant and forward search over all rows, nearest hit/miss relevance on 4000."""
    rows = _labelled(spark, sf_dir)
    sample = SP.class_cap(rows.withColumn("k", F.xxhash64(*FEATURES, "l_orderkey")), "label", "k", 2000).toPandas()  # at most 4000 rows
    relevance = SB.relief(sample[FEATURES].to_numpy(float), sample["label"].to_numpy(int))
    ready = SB.prepared(rows, "label", FEATURES)
    more = [(f"relief_{f}", [f], float(r), 0.0) for f, r in zip(FEATURES, relevance, strict=True)]
    more += [(f"sfs_{i + 1}", [f], float(a), 0.0) for i, (f, a) in enumerate(SB.forward_search(spark, ready, "label", FEATURES, 3))]
    prefixes = SB.evaluate_subsets(ready, "label", FEATURES, [(f"top{k}", FEATURES[:k]) for k in range(1, len(FEATURES) + 1)])
    return prefixes.union(spark.createDataFrame(more, "name string, features array<string>, auc double, separation double"))


@query("SELECT s_suppkey, 'rec-FIP-64K-' || s_suppkey || '.npz' AS file_name, 16::BIGINT AS npts, 64000.0::DOUBLE AS sample_rate, 'BK00' AS type, round(120 * 0.5 + 16 * (s_suppkey % 7), 6)::DOUBLE AS total, 0::BIGINT AS n_failed FROM supplier")
def npz_round_trip(spark, sf_dir):
    """#1, #4, #6, #10, #17, #27, #28: records written as containers to the shared folder, found and decoded again."""
    k = F.col("s_suppkey")
    wave = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * 0.5 + k % 7)
    t = table(spark, sf_dir, "supplier").select(F.concat(F.lit("rec-FIP-64K-"), k.cast("string"), F.lit(".npz")).alias("file_name"), wave.alias("signal"), F.lit(RATE).alias("sample_rate"), F.lit("20260101T000000.000").alias("starttime"), F.lit("BK00").alias("type"))
    folder = new_path(spark, "npz")
    DC.write_npz(t, f"{folder}/BK00").count()
    found = DC.decode(SF.with_names(SF.discover(spark, folder))).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    total = F.round(F.aggregate("signal", F.lit(0.0), lambda s, x: s + x), 6)
    return found.select(
        F.regexp_extract("file_name", r"-(\d+)\.npz$", 1).cast(dict(table(spark, sf_dir, "supplier").dtypes)["s_suppkey"]).alias("s_suppkey"), "file_name", F.size("signal").cast("long").alias("npts"),
        "sample_rate", "type", total.alias("total"), (F.col("status") == "failed").cast("long").alias("n_failed"),
    )


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier WHERE s_suppkey % 4 < 3)
 SELECT s_suppkey, CASE k WHEN 2 THEN 'F130' ELSE 'BK14' END AS dataset, CASE k WHEN 0 THEN 'corrosion' WHEN 1 THEN 'cut' END AS method, CASE WHEN k < 2 AND s_suppkey % 3 > 0 THEN 'labeled' ELSE 'estimated' END AS arrival_source,
 CASE WHEN k < 2 AND s_suppkey % 3 > 0 THEN least(15, s_suppkey % 20)::BIGINT END AS arrival_index FROM s""")
def dataset_routing(spark, sf_dir):
    """#15, #16, #5: containers in the folders of two methods, of a flow set and of none, read by dataset; labelled arrivals to the
    nearest sample within the signal (estimated ones are in wave_arrivals)."""
    k, folder = F.col("s_suppkey"), new_path(spark, "datasets")
    wave = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(i * 0.7 + k % 7))
    place = F.element_at(F.array(*map(F.lit, (f"{RC.EVENT_FOLDER}/corrosion", f"{RC.EVENT_FOLDER}/cut", "F130", "elsewhere"))), (k % 4 + 1).cast("int"))
    stamp = F.concat(F.lit("20260101000000."), F.lpad((k % 20 * 50).cast("string"), 6, "0"))
    t = table(spark, sf_dir, "supplier").select(place.alias("place"), F.concat(F.lit("rec-"), k.cast("string"), F.lit(".npz")).alias("file_name"), wave.alias("signal"), F.lit(20_000.0).alias("sample_rate"), F.lit("20260101T000000.000").alias("starttime"), F.when(k % 3 > 0, stamp).otherwise("None").alias("arrival_time"))
    for p in (f"{RC.EVENT_FOLDER}/corrosion", f"{RC.EVENT_FOLDER}/cut", "F130", "elsewhere"):
        DC.write_npz(t.where(F.col("place") == p).drop("place"), f"{folder}/{p.replace(' ', '%20')}").count()
    found = RC.dataset_records(spark, folder, ["BK14", "F130"])
    shown = F.when(F.col("arrival_source") == "labeled", F.col("arrival_index"))
    return found.select(F.regexp_extract("path", r"-(\d+)\.npz$", 1).cast(dict(table(spark, sf_dir, "supplier").dtypes)["s_suppkey"]).alias("s_suppkey"), "dataset", "method", "arrival_source", shown.alias("arrival_index"))


#: Order keys of one stand-in recording, samples of one range of it, and the margins of the range queries.
BLOCK, RANGE_SAMPLES, BEFORE, AFTER = 2048, 100, 7, 9


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of neighbouring orders, at most BLOCK samples: rec, a (prices) and b (keys modulo 97) by order key."""
    t = table(spark, sf_dir, "orders").select((F.col("o_orderkey").cast("long") / BLOCK).cast("long").alias("rec"), F.struct(F.col("o_orderkey").cast("long").alias("k"), F.col("o_totalprice").cast("double").alias("p")).alias("s"))
    held = t.groupBy("rec").agg(F.array_sort(F.collect_list("s")).alias("xs"))
    return held.select("rec", F.transform("xs", lambda s: s["p"]).alias("a"), F.transform("xs", lambda s: (s["k"] % 97).cast("double")).alias("b"))


def _range_sql(channels: dict[str, str], scale: str = "1") -> str:
    """Rows of every range of every channel from the orders themselves: own samples, margins, and sums of both."""
    all_channels = " UNION ALL ".join(f"SELECT rec, i, n, {c} AS channel_index, ({e}) * {scale} AS v FROM o" for c, e in channels.items())
    return f"""WITH o AS (SELECT o_orderkey // {BLOCK} AS rec, o_orderkey AS k, o_totalprice::DOUBLE AS p, row_number() OVER (PARTITION BY o_orderkey // {BLOCK} ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderkey // {BLOCK}) AS n FROM orders),
 v AS ({all_channels}), r AS (SELECT DISTINCT rec, channel_index, n, i // {RANGE_SAMPLES} AS part FROM v)
 SELECT r.rec::BIGINT AS rec, r.channel_index::INTEGER AS channel_index, (part * {RANGE_SAMPLES})::BIGINT AS first, least(r.n, (part + 1) * {RANGE_SAMPLES})::BIGINT AS last, r.n::BIGINT AS total, least(part * {RANGE_SAMPLES}, {BEFORE})::INTEGER AS lead, count(*)::BIGINT AS samples,
 round(sum(v) FILTER (i // {RANGE_SAMPLES} = part), 2) AS own_sum, round(sum(v * (i - part * {RANGE_SAMPLES} + {BEFORE} + 1)), 2) AS weighted, 64000.0::DOUBLE AS sample_rate
 FROM r JOIN v ON v.rec = r.rec AND v.channel_index = r.channel_index AND v.i >= part * {RANGE_SAMPLES} - {BEFORE} AND v.i < (part + 1) * {RANGE_SAMPLES} + {AFTER} GROUP BY ALL"""


def _range_rows(ranges: DataFrame) -> DataFrame:
    own = F.aggregate(RG.owned(), F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.zip_with("signal", F.sequence(F.lit(1), F.size("signal")), lambda x, i: x * (i + BEFORE - F.col("lead"))), F.lit(0.0), lambda s, x: s + x)
    return ranges.select(
        F.regexp_extract("path", r"rec(\d+)[^/]*$", 1).cast("long").alias("rec"), "channel_index", "first", "last", "total", "lead", F.size("signal").cast("long").alias("samples"), F.round(own, 2).alias("own_sum"), F.round(weighted, 2).alias("weighted"), "sample_rate",
    )


@query(_range_sql({"0": "p", "1": "k % 97"}))
def npz_ranges(spark, sf_dir):
    """#4-#8, #10, #104: two-channel containers of whole recordings, every third compressed, read by ranges with margins."""

    def encode(r: dict) -> bytes:
        return DC.encode_npz(np.column_stack([r["a"], r["b"]]), RATE, compressed=r["rec"] % 3 == 0, starttime="20260101T000000.000")

    folder = new_path(spark, "npz-ranges")
    DC.write_files(_blocks(spark, sf_dir).withColumn("file_name", F.concat(F.lit("rec"), F.col("rec"), F.lit(".npz"))), folder, encode).count()
    return _range_rows(RG.read_ranges(spark, folder, range_values=2 * RANGE_SAMPLES, before=BEFORE, after=AFTER))


@query(_range_sql({"0": "round(p)", "1": "k % 97"}, "(pi() / 32767)"))
def bin_ranges(spark, sf_dir):
    """#11: frames of two points of whole numbers, read by ranges with margins and scaled to radians."""

    def encode(r: dict) -> bytes:
        return DC.encode_bin(np.column_stack([r["whole"], r["b"]]))

    folder = new_path(spark, "bin-ranges")
    t = _blocks(spark, sf_dir).withColumn("whole", F.transform("a", lambda v: F.round(v))).withColumn("file_name", F.concat(F.lit("rec"), F.col("rec"), F.lit("-2pt-64000Hz-.bin")))
    DC.write_files(t, folder, encode).count()
    return _range_rows(RG.read_ranges(spark, folder, range_values=2 * RANGE_SAMPLES, before=BEFORE, after=AFTER))


@query(_range_sql({"0": "p"}))
def tdms_ranges(spark, sf_dir):
    """#9: segmented files of two channels, every other one interleaved; the table of files is planned by tasks."""

    def encode(r: dict) -> bytes:
        return DC.encode_tdms({"noise": r["b"], "phase": r["a"]}, {"sample_rate": RATE}, segment=333, interleaved=r["rec"] % 2 == 1)

    folder = new_path(spark, "tdms-ranges")
    DC.write_files(_blocks(spark, sf_dir).withColumn("file_name", F.concat(F.lit("rec"), F.col("rec"), F.lit(".tdms"))), folder, encode).count()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tdms").load(folder)
    return _range_rows(RG.ranges_of(files, RANGE_SAMPLES, BEFORE, AFTER))


#: Records whose transforms a task holds at a time.
INVARIANT_RECORDS = 256


@query("SELECT vec_id, true AS round_trip, true AS rows_apart, true AS fast_is_scaled FROM embeddings")
def signal_invariants(spark, sf_dir):
    """#59, #70-#72 on every record: the transform and back within 1e-10, band filters that don't mix rows, and the unscaled
    fast power against its definition."""

    def run(frames):
        # the transform of a record is many times its size, so that few are held at a time
        for f in (g.iloc[k : k + INVARIANT_RECORDS] for g in frames for k in range(0, len(g), INVARIANT_RECORDS)):
            x = np.stack(f["signal"].map(np.asarray).to_list()).astype(float)
            _, _, z = spectra.stft(x, RATE, 1.0, 0.75)
            back = np.abs(spectra.istft(z, RATE, 1.0, 0.75, x.shape[1]) - x).max(axis=1)
            wide, alone = filters.band_filter(x, RATE, (1_000.0, 10_000.0)), [filters.band_filter(r, RATE, (1_000.0, 10_000.0)) for r in x]
            _, _, power = spectra.fast_power(x, RATE, 1.0, 0.75)
            size = spectra.frame_sizes(RATE, 1.0, 0.75, None)[0]
            middle = np.abs(np.fft.rfft(x[:, :size] * np.hanning(size), n=2 * (power.shape[1] - 1), axis=1)) ** 2
            hop = spectra.frame_sizes(RATE, 1.0, 0.75, None)[1]
            yield pd.DataFrame({
                "vec_id": f["vec_id"], "round_trip": back < 1e-10,
                "rows_apart": np.abs(wide - np.stack(alone)).max(axis=1) < 1e-10, "fast_is_scaled": np.isclose(power[:, :, size // 2 // hop], middle, rtol=1e-9, atol=1e-12).all(axis=1),
            })

    return tiled(spark, sf_dir).select("vec_id", "signal").mapInPandas(run, "vec_id long, round_trip boolean, rows_apart boolean, fast_is_scaled boolean")


_STREAM_SQL = """SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""


@query(_STREAM_SQL)
def stream_tumbling(spark, sf_dir):
    """Event-time windows of a file stream, all that is there; the result table equals the batch one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{shared_dir(spark)}/stream-{os.urandom(6).hex()}"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{folder}/in")
    s = ST.sliding(ST.timed(ST.read_files(spark, f"{folder}/in", schema), "ts", "1 second"), "ts", ["event_type"], "value", "1 hour")
    name = "stream_" + os.urandom(6).hex()
    ST.run_once(s, name, f"{folder}/ck", "complete")
    return spark.table(name).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query(f"""SELECT event_id, round(1 / (1 + exp(-(value - 80) / 20)), 6) AS probability, 1 / (1 + exp(-(value - 80) / 20)) >= 0.5 AS alarm FROM events""")
def stream_scoring(spark, sf_dir):
    """#167 on a stream, appended to a table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{shared_dir(spark)}/stream-{os.urandom(6).hex()}"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{folder}/in")
    s = ST.alarms(ST.read_files(spark, f"{folder}/in", schema), {"value": 1 / 20}, -4.0, 0.5).select("event_id", "probability", "alarm")
    ST.write_once(s, f"{folder}/out", f"{folder}/ck")
    return spark.read.parquet(f"{folder}/out").select("event_id", F.round("probability", 6).alias("probability"), "alarm")


_LATE_SQL = """WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS wm FROM events), e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_id, value) - 1 AS i FROM events, m WHERE (epoch_ms(ts) // 3600000 + 1) * 3600000 <= epoch_ms(wm)),
 n AS (SELECT user_id, max(i) + 1 AS n FROM e GROUP BY 1), w AS (SELECT user_id, unnest(range(0, (n - 8) // 4 + 1)) AS window_id FROM n WHERE n >= 8)
 SELECT w.user_id, w.window_id, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak FROM w JOIN e ON e.user_id = w.user_id AND e.i >= 4 * window_id AND e.i < 4 * window_id + 8 GROUP BY ALL"""


@query(_LATE_SQL)
def stream_late_windows(spark, sf_dir):
    """2.12c: windows of eight events, four apart, across the batches of a stream; weeks arrive one after the other and their
    events in no order. Rows wait for the watermark, a week behind, and hours that it hasn't passed aren't out yet."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = new_path(spark, "late-stream")
    week = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / (7 * 86_400_000))
    weeks = [r[0] for r in events.select(week.alias("week")).distinct().orderBy("week").collect()]  # a row a week
    for w in weeks:
        events.where(week == w).write.mode("append").parquet(f"{folder}/in")
    # about a week a batch, however many files it has: what is left is never before the week of the last file
    s = ST.timed(ST.read_files(spark, f"{folder}/in", events.schema, files_per_batch=max(1, events.rdd.getNumPartitions())), "ts", "7 days")
    ST.write_once(SW.late_windows(s, "user_id", "ts", "event_id", "value", 8, 4, 3600.0, 1e9), f"{folder}/out", f"{folder}/ck")
    return spark.read.parquet(f"{folder}/out").select("user_id", "window_id", *[F.round(c, 6).alias(c) for c in ("mean", "rms", "peak")])


#: Files of one batch where a stream's whole input is there at once.
MANY_FILES = 1_000_000


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
 SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """2.12d: session windows of a file stream, all that is there."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = new_path(spark, "session-stream")
    events.write.parquet(f"{folder}/in")
    ST.end_row(events, "ts", "1 DAY").write.mode("append").parquet(f"{folder}/in")
    s = ST.sessions(ST.timed(ST.read_files(spark, f"{folder}/in", events.schema, files_per_batch=MANY_FILES), "ts", "1 second"), "ts", ["user_id"], "6 hours")
    ST.write_once(s, f"{folder}/out", f"{folder}/ck")
    return spark.read.parquet(f"{folder}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
