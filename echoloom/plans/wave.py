"""Queries over waveforms: embeddings.embedding stands for a short recording, events.value for a continuous one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import windows as WN

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", S.doubles(F.col("embedding")).alias("x"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


#: Long form of the waveforms for the SQL side.
LONG = "SELECT vec_id, label, i - 1 AS i, embedding[i]::DOUBLE AS x, len(embedding) AS n FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) t"


@query(f"""SELECT vec_id, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(sqrt(avg(x * x)), 6) AS rms,
 round(sqrt(avg(x * x)) / (avg(abs(x)) + 1e-12), 6) AS waveform_factor, round(max(abs(x)) / (sqrt(avg(x * x)) + 1e-12), 6) AS crest_factor,
 round(max(abs(x)) / (avg(abs(x)) + 1e-12), 6) AS impulse_factor, round(max(abs(x)) / (power(avg(sqrt(abs(x))), 2) + 1e-12), 6) AS clearance_factor
 FROM ({LONG}) GROUP BY vec_id""")
def wave_classic_features(spark, sf_dir):
    """moments and shape factors of each waveform."""
    m = S.moments(F.col("x"))
    t = _waves(spark, sf_dir).select("vec_id", "x", m.alias("m"))
    factors = [F.round(c, 6).alias(k) for k, c in S.shape_factors(F.col("x")).items()]
    return t.select("vec_id", F.round("m.mean", 6).alias("mean"), F.round("m.m2", 6).alias("variance"), F.round(S.rms(F.col("x")), 6).alias("rms"), *factors)


@query(f"""WITH f AS (SELECT vec_id, label, sqrt(avg(x * x)) AS rms, max(abs(x)) / (sqrt(avg(x * x)) + 1e-12) AS crest_factor FROM ({LONG}) GROUP BY vec_id, label)
 SELECT label, count(*) AS n, round(avg(rms), 6) AS mean_rms, round(quantile_cont(rms, 0.5), 6) AS median_rms, round(stddev_samp(rms), 6) AS std_rms, round(min(rms), 6) AS min_rms,
 round(max(rms), 6) AS max_rms, round(avg(crest_factor), 6) AS mean_crest FROM f GROUP BY label""")
def label_method_summary(spark, sf_dir):
    """#122 over F1-F3: one summary row per label."""
    f = _waves(spark, sf_dir).select("label", S.rms(F.col("x")).alias("rms"), S.shape_factors(F.col("x"))["crest_factor"].alias("crest"))
    return f.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rms"), 6).alias("mean_rms"), F.round(F.percentile("rms", F.lit(0.5)), 6).alias("median_rms"), F.round(F.stddev_samp("rms"), 6).alias("std_rms"),
        F.round(F.min("rms"), 6).alias("min_rms"), F.round(F.max("rms"), 6).alias("max_rms"), F.round(F.avg("crest"), 6).alias("mean_crest"),
    )


@query(f"SELECT vec_id, round(skewness(x), 6) AS skewness, round(kurtosis(x) + 3, 6) AS kurtosis FROM ({LONG}) GROUP BY vec_id")
def wave_skew_kurtosis_adjusted(spark, sf_dir):
    """adjusted skewness and non-excess kurtosis."""
    t = _waves(spark, sf_dir).select("vec_id", S.moments(F.col("x")).alias("m"))
    return t.select("vec_id", F.round(S.adjusted_skewness(F.col("m")), 6).alias("skewness"), F.round(S.adjusted_kurtosis(F.col("m")), 6).alias("kurtosis"))


@query(f"""WITH t AS (SELECT vec_id, x * x - lag(x) OVER w * lead(x) OVER w AS p FROM ({LONG}) WINDOW w AS (PARTITION BY vec_id ORDER BY i))
 SELECT vec_id, round(max(p) / (avg(p) + 1e-12), 4) AS r_tkeo FROM t GROUP BY vec_id HAVING abs(avg(p)) > 1e-4""")
def wave_tkeo_ratio(spark, sf_dir):
    """F13, #87; waveforms whose mean energy operator is about zero have no stable ratio."""
    t = _waves(spark, sf_dir).select("vec_id", S.tkeo(F.col("x")).alias("p"))
    return t.where(F.abs(S.mean(F.col("p"))) > 1e-4).select("vec_id", F.round(F.array_max("p") / (S.mean(F.col("p")) + 1e-12), 4).alias("r_tkeo"))


@query(f"""WITH c AS (SELECT vec_id, CASE WHEN i < (n % 8) * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE (i - (n % 8)) // (n // 8) END AS k, sum(x * x) AS e FROM ({LONG}) GROUP BY 1, 2),
 s AS (SELECT vec_id, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-12) AS p FROM c)
 SELECT vec_id, round(-sum(p * ln(p + 1e-12)) / ln(8), 6) AS energy_entropy FROM s GROUP BY vec_id""")
def wave_energy_entropy(spark, sf_dir):
    """F15."""
    return _waves(spark, sf_dir).select("vec_id", F.round(S.energy_entropy(F.col("x")), 6).alias("energy_entropy"))


@query(f"""WITH g AS (SELECT vec_id, (x <= lead(x) OVER w)::INT * 4 + (x <= lead(x, 2) OVER w)::INT * 2 + (lead(x) OVER w <= lead(x, 2) OVER w)::INT AS c, lead(x, 2) OVER w AS z FROM ({LONG}) WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
 p AS (SELECT vec_id, c, count(*) / sum(count(*)) OVER (PARTITION BY vec_id) AS p FROM g WHERE z IS NOT NULL GROUP BY vec_id, c)
 SELECT vec_id, round(-sum(p * ln(p)) / ln(6), 6) AS permutation_entropy FROM p GROUP BY vec_id""")
def wave_permutation_entropy(spark, sf_dir):
    """F16."""
    return _waves(spark, sf_dir).select("vec_id", F.round(S.permutation_entropy(F.col("x")), 6).alias("permutation_entropy"))


@query(f"""WITH c AS (SELECT vec_id, i // 2 AS i, avg(x) AS x FROM ({LONG}) GROUP BY 1, 2),
 g AS (SELECT vec_id, (x <= lead(x) OVER w)::INT * 4 + (x <= lead(x, 2) OVER w)::INT * 2 + (lead(x) OVER w <= lead(x, 2) OVER w)::INT AS c, lead(x, 2) OVER w AS z FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
 p AS (SELECT vec_id, c, count(*) / sum(count(*)) OVER (PARTITION BY vec_id) AS p FROM g WHERE z IS NOT NULL GROUP BY vec_id, c)
 SELECT vec_id, round(-sum(p * ln(p)) / ln(6), 6) AS mpe_scale2 FROM p GROUP BY vec_id""")
def wave_multiscale_entropy(spark, sf_dir):
    """F16 on means of two samples."""
    t = _waves(spark, sf_dir).select("vec_id", S.coarse(F.col("x"), 2).alias("c"))
    return t.select("vec_id", F.round(S.permutation_entropy(F.col("c"), 16), 6).alias("mpe_scale2"))


@query(f"""WITH c AS (SELECT vec_id, n, sum(x * x) OVER (PARTITION BY vec_id ORDER BY i) AS s, sum(x * x) OVER (PARTITION BY vec_id) AS t, i FROM ({LONG}))
 SELECT vec_id, coalesce(min(i) FILTER (WHERE s >= 0.05 * t), max(n))::INT AS i05, coalesce(min(i) FILTER (WHERE s >= 0.95 * t), max(n))::INT AS i95 FROM c GROUP BY vec_id""")
def wave_energy_bounds(spark, sf_dir):
    """#77."""
    low, high = S.energy_bounds(F.col("x"))
    return _waves(spark, sf_dir).select("vec_id", low.alias("i05"), high.alias("i95"))


@query(f"SELECT a.vec_id, round(corr(a.x, b.x), 6) AS s_env FROM ({LONG}) a JOIN ({LONG}) b ON a.vec_id = b.vec_id AND b.i = a.n - 1 - a.i GROUP BY a.vec_id")
def wave_self_symmetry(spark, sf_dir):
    """F6, #91."""
    return _waves(spark, sf_dir).select("vec_id", F.round(S.self_symmetry(F.col("x")), 6).alias("s_env"))


@query(f"""WITH p AS (SELECT *, abs(x) AS a, first_value(i) OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS peak, max(x) OVER (PARTITION BY vec_id) AS top FROM ({LONG}))
 SELECT vec_id, round(sum(i * x * x) / (sum(x * x) + 1e-12), 5) AS c_e, round(coalesce(sum(x * x) FILTER (WHERE i < peak), 0) / (coalesce(sum(x * x) FILTER (WHERE i > peak), 0) + 1e-12), 4) AS r_fb, round(avg((x >= 0.6 * top)::INT), 6) AS c_bulge
 FROM p WHERE peak < n - 1 GROUP BY vec_id""")
def wave_envelope_shape(spark, sf_dir):
    """F5, F8, F9."""
    x = F.col("x")
    peak = F.array_position(F.transform(x, F.abs), F.array_max(F.transform(x, F.abs)))
    t = _waves(spark, sf_dir).where(peak < F.size(x))
    return t.select("vec_id", F.round(S.energy_centroid(x), 5).alias("c_e"), F.round(S.front_back_ratio(x), 4).alias("r_fb"), F.round(S.bulge_share(x), 6).alias("c_bulge"))


@query(f"""SELECT vec_id, w AS window_id, (w * 8)::INT AS start, round(sqrt(avg(x * x)), 6) AS rms FROM ({LONG}), (SELECT unnest(range(0, 7)) AS w) k WHERE i >= w * 8 AND i < w * 8 + 16 GROUP BY vec_id, w""")
def wave_window_slices(spark, sf_dir):
    """#93: sliding windows of 16 samples, step 8."""
    t = _waves(spark, sf_dir).select("vec_id", F.posexplode(S.windows(F.col("x"), 16, 8)).alias("window_id", "w"))
    return t.select("vec_id", F.col("window_id").cast("long").alias("window_id"), "w.start", F.round(S.rms(F.col("w.samples")), 6).alias("rms"))


@query(f"SELECT vec_id, i::INT AS i, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM ({LONG})")
def wave_moving_average(spark, sf_dir):
    """#64."""
    return _waves(spark, sf_dir).select("vec_id", F.posexplode(S.moving_average(F.col("x"), 5)).alias("i", "s")).select("vec_id", "i", F.round("s", 6).alias("smooth"))


@query(f"""WITH m AS (SELECT vec_id, median(x) AS m FROM ({LONG}) GROUP BY vec_id), d AS (SELECT l.vec_id, median(abs(l.x - m.m)) AS mad FROM ({LONG}) l JOIN m USING (vec_id) GROUP BY l.vec_id)
 SELECT l.vec_id, l.i::INT AS i, round((l.x - m.m) / (1.4826 * d.mad + 1e-12), 5) AS z FROM ({LONG}) l JOIN m USING (vec_id) JOIN d USING (vec_id)""")
def wave_robust_norm(spark, sf_dir):
    """#62."""
    return _waves(spark, sf_dir).select("vec_id", F.posexplode(S.robust_normalize(F.col("x"))).alias("i", "z")).select("vec_id", "i", F.round("z", 5).alias("z"))


@query(f"""SELECT a.vec_id, round(sqrt(avg(power(0.75 * a.x + 1.25 * b.x, 2))), 6) AS mixed_rms FROM ({LONG}) a JOIN ({LONG}) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def wave_mix(spark, sf_dir):
    """#88: each waveform as noise with the next as event."""
    w = _waves(spark, sf_dir)
    event = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return w.join(event, "vec_id").select("vec_id", F.round(S.rms(S.mix(F.col("x"), F.col("y"), 0.75, 1.25)), 6).alias("mixed_rms"))


@query(f"""WITH s AS (SELECT vec_id, regr_slope(x, i) AS b, avg(x) AS m, avg(i) AS t FROM ({LONG}) GROUP BY vec_id)
 SELECT l.vec_id, round(sqrt(avg(power(l.x - s.m - s.b * (l.i - s.t), 2))), 6) AS detrended_rms, round(any_value(s.b), 8) AS slope FROM ({LONG}) l JOIN s USING (vec_id) GROUP BY l.vec_id""")
def wave_detrend(spark, sf_dir):
    """#58, #90."""
    x = F.col("x")
    return _waves(spark, sf_dir).select("vec_id", F.round(S.rms(S.detrend(x)), 6).alias("detrended_rms"), F.round(S.slope(x), 8).alias("slope"))


@query(f"""WITH s AS (SELECT label, i, stddev_pop(x) AS sd FROM ({LONG}) GROUP BY label, i) SELECT label, round(avg(sd), 6) AS mean_channel_std, round(max(sd), 6) AS max_channel_std FROM s GROUP BY label""")
def channel_normalisation(spark, sf_dir):
    """#63: the sample number stands for a channel of the label's array."""
    t = _waves(spark, sf_dir).select("label", F.posexplode("x").alias("channel", "v"))
    s = t.groupBy("label", "channel").agg(F.stddev_pop("v").alias("sd"))
    return s.groupBy("label").agg(F.round(F.avg("sd"), 6).alias("mean_channel_std"), F.round(F.max("sd"), 6).alias("max_channel_std"))


@query("""SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def event_tumbling(spark, sf_dir):
    """#93 in time: one hour."""
    t = _events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))
    return t.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total", "mean")


@query("""WITH w AS (SELECT event_type, value, (time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE)::TIMESTAMP AS window_start FROM events, (SELECT unnest([0, 1]) AS k) t)
 SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def event_sliding(spark, sf_dir):
    """#93 in time: one hour, every thirty minutes."""
    t = _events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g)
 SELECT user_id, segment::BIGINT AS segment, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, segment""")
def event_sessions(spark, sf_dir):
    """#100: a gap of more than two hours starts a segment."""
    s = WN.gap_segments(_events(spark, sf_dir), ["user_id"], "ts", 7200.0, ["event_id"])
    out = s.groupBy("user_id", "segment").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query("""WITH g AS (SELECT user_id, ts, event_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS island FROM events),
 r AS (SELECT user_id, island, count(*) AS run FROM g WHERE ok GROUP BY user_id, island)
 SELECT user_id, max(run) AS longest_run, sum(run)::BIGINT AS total_true FROM r GROUP BY user_id""")
def event_longest_run(spark, sf_dir):
    """#75, #101."""
    return WN.true_runs(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@query("""WITH a AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id), m AS (SELECT * FROM (VALUES ('before', -7200.0, 0.0), ('after', 0.0, 3600.0), ('wide', -3600.0, 7200.0)) v(mode, lo, hi))
 SELECT a.user_id, m.mode, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 4) AS total FROM a CROSS JOIN m LEFT JOIN events e ON e.user_id = a.user_id AND date_diff('microsecond', a.t0, e.ts) >= m.lo * 1000000 AND date_diff('microsecond', a.t0, e.ts) < m.hi * 1000000 GROUP BY 1, 2""")
def event_anchor_windows(spark, sf_dir):
    """#96: windows about each user's first event of the first type."""
    e = _events(spark, sf_dir)
    first = e.agg(F.min("event_type")).first()[0]
    anchors = e.where(F.col("event_type") == first).groupBy("user_id").agg(F.min("ts").alias("t0"))
    modes = {"before": (-7200.0, 0.0), "after": (0.0, 3600.0), "wide": (-3600.0, 7200.0)}
    return WN.anchored(anchors, e.select("user_id", "ts", "value"), "user_id", modes)


@query("""SELECT user_id, count(*) AS n, round(regr_slope(value, epoch(ts) - 1.7e9) * 1e6, 4) AS slope_per_megasecond, round(regr_r2(value, epoch(ts) - 1.7e9), 5) AS r2 FROM events GROUP BY user_id HAVING count(*) > 2""")
def event_trend_slope(spark, sf_dir):
    """#90."""
    t = F.unix_micros("ts") / 1e6 - 1.7e9
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("value", t) * 1e6, 4).alias("slope_per_megasecond"), F.round(F.regr_r2("value", t), 5).alias("r2"))
    return e.where("n > 2")


@query("""WITH s AS (SELECT event_type, k * 20 AS size, k FROM (SELECT DISTINCT event_type FROM events) e, (SELECT unnest(range(1, 11)) AS k) t),
 r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
 m AS (SELECT event_type, avg(value) AS full_mean FROM events GROUP BY event_type),
 e AS (SELECT s.event_type, s.size, abs(avg(r.value) - any_value(m.full_mean)) / any_value(m.full_mean) AS err FROM s JOIN r ON r.event_type = s.event_type AND r.rn <= s.size JOIN m ON m.event_type = s.event_type GROUP BY 1, 2),
 w AS (SELECT event_type, size, max(err) OVER v AS worst, count(*) OVER v AS c FROM e WINDOW v AS (PARTITION BY event_type ORDER BY size ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
 SELECT event_type, min(size) FILTER (WHERE worst <= 0.2 AND c = 3)::BIGINT AS stable_size FROM w GROUP BY event_type""")
def first_stable_size(spark, sf_dir):
    """#102, #103: the first of three sizes in a row whose mean is within 20 % of the whole."""
    e = _events(spark, sf_dir)
    return WN.first_stable(WN.prefix_errors(e, "event_type", "value", ["ts", "event_id"], [20 * k for k in range(1, 11)]), ["event_type"], "size", "err", 0.2, 3)


@query("""SELECT event_type, round(max(value), 4) AS peak, round(sqrt(avg(value * value)), 6) AS rms, round(quantile_cont(value * value, 0.8) / (quantile_cont(value * value, 0.2) + 1e-12), 3) AS snr_proxy FROM events GROUP BY event_type""")
def channel_snr(spark, sf_dir):
    """#169: ratio of the 80 % to the 20 % quantile of power, a channel per event type."""
    p = F.col("value") * F.col("value")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.max("value"), 4).alias("peak"), F.round(F.sqrt(F.avg(p)), 6).alias("rms"), F.round(F.percentile(p, F.lit(0.8)) / (F.percentile(p, F.lit(0.2)) + 1e-12), 3).alias("snr_proxy"))


@query("""WITH c AS (SELECT event_type, quantile_cont(value * value, 0.8) / (quantile_cont(value * value, 0.2) + 1e-12) AS snr FROM events GROUP BY event_type)
 SELECT event_type AS reference_channel, round(snr, 3) AS snr FROM c QUALIFY row_number() OVER (ORDER BY snr DESC, event_type) = 1""")
def reference_channel(spark, sf_dir):
    """#169: the channel of the largest ratio."""
    p = F.col("value") * F.col("value")
    c = _events(spark, sf_dir).groupBy("event_type").agg((F.percentile(p, F.lit(0.8)) / (F.percentile(p, F.lit(0.2)) + 1e-12)).alias("snr"))
    return c.orderBy(F.desc("snr"), "event_type").limit(1).select(F.col("event_type").alias("reference_channel"), F.round("snr", 3).alias("snr"))


@query(f"""WITH e AS (SELECT vec_id, i, x * x AS e FROM ({LONG})), b AS (SELECT vec_id, avg(e) AS m, stddev_pop(e) AS s FROM e WHERE i < 16 GROUP BY vec_id), p AS (SELECT vec_id, min(i) AS peak FROM (SELECT vec_id, i, e, max(e) OVER (PARTITION BY vec_id) AS t FROM e) WHERE e = t GROUP BY vec_id)
 SELECT e.vec_id, coalesce(min(e.i) FILTER (WHERE e.e >= b.m + 2 * b.s AND e.i >= 16), any_value(p.peak))::INT AS onset FROM e JOIN b USING (vec_id) JOIN p USING (vec_id) GROUP BY e.vec_id""")
def wave_onset(spark, sf_dir):
    """#78 on unsmoothed energy, two deviations over the first quarter; the peak where nothing rises so far."""
    return WN.onsets(_waves(spark, sf_dir), "vec_id", "x", 16, 2.0)


@query(f"""WITH e AS (SELECT vec_id, i, n, x * x AS e FROM ({LONG})), p AS (SELECT vec_id, min(i) AS peak, any_value(t) AS top FROM (SELECT vec_id, i, e, max(e) OVER (PARTITION BY vec_id) AS t FROM e) WHERE e = t GROUP BY vec_id)
 SELECT e.vec_id, coalesce(min(e.i) FILTER (WHERE e.i > p.peak AND e.e <= p.top / exp(1)), max(e.n) - 1)::INT AS decay_end FROM e JOIN p USING (vec_id) GROUP BY e.vec_id""")
def wave_decay_end(spark, sf_dir):
    """#79: first sample after the peak at or under the peak's energy over e, else the last."""
    return WN.decay_ends(_waves(spark, sf_dir), "vec_id", "x")


@query("""WITH r AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN '0_30' ELSE '-10_30' END AS window_mode FROM events), s AS (SELECT * FROM r WHERE window_mode = '0_30')
 SELECT r.event_type, count(*) AS "rows", count(DISTINCT r.event_id) AS events, (SELECT count(*) FROM s WHERE s.event_type = r.event_type) AS selected_rows, (SELECT count(DISTINCT event_id) FROM s WHERE s.event_type = r.event_type) AS selected_events FROM r GROUP BY r.event_type""")
def canonical_window_audit(spark, sf_dir):
    """#55."""
    mode = F.when(F.col("event_id") % 3 == 0, "0_30").otherwise("-10_30")
    r = _events(spark, sf_dir).select("event_id", "event_type", mode.alias("window_mode"), F.when(mode == "0_30", 0.0).otherwise(-10.0).alias("window_start_ms"), F.lit(30.0).alias("window_end_ms"))
    return WN.window_audit(r, WN.canonical_windows(r, "event_id"), "event_type", "event_id")


@query("""SELECT event_id, CASE WHEN ts IS NOT NULL THEN ts + to_microseconds((event_id % 7) * 1000000) END AS time_axis FROM events""")
def scoring_time_axis(spark, sf_dir):
    """#57: the first full time column, moved by each row's offset."""
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("window_start_datetime"), F.col("ts").alias("starttime_raw"), (F.col("event_id") % 7).cast("double").alias("offset_s"))
    t = WN.time_axis(e, ["window_start_datetime", "starttime_raw", "arrival_time_raw"], "offset_s")
    return t.select("event_id", F.col("time_axis").cast("timestamp_ntz").alias("time_axis"))


@query(f"""SELECT vec_id, i::INT AS i, round((SELECT avg(embedding[greatest(1, least(len(embedding), i + 1 + d))]::DOUBLE) FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d) t), 6) AS smooth FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)""")
def wave_moving_average_edges(spark, sf_dir):
    """#64 with the end samples repeated."""
    return _waves(spark, sf_dir).select("vec_id", F.posexplode(S.moving_average_edges(F.col("x"), 5)).alias("i", "s")).select("vec_id", "i", F.round("s", 6).alias("smooth"))


@query()
def noise_at_snr(spark, sf_dir):
    """#92: measured ratio of each waveform to the noise put on it at 10 dB."""
    t = _waves(spark, sf_dir).withColumn("y", S.with_noise(F.col("x"), 10.0, F.col("vec_id")))
    noise = F.zip_with("x", "y", lambda a, b: b - a)
    return t.select("vec_id", F.round(20 * F.log10(S.rms(F.col("x")) / (S.rms(noise) + 1e-12)), 4).alias("snr_db"))
