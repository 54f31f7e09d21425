"""Statistics of one waveform held as array<double>, as built-in expressions (no Python worker)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import EPS, let, median_of


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def size(a: Column) -> Column:
    return F.size(a).cast("double")


def mean(a: Column) -> Column:
    return total(a) / size(a)


def moments(a: Column) -> Column:
    """struct(n, mean, m2, m3, m4): population central moments."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    n = size(a)

    def about(m: Column) -> Column:
        sums = F.aggregate(F.transform(a, lambda x: x - m), zero, lambda s, d: F.struct((s["a"] + d * d).alias("a"), (s["b"] + d * d * d).alias("b"), (s["c"] + d * d * d * d).alias("c")))
        return let(sums, lambda s: F.struct(n.alias("n"), m.alias("mean"), (s["a"] / n).alias("m2"), (s["b"] / n).alias("m3"), (s["c"] / n).alias("m4")))

    return let(mean(a), about)


def rms(a: Column) -> Column:
    """Root mean square; 0 for an empty array."""
    return F.when(F.size(a) > 0, F.sqrt(total(F.transform(a, lambda x: x * x)) / size(a))).otherwise(F.lit(0.0))


def adjusted_skewness(m: Column) -> Column:
    """G1 from the struct of moments()."""
    n = m["n"]
    return m["m3"] / F.pow(m["m2"], F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)


def adjusted_kurtosis(m: Column) -> Column:
    """G2 plus 3 (not in excess of the normal's)."""
    n = m["n"]
    g2 = m["m4"] / (m["m2"] * m["m2"]) - 3
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3


def shape_factors(a: Column) -> dict[str, Column]:
    """Waveform, crest, impulse and clearance factor."""
    absolute = F.transform(a, F.abs)
    r, peak, ma, root = rms(a), F.array_max(absolute), mean(absolute), mean(F.transform(absolute, F.sqrt))
    return {
        "waveform_factor": r / (ma + EPS),
        "crest_factor": peak / (r + EPS),
        "impulse_factor": peak / (ma + EPS),
        "clearance_factor": peak / (root * root + EPS),
    }


def tkeo(a: Column) -> Column:
    """Teager-Kaiser energy x[i]^2 - x[i-1] x[i+1] of the inner samples."""
    return F.transform(F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0))), lambda x, i: x * x - F.get(a, i) * F.get(a, i + 2))


def tkeo_ratio(a: Column) -> Column:
    t = tkeo(a)
    return F.array_max(t) / (mean(t) + EPS)


def chunk_bounds(n: Column, k: Column, chunks: int) -> tuple[Column, Column]:
    """Start and length of chunk k when n items are cut in `chunks`: the first n % chunks have one more."""
    base, more = F.floor(n / chunks), n % chunks
    start = k * base + F.least(k, more)
    return start, base + (k < more).cast("int")


def energy_entropy(a: Column, chunks: int = 8) -> Column:
    """Shannon entropy of the chunks' energy shares over log(chunks)."""
    n = F.size(a)

    def energy(k: Column) -> Column:
        start, length = chunk_bounds(n, k, chunks)
        return total(F.transform(F.slice(a, (start + 1).cast("int"), length.cast("int")), lambda x: x * x))

    e = F.transform(F.array(*[F.lit(k) for k in range(chunks)]), energy)
    p = let(e, lambda v: let(total(v) + EPS, lambda t: F.transform(v, lambda x: x / t)))
    return -total(F.transform(p, lambda x: x * F.log(x + EPS))) / math.log(chunks)


def ordinal_codes(a: Column) -> Column:
    """Order-3 ordinal patterns 0..5 with stable ties, one for each three neighbours."""
    n = F.size(a)

    def code(i: Column) -> Column:
        x, y, z = F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)
        return (x <= y).cast("int") * 4 + (x <= z).cast("int") * 2 + (y <= z).cast("int")

    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), code)).otherwise(F.array().cast("array<int>"))


def permutation_entropy(a: Column, least: int = 8) -> Column:
    """Entropy of the ordinal patterns over log(6); 0 for short arrays."""
    p = let(ordinal_codes(a), lambda c: F.transform(F.array(*[F.lit(k) for k in range(8)]), lambda k: F.size(F.filter(c, lambda x: x == k)) / size(c)))
    h = -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))) / math.log(6)
    return F.when(F.size(a) >= least, h).otherwise(F.lit(0.0))


def coarse(a: Column, scale: int) -> Column:
    """Means of successive runs of `scale` samples."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / scale).cast("int") - 1), lambda k: mean(F.slice(a, k * scale + 1, scale)))


def energy_bounds(a: Column, low: float = 0.05, high: float = 0.95) -> tuple[Column, Column]:
    """First sample at which the running energy reaches each share of the whole; n if never."""
    running = F.aggregate(
        a, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("c")),
        lambda t, x: F.struct((t["s"] + x * x).alias("s"), F.concat(t["c"], F.array(t["s"] + x * x)).alias("c")), lambda t: t["c"],
    )

    def first(share: float) -> Column:
        return let(running, lambda c: let(F.element_at(c, -1) * share, lambda limit: F.size(F.filter(c, lambda v: v < limit))))

    return first(low), first(high)


def correlation(a: Column, b: Column) -> Column:
    """Pearson; NULL where a side is constant."""

    def centred(x: Column) -> Column:
        return let(mean(x), lambda m: F.transform(x, lambda v: v - m))

    def of(x: Column, y: Column) -> Column:
        num = total(F.zip_with(x, y, lambda u, v: u * v))
        den = F.sqrt(total(F.transform(x, lambda u: u * u)) * total(F.transform(y, lambda v: v * v)))
        return F.when(den > 0, num / den)

    return let(centred(a), lambda x: let(centred(b), lambda y: of(x, y)))


def self_symmetry(a: Column) -> Column:
    """Correlation of an envelope with its reverse, for more than three samples."""
    return F.when(F.size(a) > 3, correlation(a, F.reverse(a)))


def energy_centroid(a: Column) -> Column:
    """Energy-weighted mean sample number."""
    e = F.transform(a, lambda x: x * x)
    return total(F.transform(e, lambda x, i: x * i)) / (total(e) + EPS)


def front_back_ratio(a: Column) -> Column:
    """Energy before the largest magnitude over the energy after it, the peak itself in neither."""
    absolute = F.transform(a, F.abs)
    peak = F.array_position(absolute, F.array_max(absolute)).cast("int")
    e = F.transform(a, lambda x: x * x)
    return total(F.slice(e, 1, peak - 1)) / (total(F.slice(e, peak + 1, F.size(a))) + EPS)


def bulge_share(a: Column, level: float = 0.6) -> Column:
    return let(F.array_max(a) * level, lambda top: F.size(F.filter(a, lambda x: x >= top))) / size(a)


def robust_normalize(a: Column) -> Column:
    """(x - median) / (1.4826 MAD + eps)."""
    centred = let(median_of(a), lambda m: F.transform(a, lambda x: x - m))
    return let(centred, lambda c: let(1.4826 * median_of(F.transform(c, F.abs)) + EPS, lambda d: F.transform(c, lambda x: x / d)))


def moving_average(a: Column, width: int) -> Column:
    """Centred mean over `width` samples, samples outside counted as zero; an even width reaches one further back."""
    left = width // 2
    n = F.size(a)

    def at(_: Column, i: Column) -> Column:
        first = F.greatest(i - left, F.lit(0))
        last = F.least(i - left + width, n)
        return total(F.slice(a, first + 1, last - first)) / width

    return F.transform(a, at)


def mix(noise: Column, event: Column, w1: float | Column, w2: float | Column) -> Column:
    """w1 noise + w2 event; arrays of unlike length are an error."""
    same = F.assert_true(F.size(noise) == F.size(event), "signals differ in length")
    return F.when(same.isNull(), F.zip_with(noise, event, lambda x, y: w1 * x + w2 * y))


def slope(a: Column) -> Column:
    """Least-squares slope per sample."""
    n = size(a)
    return total(F.transform(a, lambda x, i: (i - (n - 1) / 2) * x)) / (n * (n * n - 1) / 12)


def detrend(a: Column) -> Column:
    """Least-squares line removed."""
    n = size(a)
    return let(mean(a), lambda m: let(slope(a), lambda b: F.transform(a, lambda x, i: x - m - b * (i - (n - 1) / 2))))


def windows(a: Column, length: Column | int, step: Column | int) -> Column:
    """Array of (start, samples) of the full windows; none where the signal is shorter."""
    n = F.size(a)
    length, step = (F.lit(x) if isinstance(x, int) else x for x in (length, step))
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(a, s + 1, length).alias("samples")))


def with_noise(a: Column, snr_db: float | Column, *key: Column, seed: int = 42) -> Column:
    """a plus Gaussian noise at a signal-to-noise ratio. The draws come from a hash of the key and the sample's number, so
    they don't depend on partitions (two uniform hashes make one normal)."""
    power = total(F.transform(a, lambda x: x * x)) / size(a)
    sigma = F.sqrt(power / F.pow(F.lit(10.0), snr_db / 10 if isinstance(snr_db, Column) else F.lit(snr_db / 10)))

    def uniform(i: Column, part: int) -> Column:
        return (F.pmod(F.xxhash64(*key, i, F.lit(seed), F.lit(part)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    return let(sigma, lambda s: F.transform(a, lambda x, i: x + s * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1))))


def moving_average_edges(a: Column, width: int) -> Column:
    """Centred mean over `width` samples, the first and last sample repeated beyond the ends."""
    left = width // 2
    right = width - 1 - left
    padded = F.concat(F.array_repeat(F.get(a, F.lit(0)), left), a, F.array_repeat(F.element_at(a, -1), right))
    return let(padded, lambda p: F.transform(a, lambda _, i: total(F.slice(p, i + 1, width)) / width))
