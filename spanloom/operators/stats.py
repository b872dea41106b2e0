"""Aggregates: population moments, order statistics without interpolation, robust thresholds, Kolmogorov-Smirnov."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import point_join


def moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, mean and population deviation; an empty group has none of them."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def trimmed_moments(df: DataFrame, by: Sequence[str], x: str, sds: float = 5.0) -> DataFrame:
    """Mean and deviation again, without values more than sds deviations off; deviations below and above apart.

    Adds lo = mean - 3 * sd below and hi = mean + 3.5 * sd above. Mean and deviation of the second pass are whole numbers,
    cut towards zero; one-sided deviations are root mean squares of the distance to that mean, the mean itself included
    on both sides.
    """
    first = moments(df, by, x).select(*by, F.col("mean").alias("_m"), F.col("sd").alias("_s"))
    kept = df.join(first, list(by)).where(F.abs(F.col(x) - F.col("_m")) <= sds * F.col("_s")) if by else df.crossJoin(F.broadcast(first)).where(F.abs(F.col(x) - F.col("_m")) <= sds * F.col("_s"))
    second = kept.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).cast("long").alias("mean"), F.stddev_pop(x).cast("long").alias("sd"))
    both = kept.drop("_m", "_s").join(second, list(by)) if by else kept.drop("_m", "_s").crossJoin(F.broadcast(second))
    off = F.col(x) - F.col("mean")
    side = lambda keep: F.sqrt(F.avg(F.when(keep, off * off)))
    out = both.groupBy(*by, "n", "mean", "sd").agg(side(off <= 0).alias("sd_below"), side(off >= 0).alias("sd_above"))
    return out.withColumns({"lo": F.col("mean") - 3.0 * F.col("sd_below"), "hi": F.col("mean") + 3.5 * F.col("sd_above")})


def order_statistics(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """sorted[n // 100], sorted[n // 2] and sorted[n - n // 100] (the last element at most), counted from 0."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(x)) - 1
    n = F.count(F.lit(1)).over(w)
    ranked = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"), k.alias("_k"), n.alias("_n"))
    at = lambda i: F.max(F.when(F.col("_k") == i, F.col("_x")))
    low = F.floor(F.col("_n") / 100)
    return ranked.groupBy(*by).agg(at(low).alias("p1"), at(F.floor(F.col("_n") / 2)).alias("p50"), at(F.least(F.col("_n") - low, F.col("_n") - 1)).alias("p99"))


def histogram(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def histogram_tails(hist: DataFrame, by: Sequence[str], value: str = "value", count: str = "count") -> DataFrame:
    """From a histogram: the first values at which the running count exceeds a hundredth, half, and all but a hundredth."""
    w = Window.partitionBy(*by)
    run = hist.select(*by, F.col(value).alias("_v"), F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.sum(count).over(w).alias("_t"))
    at = lambda share: F.min(F.when(F.col("_c") > share * F.col("_t"), F.col("_v")))
    return run.groupBy(*by).agg(at(0.01).alias("low"), at(0.5).alias("median"), at(0.99).alias("high"))


def tail_counts(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """For each distinct value: how many rows of the key lie at or above it and at or below it."""
    h = histogram(df, by, x)
    w = Window.partitionBy(*by)
    up = F.sum("count").over(w.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("count").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return h.select(*by, "value", up.alias("at_or_above"), down.alias("at_or_below"))


def mad_threshold(df: DataFrame, by: Sequence[str], x: str, weight: str | None = None, default: float = 0.0, cap: float = 0.75) -> DataFrame:
    """min(cap, max(default, median + 4 * 1.4826 * MAD)) per key, with weighted medians; keys must not be null."""
    freq = F.col(weight) if weight else F.lit(1)
    med = df.groupBy(*by).agg(F.percentile(x, F.lit(0.5), freq).alias("median"))
    off = df.join(med, list(by)).groupBy(*by, "median").agg(F.percentile(F.abs(F.col(x) - F.col("median")), F.lit(0.5), freq).alias("mad"))
    return off.withColumn("threshold", F.least(F.lit(cap), F.greatest(F.lit(default), F.col("median") + 4 * 1.4826 * F.col("mad"))))


def pooled_thresholds(obs: pd.DataFrame, length: str, x: str, weight: str, least: int = 100, default: float = 0.0, cap: float = 0.75) -> pd.DataFrame:
    """A threshold for each length from 0 to the longest, from a table bounded by the number of lengths (driver side).

    Lengths next to L are taken in at growing distance, within L/2 and 2L, until least observations are met; where they
    never are, the threshold of the next smaller length is inherited.
    """
    out, last = [], default
    for at in range(int(obs[length].max()) + 1 if len(obs) else 0):
        n, d = 0, -1
        while n < least and d < at:
            d += 1
            pool = obs[(obs[length] >= max(at - d, math.ceil(at / 2))) & (obs[length] <= min(at + d, 2 * at))]
            n = int(pool[weight].sum())
        if n >= least:
            v = np.repeat(pool[x].to_numpy(float), pool[weight].to_numpy(int))
            med = float(np.median(v))
            last = min(cap, max(default, med + 4 * 1.4826 * float(np.median(np.abs(v - med)))))
        out.append((at, last))
    return pd.DataFrame(out, columns=[length, "threshold"])


def inherited(df: DataFrame, by: Sequence[str], order: str, x: str) -> DataFrame:
    """df with x filled from the last row before it that has one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(x, F.last(x, ignorenulls=True).over(w))


def mode(df: DataFrame, by: Sequence[str], x: str, largest: bool = False) -> DataFrame:
    """The most frequent value and its count; ties go to the smallest value, or the largest."""
    h = histogram(df, by, x)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), F.desc("value") if largest else F.asc("value")))
    return h.withColumn("_r", best).where("_r = 1").select(*by, F.col("value").alias("mode"), F.col("count").alias("mode_count"))


def iqr(x: str) -> Column:
    """Distance of the quartiles, interpolated."""
    return F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))


def occupancy(items: str, slots: Column) -> Column:
    """Distinct items over the number expected when so many draws fall on slots at random: k(1 - (1 - 1/k)^n)."""
    n, k = F.count(items), slots.cast("double")
    return F.count_distinct(items) / (k * (1 - F.pow(1 - 1 / k, n)))


def size_interval(df: DataFrame, by: Sequence[str], x: str, population: float) -> DataFrame:
    """From at least four sizes: half-width of the 99 % interval by the sample variance, and distance from a population mean.

    The mean is cut to a whole number, and so is what follows from it.
    """
    agg = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.var_samp(x).alias("_v"))
    enough = F.col("n") >= 4
    return agg.select(*by, "n", F.when(enough, (2.576 * F.sqrt(F.col("_v") / F.col("n"))).cast("long")).alias("half_width"), F.when(enough, F.abs(F.col("_m").cast("long") - F.lit(population)).cast("long")).alias("distance"))


def reservoir(histogram: DataFrame, value: str, count: str, most: int = 100_000, seed: int = 0) -> DataFrame:
    """value: a sample of at most ``most`` of the observations that a histogram stands for, all with equal odds.

    Observations are numbered through the histogram; those with the smallest hashes of their numbers are taken, which no
    order of rows changes. The histogram itself is a table of different values.
    """
    spark = histogram.sparkSession
    upto = F.sum(count).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    bounds = histogram.where(F.col(count) > 0).select(F.col(value).alias("value"), (upto - F.col(count)).alias("lo"), (upto - 1).alias("hi"), F.lit(0).alias("_all"))
    n, kinds = histogram.agg(F.coalesce(F.sum(count), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return histogram.select(F.col(value).alias("value")).limit(0)
    draws = spark.range(n).select(F.col("id").alias("x"), F.lit(0).alias("_all"))
    if n > most:
        draws = draws.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(most)
    return point_join(draws, bounds, ["_all"], "x", ("lo", "hi"), max(1, n // kinds)).select("value")


def support(prefix: str, keep: Column, strand: Column, quality: Column, high: float) -> list[Column]:
    """Conditional aggregates of the rows in keep: counts by strand, quality extremes and moments, high-quality counts."""
    q = F.when(keep, quality)
    n = lambda c: F.count_if(c).alias
    return [
        n(keep)(f"{prefix}_n"),
        n(keep & strand)(f"{prefix}_fwd"),
        n(keep & ~strand)(f"{prefix}_rev"),
        n(keep & strand & (quality >= high))(f"{prefix}_fwd_hq"),
        n(keep & ~strand & (quality >= high))(f"{prefix}_rev_hq"),
        F.min(q).alias(f"{prefix}_min_q"),
        F.max(q).alias(f"{prefix}_max_q"),
        F.avg(q).alias(f"{prefix}_avg_q"),
        F.stddev_pop(q).alias(f"{prefix}_sd_q"),
    ]


def kolmogorov_cdf(n: int, d: float) -> float:
    """P(D_n < d) by the method of Marsaglia, Tsang and Wang (2003): the power of a band matrix, exact but for rounding."""
    s = d * d * n
    if s > 7.24 or s > 3.76 and n > 99:
        return 1 - 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s)
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i = np.arange(m)
    below = i[:, None] - i[None, :] + 1
    matrix = (below >= 0).astype(float)
    matrix[:, 0] -= h ** (i + 1.0)
    matrix[m - 1, :] -= h ** (m - i.astype(float))
    matrix[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    log_factorials = np.array([math.lgamma(x + 1) for x in range(m + 1)])
    matrix *= np.exp(-log_factorials[np.maximum(below, 0)])
    power, exponent = np.eye(m), 0
    base, base_exponent, left = matrix, 0, n
    while left:
        if left & 1:
            power, exponent = power @ base, exponent + base_exponent
        base, base_exponent, left = base @ base, 2 * base_exponent, left >> 1
        for which in (0, 1):
            x = (power, base)[which]
            if x[k - 1, k - 1] > 1e140:
                x *= 1e-140
                exponent, base_exponent = (exponent + 140, base_exponent) if which == 0 else (exponent, base_exponent + 140)
    if power[k - 1, k - 1] <= 0:
        return 0.0
    logs = math.log10(power[k - 1, k - 1]) + exponent + (math.lgamma(n + 1) - n * math.log(n)) / math.log(10)
    return 10**logs


def ks_p_value(a: Sequence[float], b: Sequence[float]) -> float | None:
    """Two-sample p-value with the sample size ceil(n1 n2 / (n1 + n2)); None without values on either side."""
    x, y = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    if not len(x) or not len(y):
        return None
    at = np.concatenate([x, y])
    gap = np.abs(np.searchsorted(x, at, "right") * len(y) - np.searchsorted(y, at, "right") * len(x)).max()
    return 1 - kolmogorov_cdf(math.ceil(len(x) * len(y) / (len(x) + len(y))), float(gap) / (len(x) * len(y)))


def ks_by_group(df: DataFrame, by: str, x: str, sample: str) -> DataFrame:
    """Per key: p-value of x where the boolean sample holds against where it doesn't. A key's values meet in one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = ks_p_value(g[x][g[sample]].to_numpy(), g[x][~g[sample]].to_numpy())
        return pd.DataFrame({by: [g[by].iloc[0]], "n1": [int(g[sample].sum())], "n2": [int((~g[sample]).sum())], "p_value": [p]})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, x, sample).groupBy(by).applyInPandas(run, f"{by} {kind}, n1 long, n2 long, p_value double")


def ks_statistic(df: DataFrame, by: Sequence[str], x: str, sample: str) -> DataFrame:
    """Per key the largest distance of the two samples' distribution functions, by windows over distinct values only."""
    h = df.groupBy(*by, x).agg(F.count_if(F.col(sample)).alias("_a"), F.count_if(~F.col(sample)).alias("_b"))
    w, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    d = h.select(*by, F.sum("_a").over(run).alias("a"), F.sum("_b").over(run).alias("b"), F.sum("_a").over(w).alias("n1"), F.sum("_b").over(w).alias("n2"))
    return d.groupBy(*by, "n1", "n2").agg(F.max(F.abs(F.col("a") / F.col("n1") - F.col("b") / F.col("n2"))).alias("d"))
