"""Rate-distortion curves: points, interpolation, knees, comparisons. Windows and aggregations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points_from_lines(lineitem: DataFrame) -> DataFrame:
    """(method, label, rate, recall, coverage, weight): cumulative parts by year of lines, price and quantity."""
    by = lineitem.groupBy(F.col("l_returnflag").alias("method"), F.month("l_shipdate").alias("label"), F.year("l_shipdate").alias("y")).agg(
        F.count("*").alias("n"), F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q")
    )
    all_, upto = Window.partitionBy("method", "label"), Window.partitionBy("method", "label").orderBy("y")
    part = lambda c: F.round(F.sum(c).over(upto) / F.sum(c).over(all_), 9)
    return by.select("method", "label", part("n").alias("rate"), part("p").alias("recall"), part("q").alias("coverage"), F.sum("n").over(all_).alias("weight"))


def curve(points: DataFrame, *keys: str) -> DataFrame:
    """Points by rate, without those whose rate is not above the one before by more than 1e-9; null rates are left out."""
    w = Window.partitionBy(*(keys or ("method", "label"))).orderBy("rate")
    p = points.where("rate is not null").withColumn("_before", F.lag("rate").over(w))
    return p.where("_before is null or rate - _before > 1e-9").drop("_before")


def at_rates(curve: DataFrame, rates: Sequence[float], value: str = "recall") -> DataFrame:
    """(method, label, weight, at_rate, value): the value at each rate between two points, on a straight line; none outside the curve."""
    w = Window.partitionBy("method", "label").orderBy("rate")
    s = curve.select("method", "label", "weight", "rate", F.col(value).alias("v"), F.lead("rate").over(w).alias("r2"), F.lead(value).over(w).alias("v2"))
    s = s.withColumn("at_rate", F.explode(F.filter(F.array(*[F.lit(float(r)) for r in rates]), lambda x: (x == F.col("rate")) | ((x > F.col("rate")) & (x < F.col("r2"))))))
    line = F.when(F.col("at_rate") == F.col("rate"), F.col("v")).otherwise(F.col("v") + (F.col("v2") - F.col("v")) * (F.col("at_rate") - F.col("rate")) / (F.col("r2") - F.col("rate")))
    return s.select("method", "label", "weight", "at_rate", line.alias("value"))


def weighted_mean(values: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """(keys, value, n): the mean by weight of values that are there."""
    v = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    return v.groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("value"), F.count("*").alias("n"))


def aggregate_table(values: DataFrame, rates: Sequence[float]) -> DataFrame:
    """One row for each method, one column for each rate."""
    m = values.groupBy("method", "at_rate").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("v"))
    return m.groupBy("method").agg(*[F.round(F.min(F.when(F.col("at_rate") == float(r), F.col("v"))), 6).alias(f"r{r}") for r in rates])


def knee(curve: DataFrame, floor: float = 0.9, value: str = "recall") -> DataFrame:
    """(method, label, knee): the least rate above every rate at which the value is under the floor; none where the last point is."""
    w = Window.partitionBy("method", "label")
    low = F.max(F.when(F.col(value) < floor, F.col("rate"))).over(w)
    return curve.withColumn("_low", low).where(F.col("rate") > F.coalesce("_low", F.lit(-1.0))).groupBy("method", "label").agg(F.min("rate").alias("knee"))


def deltas(values: DataFrame, a: str, b: str) -> DataFrame:
    """(label, at_rate, delta): method a less method b where both have a value."""
    side = lambda m, c: values.where(F.col("method") == m).select("label", "at_rate", F.col("value").alias(c))
    return side(a, "x").join(side(b, "y"), ["label", "at_rate"]).select("label", "at_rate", (F.col("x") - F.col("y")).alias("delta"))


def elasticity(curve: DataFrame, low: float, high: float) -> DataFrame:
    """(method, label, elasticity): the slope between two rates on logarithmic scales."""
    v = at_rates(curve, (low, high))
    p = v.groupBy("method", "label").agg(F.min(F.when(F.col("at_rate") == low, F.col("value"))).alias("a"), F.min(F.when(F.col("at_rate") == high, F.col("value"))).alias("b"))
    return p.where("a > 0 and b > 0").select("method", "label", ((F.log("b") - F.log("a")) / (F.log(F.lit(high)) - F.log(F.lit(low)))).alias("elasticity"))


def average_rank(column: str, *keys: str):
    ties = F.count("*").over(Window.partitionBy(*keys, column))
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (ties - 1) / 2.0


def spearman(features: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, rho, n): correlation of average ranks."""
    r = features.select(*keys, average_rank(x, *keys).alias("rx"), average_rank(y, *keys).alias("ry"))
    return r.groupBy(*keys).agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


def sign_test(delta: DataFrame, *keys: str) -> DataFrame:
    """(keys, up, down, p): the exact two-sided sign test; ties are left out."""
    d = F.round("delta", 9)
    s = delta.groupBy(*keys).agg(F.count(F.when(d > 0, 1)).alias("up"), F.count(F.when(d < 0, 1)).alias("down")).where("up + down > 0")
    n, k = F.col("up") + F.col("down"), F.least("up", "down")
    # log-factorials by running sums of logarithms
    lf = lambda x: F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda a, i: a + F.exp(lf(n) - lf(i) - lf(n - i) - n * F.log(F.lit(2.0))))
    return s.select(*keys, "up", "down", F.round(F.least(F.lit(1.0), 2 * tail), 6).alias("p"))


def bootstrap(values: DataFrame, value: str, *keys: str, reps: int = 400) -> DataFrame:
    """(keys, mean, low, high): the mean and the 2.5 and 97.5 percentiles of means over resamples.

    Each value stands in each resample as often as a Poisson(1) draw by its hash says, so that resamples are sums that any partitioning
    adds up alike.
    """
    u = F.pmod(F.xxhash64("label", "r", *keys), F.lit(1 << 30)) / float(1 << 30)
    bounds = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    times = sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    x = values.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("times", times)
    m = x.groupBy(*keys, "r").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    ci = m.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    mean = values.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return mean.join(ci, list(keys))
