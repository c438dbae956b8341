"""Request metrics and latency percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from candela.session import staged

#: Upper bounds of the cumulative latency buckets, in seconds.
BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def request_metrics(requests: DataFrame, by: list[str]) -> DataFrame:
    """Counts, server errors, latency sum and cumulative buckets per group."""
    buckets = [F.count_if(F.col("latency") <= b).alias(f"le_{k}") for k, b in enumerate(BOUNDS)]
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.sum("latency").alias("latency_sum"), *buckets)


#: Buckets that a range of latencies is cut into, and the most distinct latencies that are put in order.
CUTS, ORDERED = 1024, 100_000


def latency_percentiles(requests: DataFrame, by: list[str], cuts: int = CUTS, ordered: int = ORDERED) -> DataFrame:
    """Per group the median, and for p95 and p99 the value at place int(n * q), from 1, in order.

    Places are found by histogram: the range that holds a wanted place is cut
    into buckets, counted, and the bucket that holds it is the next range, until
    it has few distinct latencies, which alone are put in order. So a group of
    any size is counted by many tasks.
    """
    counted = staged(requests.where("latency is not null").groupBy(*by, "latency").agg(F.count(F.lit(1)).alias("n")), "latencies")
    ends = counted.groupBy(*by).agg(F.sum("n").alias("total"), F.min("latency").alias("lo"), F.max("latency").alias("hi"), F.count(F.lit(1)).alias("values"))
    total, one = F.col("total"), F.lit(1).cast("long")
    places = {"low": F.floor((total + 1) / 2), "high": F.floor(total / 2 + 1), "p95": F.floor(total * F.lit(0.95)), "p99": F.floor(total * F.lit(0.99))}
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(v.cast("long"), one).alias("place")) for k, v in places.items()])
    # place: from 1, within the range from lo to hi, both included.
    wanted = staged(ends.select(*by, F.explode(named).alias("w"), "lo", "hi", "values").select(*by, "w.*", "lo", "hi", "values"), "wanted")
    groups = _same_group(by)
    while not wanted.where(F.col("values") > ordered).isEmpty():
        w = wanted.select(*[F.col(c).alias(f"w_{c}") for c in by], "name", "place", "lo", "hi")
        inside = counted.join(w, groups(counted, w)).where(F.col("latency").between(F.col("lo"), F.col("hi")))
        wide = (F.col("hi") - F.col("lo")).cast("double")
        bucket = F.when(wide == 0, 0).otherwise(F.least(F.floor((F.col("latency") - F.col("lo")).cast("double") / wide * cuts), F.lit(cuts - 1)))
        hist = inside.groupBy(*by, "name", "place", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.min("latency").alias("lo"), F.max("latency").alias("hi"), F.count(F.lit(1)).alias("values"))
        # At most `cuts` rows a group and place.
        upto = F.sum("n").over(W.Window.partitionBy(*by, "name").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0))
        found = hist.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        wanted = staged(found.select(*by, "name", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), "lo", "hi", "values"), "wanted")
    w = wanted.select(*[F.col(c).alias(f"w_{c}") for c in by], "name", "place", "lo", "hi")
    last = counted.join(w, groups(counted, w)).where(F.col("latency").between(F.col("lo"), F.col("hi")))
    upto = F.sum("n").over(W.Window.partitionBy(*by, "name").orderBy("latency").rowsBetween(W.Window.unboundedPreceding, 0))
    hit = last.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("latency")))
    return hit.groupBy(*by).agg(((at("low") + at("high")) / 2).cast("double").alias("p50"), at("p95").alias("p95"), at("p99").alias("p99"))


def _same_group(by: list[str]):
    """The condition that two tables have the same group, nulls being one."""
    return lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"w_{c}"]) for c in by])
