"""Bounded histograms with percentiles by upper bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cachelens.errors import InvalidHistogramBounds

#: Bounds of lifetimes: powers of two from 2 to 65536.
LIFE_BOUNDS = tuple(2**k for k in range(1, 17))
LONG_MAX = 2**63 - 1


def bucket_of(value: Column, bounds: tuple[int, ...]) -> Column:
    """The first bucket whose bound exceeds the value; beyond the last bound the overflow bucket."""
    if list(bounds) != sorted(set(bounds)) or not bounds:
        raise InvalidHistogramBounds("bounds must rise")
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value < int(bounds[i]), i).otherwise(out)
    return out


def buckets(df: DataFrame, value: str, bounds: tuple[int, ...] = LIFE_BOUNDS) -> DataFrame:
    """``bucket, lo, hi, n, pct, cum_pct`` of the buckets that are not empty; ``hi`` of the overflow bucket is null.

    Everything after the count works on at most ``len(bounds) + 1`` rows.
    """
    edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    n = df.where(F.col(value).isNotNull()).groupBy(bucket_of(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))
    every, so_far = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bucket")
    total = F.sum("n").over(every)
    return n.select(
        "bucket",
        F.when(F.col("bucket") == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(edges, F.col("bucket"))).alias("lo"),
        F.try_element_at(edges, F.col("bucket") + 1).alias("hi"),
        "n",
        (F.col("n") * 100.0 / total).alias("pct"),
        (F.sum("n").over(so_far) * 100.0 / total).alias("cum_pct"),
    )


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...], bounds: tuple[int, ...] = LIFE_BOUNDS) -> DataFrame:
    """``p, bound``: the upper bound of the first bucket at which the running count reaches ``int(count * p)``; the last bound
    for the overflow bucket, the first one without values."""
    spark = df.sparkSession
    edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    n = df.where(F.col(value).isNotNull()).groupBy(bucket_of(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))
    grid = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").na.fill(0)
    run = grid.select("bucket", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("cum"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    asked = run.select("bucket", "cum", "total", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p"))
    reached = asked.where(F.col("cum") >= F.floor(F.col("total") * F.col("p")))
    return reached.groupBy("p").agg(F.min("bucket").alias("b")).select("p", F.element_at(edges, F.least(F.col("b") + 1, F.lit(len(bounds)))).alias("bound"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """``count, sum, min, max, mean``: the least starts at the greatest long and the greatest at 0, and the mean of nothing is 0."""
    d = df.agg(F.count(value).alias("count"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("sum"), F.coalesce(F.min(value), F.lit(LONG_MAX)).cast("long").alias("min"), F.greatest(F.lit(0), F.coalesce(F.max(value), F.lit(0))).cast("long").alias("max"))
    return d.withColumn("mean", F.coalesce(F.try_divide(F.col("sum").cast("double"), F.col("count").cast("double")), F.lit(0.0)))


def report(df: DataFrame, value: str, bounds: tuple[int, ...] = LIFE_BOUNDS) -> DataFrame:
    """``line_no, line``: summary, percentiles, and a line for every bucket that is not empty."""
    s = summary(df, value)
    p = percentiles(df, value, (0.5, 0.75, 0.9), bounds).groupBy().pivot("p", [0.5, 0.75, 0.9]).agg(F.first("bound"))
    head = s.crossJoin(p).select(F.posexplode(F.array(F.format_string("min: %d", "min"), F.format_string("max: %d", "max"), F.format_string("count: %d", "count"), F.format_string("p50: %d", F.col("`0.5`")), F.format_string("p75: %d", F.col("`0.75`")), F.format_string("p90: %d", F.col("`0.9`")))))
    rows = buckets(df, value, bounds).select(
        (F.col("bucket") + 6).alias("line_no"),
        F.concat(F.lit("["), F.col("lo").cast("string"), F.lit(", "), F.coalesce(F.col("hi").cast("string"), F.lit("infinity")), F.lit(") "), F.col("n").cast("string"), F.format_string(" %.2f%% %.2f%%", "pct", "cum_pct")).alias("line"),
    )
    return head.select(F.col("pos").alias("line_no"), F.col("col").alias("line")).unionByName(rows)
