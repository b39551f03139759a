"""Window forms that Spark SQL lacks: QUALIFY, DISTINCT ON, GROUPS frames, EXCLUDE CURRENT ROW; percentiles that are exact."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import number_rows


def qualify(df: DataFrame, value: Column, keep) -> DataFrame:
    """Rows for which keep(value) holds, value being a window expression."""
    return df.withColumn("_q", value).where(keep(F.col("_q"))).drop("_q")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; Spark limits each task's rows of a key before the shuffle."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), lambda n: n == 1)


def over_groups(df: DataFrame, value: str, name: str, by: list[str], order: str, before: int, after: int) -> DataFrame:
    """sum(value) over the peer groups from `before` preceding to `after` following."""
    peers = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    frame = Window.partitionBy(*by).orderBy("_g").rangeBetween(-before, after)
    return peers.withColumn(name, F.sum(value).over(frame)).drop("_g")


def sum_excluding_current(df: DataFrame, value: str, name: str, by: list[str], order: list, before: int, after: int) -> DataFrame:
    """sum(value) over rows from `before` preceding to `after` following without the row itself; NULL if none."""
    run = Window.partitionBy(*by).orderBy(*order)
    ahead, behind = F.sum(value).over(run.rowsBetween(-before, -1)), F.sum(value).over(run.rowsBetween(1, after))
    both = F.when(ahead.isNull() & behind.isNull(), None).otherwise(F.coalesce(ahead, F.lit(0)) + F.coalesce(behind, F.lit(0)))
    return df.withColumn(name, both)


def limit_percent(df: DataFrame, percent: float, order: list) -> DataFrame:
    """The first percent of the rows in an order, rounded down. Rows are numbered by range, so no task holds what is taken."""
    numbered = number_rows(df, order, "_place_of")
    return numbered.where(F.col("_place_of") < int(numbered.count() * percent / 100)).drop("_place_of")


def beside(df: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """df with the other columns of its group's one row in `few`, which is sent to all tasks. NULL is a key like any other."""
    right = few.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    return df.join(F.broadcast(right), on).drop(*[f"_by_{c}" for c in by])


def exact_percentile(df: DataFrame, value: str, by: list[str], p: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """The least value of each group that p of its values don't exceed; NULLs aside, NULL if there are no others.

    percentile_approx states two values around it. The values outside are only
    counted, and a task puts in order what lies between, a few in ten thousand.
    Where the counts show that the percentile lies elsewhere (NaN among the
    values), all of the group's are put in order.
    """
    ends = [max(0.0, p - 5 / accuracy), min(1.0, p + 5 / accuracy)]
    span = df.groupBy(*by).agg(F.percentile_approx(value, ends, accuracy).alias("_span"))
    counts = df.groupBy(*by, value).agg(F.count(value).alias("_n"))

    x, low, high = F.col(value), F.col("_span")[0], F.col("_span")[1]
    below, inside = F.sum(F.when(x < low, F.col("_n")).otherwise(0)), F.sum(F.when(x.between(low, high), F.col("_n")).otherwise(0))
    sums = beside(counts, span, by).groupBy(*by).agg(F.sum("_n").alias("_all"), below.alias("_below"), inside.alias("_inside"), F.first("_span").alias("_span"))
    place = F.greatest(F.ceil(F.col("_all") * p), F.lit(1))
    held = (place > F.col("_below")) & (place <= F.col("_below") + F.col("_inside"))
    sums = sums.select(*by, place.alias("_place"), F.when(held, F.col("_below")).otherwise(0).alias("_below"), F.when(held, F.col("_span")).alias("_span"))
    kept = beside(counts, sums, by).where(F.col("_span").isNull() | x.between(low, high) | x.isNull())
    run = F.col("_below") + F.sum("_n").over(Window.partitionBy(*by).orderBy(value))
    return kept.withColumn("_reached", (run >= F.col("_place")) & x.isNotNull()).groupBy(*by).agg(F.min(F.when(F.col("_reached"), x)).alias(name))


def dedup(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)
