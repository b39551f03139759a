"""Joins that Spark SQL has no words for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, take: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """left with, for each row, `take` of the right row of its key with the latest right_ts <= left_ts; NULLs if none.

    NULL keys and times match nothing. Right rows that tie on key and time are
    told apart by the taken values; the largest wins. Both sides are united and read once in the order of time.
    The window's key has a time bucket in it, so that a hot key is many
    windows; what came before a bucket is carried in from an aggregate per bucket.
    """
    names = [f"_r_{c}" for c in take]
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    row = F.struct(F.col(right_ts).alias("at"), *[F.col(c).alias(n) for c, n in zip(take, names)])
    keyed = right.dropna(subset=[right_ts, *by])
    r = keyed.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), row.alias("_right"), F.floor(seconds(right_ts) / bucket_seconds).alias("_bucket"))
    own = F.struct(*[F.col(c) for c in left.columns]).alias("_left")
    l = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), own, F.floor(seconds(left_ts) / bucket_seconds).alias("_bucket"))
    both = r.unionByName(l, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_right", True).over(inside)).where("_side = 1")
    last = r.groupBy(*by, "_bucket").agg(F.max("_right").alias("_last"))
    spans = last.select(*by, "_bucket", "_last").unionByName(l.select(*by, "_bucket").distinct(), allowMissingColumns=True).groupBy(*by, "_bucket").agg(F.first("_last", True).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", True).over(before)).drop("_last")
    joined = seen.join(carried, [*by, "_bucket"], "left")
    found = F.coalesce("_seen", "_carried")
    return joined.select("_left.*", *[found[n].alias(c) for c, n in zip(take, names)])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with low <= point < high, by an equi-join on bins of `width` instead of a nested loop.

    A range is repeated for each bin that it touches: choose the width near the
    ranges' usual length. how: inner or left.
    """
    binned = points.withColumn("_bin", F.floor(F.col(point) / width))
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    a, b = binned.alias("a"), spread.alias("b")
    on = (F.col("a._bin") == F.col("b._bin")) & (F.col(f"a.{point}") >= F.col(f"b.{low}")) & (F.col(f"a.{point}") < F.col(f"b.{high}"))
    return a.join(b, on, how).drop("_bin")


def number_rows(df: DataFrame, order: list, name: str = "_n") -> DataFrame:
    """df with its rows' numbers from 0 in an order, without a task that holds them all: ranges are numbered apart and added up."""
    from ..plans.workspace import shared_folder
    import uuid

    path = f"{shared_folder(df.sparkSession)}/numbered-{uuid.uuid4().hex}"
    df.orderBy(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    before = ranged.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """The rows of both sides side by side in the stated orders, NULLs after the shorter one's end."""
    a, b = number_rows(left, left_order).alias("a"), number_rows(right, right_order).alias("b")
    return a.join(b, F.col("a._n") == F.col("b._n"), "full").drop("_n")
