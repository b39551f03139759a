"""What the operators share: settled tables, batch handling, star components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.ship import ship
from ..plans.workspace import remove, shared_folder

#: Characters (or bytes) of text that a Python worker turns into arrays at once.
CHUNK = 1 << 18
_scopes: list[list[str]] = []
#: Cells of a pass of the threshold search.
CELLS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table by Spark's own reader; the path may be in any store."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, executors may go. The table lasts as long as the application, or its scratch()."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    for own in _scopes:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside are removed at its end; what is to last is written by then."""
    _scopes.append(made := [])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with its rows' places from 0 in an order; the sort is by range and ranges are numbered apart, so no task holds all rows."""
    ranged = settle(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    ahead = ranged.groupBy("_range").count()
    # One row a range.
    ahead = ahead.withColumn("_ahead", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(ahead), "_range").withColumn(name, F.col("_place") + F.col("_ahead")).drop("_range", "_place", "_ahead")


def finite_vector(c: Column) -> Column:
    """Whether an array column is non-null, non-empty, without null, NaN or infinite components."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(False))


def chunks(lengths: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit characters together; a longer row stands alone."""
    at, n = 0, len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = end


def with_columns(df: DataFrame, make: Callable[[pa.Array], dict[str, pa.Array]], column: str, added: str, keep: bool = True) -> DataFrame:
    """df's columns followed by those that make(array of `column`) gives; added: their DDL. No shuffle. keep=False leaves `column` out."""
    ship(df.sparkSession)
    schema, more = df.schema, StructType.fromDDL(added)
    at = schema.fieldNames().index(column)
    kept, names = [i for i in range(len(schema.fields)) if keep or i != at], more.fieldNames()
    out = StructType([*[schema.fields[i] for i in kept], *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b.column(at))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + [made[n] for n in names], names=out.fieldNames())

    return df.mapInArrow(run, out)


def threshold(scored: DataFrame, k: int) -> float | None:
    """The k-th largest key, exactly, by counting cells of ever smaller ranges; None if all are to be taken."""
    lowest, highest, n = scored.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n:
        return None
    above, low, high = 0, lowest, highest
    while True:
        width = (high - low) / CELLS
        if not width > 0 or low + width == low:
            return low
        inside = scored.where(F.col("key").between(low, high))
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(CELLS - 1)).cast("int")
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for row in sorted(cells, key=lambda r: -r["cell"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["a"] == row["b"] or (row["a"], row["b"]) == (low, high):
            return row["a"]
        if row["n"] <= CELLS:
            own = scored.where(F.col("key").between(row["a"], row["b"])).select("key").orderBy(F.desc("key")).limit(k - above).collect()
            return own[-1]["key"]
        low, high = row["a"], row["b"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v), both long and non-null, u != v.

    Alternating large-star and small-star rounds; every round is a partial
    aggregate and an equi-join, so that the centre of a huge star is split as a
    skewed join key. Returns (u, v): every node that is not its component's
    smallest, and that smallest node.
    """
    now, mark = settle(edges.select("u", "v")), None
    for _ in range(rounds):
        for large in (True, False):
            if large:
                both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            else:
                both = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            joined = both.join(least, "u")
            if large:
                new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
            now = settle(new.where("u != v").distinct())
        # A star forest is the fixed point; two rounds with the same edges have reached it.
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod("v", F.lit(1 << 30)))).first()
        if got == mark:
            return now
        mark = got
    raise RuntimeError("components did not converge")
