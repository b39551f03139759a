"""Windowed queries: SQL over a bounded view of the dataset.

A query first fixes the highest visible sequence, then the window, then the
view; files that appear later don't change it. The window is stated on seq and
on the bucket: the second is what prunes files, and the optimizer can't derive it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .dataset import Dataset

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class NoData(LookupError):
    """There is no finished part yet."""


class Mode(Enum):
    INCREMENTAL = "incremental"
    CUMULATIVE = "cumulative"


@dataclass(frozen=True)
class Bounds:
    low: int
    high: int
    bucket_low: int | None
    bucket_high: int


def resolve_window(mode: Mode, start: int, watermark: int, high: int, bucket_size: int) -> Bounds:
    """The window's ends, inclusive. Low 0 is no bound, so that sequence 0 and data without buckets are read."""
    low = watermark if mode is Mode.INCREMENTAL else start
    if low < 0:
        raise ValueError("sequences begin at 0")
    return Bounds(low, high, low // bucket_size if low > 0 else None, high // bucket_size)


@dataclass
class Engine:
    spark: SparkSession
    path: str
    bucket_size: int = 1 << 20
    view: str = "records"
    seq: str = "seq"
    dedup: bool = False
    schema: StructType | None = None
    init: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in (self.view, self.seq):
            if not NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no identifier")
        if self.bucket_size < 1:
            raise ValueError("the bucket size is positive")
        for statement in self.init:
            self.spark.sql(statement)
        self.dataset = Dataset(self.spark, self.path, self.bucket_size)
        if self.schema is not None and "seq_bucket" not in self.schema.fieldNames():
            self.schema = StructType(self.schema.fields).add("seq_bucket", LongType())

    def visible_high(self) -> int | None:
        return self.dataset.visible_high()

    def window(self, mode: Mode, start: int = 0, watermark: int = 0, high: int | None = None) -> tuple[DataFrame, int]:
        """The bounded relation and its highest sequence. NoData without parts."""
        if high is None:
            high = self.visible_high()
        if high is None:
            raise NoData(self.path)
        b = resolve_window(mode, start, watermark, high, self.bucket_size)
        df = self.dataset.read(self.schema, (b.bucket_low or 0, b.bucket_high))
        df = df.where(F.col(self.seq) <= b.high)
        bucketed = "seq_bucket" in df.columns
        if b.low > 0:
            df = df.where(F.col(self.seq) >= b.low)
            if bucketed:
                df = df.where(F.col("seq_bucket") >= b.bucket_low)
        if bucketed:
            df = df.where(F.col("seq_bucket") <= b.bucket_high)
        if self.dedup:
            # Predicates on seq still reach the scan below this aggregate.
            df = df.dropDuplicates([self.seq])
        return df, high

    def query(self, sql: str, mode: Mode = Mode.CUMULATIVE, start: int = 0, watermark: int = 0) -> tuple[DataFrame, int]:
        """Run sql over the view. The caller goes on from the returned sequence plus one."""
        df, high = self.window(mode, start, watermark)
        df.createOrReplaceTempView(self.view)
        return self.spark.sql(sql), high
