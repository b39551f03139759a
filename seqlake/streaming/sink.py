"""The materializer: tails the log and publishes parts.

A poll reads a bounded range of the log as a DataFrame, decodes it with the
caller's function (DataFrame in, DataFrame out, `seq` kept), publishes parts
and only then moves the cursor. Rows that were read but not published are read
again: a poll that fails changes nothing.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.dataset import Dataset, Encoder, FileInfo
from ..sources import logsource
from ..sources.log import Cursor, MemCursor, load, paced_end
from ..sources.store import open_store

Decode = Callable[[DataFrame], DataFrame]


def json_decoder(schema: StructType | str, names: dict[str, str] | None = None) -> Decode:
    """Decode JSON payloads; names: payload key -> column. A payload that is no such JSON fails and names its sequence."""

    def decode(df: DataFrame) -> DataFrame:
        text = F.col("data").cast("string")
        parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
        bad = F.raise_error(F.concat(F.lit("record "), F.col("seq").cast("string"), F.lit(" can't be decoded")))
        row = df.select("seq", F.when(F.try_parse_json(text).isNull(), bad).otherwise(parsed).alias("r"))
        fields = row.schema["r"].dataType.fieldNames()
        return row.select("seq", *[F.col(f"r.{f}").alias((names or {}).get(f, f)) for f in fields])

    return decode


class Sink:
    def __init__(self, spark: SparkSession, log: str, path: str, decode: Decode, *, cursor: Cursor | None = None, start: int = 0, bucket_size: int = 1 << 20, max_rows: int = 50_000, per_poll: int = 0, codec: str = "snappy", ext: str = "parquet", encoder: Encoder | None = None, store: dict[str, str] | None = None):
        """store: what the log's store needs beside its path, as open_store() names it."""
        logsource.register(spark)
        self.store = store or {}
        self.spark, self.log, self.decode, self.cursor = spark, log, decode, cursor or MemCursor()
        self.dataset = Dataset(spark, path, bucket_size, ext, encoder)
        self.max_rows, self.per_poll, self.codec = max_rows, per_poll, codec
        held = self.cursor.load()
        self.next = start if held is None else held
        self._high = self.dataset.visible_high()
        self._told: queue.Queue[int] = queue.Queue(1)

    def visible_high(self) -> int | None:
        return self._high

    def catalog(self) -> list[FileInfo]:
        return self.dataset.files()

    def notify(self) -> queue.Queue[int]:
        """Holds the latest high after a publish; one that nobody took is replaced."""
        return self._told

    def poll(self) -> int:
        """One pass; the number of sequences ingested."""
        m, _ = load(open_store(self.log, **self.store))
        end = paced_end(m, self.next, self.per_poll)
        if end <= self.next:
            return 0
        raw = self.spark.read.format("seqlog").option("path", self.log).option("start", self.next).option("end", end).options(**{logsource.OPTIONS[k]: v for k, v in self.store.items()}).load()
        done = self.dataset.publish(self.decode(raw), self.max_rows, self.codec)
        n, self.next = end - self.next, end
        if done:
            self._high = done.last if self._high is None else max(self._high, done.last)
        self.cursor.save(self.next)
        if done:
            try:
                self._told.get_nowait()
            except queue.Empty:
                pass
            self._told.put_nowait(self._high)
        return n

    def drain(self) -> int:
        """Poll until a poll finds nothing."""
        total = 0
        while n := self.poll():
            total += n
        return total

    def run(self, stop: threading.Event, seconds: float = 1.0) -> None:
        while not stop.is_set():
            self.poll()
            stop.wait(seconds)


def ingest_stream(spark: SparkSession, log: str, path: str, decode: Decode, checkpoint: str, bucket_size: int = 1 << 20, max_rows: int = 50_000, records_per_batch: int = 0):
    """The same as a Structured Streaming query: every micro-batch is published; a batch that runs again replaces its own parts."""
    logsource.register(spark)
    dataset = Dataset(spark, path, bucket_size)
    raw = spark.readStream.format("seqlog").option("path", log).option("recordsPerBatch", records_per_batch).load()
    return raw.writeStream.foreachBatch(lambda df, _: dataset.publish(decode(df), max_rows) and None).option("checkpointLocation", checkpoint)
