"""The log as a Spark data source, format "seqlog": batch and stream reads, and writes.

Options: path (s3://bucket/prefix, or a folder that driver and executors share;
for S3 also endpoint, region, accessKey, secretKey and sessionToken where the
environment doesn't have them), start, end (exclusive), startSegment,
recordsPerBatch, partitionRecords, minPartitions. Each partition is
a run of segments; it holds about partitionRecords records at most, and fewer
where the read would have less than minPartitions partitions otherwise.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans.ship import ship
from .codec import Entry, Group, encode_segment
from .log import Writer, WriterOptions, load, paced_end, segment_records, upload
from .store import Store, open_store

SCHEMA = "seq long, group_meta binary, data binary, ingest_ts timestamp, segment string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Records that a partition has at least, if the log does.
LEAST = 4096


#: A store's keywords and the source's options.
OPTIONS = {"endpoint": "endpoint", "region": "region", "access_key": "accessKey", "secret_key": "secretKey", "token": "sessionToken"}


def store_of(options: dict) -> Store:
    """The store of a reader's or writer's options (lower-case names)."""
    return open_store(options["path"], **{k: options.get(v.lower()) for k, v in OPTIONS.items()})


class _Run(InputPartition):
    def __init__(self, entries: list[Entry], start: int, end: int):
        self.entries, self.start, self.end = entries, start, end


def _runs(options: dict, start: int, end: int) -> list[_Run]:
    """Partitions: segments with sequences in [start, end), put together up to a number of records."""
    m, _ = load(store_of(options))
    share = -(-(end - start) // int(options.get("minpartitions", 16)))
    most = min(int(options.get("partitionrecords", 1_000_000)), max(share, LEAST))
    out: list[list[Entry]] = []
    held = 0
    for e in m.suffix(start):
        if e.seq >= end:
            break
        if not out or held >= most:
            out.append([])
            held = 0
        out[-1].append(e)
        held += e.end - e.seq
    return [_Run(x, start, end) for x in out]


def _read(options: dict, run: _Run) -> Iterator[pa.RecordBatch]:
    """A segment's records at a time, as Arrow."""
    store = store_of(options)
    for e in run.entries:
        held = segment_records(store, e)
        seq = e.seq + np.arange(len(held)) if e.count else np.full(len(held), e.seq)
        low, high = np.searchsorted(seq, [run.start, run.end])
        if low == high:
            continue
        # Place 0 is for records before the first group.
        begins = np.array([g.start for g in e.groups], np.int64)
        group = pa.array(np.searchsorted(begins, np.arange(low, high), "right"))
        meta = pa.array([b"", *[g.payload for g in e.groups]], pa.binary())
        came = pa.array([0, *[g.ingest_ms * 1000 for g in e.groups]], pa.int64()).cast(pa.timestamp("us", "UTC"))
        columns = [pa.array(seq[low:high]), meta.take(group), pa.array(held[low:high], pa.binary()), came.take(group), pa.repeat(pa.scalar(e.location), high - low)]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _start(options: dict) -> int:
    if "startsegment" in options:
        return load(store_of(options))[0].segment_start(int(options["startsegment"]))
    return int(options.get("start", 0))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Run]:
        m, _ = load(store_of(self.options))
        start = _start(self.options)
        end = min(int(self.options.get("end", m.next_seq)), m.next_seq)
        if "recordsperbatch" in self.options:
            end = min(end, paced_end(m, start, int(self.options["recordsperbatch"])))
        return _runs(self.options, start, end) or [_Run([], start, start)]

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        return _read(self.options, run)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {"seq": next}. The source has no rate limit of its own, so the reader keeps where the last batch ended."""

    def __init__(self, options: dict):
        self.options, self.last = options, None

    def initialOffset(self) -> dict:
        return {"seq": _start(self.options)}

    def latestOffset(self) -> dict:
        m, _ = load(store_of(self.options))
        at = self.last if self.last is not None else _start(self.options)
        self.last = max(at, paced_end(m, at, int(self.options.get("recordsperbatch", 0))))
        return {"seq": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Run]:
        if self.last is None or end["seq"] > self.last:
            self.last = end["seq"]
        return _runs(self.options, start["seq"], end["seq"])

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        return _read(self.options, run)

    def commit(self, end: dict) -> None:
        pass


class _Part(WriterCommitMessage):
    def __init__(self, partition: int, segments: list[tuple[str, int, list[Group]]]):
        self.partition, self.segments = partition, segments


class _Writer(DataSourceArrowWriter):
    """Tasks upload segments; the driver commits them with one manifest write, in order of partitions.

    Rows need a binary or string column `data`, null being empty; `group_meta` binary is optional.
    Rows in a row with equal group_meta are one group. A task that is run again uploads under new names, of
    which the commit takes only the successful attempt's.
    """

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.fieldNames()
        self.run = secrets.token_hex(12)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        store, task = store_of(self.options), TaskContext.get()
        most = int(self.options.get("segmentbytes", 16 << 20))
        now = int(datetime.now(timezone.utc).timestamp() * 1000)
        segments: list[tuple[str, int, list[Group]]] = []
        data: list[bytes] = []
        groups: list[Group] = []
        size = 0

        def put() -> None:
            nonlocal data, groups, size
            if data:
                key = f"segments/{self.run}/{task.partitionId():08x}-{task.taskAttemptId():x}-{len(segments):08x}"
                upload(store, key, encode_segment(data))
                segments.append((key, len(data), groups))
                data, groups, size = [], [], 0

        for b in batches:
            held = pc.fill_null(b.column("data").cast(pa.binary()), b"")
            meta = pc.fill_null(b.column("group_meta").cast(pa.binary()), b"") if "group_meta" in self.names else pa.repeat(pa.scalar(b"", pa.binary()), b.num_rows)
            sizes = pc.binary_length(held).to_numpy().astype(np.int64) + 4
            codes = meta.dictionary_encode().indices.to_numpy()
            fresh = np.r_[True, codes[1:] != codes[:-1]][: len(codes)]
            total, at = np.cumsum(sizes), 0
            while at < b.num_rows:
                # As many rows as there is room for; a larger one stands alone.
                room = (total[at - 1] if at else 0) + most - size
                end = int(np.searchsorted(total, room, "right"))
                if end <= at:
                    if data:
                        put()
                        continue
                    end = at + 1
                for k in sorted({0, *np.flatnonzero(fresh[at:end]).tolist()}):
                    own = meta[at + k].as_py()
                    if not groups or groups[-1].payload != own:
                        groups.append(Group(len(data) + k, now, own))
                data += held[at:end].to_pylist()
                size += int(total[end - 1] - (total[at - 1] if at else 0))
                at = end
        put()
        return _Part(task.partitionId(), segments)

    def commit(self, messages: list[_Part | None]) -> None:
        writer = Writer(store_of(self.options), WriterOptions(), background=False)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        segments = [(key, count, tuple(groups)) for part in parts for key, count, groups in part.segments]
        if segments:
            writer.commit(segments)

    def abort(self, messages: list[_Part | None]) -> None:
        store = store_of(self.options)
        for m in messages:
            for key, _, _ in m.segments if m is not None else []:
                store.delete(key)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqlog"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is appended to only")
        return _Writer(self._options(), schema)


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(LogSource)


