"""The dataset: Parquet files of sequence ranges, under directories of sequence buckets.

    <path>/seq_bucket=<20 digits>/part-<first>-<last>.parquet

Files are seen through Spark's file system layer, so a path may be in any store
that Spark reads. The bucket size is kept beside the data; a reader with another is refused.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

from .ship import ship

PART = re.compile(r"part-(\d{20})-(\d{20})\.[A-Za-z0-9.]+")
BUCKET = re.compile(r"seq_bucket=(\d+)")
META = "_bucket_size"
CODECS = ("snappy", "zstd", "gzip", "none")


class BucketSizeMismatch(ValueError):
    pass


def part_name(first: int, last: int, ext: str = "parquet") -> str:
    return f"part-{first:020d}-{last:020d}.{ext}"


def parse_part(name: str) -> tuple[int, int] | None:
    """(first, last) of a part's file name; None for any other name."""
    m = PART.fullmatch(name)
    if not m or int(m[1]) > int(m[2]):
        return None
    return int(m[1]), int(m[2])


def parse_bucket(name: str) -> int | None:
    m = BUCKET.fullmatch(name)
    return int(m[1]) if m else None


@dataclass(frozen=True)
class FileInfo:
    path: str
    bucket: int | None
    first: int
    last: int
    bytes: int


@dataclass(frozen=True)
class Published:
    """What publish() has put in place."""

    parts: int
    first: int
    last: int


@dataclass(frozen=True)
class Encoder:
    """A file format of the caller's: write(path, table) makes the whole file of one part, its rows in the order of their sequences."""

    ext: str
    write: Callable[[str, pa.Table], None]


#: Renames that the driver has under way at once, in a store that tasks can't reach.
RENAMES = 32
#: Buckets of a window that are listed one by one; of more, Spark lists all in parallel.
FEW = 64


#: Types that Arrow's Parquet files hold as Spark's do.
PLAIN = (BinaryType, BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType)
#: Tasks that list folders, for each core.
LISTERS = 2
#: Bytes of a Parquet file's rows that its task holds before it writes them.
GROUP_BYTES = 1 << 26


class _Whole:
    """A part by the caller's encoder, which takes all of its rows."""

    def __init__(self, path: str, encoder: Encoder):
        self.path, self.encoder, self.rows = path, encoder, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)

    def close(self) -> None:
        self.encoder.write(self.path, pa.Table.from_batches(self.rows))


class _Parquet:
    """A part in Parquet as Spark has it; rows are held up to GROUP_BYTES.

    Spark's own writer costs more for each file: on a local folder it starts a
    process to set a mode, for the file and its checksums, and the driver
    renames all files one by one.
    """

    def __init__(self, path: str, codec: str, kept: dict[str, str]):
        self.path, self.codec, self.kept = path, codec, kept
        self.rows: list[pa.RecordBatch] = []
        self.bytes, self.out = 0, None

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)
        self.bytes += rows.nbytes
        if self.bytes >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        rows = pa.Table.from_batches(self.rows).replace_schema_metadata(self.kept)
        self.out = self.out or pq.ParquetWriter(self.path, rows.schema, compression=self.codec)
        self.out.write_table(rows)
        self.rows, self.bytes = [], 0

    def close(self) -> None:
        if self.rows:
            self._flush()
        self.out.close()


class Dataset:
    def __init__(self, spark: SparkSession, path: str, bucket_size: int = 1 << 20, ext: str = "parquet", encoder: Encoder | None = None):
        self.spark, self.path, self.bucket_size, self.encoder = spark, path.rstrip("/"), bucket_size, encoder
        self.ext = encoder.ext.lstrip(".") if encoder else ext
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        #: The folder, where driver and executors share it as one.
        self.folder = self._at(self.path).toUri().getPath() if self.fs.getUri().getScheme() == "file" else None
        kept = self._kept_size()
        if kept is not None and kept != bucket_size:
            raise BucketSizeMismatch(f"{self.path} has buckets of {kept}, not {bucket_size}")

    def _kept_size(self) -> int | None:
        if self.folder is not None:
            try:
                with open(f"{self.folder}/{META}", "rb") as f:
                    return int(f.read())
            except FileNotFoundError:
                return None
        at = self._at(f"{self.path}/{META}")
        if not self.fs.exists(at):
            return None
        f = self.fs.open(at)
        try:
            return int(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def _entries(self, below: str = "") -> list[tuple[str, bool, int]]:
        """(name, whether it is a folder, bytes) in the dataset's folder or one below; none if it is absent. What begins with _ or . isn't seen."""
        if self.folder is not None:
            try:
                with os.scandir(os.path.join(self.folder, below)) as found:
                    out = [(x.name, x.is_dir(), 0 if x.is_dir() else x.stat().st_size) for x in found if x.name[0] not in "_."]
            except (FileNotFoundError, NotADirectoryError):
                return []
            return out
        at = self._at(f"{self.path}/{below}" if below else self.path)
        if not self.fs.exists(at):
            return []
        listed = [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self.fs.listStatus(at)]
        return [x for x in listed if x[0][0] not in "_."]

    def _parts(self, below: str, entries: list[tuple[str, bool, int]]) -> list[FileInfo]:
        at = f"{self.path}/{below}" if below else self.path
        found = [(name, parse_part(name), size) for name, folder, size in entries if not folder and name.endswith(f".{self.ext}")]
        return [FileInfo(f"{at}/{name}", parse_bucket(below), *span, size) for name, span, size in found if span]

    def files(self) -> list[FileInfo]:
        """All finished parts in order of their first sequence; an absent folder has none."""
        top = self._entries()
        out = self._parts("", top)
        for name, folder, _ in top:
            if folder:
                out += self._parts(name, self._entries(name))
        return sorted(out, key=lambda f: (f.first, f.last))

    def visible_high(self) -> int | None:
        """The highest sequence of a finished part, from the names: of the last bucket that has one, as a part lies in one bucket."""
        top = self._entries()
        high = [f.last for f in self._parts("", top)]
        buckets = sorted(((parse_bucket(name), name) for name, folder, _ in top if folder), key=lambda x: -1 if x[0] is None else x[0], reverse=True)
        for bucket, name in buckets:
            own = [f.last for f in self._parts(name, self._entries(name))]
            high += own
            if own and bucket is not None:
                break
        return max(high, default=None)

    def catalog(self) -> DataFrame:
        """(path, seq_bucket, first, last, bytes, rows) of the parts; rows come from the files."""
        rows = [(f.path, f.bucket, f.first, f.last, f.bytes) for f in self.files()]
        listed = self.spark.createDataFrame(rows, "path string, seq_bucket long, first long, last long, bytes long")
        if not rows:
            return listed.withColumn("rows", F.lit(0).cast("long"))
        place = F.substring_index("path", "/", -2)
        counts = self.read().groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        counts = counts.select(place.alias("place"), "rows")
        return listed.withColumn("place", place).join(counts, "place", "left").drop("place")

    def publish(self, df: DataFrame, max_rows: int = 50_000, codec: str = "snappy", seq: str = "seq", row_group_bytes: int | None = None) -> Published | None:
        """Write df's rows as parts; None if there are none.

        A part is a slice of max_rows sequences of one bucket, sorted, written
        by one task: a bucket's rows are bounded by its sequences, so no key is
        hot. All files are staged out of a reader's sight before the first is
        renamed. Tasks rename them; in a store that only the driver reaches it
        does so, many at once. The same rows give the same names, and a file
        replaces one of its name at once.
        """
        if codec not in CODECS:
            raise ValueError(f"unknown compression {codec}")
        n, rows = self.bucket_size, max(1, max_rows)
        stage = f"{self.path}/_staging-{uuid.uuid4().hex}"
        placed = df.withColumn("_bucket", F.expr(f"{seq} div {n}L")).withColumn("_part", F.expr(f"(({seq} % {n}L) div {rows}L)"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        out = placed.repartition(parts, "_bucket", "_part").sortWithinPartitions("_bucket", "_part", seq)
        try:
            if self.encoder:
                encoder = self.encoder
                staged = self._encoded(out, stage, seq, encoder.ext.lstrip("."), lambda path: _Whole(path, encoder))
            elif self.folder is not None and self.ext == "parquet" and row_group_bytes is None and all(type(f.dataType) in PLAIN for f in df.schema):
                kept = {"org.apache.spark.version": self.spark.version, "org.apache.spark.sql.parquet.row.metadata": df.schema.json()}
                staged = self._encoded(out, stage, seq, "parquet", lambda path: _Parquet(path, codec, kept))
            else:
                staged = self._written(out, df.schema, stage, codec, seq, row_group_bytes)
            if staged is None:
                return None
            self._keep_size()
            done = self._put(staged).agg(F.count("*").alias("parts"), F.min("first").alias("first"), F.max("last").alias("last")).first()
            return Published(done["parts"], done["first"], done["last"]) if done["parts"] else None
        finally:
            self.fs.delete(self._at(stage), True)

    def _written(self, out: DataFrame, schema: StructType, stage: str, codec: str, seq: str, row_group_bytes: int | None) -> DataFrame | None:
        """Staged files (path, first, last) by Spark's own writer."""
        write = out.write.partitionBy("_bucket", "_part").option("compression", codec).option("maxRecordsPerFile", 0)
        if row_group_bytes:
            write = write.option("parquet.block.size", row_group_bytes)
        kind = "parquet" if self.ext == "parquet" else "json"
        write.format(kind).save(stage)
        if not self.fs.globStatus(self._at(f"{stage}/_bucket=*")):
            return None
        # Of every file the sequences alone are read again.
        read = self.spark.read.schema(schema).format(kind).option("recursiveFileLookup", "true").load(stage)
        return read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(seq).cast("long").alias("first"), F.max(seq).cast("long").alias("last"))

    def _encoded(self, out: DataFrame, stage: str, seq: str, ext: str, begin: Callable[[str], _Whole | _Parquet]) -> DataFrame:
        """Staged files (path, first, last), written in tasks by what begin(path) gives."""
        if self.folder is None:
            raise ValueError("an encoder writes to a folder that executors share")
        ship(self.spark)
        folder = self._at(stage).toUri().getPath()

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            os.makedirs(folder, exist_ok=True)
            part, now, first, last, done = None, None, None, None, []

            def end() -> None:
                part.close()
                done.append((f"file://{part.path}", first, last))

            for b in batches:
                keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("_bucket", "_part")]
                cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
                for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                    if at == to:
                        continue
                    rows = b.slice(at, to - at)
                    key, seqs = (keys[0][at], keys[1][at]), rows.column(seq)
                    if key != now:
                        if part:
                            end()
                        part, now, first = begin(f"{folder}/{uuid.uuid4().hex}.{ext}"), key, seqs[0].as_py()
                    part.add(rows.drop_columns(["_bucket", "_part"]))
                    last = seqs[-1].as_py()
            if part:
                end()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "first", "last"])

        out.mapInArrow(write, "path string, first long, last long").write.parquet(f"{stage}/_list")
        return self.spark.read.parquet(f"{stage}/_list")

    def _put(self, staged: DataFrame) -> DataFrame:
        """Rename staged files (path, first, last) to where they belong."""
        n, ext = self.bucket_size, self.ext
        place = lambda first, last: f"seq_bucket={first // n:020d}/{part_name(first, last, ext)}"
        if self.folder is None:
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
            over = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            over[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

            def one(r) -> tuple[int, int]:
                goal = self._at(f"{self.path}/{place(r['first'], r['last'])}")
                self.fs.mkdirs(goal.getParent())
                context.rename(self._at(r["path"]), goal, over)
                return r["first"], r["last"]

            rows, done, first, last = staged.toLocalIterator(), 0, None, None
            with ThreadPoolExecutor(RENAMES) as pool:
                while some := list(islice(rows, 10_000)):
                    for a, b in pool.map(one, some):
                        done, first, last = done + 1, a if first is None else min(a, first), b if last is None else max(b, last)
            return self.spark.sql(f"SELECT {'null' if first is None else first}L AS first, {'null' if last is None else last}L AS last FROM range({done})") if done else self.spark.createDataFrame([], "first long, last long")
        ship(self.spark)
        folder = self.folder

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, first, last in zip(*[c.to_pylist() for c in b.columns]):
                    goal, own = f"{folder}/{place(first, last)}", unquote(urlparse(path).path)
                    os.makedirs(os.path.dirname(goal), exist_ok=True)
                    try:
                        os.replace(own, goal)
                    except FileNotFoundError:
                        if not os.path.exists(goal):  # else a task that ran before has done it
                            raise
                yield b.select(["first", "last"])

        return staged.select("path", "first", "last").mapInArrow(move, "first long, last long")

    def _keep_size(self) -> None:
        at = self._at(f"{self.path}/{META}")
        if not self.fs.exists(at):
            f = self.fs.create(at, True)
            try:
                f.write(bytearray(str(self.bucket_size).encode()))
            finally:
                f.close()

    def _listed(self, load: Callable[[], DataFrame]) -> DataFrame:
        """load(), where Spark lists the folders of buckets by LISTERS tasks a core; by itself it takes one a folder."""
        key, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTERS * self.spark.sparkContext.defaultParallelism
        had = self.spark.conf.get(key)
        self.spark.conf.set(key, str(min(int(had), most)))
        try:
            return load()
        finally:
            self.spark.conf.set(key, had)

    def read(self, schema: StructType | None = None, buckets: tuple[int, int] | None = None) -> DataFrame:
        """All parts, columns by name, NULL where a file lacks one; seq_bucket is a LONG column where there are buckets.

        With a schema, only the folders of `buckets` (first, last) are listed if they are few.
        """
        kind = "parquet" if self.ext == "parquet" else "json"
        reader = self.spark.read.option("pathGlobFilter", f"part-*.{self.ext}").option("basePath", self.path)
        if schema is not None:
            where: list[str] | str = self.path
            if buckets is not None:
                top = self._entries()
                inside = [name for name, folder, _ in top if folder and buckets[0] <= (-1 if (b := parse_bucket(name)) is None else b) <= buckets[1]]
                whole = all(parse_bucket(name) is not None for name, folder, _ in top if folder) and not self._parts("", top)
                if whole and not inside:
                    return self.spark.createDataFrame([], schema)
                if whole and len(inside) <= FEW:
                    where = [f"{self.path}/{name}" for name in sorted(inside)]
            return self._listed(lambda: reader.schema(schema).format(kind).load(where))
        df = self._listed(lambda: reader.option("mergeSchema", "true").format(kind).load(self.path))
        return df.withColumn("seq_bucket", F.col("seq_bucket").cast("long")) if "seq_bucket" in df.columns else df
