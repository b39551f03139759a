"""Dataset, windows, materializer, continuous queries."""

import json
import os
import queue

import pytest
from pyspark.sql import functions as F

from seqlake.plans.dataset import BucketSizeMismatch, Dataset, Encoder, Published, parse_part, part_name
from seqlake.plans.engine import Engine, Mode, NoData, resolve_window
from seqlake.sources.log import FileCursor, Writer, WriterOptions, truncate
from seqlake.sources.store import LocalStore, MemStore
from seqlake.streaming.continuous import Continuous
from seqlake.streaming.sink import Sink, json_decoder
from seqlake.streaming.watermark import FileWatermark, MemWatermark, StoreWatermark, WatermarkConflict


def rows(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("seq"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("val"))


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_names():
    assert parse_part(part_name(3, 9)) == (3, 9)
    for bad in ("part-1-2.parquet", "x" + part_name(1, 2), part_name(5, 2)):
        assert parse_part(bad) is None


def test_truth_table():
    assert resolve_window(Mode.INCREMENTAL, 5, 0, 7, 10).bucket_low is None
    b = resolve_window(Mode.INCREMENTAL, 0, 25, 31, 10)
    assert (b.low, b.bucket_low, b.bucket_high) == (25, 2, 3)
    assert resolve_window(Mode.CUMULATIVE, 12, 3, 31, 10).low == 12


def test_layout_and_windows(spark, tmp_path):
    path = str(tmp_path / "d")
    e = Engine(spark, path, 10)
    with pytest.raises(NoData):
        e.query("SELECT * FROM records")
    d = Dataset(spark, path, 10)
    assert d.publish(rows(spark, 0, 25)) == Published(3, 0, 24) and [(f.first, f.last) for f in d.files()] == [(0, 9), (10, 19), (20, 24)]
    assert e.visible_high() == 24
    df, high = e.query("SELECT * FROM records ORDER BY seq", start=5)
    assert high == 24 and seqs(df) == list(range(5, 25)) and "seq_bucket" in df.columns
    df, _ = e.query("SELECT * FROM records", Mode.INCREMENTAL, watermark=21)
    assert seqs(df) == [21, 22, 23, 24]
    assert df.select(F.col("val")).count() == 4
    assert e.query("SELECT * FROM records", Mode.INCREMENTAL, watermark=25)[0].count() == 0
    assert [r.rows for r in e.dataset.catalog().orderBy("first").collect()] == [10, 10, 5]
    with pytest.raises(BucketSizeMismatch):
        Engine(spark, path, 5)
    with pytest.raises(ValueError):
        Engine(spark, path, 10, view="a b")


def test_only_the_windows_files_are_read(spark, tmp_path):
    path = str(tmp_path / "d")
    Dataset(spark, path, 10).publish(rows(spark, 0, 100))
    e = Engine(spark, path, 10)
    for mode_start, files in ((95, 1), (0, 10)):
        df, _ = e.window(Mode.CUMULATIVE, mode_start)
        df = df.select("seq", F.col("_metadata.file_name").alias("f"))
        assert df.select("f").distinct().count() == files
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("PartitionFilters: [isnotnull(seq_bucket" in plan) and "PushedFilters: [IsNotNull(seq)" in plan


def test_dedup_and_idempotent_publish(spark, tmp_path):
    path = str(tmp_path / "d")
    d = Dataset(spark, path, 10)
    for _ in range(2):
        d.publish(rows(spark, 0, 3))
    d.publish(rows(spark, 0, 5))
    assert len(d.files()) == 2
    assert Engine(spark, path, 10).query("SELECT * FROM records")[0].count() == 8
    assert seqs(Engine(spark, path, 10, dedup=True).query("SELECT * FROM records")[0]) == [0, 1, 2, 3, 4]
    assert [p.bucket for p in d.files()] == [0, 0] and d.publish(rows(spark, 0, 0)) is None
    with pytest.raises(ValueError):
        d.publish(rows(spark, 0, 1), codec="unknown")


def test_schema_union(spark, tmp_path):
    path = str(tmp_path / "d")
    Dataset(spark, path, 10).publish(rows(spark, 0, 2))
    Dataset(spark, path, 10).publish(rows(spark, 10, 12).withColumn("extra", F.concat(F.lit("x"), F.col("seq").cast("string"))))
    got = Engine(spark, path, 10).query("SELECT seq, extra FROM records ORDER BY seq")[0].collect()
    assert [tuple(r) for r in got] == [(0, None), (1, None), (10, "x10"), (11, "x11")]


def test_max_rows_per_part(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "d"), 10)
    assert d.publish(rows(spark, 0, 12), max_rows=4).parts == 4 and [(f.first, f.last) for f in d.files()] == [(0, 3), (4, 7), (8, 9), (10, 11)]


def test_publish_where_only_the_driver_reaches(spark, tmp_path):
    """Renames by the driver, which replace a file of the same name."""
    d = Dataset(spark, str(tmp_path / "d"), 10)
    d.folder = None
    for _ in range(2):
        assert d.publish(rows(spark, 0, 25)) == Published(3, 0, 24) and d.visible_high() == 24
    assert [(f.first, f.last, f.bucket) for f in d.files()] == [(0, 9, 0), (10, 19, 1), (20, 24, 2)] and d.files()[0].bytes > 0
    assert seqs(d.read()) == list(range(25)) and d.publish(rows(spark, 0, 0)) is None


def test_encoder(spark, tmp_path):
    """Parts in a format of the caller's, one call a part."""

    def write(path, table):
        import pathlib

        pathlib.Path(path).write_text("".join(f"{s}={v}\n" for s, v in zip(table["seq"].to_pylist(), table["val"].to_pylist())))

    d = Dataset(spark, str(tmp_path / "d"), 10, encoder=Encoder(".txt", write))
    assert d.publish(rows(spark, 0, 25).repartition(3), max_rows=7) == Published(5, 0, 24)
    assert [(f.first, f.last) for f in d.files()] == [(0, 6), (7, 9), (10, 16), (17, 19), (20, 24)]
    assert open(d.files()[1].path).read() == "7=v7\n8=v8\n9=v9\n"
    d.folder = None
    with pytest.raises(ValueError):
        d.publish(rows(spark, 0, 5))


def test_few_buckets_are_listed(spark, tmp_path):
    """With a schema a narrow window reads its buckets' folders; parts without buckets are still seen."""
    path = str(tmp_path / "d")
    Dataset(spark, path, 10).publish(rows(spark, 0, 100))
    e = Engine(spark, path, 10, schema=rows(spark, 0, 1).schema)
    df, _ = e.window(Mode.INCREMENTAL, watermark=85)
    assert seqs(df) == list(range(85, 100)) and len(df.inputFiles()) == 2 and "seq_bucket" in df.columns
    assert e.window(Mode.INCREMENTAL, watermark=100)[0].count() == 0
    assert seqs(e.window(Mode.CUMULATIVE)[0]) == list(range(100))
    os.makedirs(f"{path}/seq_bucket={11:020d}")
    assert e.visible_high() == 99
    Dataset(spark, str(tmp_path / "x"), 1000).publish(rows(spark, 200, 210))
    os.replace(Dataset(spark, str(tmp_path / "x"), 1000).files()[0].path, f"{path}/{part_name(200, 209)}")
    assert e.visible_high() == 209 and seqs(e.window(Mode.INCREMENTAL, watermark=95)[0].drop("seq_bucket")) == list(range(95, 100))


def write(path, low, high):
    with Writer(LocalStore(path), WriterOptions(segment_bytes=1), background=False) as w:
        for i in range(low, high):
            w.append([json.dumps({"val": f"v{i}"}).encode()], meta=b"g%d" % i)


def test_sink_resumes(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    write(path, 0, 25)
    make = lambda: Sink(spark, path, out, json_decoder("val string"), cursor=FileCursor(tmp_path / "cursor"), bucket_size=10)
    sink = make()
    assert sink.drain() == 25 and [(f.first, f.last) for f in sink.catalog()] == [(0, 9), (10, 19), (20, 24)]
    assert sink.notify().get_nowait() == 24
    again = make()
    assert again.poll() == 0 and again.visible_high() == 24
    write(path, 25, 31)
    assert again.poll() == 6 and again.visible_high() == 30
    assert seqs(Engine(spark, out, 10, dedup=True).query("SELECT * FROM records")[0]) == list(range(31))


def test_a_failed_poll_loses_nothing(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    write(path, 0, 3)
    with Writer(LocalStore(path), background=False) as w:
        w.append([b"no json"])
    sink = Sink(spark, path, out, json_decoder("val string"), bucket_size=10)
    with pytest.raises(Exception, match="record 3"):
        sink.poll()
    assert sink.next == 0 and sink.catalog() == []
    sink.per_poll = 3
    assert sink.poll() == 3 and sink.visible_high() == 2


def test_log_source_stream_and_truncation(spark, tmp_path):
    path = str(tmp_path / "log")
    write(path, 0, 7)
    Sink(spark, path, str(tmp_path / "o"), json_decoder("val string"), bucket_size=10)
    got = spark.read.format("seqlog").option("path", path).option("start", 2).option("end", 5).load().collect()
    assert [(r.seq, bytes(r.group_meta)) for r in sorted(got, key=lambda r: r.seq)] == [(i, b"g%d" % i) for i in range(2, 5)]
    assert seqs(spark.read.format("seqlog").option("path", path).option("startSegment", 6).load()) == [6]
    stream = spark.readStream.format("seqlog").option("path", path).option("recordsPerBatch", 3).load().writeStream
    q = stream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert seqs(spark.table("tail")) == list(range(7))
    finally:
        q.stop()
    assert truncate(LocalStore(path), 3) == 4
    assert seqs(spark.read.format("seqlog").option("path", path).load()) == [4, 5, 6]


@pytest.mark.parametrize("kind", ["memory", "file", "store"])
def test_watermarks(kind, tmp_path):
    s = {"memory": MemWatermark, "file": lambda: FileWatermark(tmp_path / "w"), "store": lambda: StoreWatermark(LocalStore(tmp_path))}[kind]()
    assert s.load() == (0, False)
    s.save(0, 5)
    s.save(5, 10)
    with pytest.raises(WatermarkConflict):
        s.save(5, 99)
    assert s.load() == (10, True)


def test_a_watermark_that_moves_between(monkeypatch):
    store = MemStore()
    a, b = StoreWatermark(store), StoreWatermark(store)
    for old, new in ((0, 5), (5, 9)):
        held = a._now()
        b.save(old, new)
        monkeypatch.setattr(a, "_now", lambda held=held: held)
        with pytest.raises(WatermarkConflict):
            a.save(old, 77)
        monkeypatch.undo()
    assert a.load() == (9, True)


def test_continuous(spark, tmp_path):
    path = str(tmp_path / "d")
    d, e = Dataset(spark, path, 10), Engine(spark, path, 10)
    c = Continuous(e, "SELECT seq FROM records ORDER BY seq", bind=lambda r: r.seq)
    assert c.trigger() is None
    d.publish(rows(spark, 0, 10))
    assert c.trigger().rows == list(range(10)) and c.trigger() is None and c.store.load() == (10, True)
    d.publish(rows(spark, 10, 15))
    ticks = queue.Queue()
    for t in (14, 14, None):
        ticks.put(t)
    assert [r.rows for r in c.run(ticks)] == [[10, 11, 12, 13, 14]]
    every = Continuous(e, "SELECT count(*) AS n FROM records", Mode.CUMULATIVE, bind=lambda r: r.n)
    assert [every.trigger().rows, every.trigger().rows] == [[15], [15]]


def test_asof_join_of_null_keys(spark):
    from seqlake.operators.joins import asof_join

    left = spark.createDataFrame([(None, 5, 1), ("a", 5, 2), ("a", None, 3), ("b", 5, 4)], "k string, t int, id int").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([(None, 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", 9, "w")], "k string, t int, v string").withColumn("t", F.timestamp_seconds("t"))
    got = asof_join(left, right, ["k"], "t", "t", ["v"]).collect()
    assert sorted((r.id, r.v) for r in got) == [(1, None), (2, "y"), (3, None), (4, None)]


@pytest.mark.parametrize("percent", [0, 10, 33.4, 100])
def test_limit_percent(spark, percent):
    from seqlake.operators.windows import limit_percent

    df = spark.range(97).repartition(5).withColumn("tie", F.col("id") % 2)
    got = sorted((r.tie, r.id) for r in limit_percent(df, percent, ["tie", "id"]).collect())
    assert got == sorted((i % 2, i) for i in range(97))[: int(97 * percent / 100)]
    assert limit_percent(df.limit(0), percent, ["id"]).count() == 0


def test_parquet_parts_by_tasks(spark, tmp_path, monkeypatch):
    """Plain types come back as Spark's own writer has them, and one file costs no more than itself; other types are Spark's to write."""
    from seqlake.plans import dataset

    plain = ["seq", "cast(seq % 3 AS tinyint) AS b", "cast(seq AS smallint) AS s", "cast(seq AS int) AS i", "float(seq) / 3 AS f", "if(seq = 3, double('NaN'), seq / 7) AS d", "cast(seq AS decimal(7, 2)) AS p", "cast(seq AS decimal(30, 4)) AS q"]
    plain += ["if(seq % 2 = 0, null, 'é' || seq) AS t", "encode(string(seq), 'utf-8') AS x", "seq % 2 = 0 AS y", "date'0999-12-30' + cast(seq AS int) AS z", "timestamp'1501-01-01 00:00:00.000001' + make_interval(0, 0, 0, cast(seq AS int)) AS at", "timestamp_ntz'2020-01-01 01:02:03.000004' AS n"]
    df = spark.range(0, 25).withColumnRenamed("id", "seq").selectExpr(*plain)
    own = Dataset(spark, str(tmp_path / "own"), 10)
    own.publish(df, max_rows=4, row_group_bytes=1 << 20)
    monkeypatch.setattr(Dataset, "_written", None)
    monkeypatch.setattr(dataset, "GROUP_BYTES", 1)
    for codec in ("snappy", "zstd", "gzip", "none"):
        d = Dataset(spark, str(tmp_path / codec), 10)
        assert d.publish(df, max_rows=4, codec=codec) == Published(8, 0, 24)
        assert [(f.first, f.last) for f in d.files()] == [(f.first, f.last) for f in own.files()]
        assert d.read().schema == own.read().schema
        assert [str(r) for r in d.read().orderBy("seq").collect()] == [str(r) for r in own.read().orderBy("seq").collect()] and d.read().count() == 25
    with pytest.raises(TypeError):
        Dataset(spark, str(tmp_path / "array"), 10).publish(df.withColumn("a", F.array("seq")))


def test_few_tasks_list_many_buckets(spark, tmp_path):
    path = str(tmp_path / "d")
    Dataset(spark, path, 10).publish(rows(spark, 0, 1000))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    had = spark.conf.get(key)
    schema = rows(spark, 0, 1).schema
    spark.sparkContext.setJobGroup("listing", "")
    df, _ = Engine(spark, path, 10, schema=schema).window(Mode.CUMULATIVE)
    spark.sparkContext.setJobGroup("after", "")
    seen = spark.sparkContext.statusTracker()
    stages = [s for j in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(j).stageIds]
    assert stages and max(seen.getStageInfo(s).numTasks for s in stages) <= 8 and spark.conf.get(key) == had
    assert df.count() == 1000
