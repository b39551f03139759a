"""Named queries and their SQL.

Queries on records go through the whole path: events are materialized as parts
(seq = event_id) once in a session, and the engine binds the window. Log
queries write the events to a log first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .functions import dialect as D
from .operators import joins, windows
from .plans.dataset import Dataset
from .plans.engine import Engine, Mode
from .plans.workspace import once
from .sources import files, logsource
from .sources.log import load, paced_end
from .sources.store import open_store
from .streaming import events as event_time
from .streaming.sink import json_decoder

Query = Callable[[SparkSession, str], DataFrame]
N = 1000
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__.lstrip("_")] = f
        if sql is not None:
            _sql[f.__name__.lstrip("_")] = sql
        return f

    return add


def both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query that SQL states on either side; {table} names a table for Spark."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", spark_sql))
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in names})

    _queries[name] = run
    _sql[name] = duck_sql or spark_sql.replace("{", "").replace("}", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_records(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq"), "ts", "user_id", "event_type", "value", "props")


def engine(spark: SparkSession, sf_dir: str, dedup: bool = False) -> Engine:
    path = once(spark, "events", sf_dir, lambda p: Dataset(spark, p, N).publish(as_records(table(spark, sf_dir, "events"))) and None)
    schema = as_records(table(spark, sf_dir, "events")).schema
    return Engine(spark, path, N, dedup=dedup, schema=schema)


def _overlap(spark: SparkSession, sf_dir: str, dedup: bool) -> Engine:
    """All events, and parts with other ends that hold two thirds of every bucket again."""

    def make(path: str) -> None:
        rows = as_records(table(spark, sf_dir, "events"))
        Dataset(spark, path, N).publish(rows)
        Dataset(spark, path, N).publish(rows.where("seq % 3 != 0"), max_rows=400)

    schema = as_records(table(spark, sf_dir, "events")).schema  # else all files' footers are read for it
    return Engine(spark, once(spark, "overlap", sf_dir, make), N, dedup=dedup, schema=schema)


def _log(spark: SparkSession, sf_dir: str) -> str:
    """A log of the events' JSON: groups of 100 records with their number as metadata, 1000 records a segment."""
    logsource.register(spark)

    def make(path: str) -> None:
        rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("data"))
        meta = F.expr("event_id div 100").cast("string").cast("binary")
        out = rows.withColumn("group_meta", meta).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
        out.select("group_meta", F.col("data").cast("binary").alias("data")).write.format("seqlog").option("path", path).option("segmentBytes", 20_000).mode("append").save()

    return once(spark, "log", sf_dir, make)


def _tail(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    return spark.read.format("seqlog").option("path", _log(spark, sf_dir)).options(**options).load()


COLS = "seq, user_id, event_type, round(value, 4) AS value"
RAW = "event_id AS seq, user_id, event_type, round(value, 4) AS value"


@query(f"SELECT {RAW} FROM events")
def scan_all(spark, d):
    return engine(spark, d).query(f"SELECT {COLS} FROM records")[0]


@query(f"SELECT {RAW} FROM events WHERE event_type <> 'click' AND value > 10")
def project_filter(spark, d):
    return engine(spark, d).query(f"SELECT {COLS} FROM records WHERE event_type <> 'click' AND value > 10")[0]


@query("SELECT count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events")
def cumulative_all(spark, d):
    return engine(spark, d).query("SELECT count(*) AS n, min(seq) AS low, max(seq) AS high FROM records")[0]


@query(f"SELECT {RAW} FROM events WHERE event_id >= 517")
def cumulative_from(spark, d):
    return engine(spark, d).query(f"SELECT {COLS} FROM records", start=517)[0]


@query("SELECT event_type, count(*) AS n, round(avg(value), 2) AS avg_value FROM events GROUP BY event_type")
def cumulative_grouped(spark, d):
    return engine(spark, d).query("SELECT event_type, count(*) AS n, round(avg(value), 2) AS avg_value FROM records GROUP BY event_type")[0]


@query(f"SELECT {RAW} FROM events")
def incremental_first(spark, d):
    return engine(spark, d).query(f"SELECT {COLS} FROM records", Mode.INCREMENTAL, watermark=0)[0]


@query(f"SELECT {RAW} FROM events WHERE event_id >= (SELECT max(event_id) - 41 FROM events)")
def incremental_tail(spark, d):
    e = engine(spark, d)
    return e.query(f"SELECT {COLS} FROM records", Mode.INCREMENTAL, watermark=e.visible_high() - 41)[0]


@query(f"SELECT {RAW} FROM events WHERE false")
def incremental_empty(spark, d):
    e = engine(spark, d)
    return e.query(f"SELECT {COLS} FROM records", Mode.INCREMENTAL, watermark=e.visible_high() + 1)[0]


@query(f"SELECT {RAW} FROM events")
def incremental_two_steps(spark, d):
    e, half = engine(spark, d), 450
    first, _ = e.window(Mode.INCREMENTAL, high=half)
    rest, _ = e.window(Mode.INCREMENTAL, watermark=half + 1)
    return first.unionByName(rest).selectExpr(*[x.strip() for x in ("seq", "user_id", "event_type", "round(value, 4) AS value")])


@query("SELECT event_id AS seq, event_type FROM events")
def dedup_overlap(spark, d):
    return _overlap(spark, d, True).query("SELECT seq, event_type FROM records")[0]


@query("SELECT event_id AS seq, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 != 0")
def no_dedup_overlap(spark, d):
    return _overlap(spark, d, False).query("SELECT seq, event_type FROM records")[0]


@query("SELECT event_id AS seq, event_type, CASE WHEN event_id >= 500 THEN 'x' || event_id END AS extra FROM events")
def schema_union(spark, d):
    def make(path: str) -> None:
        rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type")
        Dataset(spark, path, N).publish(rows.where("seq < 500"))
        Dataset(spark, path, N).publish(rows.where("seq >= 500").withColumn("extra", F.concat(F.lit("x"), F.col("seq").cast("string"))))

    return Engine(spark, once(spark, "drift", d, make), N).query("SELECT seq, event_type, extra FROM records")[0]


@query("SELECT max(event_id) AS high FROM events")
def visible_high(spark, d):
    return spark.createDataFrame([(engine(spark, d).visible_high(),)], "high long")


@query("SELECT event_id // 1000 AS seq_bucket, min(event_id) AS first, max(event_id) AS last, count(*) AS rows FROM events GROUP BY 1")
def file_catalog(spark, d):
    return engine(spark, d).dataset.catalog().select("seq_bucket", "first", "last", "rows")


@query("SELECT event_id // 1000 AS seq_bucket, count(*) AS n FROM events GROUP BY 1")
def bucket_column_visible(spark, d):
    return engine(spark, d).query("SELECT seq_bucket, count(*) AS n FROM records GROUP BY seq_bucket")[0]


@query("SELECT event_id AS seq, event_type FROM events")
def log_replay_all(spark, d):
    return _tail(spark, d).select("seq", F.get_json_object(F.col("data").cast("string"), "$.event_type").alias("event_type"))


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id >= 777")
def log_replay_from(spark, d):
    return _tail(spark, d, start=777).select("seq", F.get_json_object(F.col("data").cast("string"), "$.event_type").alias("event_type"))


@query("SELECT event_id AS seq, event_id AS id FROM events WHERE event_id IN (0, 1, 333, 999)")
def log_locate(spark, d):
    """Point reads: the manifest names the one segment of each sequence."""
    m, _ = load(open_store(_log(spark, d)))
    reads = [_tail(spark, d, start=s, end=s + 1) for s in (0, 1, 333, 999) if m.locate(s)]
    out = reads[0]
    for r in reads[1:]:
        out = out.unionAll(r)
    return out.select("seq", F.get_json_object(F.col("data").cast("string"), "$.event_id").cast("long").alias("id"))


@query("SELECT 600 AS x, true AS first_holds_x, max(event_id) + 1 AS next_seq, max(event_id) + 1 - 600 AS from_x FROM events")
def log_suffix(spark, d):
    m, _ = load(open_store(_log(spark, d)))
    found = m.suffix(600)
    rows = [(600, found[0].seq <= 600 < found[0].end, m.next_seq, found[-1].end - 600)]
    return spark.createDataFrame(rows, "x int, first_holds_x boolean, next_seq long, from_x long")


@query("SELECT event_id AS seq, CAST(event_id // 100 AS VARCHAR) AS meta FROM events WHERE event_id >= (SELECT max(event_id) // 2 FROM events)")
def log_replay_segment(spark, d):
    """From a segment's begin on, named by its number; what lies before the asked sequence is left out."""
    m, _ = load(open_store(_log(spark, d)))
    half = (m.next_seq - 1) // 2
    k = next(i for i, e in enumerate(m.entries) if e.end > half)
    return _tail(spark, d, startSegment=k).where(F.col("seq") >= half).select("seq", F.col("group_meta").cast("string").alias("meta"))


@query("SELECT 450 AS x, true AS after_is_later, true AS since_is_not_before, true AS tail_ends_the_log, max(event_id) + 1 AS next_seq FROM events")
def log_lookups(spark, d):
    """Segments that begin after a sequence, or at it, and the last ones by their places."""
    m, _ = load(open_store(_log(spark, d)))
    after, since, tail = m.after(450), m.since(450), list(m.tail(3).values())
    rows = [(450, all(e.seq > 450 for e in after), all(e.seq >= 450 for e in since) and since[-1].end == m.next_seq, tail == m.entries[-3:], tail[-1].end)]
    return spark.createDataFrame(rows, "x int, after_is_later boolean, since_is_not_before boolean, tail_ends_the_log boolean, next_seq long")


@query("SELECT max(event_id) + 1 AS next_seq, true AS tiles, true AS all_dropped_before FROM events")
def log_truncate(spark, d):
    """Dropping a prefix keeps the next sequence and splits no segment."""
    m, _ = load(open_store(_log(spark, d)))
    m.truncate(400)
    kept = m.entries
    tiles = all(a.end == b.seq for a, b in zip(kept, kept[1:]))
    return spark.createDataFrame([(m.next_seq, tiles, all(e.end - 1 > 400 for e in kept))], "next_seq long, tiles boolean, all_dropped_before boolean")


@query("SELECT CAST(event_id // 100 AS VARCHAR) AS meta, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def log_group_meta(spark, d):
    return _tail(spark, d).groupBy(F.col("group_meta").cast("string").alias("meta")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query("SELECT count(*) AS n, count(*) AS distinct_n, true AS paced FROM events")
def log_paced(spark, d):
    """Bounded reads, one after the other, that together are the log."""
    m, _ = load(open_store(_log(spark, d)))
    at, reads, fine = 0, [], True
    while at < m.next_seq:
        end = paced_end(m, at, max(1, m.next_seq // 5))
        reads.append(_tail(spark, d, start=at, end=end))
        fine = fine and (end - at >= m.next_seq // 5 or end == m.next_seq)
        at = end
    out = reads[0]
    for r in reads[1:]:
        out = out.unionAll(r)
    return out.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("distinct_n")).withColumn("paced", F.lit(fine))


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark, d):
    return engine(spark, d).query("SELECT seq, from_json(props, 'k long').k AS k FROM records")[0]


@query("SELECT event_id AS seq, event_id AS index, event_type AS product_name, 'é \"' || event_id AS review_text FROM events")
def json_payload(spark, d):
    """Payloads whose keys differ from the columns, put in a log's form and decoded again."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('é "'), F.col("event_id").cast("string"))
    rows = e.select(F.col("event_id").alias("index"), F.lit("r").alias("review_id"), F.col("event_type").alias("product_name"), F.lit(5).alias("rating"), text.alias("review_text"))
    logged = files.to_payload(rows.withColumn("seq", F.col("index")), keep=["seq"])
    return json_decoder(files.REVIEW_SCHEMA, files.REVIEW_KEYS)(logged).select("seq", "index", "product_name", "review_text")


@query(f"SELECT {RAW} FROM events")
def jsonl_roundtrip(spark, d):
    rows = as_records(table(spark, d, "events")).select("seq", "user_id", "event_type", F.round("value", 4).alias("value"))
    path = once(spark, "jsonl", d, lambda p: files.write_jsonl(rows, p))
    schema = StructType().add("seq", LongType()).add("user_id", LongType()).add("event_type", StringType()).add("value", DoubleType())
    return files.read_jsonl(spark, path, schema)


@query("SELECT event_id AS index, 'r' || event_id AS review_id, event_type AS product_name, event_id % 5 AS rating, 'a, \"b\"' AS review_text FROM events")
def csv_ingest(spark, d):
    def make(path: str) -> None:
        e = table(spark, d, "events")
        cols = [F.col("event_id"), F.concat(F.lit("r"), F.col("event_id").cast("string")), F.concat(F.lit(" "), F.col("event_type"), F.lit("\t")), F.col("event_id") % 5, F.lit('a, "b"')]
        e.select(*[c.alias(n) for c, n in zip(cols, files.REVIEW_HEADER)]).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    return files.read_csv(spark, once(spark, "csv", d, make))


# Joins.
both("join_inner", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 1) AS total FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
both("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
both("join_right", "SELECT r_name, count(n_nationkey) AS n FROM {nation} RIGHT JOIN {region} ON n_regionkey = r_regionkey AND n_name < 'M' GROUP BY r_name")
both("join_full", "SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY 1) s ON c.k = s.k")
both("join_natural", "SELECT n_name, r_name FROM {nation} NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {region}) r")
both("join_semi", "SELECT c_custkey, c_name FROM {customer} SEMI JOIN {orders} ON c_custkey = o_custkey")
both("join_anti", "SELECT c_custkey, c_name FROM {customer} ANTI JOIN {orders} ON c_custkey = o_custkey")
both("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation} WHERE n_nationkey < 5")
both("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
both("join_exists", "SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT 1 FROM {nation} WHERE n_nationkey = s_nationkey AND n_regionkey = 1)")
both("join_lateral", "SELECT n_name, t.c_custkey AS top_customer FROM {nation}, LATERAL (SELECT c_custkey FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t")


@query("SELECT o_orderkey, band FROM orders JOIN (VALUES (0, 50000.0, 'low'), (1, 150000.0, 'mid'), (2, 1e12, 'high')) b(i, hi, band) ON o_totalprice >= CASE i WHEN 0 THEN 0 WHEN 1 THEN 50000 ELSE 150000 END AND o_totalprice < hi")
def join_range(spark, d):
    bands = spark.createDataFrame([(0.0, 50_000.0, "low"), (50_000.0, 150_000.0, "mid"), (150_000.0, 1e12, "high")], "lo double, hi double, band string")
    return joins.range_join(table(spark, d, "orders"), bands, "o_totalprice", "lo", "hi", 50_000.0).select("o_orderkey", "band")


_ASOF = "SELECT a.event_id, b.event_id AS prior FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts"


@query(_ASOF)
def join_asof(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("prior"))
    return joins.asof_join(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "ts", ["prior"]).select("event_id", "prior")


@query("SELECT n_name, s_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) FULL JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)")
def join_positional(spark, d):
    return joins.positional_join(table(spark, d, "nation"), table(spark, d, "supplier"), ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_name")


# Aggregates.
both("agg_basic", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 1) AS qty, round(avg(l_discount), 4) AS disc, min(l_tax) AS low, max(l_tax) AS high, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag")
both("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even FROM {events} GROUP BY event_type")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
both("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("agg_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
both("agg_percentile", "SELECT event_type, round(percentile(value, 0.5), 4) AS p50, round(percentile(value, 0.9), 4) AS p90 FROM {events} GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY event_type")
both("agg_median", "SELECT event_type, round(median(value), 4) AS mid FROM {events} GROUP BY event_type")
both("agg_mode", "SELECT l_returnflag, max(q) AS most FROM (SELECT l_returnflag, q, rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS r FROM (SELECT l_returnflag, l_quantity AS q, count(*) AS n FROM {lineitem} GROUP BY ALL)) WHERE r = 1 GROUP BY l_returnflag")
both("agg_argmax", "SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS poorest FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, row(c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, row(c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey")
both("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("agg_stats", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS vp, round(corr(value, user_id), 6) AS c FROM {events} GROUP BY event_type")
both("agg_bool", "SELECT event_type, bool_and(value >= 0) AS every, bool_or(value > 99) AS some FROM {events} GROUP BY event_type")


@query("SELECT l_returnflag, true AS close, quantile_disc(l_quantity, 0.5) AS mid FROM lineitem GROUP BY l_returnflag")
def agg_approx(spark, d):
    """The approximate count lies within three standard errors of the exact one; the approximate percentile is made exact, at any number of rows.

    Sketches are kept by flag alone: beside a distinct count in one aggregate they would be kept for each part of each flag.
    """
    rows = table(spark, d, "lineitem")
    near = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
    exact = rows.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    mid = windows.exact_percentile(rows, "l_quantity", ["l_returnflag"], 0.5, "mid")
    joined = windows.beside(windows.beside(mid, near, ["l_returnflag"]), exact, ["l_returnflag"])
    return joined.select("l_returnflag", (F.abs(F.col("parts") - F.col("exact")) <= 0.06 * F.col("exact")).alias("close"), "mid")


@query("SELECT min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, max(v50) AS p50, max(v90) AS p90, max(v99) AS p99 FROM (SELECT value, CASE WHEN i = CAST(floor(0.5 * n) AS BIGINT) THEN value END AS v50, CASE WHEN i = CAST(floor(0.9 * n) AS BIGINT) THEN value END AS v90, CASE WHEN i = CAST(floor(0.99 * n) AS BIGINT) THEN value END AS v99 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events))")
def agg_index_percentiles(spark, d):
    """Percentiles by index in the sorted values, as throughput reports state them."""
    e = table(spark, d, "events")
    n = e.count()
    numbered = joins.number_rows(e.select("value", "event_id"), ["value", "event_id"])
    at = [F.max(F.when(F.col("_n") == int(p * n), F.col("value"))).alias(a) for p, a in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return numbered.agg(F.min("value").alias("low"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"), *at)


# Windows.
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
both("win_rank", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS c FROM {supplier}")
both("win_dense", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM {part}")
both("win_row_number", f"SELECT event_id, row_number() OVER {_W} AS n FROM {{events}}")
both("win_ntile", f"SELECT event_id, ntile(4) OVER {_W} AS q FROM {{events}}")
both("win_lag_lead", f"SELECT event_id, lag(event_id) OVER {_W} AS prev, lead(event_id, 2) OVER {_W} AS next2 FROM {{events}}")
both("win_first_last", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
both("win_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS s FROM {events}")
both("win_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS n FROM {events}")


@query("SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def win_groups(spark, d):
    return windows.over_groups(table(spark, d, "part"), "p_size", "s", ["p_brand"], "p_size", 1, 0).select("p_partkey", "s")


@query("SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s FROM events")
def win_exclude(spark, d):
    return windows.sum_excluding_current(table(spark, d, "events"), "event_id", "s", ["user_id"], ["event_id"], 1, 1).select("event_id", "s")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")
def win_qualify(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return windows.qualify(table(spark, d, "events"), F.row_number().over(w), lambda n: n <= 2).select("event_id", "user_id")


# Sorting and limits.
both("sort_nulls", "SELECT k, row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS place FROM (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS v FROM {nation})")
both("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
both("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 15")


@query("SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, value DESC, event_id")
def distinct_on(spark, d):
    return windows.distinct_on(table(spark, d, "events"), ["user_id"], [F.desc("value"), "event_id"]).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10%")
def limit_percent(spark, d):
    return windows.limit_percent(table(spark, d, "orders"), 10, ["o_orderkey"]).select("o_orderkey")


# Sets.
both("set_union", "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}")
both("set_union_all", "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
both("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
both("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
both("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
both("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")


@query("SELECT n_name AS name, n_regionkey AS k, NULL AS extra FROM nation UNION ALL BY NAME SELECT r_name AS name, 'r' AS extra, r_regionkey AS k FROM region")
def set_union_by_name(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    b = table(spark, d, "region").select(F.lit("r").alias("extra"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


# Scalar functions, one projection for each family.
@query("SELECT p_partkey, substr(p_name, 1, 5) AS a, length(p_name) AS b, upper(p_brand) AS c, lpad(p_brand, 12, '*') AS d, contains(p_type, 'A') AS e, md5(p_name) AS f, starts_with(p_name, 'a') AS g, string_split(p_type, ' ')[1] AS h, regexp_matches(p_name, '[0-9]+') AS i, strlen(p_name) AS j, replace(p_name, 'a', 'b') AS k, concat(p_name, NULL, '!') AS l, trim(p_type) AS m FROM part")
def fn_string(spark, d):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.substring(n, 1, 5).alias("a"), F.length(n).alias("b"), F.upper("p_brand").alias("c"), F.lpad("p_brand", 12, "*").alias("d"), F.contains(t, F.lit("A")).alias("e"), F.md5(n).alias("f"),
        n.startswith("a").alias("g"), F.element_at(D.string_split(t, " "), 1).alias("h"), D.regexp_matches(n, "[0-9]+").alias("i"), D.strlen(n).alias("j"), F.replace(n, F.lit("a"), F.lit("b")).alias("k"),
        D.concat(n, F.lit(None), F.lit("!")).alias("l"), F.trim(t).alias("m"),
    )


@query("SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS b, CAST(floor(s_acctbal) AS BIGINT) AS c, round(sqrt(abs(s_acctbal)), 6) AS d, greatest(s_suppkey, 10) AS e, least(s_suppkey, 10) AS f, s_suppkey % 7 AS g, round(power(s_suppkey, 2), 3) AS h, round(ln(s_suppkey + 1), 6) AS i, round(log(s_suppkey + 1), 6) AS j, s_suppkey // 3 AS k, CASE WHEN s_nationkey <> 0 THEN round(s_acctbal / s_nationkey, 6) END AS l FROM supplier")
def fn_math(spark, d):
    x, k = F.col("s_acctbal"), F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.round(F.abs(x), 2).alias("a"), F.ceil(x).alias("b"), F.floor(x).alias("c"), F.round(F.sqrt(F.abs(x)), 6).alias("d"), F.greatest(k, F.lit(10)).alias("e"), F.least(k, F.lit(10)).alias("f"),
        (k % 7).alias("g"), F.round(F.power(k, F.lit(2)), 3).alias("h"), F.round(F.ln(k + 1), 6).alias("i"), F.round(D.log(k + 1), 6).alias("j"), D.floor_divide(k, F.lit(3)).alias("k"), F.round(D.divide(x, F.col("s_nationkey")), 6).alias("l"),
    )


@query("SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS a, CAST(year(ts) AS INTEGER) AS b, CAST(dayofweek(ts) AS INTEGER) AS c, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS d, CAST(epoch_ms(ts) AS BIGINT) AS e, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS f, strftime(ts + INTERVAL '1 day', '%Y%m%d') AS g FROM events")
def fn_date(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", D.strftime(F.date_trunc("month", ts), "%Y-%m-%d").alias("a"), F.year(ts).alias("b"), D.dayofweek(ts).alias("c"), D.strftime(D.time_bucket(ts, 3600), "%Y-%m-%d %H:%M:%S").alias("d"),
        D.epoch_ms(ts).alias("e"), D.date_diff_days(F.lit("2020-01-01").cast("date"), ts.cast("date")).alias("f"), D.strftime(ts + F.expr("interval 1 day"), "%Y%m%d").alias("g"),
    )


@query("SELECT k, CAST(list_sum(x) AS BIGINT) AS a, CAST(len(x) AS INTEGER) AS b, x[1] AS c, CAST(list_sum(list_transform(x, lambda v: v * 2)) AS BIGINT) AS e, CAST(len(list_filter(x, lambda v: v > 3)) AS INTEGER) AS f, list_contains(x, 2) AS g FROM (SELECT n_nationkey AS k, [n_nationkey, n_regionkey, 7] AS x FROM nation)")
def fn_array(spark, d):
    x = F.array("n_nationkey", "n_regionkey", F.lit(7))
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"), D.list_sum(x).alias("a"), F.size(x).alias("b"), F.element_at(x, 1).alias("c"), D.list_sum(F.transform(x, lambda v: v * 2)).alias("e"), F.size(F.filter(x, lambda v: v > 3)).alias("f"), F.array_contains(x, 2).alias("g")
    )


both("fn_unnest", "SELECT k, explode(sequence(0, k % 3)) AS i FROM (SELECT n_nationkey AS k FROM {nation})", "SELECT k, CAST(unnest(generate_series(0, k % 3)) AS INTEGER) AS i FROM (SELECT n_nationkey AS k FROM nation)")
both("fn_map", "SELECT n_nationkey, map('a', n_regionkey, 'b', 9)['a'] AS a, size(map_keys(map('a', 1, 'b', 2))) AS n FROM {nation}", "SELECT n_nationkey, MAP {'a': n_regionkey, 'b': 9}['a'] AS a, CAST(len(map_keys(MAP {'a': 1, 'b': 2})) AS INTEGER) AS n FROM nation")
both("fn_struct", "SELECT s.a AS a, s.b AS b FROM (SELECT named_struct('a', n_nationkey, 'b', n_name) AS s FROM {nation})", "SELECT s.a AS a, s.b AS b FROM (SELECT {'a': n_nationkey, 'b': n_name} AS s FROM nation)")


@query("SELECT event_id, props->>'$.k' AS k, json_extract_string(props, '$.none') AS none FROM events")
def fn_json(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", D.json_extract_string(p, "$.k").alias("k"), D.json_extract_string(p, "$.none").alias("none"))


@query("SELECT event_id, CAST(round(value) AS INTEGER) AS a, CAST(event_id AS VARCHAR) AS b, TRY_CAST(event_type AS INTEGER) AS c, CAST(event_id AS DOUBLE) AS e FROM events")
def fn_cast(spark, d):
    return table(spark, d, "events").select("event_id", D.to_int(F.col("value")).alias("a"), F.col("event_id").cast("string").alias("b"), F.col("event_type").try_cast("int").alias("c"), F.col("event_id").cast("double").alias("e"))


both("fn_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c, coalesce(nullif(o_orderpriority, '1-URGENT'), 'top') AS p FROM {orders}")
both("sql_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
both("sql_pivot", "SELECT * FROM (SELECT c_mktsegment, c_nationkey % 2 AS odd FROM {customer}) PIVOT (count(*) FOR odd IN (0 AS even_n, 1 AS odd_n))", "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey % 2 = 0) AS even_n, count(*) FILTER (WHERE c_nationkey % 2 = 1) AS odd_n FROM customer GROUP BY 1")
both("sql_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders i WHERE i.o_custkey = o.o_custkey)")


# Event time.
@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    out = event_time.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1")
def sliding(spark, d):
    out = event_time.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", [], [F.count("*").alias("n")])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session(spark, d):
    out = event_time.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
