"""The command line: stream a CSV into a log, or follow a log with a query.

    python -m seqlake.app --mode producer --csv reviews.csv --log s3://bucket/wal
    python -m seqlake.app --mode consumer --sql "SELECT ..." --log /shared/log --out-dir /shared/out

Options come from defaults, over them a JSON file (--config), over that flags.
In the file durations are whole milliseconds under names with _ms, and a value
of zero or an empty one leaves the default in place; a switch may be false.
"""

from __future__ import annotations

import argparse
import csv
import json
import shutil
import sys
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from .plans.engine import Engine, Mode, NoData
from .sources.codec import NONE, ZSTD
from .sources.files import REVIEW_KEYS, REVIEW_SCHEMA
from .sources.log import FileCursor, SeqRange, Writer, WriterOptions
from .sources.store import S3Store, open_store
from .streaming.sink import Sink, json_decoder

#: Bytes of a cell that the console shows.
CELL = 48
CLEAR = "\033[H\033[2J"


@dataclass
class Config:
    mode: str = ""
    log: str = "./_log"
    endpoint: str = ""
    access_key: str = ""
    secret_key: str = ""
    region: str = ""
    create_bucket: bool = True
    segment_prefix: str = "segments"
    csv: str = ""
    batch_size: int = 1
    append_delay: float = 0.5
    loop: bool = False
    flush_interval: float = 0.2
    segment_max_bytes: int = 65_536
    sql: str = ""
    incremental: bool = False
    start_seq: int = 0
    out_dir: str = "./_out"
    cursor_path: str = ""
    bucket_size: int = 1000
    max_rows: int = 2000
    compression: str = "zstd"
    poll_interval: float = 1.0
    dedup: bool = True
    no_clear: bool = False
    follow: bool = True
    ingest_per_tick: int = 0
    reset: bool = False

    def options(self) -> dict[str, str]:
        """What a store needs beside its path."""
        named = {"endpoint": self.endpoint, "region": self.region, "access_key": self.access_key, "secret_key": self.secret_key}
        return {k: v for k, v in named.items() if v}


def overlay(config: Config, path: str) -> None:
    """Put a JSON file's values over config's. Names that nobody knows are left out; a value of another kind is an error."""
    try:
        held = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ValueError(f"config {path}: {e}") from e
    for f in fields(config):
        old = getattr(config, f.name)
        value, kind = held.get(f"{f.name}_ms" if isinstance(old, float) else f.name), int if isinstance(old, float) else type(old)
        if value is None:
            continue
        if type(value) is not kind:
            raise ValueError(f"config {path}: {f.name} is to be {kind.__name__}")
        if isinstance(old, bool) or value:
            setattr(config, f.name, value / 1000 if isinstance(old, float) else value)


def load_config(args: list[str]) -> Config:
    config, first = Config(), argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--config")
    if path := first.parse_known_args(args)[0].config:
        overlay(config, path)
    parser = argparse.ArgumentParser("seqlake", parents=[first], allow_abbrev=False)
    for f in fields(config):
        old, flag = getattr(config, f.name), "--" + f.name.replace("_", "-")
        if isinstance(old, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=old)
        else:
            parser.add_argument(flag, type=type(old), default=old)
    for name, value in vars(parser.parse_args(args)).items():
        if name != "config":
            setattr(config, name, value)
    config.cursor_path = config.cursor_path or str(Path(config.out_dir) / "cursor")
    if config.mode not in ("producer", "consumer"):
        raise ValueError("--mode is producer or consumer")
    if config.mode == "producer" and not config.csv:
        raise ValueError("a producer needs --csv")
    if config.mode == "consumer" and not config.sql:
        raise ValueError("a consumer needs --sql")
    return config


def reviews(path: str) -> Iterator[dict[str, Any]]:
    """A CSV's rows as payloads, a row at a time: the header and rows of fewer than five fields are left out, bad numbers are 0."""

    def number(text: str) -> int:
        try:
            return int(text)
        except ValueError:
            return 0

    with open(path, newline="", encoding="utf-8") as f:
        rows = csv.reader(f)
        next(rows, None)
        for row in rows:
            if len(row) >= 5:
                index, review, product, rating, text = (x.strip(" \t") for x in row[:5])
                yield {"index": number(index), "review_id": review, "product": product, "rating": number(rating), "text": text}


def stream_pass(writer: Writer, rows: Iterator[dict[str, Any]], batch: int, delay: float, stop: threading.Event, tell: Callable[[list[dict], SeqRange], None]) -> int:
    """Append every row once, `batch` of them a group; each group is durable before the next. The number of rows."""
    held: list[dict[str, Any]] = []
    n = 0

    def put() -> None:
        nonlocal n
        tell(held, writer.append([json.dumps(r, ensure_ascii=False).encode() for r in held]).wait())
        n += len(held)
        held.clear()
        stop.wait(delay)

    for row in rows:
        if stop.is_set():
            return n
        held.append(row)
        if len(held) >= max(1, batch):
            put()
    if held and not stop.is_set():
        put()
    return n


def produce(config: Config, stop: threading.Event, out: TextIO = sys.stdout) -> int:
    """Stream the CSV into the log, once or, with loop, until stopped; each pass has sequences of its own. The rows appended."""

    def tell(rows: list[dict], at: SeqRange) -> None:
        print(f"appended {len(rows)} row{'s' * (len(rows) > 1)} seq=[{at.first}..{at.last}]", file=out, flush=True)

    store = open_store(config.log, **config.options())
    if config.create_bucket and isinstance(store, S3Store):
        store.make_bucket()
    options = WriterOptions(segment_bytes=config.segment_max_bytes, flush_seconds=config.flush_interval, compression=ZSTD if config.compression == "zstd" else NONE)
    total = 0
    with Writer(store, options, prefix=config.segment_prefix) as writer:
        while not stop.is_set():
            n = stream_pass(writer, reviews(config.csv), config.batch_size, config.append_delay, stop, tell)
            if not n and not stop.is_set():
                raise ValueError(f"no rows in {config.csv}")
            total += n
            if not config.loop:
                break
    return total


def shown(value: Any) -> str:
    """A cell: one line, cut to CELL bytes with a mark."""
    text = "" if value is None else str(value).replace("\n", " ")
    raw = text.encode()
    return text if len(raw) <= CELL else raw[: CELL - 1].decode(errors="ignore") + "…"


def grid(columns: list[str], rows: list[list[str]]) -> str:
    """Columns side by side, two spaces between them."""
    every = [columns, *rows]
    wide = [max(len(r[i]) for r in every) for i in range(len(columns))]
    return "".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() + "\n" for r in every)


class Console:
    """Draws results, in place on a terminal."""

    def __init__(self, config: Config, out: TextIO = sys.stdout):
        self.out, self.clear = out, out.isatty() and not config.no_clear
        self.mode = "incremental" if config.incremental else "cumulative"

    def _begin(self) -> None:
        print(CLEAR if self.clear else f"--- refresh @ {time.strftime('%H:%M:%S')} ---", end="" if self.clear else "\n", file=self.out)

    def draw(self, df: DataFrame, low: int, high: int) -> int:
        """The frame of a result that a screen is to hold; the number of rows."""
        rows = [[shown(v) for v in r] for r in df.collect()]
        self._begin()
        print(grid(df.columns, rows), end="", file=self.out)
        print(f"\n- {self.mode}  window=[{low}, {high}]  rows={len(rows)}  {time.strftime('%H:%M:%S')} -", file=self.out, flush=True)
        return len(rows)

    def wait(self, watermark: int) -> None:
        self._begin()
        print(f"waiting for data...  ({self.mode}, watermark={watermark}, {time.strftime('%H:%M:%S')})", file=self.out, flush=True)


class Consumer:
    """Materializes the log and runs the query, tick by tick."""

    def __init__(self, spark: SparkSession, config: Config, out: TextIO = sys.stdout):
        self.config, self.console, self.watermark = config, Console(config, out), 0
        if config.reset:
            shutil.rmtree(config.out_dir, ignore_errors=True)
            Path(config.cursor_path).unlink(missing_ok=True)
        Path(config.cursor_path).parent.mkdir(parents=True, exist_ok=True)
        self.sink = Sink(
            spark, config.log, config.out_dir, json_decoder(REVIEW_SCHEMA, REVIEW_KEYS), cursor=FileCursor(config.cursor_path), bucket_size=config.bucket_size,
            max_rows=config.max_rows, per_poll=config.ingest_per_tick if config.follow else 0, codec=config.compression, store=config.options(),
        )
        self.engine = Engine(spark, config.out_dir, config.bucket_size, dedup=config.dedup)

    def emit(self) -> None:
        """Run the query and draw its result; an incremental one goes on from where it ended."""
        c = self.config
        try:
            df, high = self.engine.query(c.sql, Mode.INCREMENTAL if c.incremental else Mode.CUMULATIVE, c.start_seq, self.watermark)
        except NoData:
            return self.console.wait(self.watermark)
        self.console.draw(df, self.watermark if c.incremental else c.start_seq, high)
        if c.incremental:
            self.watermark = high + 1

    def run(self, stop: threading.Event) -> None:
        """One-shot: everything, then one result. Else a poll and a result a tick until stopped; what fails is told and tried again."""
        if not self.config.follow:
            self.sink.drain()
            return self.emit()
        while not stop.is_set():
            for step in (self.sink.poll, self.emit):
                try:
                    step()
                except Exception as e:
                    print(f"{step.__name__}: {e}", file=sys.stderr)
            stop.wait(self.config.poll_interval)


def main(args: list[str] | None = None) -> None:
    stop = threading.Event()
    try:
        config = load_config(sys.argv[1:] if args is None else args)
    except ValueError as e:
        sys.exit(f"seqlake: {e}")
    try:
        if config.mode == "producer":
            produce(config, stop)
        else:
            Consumer(SparkSession.builder.getOrCreate(), config).run(stop)
    except KeyboardInterrupt:
        stop.set()


if __name__ == "__main__":
    main()
