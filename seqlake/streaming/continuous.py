"""Continuous queries: one query run anew whenever the sink tells of new data."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row

from ..plans.engine import Engine, Mode, NoData
from .watermark import MemWatermark


@dataclass(frozen=True)
class Result:
    high: int
    columns: list[str]
    rows: list[Any]


class Continuous:
    """Runs sql on each tick and hands its rows over through a bounded buffer.

    Incremental queries return what lies at or over the watermark and move it to
    the highest sequence plus one; a tick without new sequences emits nothing.
    Cumulative ones emit at every tick. The watermark moves before delivery, so
    a crash may lose a result (at_least_once=True: after it, so that it may
    repeat one). A result is held by the driver, as its caller takes it row by
    row: the query is to state an aggregate or a limit. Every stream has a session of its own, as views are a session's.
    """

    def __init__(self, engine: Engine, sql: str, mode: Mode = Mode.INCREMENTAL, start: int = 0, store: Any = None, bind: Callable[[Row], Any] | None = None, buffer: int = 1, at_least_once: bool = False):
        if not sql.strip():
            raise ValueError("the query is empty")
        self.engine = Engine(engine.spark.newSession(), engine.path, engine.bucket_size, engine.view, engine.seq, engine.dedup, engine.schema, list(engine.init))
        self.sql, self.mode, self.start, self.store = sql, mode, start, store if store is not None else MemWatermark()
        self.bind, self.at_least_once = bind or (lambda r: r), at_least_once
        self.results: queue.Queue[Result | BaseException | None] = queue.Queue(max(1, buffer))
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def trigger(self) -> Result | None:
        """One tick; None if there is nothing to emit."""
        high = self.engine.visible_high()
        if high is None:
            return None
        old = 0
        if self.mode is Mode.INCREMENTAL:
            old, _ = self.store.load()
            if old > high:
                return None
        try:
            df, _ = self.engine.window(self.mode, self.start, old, high)
        except NoData:
            return None
        df.createOrReplaceTempView(self.engine.view)
        out = self.engine.spark.sql(self.sql)
        result = Result(high, out.columns, [self.bind(r) for r in out.collect()])
        if self.mode is Mode.INCREMENTAL:
            if self.at_least_once:
                self._deliver(result)
            self.store.save(old, high + 1)
            if self.at_least_once:
                return None
        return result

    def _deliver(self, result: Result) -> None:
        while not self._stop.is_set():
            try:
                return self.results.put(result, timeout=0.1)
            except queue.Full:
                continue

    def run(self, ticks: queue.Queue) -> Continuous:
        """Follow a queue of ticks in a thread; None ends it. Errors are put among the results and end it too."""

        def loop() -> None:
            try:
                while not self._stop.is_set():
                    try:
                        tick = ticks.get(timeout=0.1)
                    except queue.Empty:
                        continue
                    if tick is None:
                        break
                    if (result := self.trigger()) is not None:
                        self._deliver(result)
            except BaseException as e:
                self._deliver(e)
            finally:
                self._deliver(None)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def __iter__(self) -> Iterator[Result]:
        while (item := self.results.get()) is not None:
            if isinstance(item, BaseException):
                raise item
            yield item

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join(30)
