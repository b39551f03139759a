"""Watermark stores: the next sequence that a query is to return, guarded by compare-and-set."""

from __future__ import annotations

import fcntl
import threading
from pathlib import Path

from ..sources.store import Busy, Conflict, NotFound, Store


class WatermarkConflict(RuntimeError):
    """Another one has moved the watermark."""


class MemWatermark:
    def __init__(self) -> None:
        self._value: int | None = None
        self._lock = threading.Lock()

    def load(self) -> tuple[int, bool]:
        """(value, whether one was saved)."""
        with self._lock:
            return self._value or 0, self._value is not None

    def save(self, old: int, new: int) -> None:
        """Unset counts as 0."""
        with self._lock:
            if (self._value or 0) != old:
                raise WatermarkConflict(f"{self._value}, not {old}")
            self._value = new


class FileWatermark:
    """Decimal text, replaced by rename; a lock file makes the comparison safe between processes."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> tuple[int, bool]:
        if not self.path.exists():
            return 0, False
        return int(self.path.read_text().strip()), True

    def save(self, old: int, new: int) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(self.path.with_name(f".{self.path.name}.lock"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            now, _ = self.load()
            if now != old:
                raise WatermarkConflict(f"{now}, not {old}")
            fresh = self.path.with_name(f".{self.path.name}.tmp")
            fresh.write_text(f"{new}\n")
            fresh.replace(self.path)


class StoreWatermark:
    """Decimal text in an object of a store; its conditional writes make the comparison safe between machines."""

    def __init__(self, store: Store, key: str = "watermark"):
        self.store, self.key = store, key

    def _now(self) -> tuple[int, str | None]:
        try:
            raw, tag = self.store.get(self.key)
        except NotFound:
            return 0, None
        return int(raw), tag

    def load(self) -> tuple[int, bool]:
        value, tag = self._now()
        return value, tag is not None

    def save(self, old: int, new: int) -> None:
        now, tag = self._now()
        if now != old:
            raise WatermarkConflict(f"{now}, not {old}")
        data = f"{new}\n".encode()
        try:
            self.store.put(self.key, data, create=True) if tag is None else self.store.put(self.key, data, match=tag)
        except (Conflict, Busy) as e:
            raise WatermarkConflict(f"{self.key} has moved") from e
