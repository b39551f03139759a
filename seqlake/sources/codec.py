"""Wire formats: segments and manifests, little-endian, with CRC-32C.

A segment is a block of records, each a u32 length and its bytes, put through
zstd or not, and a footer. A manifest is the entries' frames, a snapshot block
and a footer. All older versions are read; segments v2 and manifests v4 are written.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import zstandard

# Fixed values of the formats.
NONE, ZSTD = 0, 1
SEGMENT_V1, SEGMENT_V2 = struct.Struct("<BIH"), struct.Struct("<BIIH")
FOOT_OLD, FOOT_V4 = struct.Struct("<IQQH"), struct.Struct("<IQQIH")
MAX_SEQ, MAX_LOCATION = 2**63 - 1, 65_535
CASTAGNOLI = 0x82F63B78


class Corrupt(ValueError):
    """Bytes that are no valid segment or manifest."""


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


_TABLE = _crc_table()
_BYTE = _TABLE.tolist()
#: Lane lengths of short and long inputs, and where an input is long.
_LANES, _LONG = (64, 1024), 1 << 18


def _advance(state: int, zeros: int) -> int:
    """The register after so many zero bytes, by repeated squaring of the one-byte step."""
    step = [_BYTE[(1 << i) & 255] ^ ((1 << i) >> 8) for i in range(32)]

    def times(matrix: list[int], v: int) -> int:
        out = 0
        for row in matrix:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    while zeros:
        if zeros & 1:
            state = times(step, state)
        step = [times(step, row) for row in step]
        zeros >>= 1
    return state


@cache
def _lane_shift(lane: int) -> list[list[int]]:
    """Tables that advance a register by one lane: one for each byte of the register."""
    unit = [_advance(1 << i, lane) for i in range(32)]
    tables = []
    for b in range(4):
        row = [0] * 256
        for v in range(256):
            for i in range(8):
                if v >> i & 1:
                    row[v] ^= unit[8 * b + i]
        tables.append(row)
    return tables


def crc32c(data: bytes) -> int:
    """CRC-32C; long inputs go through in equal lanes side by side, joined afterwards."""
    lane = _LANES[len(data) >= _LONG]
    state, lanes = 0xFFFFFFFF, len(data) // lane
    if lanes >= 4:
        grid = np.frombuffer(data, np.uint8, lanes * lane).reshape(lanes, lane).T
        own = np.zeros(lanes, np.uint32)
        for column in grid:
            own = _TABLE[(own ^ column) & 255] ^ (own >> 8)
        a, b, c, d = _lane_shift(lane)
        for x in own.tolist():
            state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ x
        data = data[lanes * lane :]
    for x in data:
        state = _BYTE[(state ^ x) & 255] ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def encode_segment(records: list[bytes], compression: int = NONE, legacy: bool = False) -> bytes:
    if compression not in (NONE, ZSTD):
        raise ValueError(f"unknown compression {compression}")
    block = b"".join(struct.pack("<I", len(r)) + r for r in records)
    if compression == ZSTD:
        block = zstandard.ZstdCompressor().compress(block)
    if legacy:
        return block + SEGMENT_V1.pack(compression, len(records), 1)
    head = struct.pack("<BI", compression, len(records))
    return block + SEGMENT_V2.pack(compression, len(records), crc32c(block + head), 2)


def decode_segment(data: bytes) -> list[bytes]:
    if len(data) < SEGMENT_V1.size:
        raise Corrupt("segment is shorter than its footer")
    version = struct.unpack("<H", data[-2:])[0]
    if version == 1:
        compression, count, _ = SEGMENT_V1.unpack(data[-SEGMENT_V1.size :])
        block = data[: -SEGMENT_V1.size]
    elif version == 2 and len(data) >= SEGMENT_V2.size:
        compression, count, crc, _ = SEGMENT_V2.unpack(data[-SEGMENT_V2.size :])
        block = data[: -SEGMENT_V2.size]
        if crc32c(block + struct.pack("<BI", compression, count)) != crc:
            raise Corrupt("segment checksum differs")
    else:
        raise Corrupt(f"segment version {version}")
    if compression == ZSTD:
        try:
            block = zstandard.ZstdDecompressor().decompressobj().decompress(block)
        except zstandard.ZstdError as e:
            raise Corrupt("segment block doesn't decompress") from e
    elif compression != NONE:
        raise Corrupt(f"segment compression {compression}")
    out, at = [], 0
    while at < len(block):
        if at + 4 > len(block):
            raise Corrupt("a record's length is cut off")
        n = int.from_bytes(block[at : at + 4], "little")
        at += 4 + n
        if at > len(block):
            raise Corrupt("a record is cut off")
        out.append(block[at - n : at])
    if len(out) != count:
        raise Corrupt(f"{len(out)} records, the footer says {count}")
    return out


@dataclass(frozen=True)
class Group:
    """One append: where its records begin in the segment, when it came, and its payload."""

    start: int
    ingest_ms: int
    payload: bytes = b""


@dataclass(frozen=True)
class Entry:
    """A segment and the sequences [seq, end) that it owns; count 0 is an old entry with one sequence for all its records."""

    seq: int
    count: int
    location: str
    groups: tuple[Group, ...] = ()

    @property
    def end(self) -> int:
        return self.seq + max(1, self.count)

    def group_of(self, record: int) -> Group | None:
        """The last group that begins at or before a record of the segment."""
        after = bisect_right(self.groups, record, key=lambda g: g.start)
        return self.groups[after - 1] if after else None


@dataclass(frozen=True)
class Snapshot:
    location: str
    through: int
    created_ms: int


@dataclass
class Manifest:
    entries: list[Entry] = field(default_factory=list)
    next_seq: int = 0
    epoch: int = 0
    snapshot: Snapshot | None = None

    def append(self, location: str, count: int, groups: tuple[Group, ...] = ()) -> Entry:
        if count < 1:
            raise ValueError("a segment holds a record at least")
        if len(location.encode()) > MAX_LOCATION:
            raise ValueError("location is too long")
        if self.next_seq + count > MAX_SEQ:
            raise ValueError("sequences are used up")
        entry = Entry(self.next_seq, count, location, groups)
        self.entries.append(entry)
        self.next_seq = entry.end
        return entry

    def locate(self, seq: int) -> tuple[Entry, int] | None:
        """The entry that owns seq and the place in it."""
        low, high = 0, len(self.entries)
        while low < high:
            mid = (low + high) // 2
            if self.entries[mid].end <= seq:
                low = mid + 1
            else:
                high = mid
        if low < len(self.entries) and self.entries[low].seq <= seq:
            return self.entries[low], seq - self.entries[low].seq
        return None

    def suffix(self, seq: int) -> list[Entry]:
        """Entries with any sequence at or after seq."""
        return self.entries[bisect_right(self.entries, seq, key=lambda e: e.end) :]

    def after(self, seq: int) -> list[Entry]:
        return [e for e in self.entries if e.seq > seq]

    def since(self, seq: int) -> list[Entry]:
        return [e for e in self.entries if e.seq >= seq]

    def tail(self, limit: int) -> dict[str, Entry]:
        return {e.location: e for e in self.entries[-limit:]} if limit > 0 else {}

    def segment_start(self, index: int) -> int:
        if not 0 <= index < len(self.entries):
            raise IndexError(f"segment {index} of {len(self.entries)}")
        return self.entries[index].seq

    def truncate(self, through: int) -> int:
        """Drop the entries all of whose sequences are at most `through`; the number dropped."""
        kept = [e for e in self.entries if e.end - 1 > through]
        dropped = len(self.entries) - len(kept)
        self.entries = kept
        return dropped


def _frame(e: Entry) -> bytes:
    place = e.location.encode()
    body = struct.pack("<QIH", e.seq, e.count, len(place)) + place + struct.pack("<I", len(e.groups))
    for g in e.groups:
        body += struct.pack("<IqI", g.start, g.ingest_ms, len(g.payload)) + g.payload
    return struct.pack("<I", len(body)) + body


def encode_manifest(m: Manifest) -> bytes:
    snapshot = m.snapshot or Snapshot("", 0, 0)
    place = snapshot.location.encode()
    data = b"".join(map(_frame, m.entries)) + place + struct.pack("<HQq", len(place), snapshot.through, snapshot.created_ms)
    head = struct.pack("<IQQ", len(m.entries), m.next_seq, m.epoch)
    return data + head + struct.pack("<IH", crc32c(data + head), 4)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupt("manifest is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        raise Corrupt("a location is no UTF-8") from e


def _entry(body: bytes, version: int) -> Entry:
    r = _Reader(body)
    (seq,) = r.unpack("<Q")
    count = r.unpack("<I")[0] if version >= 3 else 0
    location = _text(r.take(r.unpack("<H")[0]))
    groups = []
    for _ in range(r.unpack("<I")[0]):
        start, ms, n = r.unpack("<IqI")
        groups.append(Group(start, ms, r.take(n)))
    if r.at != len(body):
        raise Corrupt("bytes after an entry")
    if seq + max(1, count) > MAX_SEQ:
        raise Corrupt("a sequence doesn't fit a long")
    return Entry(seq, count, location, tuple(groups))


def decode_manifest(data: bytes) -> Manifest:
    if not data:
        return Manifest()
    if len(data) < FOOT_OLD.size:
        raise Corrupt("manifest is shorter than its footer")
    version = struct.unpack("<H", data[-2:])[0]
    if version not in (1, 2, 3, 4):
        raise Corrupt(f"manifest version {version}")
    if version == 4:
        if len(data) < FOOT_V4.size:
            raise Corrupt("manifest is shorter than its footer")
        count, next_seq, epoch, crc, _ = FOOT_V4.unpack(data[-FOOT_V4.size :])
        if crc32c(data[:-6]) != crc:
            raise Corrupt("manifest checksum differs")
        body = data[: -FOOT_V4.size]
    else:
        count, next_seq, epoch, _ = FOOT_OLD.unpack(data[-FOOT_OLD.size :])
        body = data[: -FOOT_OLD.size]
    if next_seq > MAX_SEQ:
        raise Corrupt("a sequence doesn't fit a long")
    snapshot = None
    if version >= 2:
        if len(body) < 18:
            raise Corrupt("manifest has no snapshot block")
        n, through, created = struct.unpack("<HQq", body[-18:])
        if len(body) < 18 + n:
            raise Corrupt("snapshot location is cut off")
        place = _text(body[len(body) - 18 - n : len(body) - 18])
        snapshot = Snapshot(place, through, created) if place else None
        body = body[: len(body) - 18 - n]
    r, entries = _Reader(body), []
    while r.at < len(body):
        entries.append(_entry(r.take(r.unpack("<I")[0]), version))
    if len(entries) != count:
        raise Corrupt(f"{len(entries)} entries, the footer says {count}")
    for a, b in zip(entries, entries[1:]):
        if b.seq < a.end:
            raise Corrupt("entries overlap")
    return Manifest(entries, next_seq, epoch, snapshot)
