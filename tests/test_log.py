"""Codec, stores, writer and replica: round trips, corruption, faults, fencing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlake.sources import log
from seqlake.sources.codec import NONE, ZSTD, Corrupt, Entry, Group, Manifest, Snapshot, crc32c, decode_manifest, decode_segment, encode_manifest, encode_segment
from seqlake.sources.store import Conflict, FaultStore, LocalStore, MemStore, NotFound

QUICK = log.WriterOptions(first_wait=0.0001, segment_bytes=16)


def plain_crc(data):
    state = 0xFFFFFFFF
    for x in data:
        state ^= x
        for _ in range(8):
            state = state >> 1 ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_crc32c():
    assert crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 4095, 4096, 9001):
        data = random.Random(n).randbytes(n)
        assert crc32c(data) == plain_crc(data)


@pytest.mark.parametrize("compression", [NONE, ZSTD])
@pytest.mark.parametrize("legacy", [False, True])
def test_segment_round_trip(compression, legacy):
    records = [b"", b"a", b"x" * 1000]
    assert decode_segment(encode_segment(records, compression, legacy)) == records


def sample():
    m = Manifest(epoch=3, snapshot=Snapshot("snap", 2, 99))
    m.append("a", 3, (Group(0, 5, b"m"), Group(2, 6)))
    m.append("b", 1)
    m.append("c", 4)
    return m


def test_every_flipped_byte_is_detected():
    for data, decode in ((encode_segment([b"one", b"two"]), decode_segment), (encode_manifest(sample()), decode_manifest)):
        whole = decode(data)
        for i in range(len(data)):
            bad = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
            try:
                assert decode(bad) == whole
            except Corrupt:
                pass
        for i in range(len(data)):
            if data[:i]:
                with pytest.raises(Corrupt):
                    decode(data[:i])


def test_manifest_model():
    m = sample()
    assert [e.seq for e in m.entries] == [0, 3, 4] and m.next_seq == 8
    back = decode_manifest(encode_manifest(m))
    assert back == m
    assert m.locate(2) == (m.entries[0], 2) and m.locate(7) == (m.entries[2], 3) and m.locate(8) is None
    assert [e.location for e in m.suffix(3)] == ["b", "c"] and [e.location for e in m.after(3)] == ["c"] and [e.location for e in m.since(3)] == ["b", "c"]
    assert m.entries[0].group_of(1).payload == b"m" and m.entries[0].group_of(2).payload == b"" and list(m.tail(1)) == ["c"]
    assert m.segment_start(1) == 3
    with pytest.raises(IndexError):
        m.segment_start(3)
    assert m.truncate(2) == 1 and m.truncate(5) == 1 and m.next_seq == 8 and [e.location for e in m.entries] == ["c"]


def test_old_manifests():
    import struct

    def entry(version):
        body = struct.pack("<Q", 7) + (struct.pack("<I", 2) if version >= 3 else b"") + struct.pack("<H", 1) + b"k" + struct.pack("<I", 0)
        return struct.pack("<I", len(body)) + body

    for version in (1, 2, 3):
        snapshot = b"" if version == 1 else struct.pack("<HQq", 0, 0, 0)
        m = decode_manifest(entry(version) + snapshot + struct.pack("<IQQH", 1, 9, 4, version))
        assert m.entries == [Entry(7, 2 if version == 3 else 0, "k")] and (m.next_seq, m.epoch) == (9, 4)
        assert decode_manifest(encode_manifest(m)) == m
    assert decode_manifest(b"") == Manifest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 8), min_size=1, max_size=30), st.integers(0, 300))
def test_entries_tile_and_locate_is_exact(counts, x):
    m = Manifest()
    for i, n in enumerate(counts):
        m.append(f"s{i}", n)
    assert m.next_seq == sum(counts) and all(a.end == b.seq for a, b in zip(m.entries, m.entries[1:]))
    found = m.locate(x)
    assert (found is not None) == (x < m.next_seq)
    if found:
        assert found[0].seq + found[1] == x and m.suffix(x)[0] == found[0]
    m.truncate(x)
    assert all(e.end - 1 > x for e in m.entries) and m.next_seq == sum(counts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.integers(0, 40))
def test_replay_from_any_sequence(groups, start):
    store, want = MemStore(), []
    with log.Writer(store, log.WriterOptions(segment_bytes=8), background=False) as w:
        for i, n in enumerate(groups):
            own = [f"{i}_{j}".encode() for j in range(n)]
            want += own
            w.append(own)
    got = []
    replica = log.Replica(store, lambda r: got.append((r.seq, r.data)), start=start)
    replica.poll()
    assert got == [(i, d) for i, d in enumerate(want) if i >= start]


@pytest.mark.parametrize("make", [MemStore, None])
def test_conditional_writes(make, tmp_path):
    s = make() if make else LocalStore(tmp_path)
    tag = s.put("a/b", b"1", create=True)
    with pytest.raises(Conflict):
        s.put("a/b", b"2", create=True)
    new = s.put("a/b", b"2", match=tag)
    with pytest.raises(Conflict):
        s.put("a/b", b"3", match=tag)
    assert s.get("a/b") == (b"2", new) and s.list("a/") == ["a/b"]
    s.delete("a/b")
    s.delete("a/b")
    with pytest.raises(NotFound):
        s.get("a/b")


def test_groups_are_never_split():
    assert log.pack([4, 4, 9, 1, 30, 2], 10) == [[0, 1], [2, 3], [4], [5]]
    assert log.pack([4, 4], 0) == [[0, 1]]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("fault", ["clean", "ambiguous", "slow_ambiguous", "corrupt"])
def test_no_append_is_lost_or_doubled(seed, fault):
    inner = MemStore()
    store = FaultStore(inner, seed, **{fault: 0.2})
    acked, unknown = {}, []
    while len(acked) + len(unknown) < 30:
        try:
            w = log.Writer(store, QUICK, background=False)
        except log.Halted:
            continue
        for _ in range(10):
            name = f"{len(acked) + len(unknown)}".encode()
            ack = w.append([name, name + b"+"])
            try:
                w.flush()
                acked[name] = ack.wait(1).first
            except Exception:
                unknown.append(name)
                break
    held = []
    log.Replica(inner, lambda r: held.append((r.seq, r.data))).poll()
    assert [s for s, _ in held] == list(range(len(held)))
    names = [d for _, d in held]
    assert len(set(names)) == len(names)
    for name, seq in acked.items():
        assert held[seq][1] == name and held[seq + 1][1] == name + b"+"


def test_an_old_writer_is_fenced():
    store = MemStore()
    old = log.Writer(store, QUICK, background=False)
    new = log.Writer(store, QUICK, background=False)
    ack = old.append([b"zombie"])
    with pytest.raises(log.Fenced):
        old.flush()
    with pytest.raises(log.Fenced):
        ack.wait(1)
    with pytest.raises(log.Halted):
        old.append([b"again"])
    new.append([b"x"])
    new.close()
    assert log.load(store)[0].next_seq == 1


def test_budget_and_empty_groups():
    w = log.Writer(MemStore(), log.WriterOptions(in_flight_bytes=10), background=False)
    with pytest.raises(ValueError):
        w.append([])
    w.append([b"x" * 100])  # alone over the budget
    with pytest.raises(BlockingIOError):
        w.append([b"y"])
    w.flush()
    w.append([b"y"])
    w.close()


def test_paced_polls():
    store = MemStore()
    with log.Writer(store, log.WriterOptions(segment_bytes=1), background=False) as w:
        for i in range(5):
            w.append([b"%d" % i])
    replica = log.Replica(store, lambda r: None, per_poll=2)
    assert [replica.poll() for _ in range(4)] == [2, 2, 1, 0]


def test_cursor_object():
    store = MemStore()
    assert log.StoreCursor(store).load() is None
    log.StoreCursor(store).save(2**40)
    assert log.StoreCursor(store).load() == 2**40
    store.put("cursor", b"x")
    with pytest.raises(Corrupt):
        log.StoreCursor(store).load()


def test_cursor_file(tmp_path):
    c = log.FileCursor(tmp_path / "c")
    assert c.load() is None
    c.save(77)
    assert log.FileCursor(tmp_path / "c").load() == 77
    (tmp_path / "c").write_bytes(b"123")
    with pytest.raises(Corrupt):
        c.load()


def test_typed_applier_names_the_sequence():
    with pytest.raises(ValueError, match="record 4"):
        log.typed(int, lambda s, v: None)(log.Record(4, b"", b"x", 0, ""))
