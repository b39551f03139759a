"""Near copies for the pipeline: SimHash and BK-trees inside shards of MinHash bands, decided by the exact Jaccard similarity.

Rows are linked whose sets of five-word shingles have a similarity of 0.8 or
more. Of 8999 such pairs of different sets on 0.1 GB the 64-bit fingerprints
differ in up to 22 bits, and in more than 4 for 88 %; no blocks of bits that a
search could be dealt by agree at such a radius. So a shard is the sets that share a
MinHash band instead; its BK-tree, over SimHash fingerprints, is followed within RADIUS,
and the two sets of a pair that it finds are compared.

Rows of equal sets are one group before that. In every shard each set is first
compared with a leader, the one that shares bands with most sets, and in shards
of more than SMALL sets with two others. Pairs within the radius that no link
joins after that are all compared: those of a small shard as pairs, those of a
large one in a task that has its sets. Of a shard that is too large for a task,
each pair of slices is one. So every pair of a shard is compared or joined
already, and groups of copies aren't expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, settle, with_columns

WORDS, SIMILARITY = 5, 0.8
#: A pair at a similarity of 0.8 differs in a bit with probability 0.15, of sets of four and five shingles 0.19: in more than 26 of 64 with one of 2e-6 at most.
RADIUS = 26
#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 24 = 7e-5.
BANDS, DEPTH, SEED = 24, 5, 42
SMALL, LEADERS = 16, 3
#: Sets, and shingles in all, of a slice of a large shard.
HOT, HEAVY = 2048, 1 << 20
#: Rows (two numbers each) that are broadcast at most to the texts and sets that they are of; more are shuffled.
FETCHED = 1 << 21
#: Shingles that are permuted at once.
STEP = 1 << 12

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * DEPTH, 1), np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of UTF-8 text's shingles, sorted; a text of fewer words is one shingle."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    norm = b" ".join(w)
    ends = list(accumulate([len(x) + 1 for x in w]))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(norm[a : b - 1], SEED) for a, b in zip(starts, ends[min(words, len(w)) - 1 :])])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of the set's MinHash; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for at in range(0, len(own), STEP):
        np.minimum(least, (own[None, at : at + STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    rows = least.reshape(BANDS, DEPTH)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def _signed(texts: pa.Array) -> dict[str, pa.Array]:
    own = [shingles(t.as_py()) for t in texts]
    return {
        "own": pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in own], pa.int64()),
        "n": pa.array([len(x) for x in own], pa.int64()),
        "bands": pa.array([bands(x) for x in own], pa.list_(pa.int64())),
    }


def _shingled(texts: pa.Array) -> dict[str, pa.Array]:
    own = [shingles(t.as_py()) for t in texts]
    fps = np.fromiter((simhash.fold(x.byteswap().tobytes()) for x in own), np.uint64, len(own))
    ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
    every = np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)
    return {"set": pa.ListArray.from_arrays(pa.array(ends), pa.array(every)), "fp": pa.array(fps.view(np.int64))}


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _sizes(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be as similar."""
    return np.minimum(a, b) >= np.maximum(a, b) * (similarity - 1e-9)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about so many rows, of whole runs of the first `keys` columns, and the run that each row is in."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        both = pa.Table.from_batches(held)
        key = np.stack([both.column(i).to_numpy() for i in range(keys)], axis=1)
        run = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
        whole = len(run) if last else int(np.searchsorted(run, run[-1]))
        held[:] = both.slice(whole).to_batches()
        if whole:
            yield both.slice(0, whole), run[:whole]

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from cut(False)
    if held:
        yield from cut(True)


def _near(similarity: float):
    """Rows (key, own, n, fp, label) sorted by key -> pairs (u, v) within the radius of a shard's sets that aren't joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both, shard in _runs(batches, 1, 1 << 17):
            own, n, fp, label = (both.column(c).to_numpy() for c in ("own", "n", "fp", "label"))
            for a, b in simhash.bk_links(shard, fp.view(np.uint64), RADIUS):
                fits = _sizes(n[a], n[b], similarity) & (label[a] != label[b])
                ends = np.sort(np.stack([own[a[fits]], own[b[fits]]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["u", "v"])

    return run


def _joined(similarity: float):
    """Rows (key, i, j, own, n, label, fp, set) sorted by the first three -> pairs (u, v) that link components of a shard; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both, shard in _runs(batches, 3, HOT):
            own, n, fp = (both.column(c).to_numpy() for c in ("own", "n", "fp"))
            # Components are told apart by shard, as a link in one says nothing to the task that has another.
            _, root = np.unique(np.stack([shard, both.column("label").to_numpy()], axis=1), axis=0, return_inverse=True)
            root, up, found = root.ravel(), np.arange(len(own)), []
            sets = pa.concat_arrays(both.column("set").chunks)
            ends, every = sets.offsets.to_numpy(), sets.values.to_numpy()
            read = lambda i: every[ends[i] : ends[i + 1]]

            def top(k: int) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            for a, b in simhash.bk_links(shard, fp.view(np.uint64), RADIUS):
                while (up[up] != up).any():
                    up[:] = up[up]
                worth = _sizes(n[a], n[b], similarity) & (up[root[a]] != up[root[b]])
                for x, y in zip(a[worth].tolist(), b[worth].tolist()):
                    p, q = top(root[x]), top(root[y])
                    if p != q and jaccard(read(x), read(y)) >= similarity:
                        up[p] = q
                        found.append((min(own[x], own[y]), max(own[x], own[y])))
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """df, settled, to be broadcast if it has at most FETCHED rows."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= FETCHED else df


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of some ids, found before sets are shuffled where the ids are few."""
    return sets.join(_few(ids.distinct()), "own", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    pairs = _few(pairs)
    a = sets.select(F.col("own").alias("u"), F.col("set").alias("a"))
    b = _only(sets, pairs.select(F.col("v").alias("own"))).select(F.col("own").alias("v"), F.col("set").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    both = a.join(pairs, "u").join(b, "v").where(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9)
    return settle(both.select("u", "v"))


def _led(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v), within the radius, of every set with its shards' leaders."""
    degree = shared.groupBy("own").agg(F.sum("size").alias("degree"))
    orders: list[Column] = [F.struct("degree", "own"), *[F.xxhash64("own", F.lit(k)) for k in range(1, LEADERS)]]
    leads = [F.max_by(F.struct("own", "n", "fp"), o) for o in orders]
    some = F.when(F.first("size") > SMALL, F.array_distinct(F.array(*leads))).otherwise(F.array(leads[0]))
    lead = shared.join(degree, "own").groupBy("key").agg(some.alias("leads")).select("key", F.explode("leads").alias("y"))
    joined = shared.alias("x").join(lead, "key")
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * (similarity - 1e-9)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    low, high = F.least("x.own", "y.own").alias("u"), F.greatest("x.own", "y.own").alias("v")
    return joined.where(fits & near & (F.col("x.own") != F.col("y.own"))).select(low, high).distinct()


def _rest(named: DataFrame, sets: DataFrame, similarity: float, parts: int) -> DataFrame:
    """Links (u, v) between components (label) that meet in a large shard."""
    slices = F.ceil(F.greatest(F.count("*") / HOT, F.sum("n") / HEAVY)).cast("int").alias("slices")
    open_ = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), slices).where("a != b").select("key", "slices")
    mine = F.pmod(F.xxhash64("own", F.lit(7)), F.col("slices")).cast("int")
    dealt = named.join(open_, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "own", "n", "label", "fp")
    dealt = settle(dealt)
    whole = dealt.join(_only(sets, dealt.select("own")).select("own", "set"), "own").select("key", "i", "j", "own", "n", "label", "fp", "set")
    return settle(whole.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "own").mapInArrow(_joined(similarity), "u long, v long").distinct())


def near_copies(numbered: DataFrame, row: str, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `numbered`: its number, doc_id, and `best`, the struct (no_id, doc_id, row) of the component's first row.

    Rows are linked where the Jaccard similarity of their sets of five-word
    shingles is at least `similarity`; texts without words are linked with each
    other. The first row has the smallest doc_id, then row number; null ids come
    last. numbered: doc_id, text and the settled, unique row number.
    """
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = numbered.select(F.col(row).alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    signed = settle(with_columns(text, _signed, "text", "own long, n long, bands array<long>", keep=False))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = settle(signed.groupBy("own").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands")))
    keyed = groups.select("own", "n", F.explode("bands").alias("key"))
    crowd = _few(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = settle(keyed.join(crowd, "key"))
    picked = _few(shared.select("own").distinct().join(groups.select("own", F.col("best.row").alias("row")), "own"))
    sets = settle(with_columns(text.join(picked, "row").select("own", "text"), _shingled, "text", "set array<long>, fp long", keep=False))
    shared = settle(shared.join(sets.select("own", "fp"), "own"))
    led = settle(_led(shared, similarity))
    links = _verified(led, sets, similarity)
    star = components(links).select(F.col("u").alias("own"), F.col("v").alias("label"))
    named = settle(shared.join(star, "own", "left").withColumn("label", F.coalesce("label", "own")))
    small, large = named.where(F.col("size") <= SMALL), named.where(F.col("size") > SMALL)
    pairs = small.select("key", "own", "n", "fp", "label").repartition(parts, "key").sortWithinPartitions("key", "own").mapInArrow(_near(similarity), "u long, v long")
    more = _verified(pairs.distinct().join(led, ["u", "v"], "left_anti"), sets, similarity)
    star = components(links.unionAll(more).unionAll(_rest(large, sets, similarity, parts)))
    star = settle(star.select(F.col("u").alias("own"), F.col("v").alias("label")))
    member = star.unionAll(star.select(F.col("label").alias("own"), "label").distinct())
    lowest = settle(member.join(groups, "own").groupBy("label").agg(F.min("best").alias("lowest")))
    named = settle(member.join(lowest, "label").select("own", "lowest"))
    every = settle(groups.join(named, "own", "left").select("own", F.coalesce("lowest", "best").alias("best")))
    return signed.join(every, "own").select(F.col("row").alias(row), "doc_id", "best")
