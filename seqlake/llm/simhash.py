"""SimHash near-duplicates: BK-tree search inside exact band shards.

A document's fingerprint has 64 bits. Two fingerprints with at most RADIUS = 4
differing bits agree in at least two of six blocks of bits, so a shard for each
pair of blocks and each value of them (15 copies of every distinct fingerprint)
holds every link somewhere. A shard is one BK-tree, its children keyed by the
Hamming distance to the parent; a search follows only the edges whose key is
within the radius of the distance at hand. Trees are not broadcast: distinct
fingerprints grow with the corpus, so a tree goes to the task that holds its
queries. A shard of more than HOT fingerprints is dealt into slices and each
pair of slices becomes a shard, so no task holds more than two slices.
A shard returns the edges of its links' components to their first fingerprint,
never all pairs; the star rounds of common.components join the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, settle, with_columns

WORDS, RADIUS, SEED = 4, 4, 42
#: Blocks of the 64 bits as (lowest bit, width).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
HOT = 4096
#: (query, node) pairs that one step of a search holds.
FRONTIER = 1 << 18

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer; zero without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    norm = b" ".join(w)
    if len(w) <= words:
        hashes = xxhash.xxh64_digest(norm, SEED)
    else:
        ends = list(accumulate([len(x) + 1 for x in w]))
        starts = [0, *ends]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(norm[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])])
    return fold(hashes)


def fold(hashes: bytes) -> int:
    """The fingerprint of big-endian 64-bit hashes: the bits that are set in over half of them."""
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, len(h), 1 << 17):
        counts += np.bincount((h[at : at + (1 << 17)] + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    on = (counts @ _BITS) * 2 > len(h)
    return int.from_bytes(np.packbits(on.ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp holds the fingerprint's 64 bits as a long."""

    def make(texts: pa.Array) -> dict[str, pa.Array]:
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        return {"fp": pa.array(fps.view(np.int64))}

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return with_columns(narrow, make, "text", "fp long", keep=False).select("doc_id", "fp")


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over runs of equal `shard`; fp: distinct inside a run. Returns (parent, distance); roots are their own parents.

    All trees grow at once, a level at a time: the first item that reaches a
    node at a distance becomes its child there, the others go on from it.
    """
    n = len(fp)
    root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    parent = np.repeat(root, np.diff(np.r_[root, n]))
    distance = np.zeros(n, np.int64)
    rest = np.flatnonzero(parent != np.arange(n))
    while len(rest):
        d = np.bitwise_count(fp[rest] ^ fp[parent[rest]]).astype(np.int64)
        key = parent[rest] * 65 + d
        _, first, where = np.unique(key, return_index=True, return_inverse=True)
        child = rest[first][where]
        settled = child == rest
        distance[rest[settled]] = d[settled]
        parent[rest[~settled]] = child[~settled]
        rest = rest[~settled]
    return parent, distance


def bk_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every link (later item, earlier item) inside a shard, by searching its BK-tree; in parts."""
    n = len(fp)
    parent, distance = bk_forest(shard, fp)
    root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    sizes = np.diff(np.r_[root, n])
    inner = np.flatnonzero(parent != np.arange(n))
    key = parent[inner] * 65 + distance[inner]
    order = np.argsort(key, kind="stable")
    key, child = key[order], inner[order]
    start = np.repeat(root, sizes)
    load = np.cumsum(np.repeat(sizes, sizes))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + FRONTIER, "right")))
        query = np.arange(at, end)
        node = start[query]
        while len(query):
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right")
            many = np.maximum(high - low, 0)
            total = int(many.sum())
            if not total:
                break
            before = np.cumsum(many) - many
            query = np.repeat(query, many)
            node = child[np.arange(total) + np.repeat(low - before, many)]
        at = end


def forest_labels(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest item of each item's component under the links."""
    label = np.arange(n)
    for a, b in links:
        while True:
            la, lb = label[a], label[b]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            open_ = low != high
            if not open_.any():
                break
            np.minimum.at(label, high[open_], low[open_])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (shard string-like binary key, fp) sorted by shard -> star edges."""

    def solve(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label = forest_labels(len(fp), bk_links(shard, fp))
        own = np.flatnonzero(label != np.arange(len(fp)))
        ends = [fp[own].view(np.int64), fp[label[own]].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        held.append((key, b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)))
        rows += b.num_rows
        if rows >= 1 << 18:
            key, fp = (np.concatenate(x) for x in zip(*held))
            cut = len(key) - int((key == key[-1]).all(axis=1)[::-1].argmin())
            if cut < len(key) or not (key == key[-1]).all():
                run = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
                yield solve(run[:cut], fp[:cut])
                held, rows = [(key[cut:], fp[cut:])], len(key) - cut
    if rows:
        key, fp = (np.concatenate(x) for x in zip(*held))
        yield solve(np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)]), fp)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fp with at most RADIUS differing bits."""
    keys = []
    for k, (a, b) in enumerate(combinations(BLOCKS, 2)):
        part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1)) for at, w in (a, b)]
        keys.append(F.shiftleft(part[0], b[1]) + part[1] + F.lit(k << 22))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = settle(keyed.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("slices")))
    if crowded.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")
        other = F.sequence(F.lit(0), F.col("slices") - 1)
        dealt = (
            keyed.join(crowded, "key", "left").select("key", "fp", F.coalesce("slices", F.lit(1)).alias("slices"))
            .select("key", "fp", mine.alias("mine"), F.explode(other).alias("other"))
            .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
        )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(_search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id.

    component_id is the smallest doc_id that is reachable over fingerprints
    with at most four differing bits, the row's own included. A null text, or
    one without words, has fingerprint zero and links like any other. A row
    with a null doc_id takes part; component_id is null where a component has
    no other ids. Repeated rows each get their row. An empty table gives an
    empty result. Other columns are not read.
    """
    fps = settle(fingerprints(docs, id_col, text_col))
    first = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    star = components(links(first.select("fp")).distinct())
    star = settle(star.select(F.col("u").alias("fp"), F.col("v").alias("label")))
    member = star.unionAll(star.select(F.col("label").alias("fp"), "label").distinct())
    lowest = settle(member.join(first, "fp").groupBy("label").agg(F.min("first").alias("component_id")))
    named = settle(member.join(lowest, "label").select("fp", "component_id"))
    every = settle(first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return fps.join(every, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies (nearcopies): that with the smallest doc_id, null ids last, then the first row.

    Texts that are null or have no words are copies of each other. Repeated
    rows are copies; rows that share an id and no text aren't. An empty table
    stays empty. docs may have any columns but _llm_row.
    """
    from .nearcopies import near_copies

    numbered = settle(docs.withColumn("_llm_row", F.monotonically_increasing_id()))
    drop = settle(near_copies(numbered, "_llm_row").where("_llm_row != best.row").select("_llm_row"))
    return numbered.join(drop, "_llm_row", "left_anti").drop("_llm_row")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
