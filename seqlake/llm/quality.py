"""Quality by importance resampling over hashed n-grams.

Two generative models of hashed words and word pairs are counted: one of the
target (documents labelled good) and one of all raw text. A document's weight
is the ratio of its probabilities under them, over its whole text. Gumbel noise
seeded by doc_id is added to the log weight and the highest keys are taken:
that draws without replacement in proportion to the weights.

The target model is fitted on at most TARGET labelled documents, those whose
ids have the smallest hashes; the raw model and the scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .common import chunks, settle, threshold, with_columns

BUCKETS, BITS = 1 << 14, 14
TARGET = 20_000
FRACTION, SEED, ALPHA = 0.5, 17, 1.0

_K = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_PLACES = 64
_POWER = np.cumprod(np.full(_PLACES, 0x100000001B3, np.uint64), dtype=np.uint64)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of the texts, and the text that each belongs to.

    A word is a run of letters, digits and bytes over 127, or of punctuation;
    its hash covers all its bytes (a power of the place, which recurs after 64).
    """
    raw = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    kind = _KIND[raw]
    change = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    start = change[kind[change] != 0]
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    runs = np.diff(np.r_[change, len(raw)])
    place = np.arange(len(raw)) - np.repeat(change, runs)
    part = (raw.astype(np.uint64) + np.uint64(1)) * _POWER[place % _PLACES]
    part *= (place // _PLACES + 1).astype(np.uint64)
    word = np.add.reduceat(part, change)[kind[change] != 0] * _K
    word ^= word >> np.uint64(29)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.searchsorted(np.cumsum(lens), start, "right")
    pair = (word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:])[doc[1:] == doc[:-1]]
    both = np.concatenate([word * _K, pair * _K])
    return (both >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        texts = [t or b"" for t in b.column(0).to_pylist()]
        good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
            g, d = grams(texts[i:j])
            raw += np.bincount(g, minlength=BUCKETS)
            target += np.bincount(g[good[i:j][d]], minlength=BUCKETS)
    if raw.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["k", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of the target's and the raw text's probability of each bucket; zero without labelled or raw text."""
    ship(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TARGET).select("doc_id", F.lit(True).alias("good"))
    # At most TARGET ids.
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(good), "doc_id", "left")
    counts = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count, "k long, raw long, target long")
    counts = counts.groupBy("k").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["k"]], target[counts["k"]] = counts["raw"], counts["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    p = (target + ALPHA) / (target + ALPHA).sum()
    # The raw model smooths the target's: rare buckets don't decide.
    r = (raw + ALPHA) / (raw + ALPHA).sum()
    mixed = 0.9 * p + 0.1 * r
    return np.log(mixed / r)


def keyed(scored: DataFrame) -> DataFrame:
    """scored (doc_id, log_weight) with key: the log weight plus Gumbel noise that the doc_id seeds."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, log_weight, key, selected for every row.

    A null or empty text has log weight 0. Rows that repeat a doc_id have the
    same noise; rows whose keys tie at the threshold are taken together. The
    share taken is `fraction` of the rows. An empty table gives an empty result.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make(texts: pa.Array) -> dict[str, pa.Array]:
        own = [t or b"" for t in texts.to_pylist()]
        out = np.zeros(len(own))
        for i, j in chunks(np.fromiter(map(len, own), np.int64, len(own))):
            g, d = grams(own[i:j])
            out[i:j] = np.bincount(d, ratio.value[g], j - i)
        return {"log_weight": pa.array(out)}

    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    scored = with_columns(narrow, make, "text", "log_weight double", keep=False).select("doc_id", "log_weight")
    scored = settle(keyed(scored))
    n = scored.count()
    least = threshold(scored, round(n * fraction)) if n and round(n * fraction) else None
    taken = F.lit(bool(round(n * fraction))) if least is None else F.col("key") >= least
    return scored.withColumn("selected", taken)


def op6(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels)
