"""Packing by order-preserving dynamic programming.

The documents of a partition, in the order in which they are read, are one
stream of ids, each document followed by id 0. Windows of at most WINDOW ids
are cut from it at document ends (free) and sentence ends (SENTENCE); inside a
sentence (INSIDE) only where it is longer than a window. A cut's penalty is
stated in ids of padding; the windows chosen minimise padding plus penalties:

    best(i) = min over j with at(i) - at(j) <= WINDOW of best(j) + WINDOW - (at(i) - at(j)) + penalty(i)

best(j) + at(j) is kept in a monotone queue, so each cut enters and leaves it once.
The minimum is over a stretch of at least STRETCH ids and not over a whole
partition, so that memory is bounded: the last window of a stretch is put
before the next, and only a partition's last window is cut short. A partition
holds no more than a stretch and the text of one batch.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from . import tokens
from .common import chunks

WINDOW, SENTENCE, INSIDE = 1024, 1, 5
STRETCH = 1 << 20
#: Ids between two places inside a sentence that is longer than a window.
APART = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def cuts(ids: np.ndarray, doc_end: np.ndarray, kit: tokens.Tokens, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a window may end, and their penalties; the last document's end is the last place."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    follows = np.r_[kit.space[ids[1:]], True]
    penalty[np.flatnonzero(kit.line[ids] | kit.mark[ids] & follows) + 1] = SENTENCE
    penalty[doc_end] = 0
    at = np.flatnonzero(penalty[1:] >= 0) + 1
    before = np.r_[0, at[:-1]]
    for k in np.flatnonzero(at - before > window):
        penalty[before[k] + APART : at[k] : APART] = INSIDE
    at = np.flatnonzero(penalty[1:] >= 0) + 1
    return at, penalty[at]


def choose(at: list[int], penalty: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest windows' ends over [0, at[-1]]; gaps between places are at most `window`."""
    n = len(at)
    key = [0] * (n + 1)  # best + place, of the begin and each place
    back = [0] * (n + 1)
    place = [0, *at]
    queue = deque([0])
    for i in range(1, n + 1):
        here = place[i]
        while here - place[queue[0]] > window:
            queue.popleft()
        j = queue[0]
        back[i] = j
        key[i] = k = key[j] + window + penalty[i - 1]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    out = []
    while n:
        out.append(place[n])
        n = back[n]
    return out[::-1]


class _Stream:
    def __init__(self, kit: tokens.Tokens, base: int):
        self.kit, self.sequence = kit, base
        self.ids = np.zeros(0, "<u4")
        self.doc: list[int | None] = []  # ids, lengths and begins (from this stretch's begin) of documents not yet done
        self.size = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)

    def add(self, doc: list[int | None], ids: np.ndarray, size: np.ndarray) -> None:
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(size) - size]
        self.ids = np.concatenate([self.ids, ids])
        self.size = np.r_[self.size, size]
        self.doc += doc

    def cut(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all windows of the stretch; of all but the last unless the stream ends."""
        if not len(self.ids):
            return None
        at, penalty = cuts(self.ids, self.begin + self.size, self.kit)
        ends = np.array(choose(at.tolist(), penalty.tolist()), np.int64)
        if not last:
            ends = ends[:-1]
        if not len(ends):
            return None
        done = int(ends[-1])
        starts = np.r_[0, ends[:-1]]
        piece = np.unique(np.concatenate([starts, self.begin[(self.begin >= 0) & (self.begin < done)]]))
        stop = np.r_[piece[1:], done]
        doc = np.searchsorted(self.begin, piece, "right") - 1
        window = np.searchsorted(starts, piece, "right") - 1
        data = memoryview(self.ids.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(piece.tolist(), stop.tolist())]
        out = [
            pa.array([self.doc[d] for d in doc.tolist()], pa.int64()), pa.array(piece - self.begin[doc]), pa.array(stop - piece),
            pa.array(crc, pa.int64()), pa.array(self.size[doc]), pa.array(self.sequence + window), pa.array(piece - starts[window]),
        ]
        self.sequence += len(ends)
        open_ = int(np.searchsorted(self.begin + self.size, done, "right"))
        self.ids, self.doc, self.size, self.begin = self.ids[done:], self.doc[open_:], self.size[open_:], self.begin[open_:] - done
        return pa.RecordBatch.from_arrays(out, names=_NAMES)


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty: its document is id 0 alone. Rows that repeat a
    doc_id, or have none, are documents of their own. sequence_id is unique over
    all partitions: the partition's number times 2**32 and a count. An empty
    table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(tokens.tokens(vocabulary, ranks, pattern), TaskContext.get().partitionId() << 32)
        for b in batches:
            doc, texts = b.column(0).to_pylist(), [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            for i, j in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                stream.add(doc[i:j], *stream.kit.encode(texts[i:j]))
                if len(stream.ids) >= STRETCH and (made := stream.cut(False)) is not None:
                    yield made
        if (made := stream.cut(True)) is not None:
            yield made

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return pack(docs, path(tokens.VOCABULARY), path(tokens.RANKS), public_tokenizers.PATTERN)
