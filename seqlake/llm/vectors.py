"""Vector search over shards and query blocks: kd-trees, exact and approximate.

Vectors become points of a few dimensions (below). A top tree of at most
2**TOP_LEVELS leaves, split at the medians of a bounded sample, deals every row
to a leaf; a leaf of more than SHARD components is dealt into shards by a hash,
so that equal vectors make no shard large. Queries, in the order of their
leaves, are dealt to blocks. A task gets one shard and one block, both of
bounded size. First every query searches the shard where it would lie itself:
its k-th score there is the bound that it takes to the other leaves, and it is
sent only to leaves whose tight box the bound allows.

Exact (op5): points are the vector's components along PRINCIPAL directions of
the sample and the norm of the rest, so that the largest inner product of a
query with a box bounds that with every vector in it. A shard's kd-tree has
median splits and tight boxes; a query goes down it best box first, comparing
the box's bound to the k-th score so far.

Approximate (op2): inner products become distances by one more component that
gives all vectors the same norm; points are their projections to DIMS Gaussian
(2-stable) directions, indexed by a kd-tree. Leaves come in the order of their
projected distance and the members as near are verified, until a chi-square
test holds: a vector as near as the k-th one would be projected nearer than
that with probability SURE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finite_vector, settle

#: Components of a shard's and of a query block's vectors.
SHARD, BLOCK = 1 << 19, 1 << 18
#: Vectors of a leaf, at most, of a tree over principal components and of one over projections.
LEAF, PROJECTED_LEAF = 64, 256
#: Components of the sample that a dimension's top tree is fitted on, on average, and the tree's levels at most.
SAMPLE, TOP_LEVELS = 1 << 20, 10
PRINCIPAL = 32
#: Rows that a shard's own principal directions are taken from.
BASIS = 1024
DIMS, SURE, SEED = 16, 0.95, 20
LONG = 2**63
NOBODY = np.iinfo(np.int64).max


@dataclass
class Tree:
    """A complete kd-tree: level i has 2**i nodes; nodes of the last level are leaves."""

    order: np.ndarray
    edges: np.ndarray  # of the leaves in order
    low: list[np.ndarray]  # by level, [node, dimension]
    high: list[np.ndarray]


def kd_tree(points: np.ndarray, leaf: int) -> Tree:
    """Median splits along the widest side of each node's tight box; rows equal in all dimensions split as well."""
    n = len(points)
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    order, edges = np.arange(n), np.array([0, n])
    low, high = [], []
    for level in range(depth + 1):
        parts = [points[order[a:b]] for a, b in zip(edges[:-1], edges[1:])]
        low.append(np.array([p.min(axis=0) for p in parts]))
        high.append(np.array([p.max(axis=0) for p in parts]))
        if level < depth:
            mids = (edges[:-1] + edges[1:]) // 2
            for k, p in enumerate(parts):
                axis = int((high[-1][k] - low[-1][k]).argmax())
                order[edges[k] : edges[k + 1]] = order[edges[k] : edges[k + 1]][np.argpartition(p[:, axis], mids[k] - edges[k])]
            edges = np.sort(np.concatenate([edges, mids]))
    return Tree(order, edges, low, high)


class Best:
    """The k best (score, id) of each query so far, the score to reach, and how many candidates were scored."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, kind: type):
        self.k = k
        self.worst = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        self.score = np.full((queries, k), self.worst, kind)
        self.id = np.full((queries, k), NOBODY, np.int64)
        self.floor = floor  # -inf where nothing is known
        self.scored = np.zeros(queries, np.int64)

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: [row, candidate], `worst` where a candidate is none for the row."""
        some = scores.max(axis=1) >= self.kth()[rows]
        if not some.any():
            return
        rows, scores = rows[some], scores[some]
        both = np.concatenate([self.score[rows], scores], axis=1)
        name = np.concatenate([self.id[rows], np.where(scores == self.worst, NOBODY, ids[None, :])], axis=1)
        by_id = np.argsort(name, axis=1, kind="stable")
        both, name = np.take_along_axis(both, by_id, 1), np.take_along_axis(name, by_id, 1)
        falling = ~both if both.dtype == np.int64 else -both
        top = np.argsort(falling, axis=1, kind="stable")[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(name, top, 1)


@dataclass
class Side:
    """A task's vectors or queries."""

    x: np.ndarray
    id: np.ndarray
    row: np.ndarray  # a query is no candidate for itself


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; exact for any size, held at the ends of the long range."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if max(1.0, np.abs(q).max()) * max(1.0, np.abs(x).max()) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    ints = [[int(v) for v in row] for row in x]
    out = [[max(-LONG, min(LONG - 1, sum(a * b for a, b in zip([int(v) for v in row], other)))) for other in ints] for row in q]
    return np.array(out, np.int64)


@dataclass
class Principal:
    """Components along the principal directions, and the norm of the rest."""

    basis: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        top = x @ self.basis
        rest = np.einsum("nd,nd->n", x, x) - np.einsum("nd,nd->n", top, top)
        return np.c_[top, np.sqrt(np.maximum(rest, 0))]

    asked = of

    def open(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return ~(self.bound(q, low, high) < kth[:, None])

    def bound(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The largest inner product, with room for rounding, of each query point and each box."""
        far = np.maximum(np.abs(low), np.abs(high))
        room = 1e-6 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(far, axis=1)[None, :]
        return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + room


def principal(x: np.ndarray, most: int = PRINCIPAL) -> Principal:
    """From at most BASIS rows; through their own products where they are fewer than the components."""
    x = x[:: max(1, -(-len(x) // BASIS))]
    scale = np.abs(x).max() or 1.0
    x = x / scale
    if x.shape[1] <= len(x):
        basis = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :most]
    else:
        basis = np.linalg.qr(x.T @ np.linalg.eigh(x @ x.T)[1][:, ::-1][:, :most])[0]
    return Principal(basis)


def search_exact(held: Side, asks: Side, floor: np.ndarray, k: int) -> Best:
    best = Best(len(asks.x), k, floor, np.int64)
    kind = principal(held.x)
    tree, q = kd_tree(kind.of(held.x), LEAF), kind.asked(asks.x)
    alive = np.ones((len(q), 1), bool)
    for low, high in zip(tree.low, tree.high):
        bound = kind.bound(q, low, high)
        alive = np.repeat(alive, bound.shape[1] // alive.shape[1], axis=1) & ~(bound < floor[:, None])
    bound[~alive] = -np.inf
    turn = np.argsort(-bound, axis=1, kind="stable")
    for r in range(turn.shape[1]):
        leaf = turn[:, r]
        reach = bound[np.arange(len(q)), leaf]
        open_ = np.flatnonzero(~(reach < best.kth()) & (reach > -np.inf))
        if not len(open_):
            break
        for node in np.unique(leaf[open_]):
            rows = open_[leaf[open_] == node]
            members = tree.order[tree.edges[node] : tree.edges[node + 1]]
            scores = exact_scores(asks.x[rows], held.x[members])
            best.scored[rows] += len(members)
            best.add(rows, np.where(held.row[members][None, :] == asks.row[rows][:, None], best.worst, scores), held.id[members])
    return best


def chi_square(t: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """P(chi-square with an even number of degrees of freedom <= t)."""
    half = np.maximum(t, 0) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-np.minimum(half, 700)) * total


def chi_square_at(p: float, dims: int = DIMS) -> float:
    """Where chi_square reaches p, by bisection."""
    low, high = 0.0, 100.0 * dims
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), dims) < p else (low, mid)
    return high


@dataclass
class Projected:
    """Projections of vectors that one more component has given the norm sqrt(most)."""

    dim: int
    most: float
    draw: np.ndarray = field(init=False)
    stop: float = field(init=False)

    def __post_init__(self) -> None:
        self.draw = np.random.default_rng(SEED).standard_normal((self.dim + 1, DIMS))
        self.stop = chi_square_at(SURE)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.most - np.einsum("nd,nd->n", x, x), 0))] @ self.draw

    def asked(self, q: np.ndarray) -> np.ndarray:
        """The queries' points, which have nothing in the added component, and their squared norms behind."""
        return np.c_[q @ self.draw[:-1], np.einsum("nd,nd->n", q, q)]

    def open(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return self.gap(q, low, high) < self.reach(q, kth)[:, None]

    def reach(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The squared projected distance from which on the test holds: it's that of the k-th vector times a quantile."""
        return np.maximum(self.most + q[:, -1] - 2 * kth, 1e-12) * self.stop

    def gap(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(low)))
        for d in range(DIMS):
            off = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
            out += off * off
        return out


def search_projected(held: Side, asks: Side, floor: np.ndarray, k: int, most: float | None = None) -> Best:
    best = Best(len(asks.x), k, floor, np.float64)
    kind = Projected(held.x.shape[1], float(np.einsum("nd,nd->n", held.x, held.x).max()) if most is None else most)
    shadow, q = kind.of(held.x), kind.asked(asks.x)
    tree = kd_tree(shadow, PROJECTED_LEAF)
    gap = kind.gap(q, tree.low[-1], tree.high[-1])
    turn = np.argsort(gap, axis=1, kind="stable")
    length = np.einsum("nd,nd->n", shadow, shadow)
    at = np.ascontiguousarray(q[:, :-1])
    own = np.einsum("nd,nd->n", at, at)
    open_ = np.arange(len(q))
    for r in range(turn.shape[1]):
        leaf = turn[open_, r]
        near = gap[open_, leaf] < kind.reach(q[open_], best.kth()[open_])
        open_, leaf = open_[near], leaf[near]
        if not len(open_):
            break
        for node in np.unique(leaf):
            rows = open_[leaf == node]
            members = tree.order[tree.edges[node] : tree.edges[node + 1]]
            distance = own[rows][:, None] + length[members][None, :] - 2 * (at[rows] @ shadow[members].T)
            kth = best.kth()[rows]
            through = (distance < kind.reach(q[rows], kth)[:, None]) & (held.row[members][None, :] != asks.row[rows][:, None])
            best.scored[rows] += through.sum(axis=1)
            # A leaf's products come from one multiplication, rounded as it likes; what may count is scored again, pair by pair.
            rough = asks.x[rows] @ held.x[members].T
            room = 1e-12 * np.sqrt(kind.most * q[rows, -1])
            a, b = np.nonzero(through & (rough >= (kth - room)[:, None]))
            scores = np.full((len(rows), len(members)), best.worst)
            scores[a, b] = np.einsum("nd,nd->n", asks.x[rows[a]], held.x[members[b]])
            best.add(rows, scores, held.id[members])
    return best


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


@dataclass
class Top:
    """A dimension's top tree: node i's children are 2i + 1 and 2i + 2; its leaves are numbered from 0."""

    kind: Principal | Projected
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray | None = None  # tight boxes of the leaves, by leaf; an empty leaf's box is inside out
    high: np.ndarray | None = None

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node, n = np.zeros(len(points), np.int64), len(self.axis)
        while n and (inner := node < n).any():
            node[inner] = 2 * node[inner] + 1 + (points[inner, self.axis[node[inner]]] >= self.cut[node[inner]])
        return node - n


def top_tree(kind: Principal | Projected, points: np.ndarray, levels: int) -> Top:
    """Median splits along the widest side, `levels` of them."""
    axis, cut = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
    parts = [points]
    for level in range(levels):
        below = []
        for i, p in enumerate(parts):
            node = 2**level - 1 + i
            if len(p):
                axis[node] = int((p.max(axis=0) - p.min(axis=0)).argmax())
                cut[node] = np.median(p[:, axis[node]])
            right = p[:, axis[node]] >= cut[node]
            below += [p[~right], p[right]]
        parts = below
    return Top(kind, axis, cut)


def _by_dim(batch: pa.RecordBatch, do: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """do(dim, places, matrix) for each dimension in a batch with columns dim and x."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        do(int(dim), at, _matrix(batch.column("x").take(pa.array(at))))


def nearest(vectors: DataFrame, k: int, is_query: Column, exact: bool) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, ties to the smaller vec_id; and scored: the candidates that came to be scored for it.

    Rows whose vec_id or vector is null, or whose vector is empty or has null
    or non-finite components, take no part; for the approximate search no zero
    vectors either, for the exact one none whose components times 1024 aren't
    finite. Rows that repeat a vec_id are rows of their own: each asks, and
    each is a candidate for the others. Vectors meet vectors of their own
    dimension only. Exact scores beyond a long's range are its ends. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    name = "embedding"
    x = F.transform(name, lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & finite_vector(F.transform(x, lambda c: c * 1024.0) if exact else F.col(name))
    if not exact:
        ok = ok & F.exists(name, lambda c: c != 0)
    rows = vectors.select("vec_id", name).where(ok)
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size(name).alias("dim"), x.alias("x"), is_query.alias("asks")))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    # A row for each dimension that occurs.
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()
    tops = _tops(rows, {r["dim"]: (r["n"], r["most"]) for r in sizes}, exact)
    shared = spark.sparkContext.broadcast(tops)  # no more than SAMPLE components and 2**TOP_LEVELS boxes each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, asked = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)

            def one(dim: int, at: np.ndarray, xs: np.ndarray) -> None:
                top, xs = shared.value[dim], _scaled(xs, exact)
                leaf[at], asked[at] = top.leaf(top.kind.of(xs)), top.leaf(top.kind.asked(xs))

            _by_dim(b, one)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(asked)], names=[*b.schema.names, "leaf", "asked"])

    if any(len(t.axis) for t in tops.values()):
        placed = settle(rows.mapInArrow(place, "row long, vec_id long, dim int, x array<double>, asks boolean, leaf int, asked int"))
        _tighten(placed, tops, exact)
    else:
        placed = rows.withColumns({"leaf": F.lit(0), "asked": F.lit(0)})
    # A row for each leaf.
    held = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n"))
    asking = placed.where("asks").groupBy("dim", F.col("asked").alias("leaf")).agg(F.count("*").alias("q"))
    leaves = held.join(asking, ["dim", "leaf"], "full").na.fill(0)
    ahead = F.sum("q").over(Window.partitionBy("dim").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))
    subs = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") / SHARD)).cast("int")
    leaves = settle(leaves.select("dim", "leaf", subs.alias("subs"), "q", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    few = F.broadcast(leaves)
    sub = F.pmod(F.xxhash64("row", F.lit(3)), "subs").cast("int").alias("sub")
    data = placed.select("row", "vec_id", "dim", "x", "leaf").join(few, ["dim", "leaf"]).select("dim", "leaf", sub, "row", "vec_id", "x")
    block = F.floor((F.col("ahead") + F.pmod(F.xxhash64("row", F.lit(5)), "q")) * F.col("dim") / BLOCK).cast("int").alias("block")
    asks = placed.where("asks").select("row", "vec_id", "dim", "x", F.col("asked").alias("leaf")).join(few, ["dim", "leaf"]).select("dim", "leaf", sub, block, "row", "vec_id", "x")
    search = search_exact if exact else search_projected
    out = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if exact else pa.float64()), ("scored", pa.int64())])

    def solve(both: pa.Table) -> pa.Table:
        is_ask = both.column("asks").to_numpy()
        left, right = both.filter(pa.array(~is_ask)), both.filter(pa.array(is_ask))
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        a, b = (Side(_scaled(_matrix(t.column("x")), exact), t.column("vec_id").to_numpy(), t.column("row").to_numpy()) for t in (left, right))
        floor = right.column("floor").to_numpy().astype(float)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        more = {} if exact else {"most": shared.value[a.x.shape[1]].kind.most}
        best = search(a, b, floor, k, **more)
        row, col = np.nonzero((best.id != NOBODY) & (best.score >= floor[:, None]))
        found = pa.table({"query": b.row[row], "query_id": b.id[row], "vec_id": best.id[row, col], "score": best.score[row, col], "scored": np.zeros(len(row), np.int64)}, schema=out)
        none = pa.nulls(len(b.id), pa.int64())
        return pa.concat_tables([found, pa.table({"query": b.row, "query_id": b.id, "vec_id": none, "score": none.cast(out.field("score").type), "scored": best.scored}, schema=out)])

    ddl = f"query long, query_id long, vec_id long, score {'long' if exact else 'double'}, scored long"
    keys = ["dim", "leaf", "sub", "block"]
    body = [*keys, "row", "vec_id", "x"]
    unknown = F.lit(None).cast("double").alias("floor")
    mine = data.withColumn("block", F.lit(0)).select(*body, F.lit(False).alias("asks"), unknown)
    near = settle(mine.unionAll(asks.withColumn("block", F.lit(0)).select(*body, F.lit(True), unknown)).groupBy(*keys).applyInArrow(solve, ddl))
    found = near
    if leaves.count() > len(sizes) or not leaves.where("subs > 1").isEmpty():
        floor = near.where("vec_id is not null").groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"))
        floor = floor.where(F.col("n") >= k).select(F.col("query").alias("row"), "floor")

        def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                wanted: list[np.ndarray | None] = [None] * b.num_rows
                floors = b.column("floor").to_numpy(zero_copy_only=False).astype(float)
                floors = np.where(np.isnan(floors), -np.inf, floors)

                def one(dim: int, at: np.ndarray, xs: np.ndarray) -> None:
                    top = shared_boxes.value[dim]
                    open_ = top.kind.open(top.kind.asked(_scaled(xs, exact)), top.low, top.high, floors[at]) & (top.low <= top.high).all(axis=1)[None, :]
                    for i, row in zip(at, open_):
                        wanted[i] = np.flatnonzero(row)

                _by_dim(b, one)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(wanted, pa.list_(pa.int32()))], names=[*b.schema.names, "wanted"])

        shared_boxes = spark.sparkContext.broadcast(tops)
        known = asks.join(floor, "row", "left").select(*body, "floor")
        sent = known.mapInArrow(targets, "dim int, leaf int, sub int, block int, row long, vec_id long, x array<double>, floor double, wanted array<int>")
        sent = sent.withColumnsRenamed({"leaf": "own", "sub": "own_sub"}).withColumn("leaf", F.explode("wanted"))
        sent = sent.join(few.select("dim", "leaf", "subs"), ["dim", "leaf"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        sent = settle(sent.where("leaf != own or sub != own_sub").select(*body, "floor"))
        pairs = sent.groupBy("dim", "leaf", "sub").agg(F.collect_set("block").alias("blocks"))
        copies = data.join(pairs, ["dim", "leaf", "sub"]).withColumn("block", F.explode("blocks")).select(*body, F.lit(False).alias("asks"), unknown)
        found = near.unionAll(settle(copies.unionAll(sent.select(*body, F.lit(True), "floor")).groupBy(*keys).applyInArrow(solve, ddl)))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).drop("scored")
    scored = found.groupBy("query").agg(F.sum("scored").alias("scored"))
    return ranked.join(scored, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "scored")


def _scaled(x: np.ndarray, exact: bool) -> np.ndarray:
    return np.floor(x * 1024.0) if exact else x


def _tops(rows: DataFrame, sizes: dict[int, tuple[int, float]], exact: bool) -> dict[int, Top]:
    """A top tree for each dimension, fitted on a sample by the hash of the rows' numbers; one leaf where a shard is enough."""
    levels = {d: min(TOP_LEVELS, int(np.ceil(np.log2(max(1.0, n * d / SHARD))))) for d, (n, _) in sizes.items()}
    taken: dict[int, list[np.ndarray]] = {}
    large = [d for d in sizes if levels[d]]
    if large:
        rate = F.create_map(*[F.lit(v) for d in large for v in (d, min(1.0, SAMPLE / (sizes[d][0] * d)))])
        place = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
        drawn = rows.where(F.col("dim").isin(large)).where(place < rate[F.col("dim")]).select("dim", "x").toArrow()
        for b in drawn.to_batches():
            _by_dim(b, lambda d, _, xs: taken.setdefault(d, []).append(_scaled(xs, exact)))
    out = {}
    for d, (_, most) in sizes.items():
        own = np.concatenate(taken[d]) if d in taken else np.zeros((1, d))
        kind = principal(own) if exact else Projected(d, most)
        out[d] = top_tree(kind, kind.of(own), levels[d])
    return out


def _tighten(placed: DataFrame, tops: dict[int, Top], exact: bool) -> None:
    """Give the top trees their leaves' tight boxes over all rows."""
    shared = placed.sparkSession.sparkContext.broadcast(tops)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            leaves = b.column("leaf").to_numpy()

            def one(dim: int, at: np.ndarray, xs: np.ndarray) -> None:
                points, leaf = shared.value[dim].kind.of(_scaled(xs, exact)), leaves[at]
                for n in np.unique(leaf).tolist():
                    own = points[leaf == n]
                    low[dim, n] = np.minimum(low.get((dim, n), np.inf), own.min(axis=0))
                    high[dim, n] = np.maximum(high.get((dim, n), -np.inf), own.max(axis=0))

            _by_dim(b, one)
        sides = [len(low[key]) for key in low]
        if low:
            of = [np.repeat([key[i] for key in low], sides).astype(np.int32) for i in (0, 1)]
            place = np.concatenate([np.arange(n) for n in sides]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*of, place, np.concatenate(list(low.values())), np.concatenate([high[key] for key in low]))], names=["dim", "leaf", "place", "low", "high"])

    found = placed.select("dim", "x", "leaf").mapInArrow(boxes, "dim int, leaf int, place int, low double, high double")
    found = found.groupBy("dim", "leaf", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    dims, leaf, place, low, high = (found.column(c).to_numpy() for c in ("dim", "leaf", "place", "low", "high"))
    for d, top in tops.items():
        own = dims == d
        top.low, top.high = (np.full((len(top.axis) + 1, place[own].max() + 1), v) for v in (np.inf, -np.inf))
        top.low[leaf[own], place[own]], top.high[leaf[own], place[own]] = low[own], high[own]


def op2(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return nearest(vectors, 20, F.col("vec_id") % 20 == 0, exact=False)


def op5(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return nearest(vectors, 10, F.col("vec_id") % 100 == 0, exact=True).drop("scored")


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 100 = 0 AND len(q.x) = len(c.x))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
