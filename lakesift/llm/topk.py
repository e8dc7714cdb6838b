"""Exact top-k search by inner product with a dual-tree walk over cover trees.

1. Vectors become integers, floor(SCALE * x). A bounded sample gives PIVOTS far points; every vector, query or not,
   goes to its nearest pivot. That is the first level of one tree over queries and data together.
2. The vectors of a pivot are dealt into blocks of about BLOCK rows; each block is packed into one row with a cover
   tree: each node has a centre, a radius that covers its members, and children around far-apart centres of about
   half that radius; members lie side by side, so a node is a slice.
3. Queries are the rows that `is_query` names, out of the same blocks, in chunks of about CHUNK that are
   broadcast; a task walks the query trees of a chunk and its data trees together. For a query node and a data node
   q.x <= cq.cx + |cq| rx + |cx| rq + rq rx, so the pair is left out if that bound is below the worst k-th score of
   the query group, which only grows. Ties are kept: only bounds that are strictly lower are left out.
4. Each task gives its k best of each query; their union gives the result.

Scores are exact: products and sums are done in float64 where all stay below 2**53, in Python integers otherwise.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an
id; a missing component of a shorter vector counts as 0; rows that repeat an id are candidates each, but never for a
query of their own id; query rows that repeat an id give a
result each; scores beyond 64 bits end at the limits of long; fewer
than k candidates give fewer rows; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import Scratch, table

SCALE = 256
PIVOTS = 32
PIVOT_SAMPLE = 2048
BLOCK = 4096  # rows of a block, about
LEAF, ASK_LEAF = 16, 8  # members up to which a node stays whole: of data, of queries
STEP = 2048  # node pairs that are settled or split together
CHUNK = 32768  # queries that are broadcast at once, or those of one block
EXACT = 2.0**53


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Floored, scaled rows in float64, short ones filled with 0."""
    dim = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    return out


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances, from differences: exact enough for any size of components."""
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def far_points(x: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to n points, each the farthest from those before it."""
    if not len(x):
        return np.zeros(0, int)
    picked, gap = [0], _gaps(x, x[0])
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, _gaps(x, x[picked[-1]]))
    return np.array(picked)


def cover_tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, centres): nodes are rows of (first, last, first child, children, radius); centres are points."""
    order = np.arange(len(x))
    nodes: list[list[float]] = [[0, len(x), 0, 0, 0.0]]
    centres = [x[0] if len(x) else np.zeros(x.shape[1])]
    at = 0
    while at < len(nodes):
        first, last = int(nodes[at][0]), int(nodes[at][1])
        own = order[first:last].copy()
        gap = _gaps(x[own], centres[at])
        nodes[at][4] = float(gap.max()) if len(own) else 0.0
        if len(own) > leaf // 8 and nodes[at][4] > 0:
            # Children: centres more than half the radius apart, members with the nearest; at most 16 of them.
            net, near, nearest = [0], _gaps(x[own], x[own[0]]), np.zeros(len(own), int)
            while len(net) < 16 and near.max() > nodes[at][4] / 2:
                net.append(int(near.argmax()))
                d = _gaps(x[own], x[own[net[-1]]])
                nearest = np.where(d < near, len(net) - 1, nearest)
                near = np.minimum(near, d)
            # A node of up to `leaf` members is split only if that halves its radius.
            if len(net) > 1 and (len(own) > leaf or near.max() <= nodes[at][4] / 2):
                by = np.argsort(nearest, kind="stable")
                order[first:last] = own[by]
                limits = first + np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(net)))])
                nodes[at][2], nodes[at][3] = len(nodes), len(net)
                for k in range(len(net)):
                    nodes.append([limits[k], limits[k + 1], 0, 0, 0.0])
                    centres.append(x[own[net[k]]])
        at += 1
    return order, np.array(nodes), np.array(centres).reshape(len(nodes), x.shape[1])


class Tree:
    """A block as numpy arrays: members in the order of its nodes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, centres: np.ndarray):
        self.ids, self.x, self.nodes, self.centres = ids, x, nodes, centres
        self.norms = np.sqrt((centres**2).sum(axis=1))

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, centres = cover_tree(x, leaf)
        return Tree(ids[order], x[order], nodes, centres)

    def columns(self) -> tuple[np.ndarray, ...]:
        """(first, last, first child, children) of all nodes as whole numbers."""
        return tuple(self.nodes[:, k].astype(np.int64) for k in range(4))


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Integer rows in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    kind = "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
    return kind, x.astype(kind).tobytes()


def _wide(kind: str, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as int64; beyond 64 bits they end at its limits."""
    dim = max(q.shape[1], x.shape[1])
    q, x = _padded(q, dim), _padded(x, dim)
    most = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(dim, 1)
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    big, limit = [[int(v) for v in r] for r in x], 2**63 - 1
    return np.array([[min(limit, max(-limit - 1, sum(map(operator.mul, map(int, r), b)))) for b in big] for r in q], np.int64).reshape(len(q), len(x))


class Best:
    """The k best (score, smaller id first) of each query of a tree."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        self.worst = np.full(len(ids), -np.inf)

    def add(self, rows: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.worst[rows, None]) & (ids != self.ids[rows, None])
        for at in np.flatnonzero(fit.any(axis=1)).tolist():
            r, s, use = rows.start + at, scores[at], fit[at]
            score, found = np.concatenate([self.scores[r], s[use]]), np.concatenate([self.found[r], ids[use]])
            best = np.lexsort((found, -score.astype(object) if score.min() == np.iinfo(np.int64).min else -score))[: self.k]
            self.scores[r], self.found[r] = score[best], found[best]
            if len(best) == self.k:
                self.worst[r] = float(self.scores[r][-1])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def walk(q: Tree, x: Tree, best: Best) -> int:
    """Compares two trees; returns how many (query, vector) products it needed."""
    if not len(q.ids) or not len(x.ids):
        return 0
    done, dim = 0, max(q.centres.shape[1], x.centres.shape[1])
    qc, xc = _padded(q.centres, dim), _padded(x.centres, dim)
    q_radius, x_radius = q.nodes[:, 4], x.nodes[:, 4]
    q_first, q_last, q_child, q_many = q.columns()
    x_first, x_last, x_child, x_many = x.columns()

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = np.einsum("ij,ij->i", qc[a], xc[b]) + q.norms[a] * x_radius[b] + x.norms[b] * q_radius[a] + q_radius[a] * x_radius[b]
        return top + 1e-9 * (np.abs(top) + q.norms[a] * x.norms[b] + 1)  # float sums may round down

    def worst() -> np.ndarray:
        """The worst k-th score of each query node."""
        return np.minimum.reduceat(np.append(best.worst, np.inf), np.stack([q_first, q_last], axis=1).ravel())[::2]

    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    top = bounds(a, b)
    while len(a):
        # Best first: a query group meets its promising partners before the others, which its worst score then rules out.
        live = np.flatnonzero(top >= worst()[a])
        live = live[np.argsort(-top[live], kind="stable")]
        now, later = live[:STEP], live[STEP:]
        one, two = a[now], b[now]
        a, b, top = a[later], b[later], top[later]
        leaf = (q_many[one] == 0) & (x_many[two] == 0)
        # Leaves: all partners of a query leaf at once.
        asks, parts = one[leaf], two[leaf]
        by = np.argsort(asks, kind="stable")
        asks, parts = asks[by], parts[by]
        for k, n in zip(*np.unique(asks, return_index=True), strict=True):
            own = parts[n : np.searchsorted(asks, k, side="right")]
            cols = _spread(x_first[own], x_last[own] - x_first[own])
            rows = slice(int(q_first[k]), int(q_last[k]))
            scores = products(q.x[rows], x.x[cols])
            done += scores.size
            best.add(rows, x.ids[cols], scores)
        one, two = one[~leaf], two[~leaf]
        data = (x_many[two] > 0) & ((q_many[one] == 0) | (x_radius[two] >= q_radius[one]))
        many = np.where(data, x_many[two], q_many[one])
        child = _spread(np.where(data, x_child[two], q_child[one]), many)
        side = np.repeat(data, many)
        new_a, new_b = np.where(side, np.repeat(one, many), child), np.where(side, child, np.repeat(two, many))
        a, b, top = np.concatenate([a, new_a]), np.concatenate([b, new_b]), np.concatenate([top, bounds(new_a, new_b)])
    return done


def _pack(group: pa.Table) -> pa.Table:
    x = _matrix([np.array(v, np.float64) for v in group.column("v").to_pylist()])
    if not x.shape[1]:
        x = np.zeros((len(x), 1))  # empty vectors: every product is 0
    ids, asks = group.column("id").to_numpy(), group.column("q").to_numpy(zero_copy_only=False).astype(bool)
    tree = Tree.of(ids, x)
    kind, raw = _narrow(tree.x)
    row = {
        "block": group.column("block")[0].as_py(), "dim": x.shape[1], "kind": kind, "ids": tree.ids.astype(np.int64).tobytes(),
        "vectors": raw, "nodes": tree.nodes.tobytes(), "centres": tree.centres.astype(kind).tobytes(), "asks": int(asks.sum()),
        "ask_ids": ids[asks].astype(np.int64).tobytes(), "ask_vectors": x[asks].astype(kind).tobytes(),
    }
    return pa.Table.from_pylist([row])


PACKED = (
    "block string, dim long, kind string, ids binary, vectors binary, nodes binary, centres binary, asks long, "
    "ask_ids binary, ask_vectors binary"
)
FOUND = "ask long, query_id long, vec_id long, score long"


def build(vectors: DataFrame, is_query, id_col: str, vector: str, scratch: Scratch) -> DataFrame:
    """The index: one packed row for each block."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = own.filter("id IS NOT NULL AND v IS NOT NULL").filter(
        ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    )
    good = good.withColumn("q", F.coalesce(is_query(F.col("id")), F.lit(False)))
    sample = good.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow().column("v").to_pylist()
    x = _matrix([np.array(v, np.float64) for v in sample])
    pivots = spark.sparkContext.broadcast(x[far_points(x, PIVOTS)])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix([np.array(v, np.float64) for v in batch.column(1).to_pylist()])
            dim = max(own.shape[1], pivots.value.shape[1])
            own, centres = _padded(own, dim), _padded(pivots.value, dim)
            gaps = np.stack([_gaps(own, c) for c in centres]) if len(centres) else np.zeros((1, len(own)))
            yield pa.record_batch([*batch.columns, pa.array(gaps.argmin(axis=0), pa.int32())], names=["id", "v", "q", "pivot"])

    placed = scratch.write(good.mapInArrow(near, "id long, v array<double>, q boolean, pivot int"), "placed")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "pivot")  # PIVOTS rows at most
    block = F.concat_ws("-", "pivot", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = dealt.select("id", "v", "q", block.alias("block")).groupBy("block").applyInArrow(_pack, PACKED)
    return scratch.write(packed, "index")


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k best of every query among all rows but its own."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    index = build(vectors, is_query, id_col, vector, scratch)
    sizes = index.filter("asks > 0").select("block", "asks").orderBy("block").toArrow().to_pylist()  # a row for each BLOCK rows
    chunks: list[list[str]] = []
    room = 0
    for row in sizes:
        if row["asks"] > room or not chunks:
            chunks.append([])
            room = CHUNK
        chunks[-1].append(row["block"])
        room -= row["asks"]

    def part(names: list[str]) -> DataFrame:
        asked = index.filter(F.col("block").isin(names)).select("dim", "kind", "ask_ids", "ask_vectors", "block").orderBy("block").toArrow().to_pylist()
        held = spark.sparkContext.broadcast(
            [Tree.of(np.frombuffer(r["ask_ids"], np.int64), _wide(r["kind"], r["ask_vectors"], r["dim"]), ASK_LEAF) for r in asked]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(t.ids, k) for t in held.value]
            for batch in batches:
                for r in batch.to_pylist():
                    dim = r["dim"]
                    x = Tree(
                        np.frombuffer(r["ids"], np.int64), _wide(r["kind"], r["vectors"], dim),
                        np.frombuffer(r["nodes"], np.float64).reshape(-1, 5), _wide(r["kind"], r["centres"], dim),
                    )
                    for q, b in zip(held.value, best, strict=True):
                        walk(q, x, b)
            for place, b in enumerate(best):
                n = [len(s) for s in b.scores]
                if sum(n):
                    ask = np.arange(len(n)) + (place << 32)
                    yield pa.record_batch(
                        [pa.array(np.repeat(ask, n)), pa.array(np.repeat(b.ids, n)), pa.array(np.concatenate(b.found)), pa.array(np.concatenate(b.scores))],
                        names=["ask", "query_id", "vec_id", "score"],
                    )

        return index.drop("ask_ids", "ask_vectors", "asks").mapInArrow(run, FOUND).withColumn("part", F.lit(names[0]))

    parts = [part(names) for names in chunks]
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    found = functools.reduce(DataFrame.union, parts)
    order = Window.partitionBy("part", "ask", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.e, x.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""
