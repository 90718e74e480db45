"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and indexes every vector. A query pops tree nodes from a
priority queue, best centroid first, and visits as many leaves as a calibration set needs to
reach the wanted recall. Leaves, cut into parts of bounded size, and the queries that visit them meet by shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import staged

#: Rows, and queries, that meet in one group of a task; queries are scored against the rows so many at once.
_PART, _ASKED, _AT_ONCE = 4096, 16_384, 512


@dataclass
class Tree:
    """Nodes in order of creation; node 0 is the root."""

    centroids: list[np.ndarray] = field(default_factory=list)  # of the children
    children: list[list[int]] = field(default_factory=list)
    leaf_of: list[int] = field(default_factory=list)  # -1 for inner nodes
    leaves: int = 0

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf_of[node] >= 0:
                out[rows] = self.leaf_of[node]
                continue
            pick = _nearest(vectors[rows], self.centroids[node])
            todo += [(child, rows[pick == k]) for k, child in enumerate(self.children[node]) if (pick == k).any()]
        return out

    def best_leaves(self, query: np.ndarray, most: int) -> list[int]:
        """Up to ``most`` leaves, best bin first: the queue holds the nodes seen, by inner product with their centroid."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                out.append(self.leaf_of[node])
                continue
            for s, child in zip((self.centroids[node] @ query).tolist(), self.children[node]):
                heapq.heappush(queue, (-s, child))
        return out


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * vectors @ centroids.T).argmin(axis=1)


def fit_tree(sample: np.ndarray, leaf_size: int, branching: int = 8, rounds: int = 8, seed: int = 1) -> Tree:
    """Split nodes by k-means until they hold at most ``leaf_size`` sample vectors."""
    rng, tree = np.random.default_rng(seed), Tree()

    def grow(rows: np.ndarray) -> int:
        node = len(tree.children)
        tree.centroids.append(np.zeros((0, sample.shape[1])))
        tree.children.append([])
        tree.leaf_of.append(-1)
        if len(rows) > leaf_size:
            own = sample[rows]
            centroids = own[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
            for _ in range(rounds):
                pick = _nearest(own, centroids)
                kept = [k for k in range(len(centroids)) if (pick == k).any()]
                centroids = np.stack([own[pick == k].mean(axis=0) for k in kept])
            pick = _nearest(own, centroids)
            parts = [rows[pick == k] for k in range(len(centroids))]
            if sum(len(p) > 0 for p in parts) > 1:
                tree.centroids[node] = centroids[[len(p) > 0 for p in parts]]
                tree.children[node] = [grow(p) for p in parts if len(p)]
                return node
        tree.leaf_of[node] = tree.leaves
        tree.leaves += 1
        return node

    grow(np.arange(len(sample)))
    return tree


def _matrix(column, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def usable(rows: DataFrame, id_col: str, vec_col: str, dims: int | None) -> DataFrame:
    """``(id, v)`` of the vectors that take part: not null, with no null or non-finite component, not zero, of ``dims`` components."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    out = rows.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return out if dims is None else out.where(F.size("v") == dims)


def _exact(queries: np.ndarray, top: int):
    """Per batch, the best rows of each calibration query with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, leaf = queries @ _matrix(batch.column("v")).T, batch.column("leaf").to_numpy()
            n = min(top, scores.shape[1])
            best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            q = np.repeat(np.arange(len(queries)), n)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores[q, best.ravel()]), pa.array(leaf[best.ravel()])], ["q", "score", "leaf"])

    return run


def _best(queries: np.ndarray, rows: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of at least the ``top`` best rows of each query, ties with the last included; scores are in double precision.

    Single precision finds the rows that can be among them, with room for its error.
    """
    n, out = min(top, len(rows)), []
    slim, longest = rows.astype(np.float32), np.sqrt((rows**2).sum(axis=1).max())
    for at in range(0, len(queries), _AT_ONCE):
        own = queries[at : at + _AT_ONCE]
        scores = own.astype(np.float32) @ slim.T
        best = np.argpartition(scores, len(rows) - n, axis=1)[:, len(rows) - n :]
        room = 2.0**-22 * rows.shape[1] * longest * np.sqrt((own**2).sum(axis=1))
        least = np.take_along_axis(scores, best, axis=1).min(axis=1) - room
        near = scores >= least[:, None]
        q, r = np.nonzero(near)
        for part in np.array_split(np.arange(len(q)), max(1, len(q) // 65_536)):
            out.append((q[part] + at, r[part], (own[q[part]] * rows[r[part]]).sum(axis=1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _meet(top: int):
    """Best ``top`` ids of one leaf part for each query that visits it."""

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, r, score = _best(_matrix(right.column("v")), _matrix(left.column("v")), top)
        ids = left.column("ids").combine_chunks()
        starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        many = np.diff(starts)[r]
        # a row for each id of an entry, then the best of each query, ties to the smaller id
        place = np.repeat(starts[r] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        q, score, found = np.repeat(q, many), np.repeat(score, many), flat[place]
        order = np.lexsort((found, -score, q))
        q = q[order]
        keep = order[np.arange(len(q)) - np.searchsorted(q, q) < top]
        qid = right.column("qid").to_numpy()
        q = np.repeat(np.arange(len(qid)), np.minimum(np.bincount(q, minlength=len(qid)), top))
        return pa.table({"qid": pa.array(qid[q], pa.int64()), "id": pa.array(found[keep], pa.int64()), "score": pa.array(score[keep], pa.float64())})

    return run


def search(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, leaf_rows: int = 1024, most_leaves: int = 8192, sample: int = 65_536, calibration: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every usable row where ``is_query`` holds, the ``k`` others with the largest inner product found.

    score is the inner product of the stored vectors in double precision; ties go to the smaller id.
    Null, zero and non-finite vectors, those with null components or null ids, and those with another number
    of components than most (ties: the larger) take no part. Equal vectors are one tree entry that keeps
    its ``k`` + 1 smallest ids, which is all a result can hold; repeated rows are one row. Fewer
    than ``k`` candidates are all returned if their leaves are visited; an empty table gives an empty result.
    The tree is fitted on at most about ``sample`` vectors, the visits on ``calibration`` queries held against all rows.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    sizes = usable(rows, id_col, vec_col, None).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    # a flag that says which rows are queries must survive the projection
    base = usable(rows.where(is_query), id_col, vec_col, sizes.d).distinct()
    all_rows = usable(rows, id_col, vec_col, sizes.d)
    ranked = all_rows.distinct().withColumn("n", F.expr("row_number() over (partition by v order by id)")).where(F.col("n") <= k + 1)
    entries = staged(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    n = entries.count()
    leaves = min(most_leaves, max(1, n // leaf_rows))
    drawn = entries.select("v") if n <= sample else entries.select("v").where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    points = _matrix(drawn.toArrow().column("v"))
    points = points[np.lexsort(points.T[:3])]
    tree = fit_tree(points, max(1, len(points) // leaves))
    kind = entries.schema["v"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.assign(_matrix(batch.column("v")))), *batch.columns], ["leaf", *batch.schema.names])

    filed = staged(entries.mapInArrow(index, f"leaf long, v {kind}, ids array<long>"), "tree-index")
    distinct = staged(base.groupBy("v").agg(F.min("id").alias("qid")), "queries")
    # calibration: how many leaves until the wanted share of true neighbours has been met
    trial = _matrix(distinct.orderBy(F.xxhash64("qid")).limit(calibration).select("v").toArrow().column("v"))
    if not len(trial):
        return spark.createDataFrame([], out)
    exact = filed.select("leaf", "v").mapInArrow(_exact(trial, k + 1), "q long, score double, leaf long")
    best = exact.withColumn("n", F.expr("row_number() over (partition by q order by score desc, leaf)")).where(F.col("n") <= k + 1).select("q", "leaf").collect()
    orders = [{leaf: p for p, leaf in enumerate(tree.best_leaves(q, tree.leaves))} for q in trial]
    places = np.sort([orders[r.q][r.leaf] for r in best])
    visits = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [tree.best_leaves(q, visits) for q in _matrix(part.column("v"))]
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.int64()), part.column("qid").take(take), part.column("v").take(take)], ["leaf", "qid", "v"])

    visiting = distinct.select("qid", "v").mapInArrow(visit, f"leaf long, qid long, v {kind}")
    held = {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row a leaf
    # queries are split only so far that a group holds them, so the index is repeated once for 16,384 queries that visit a leaf
    asked = distinct.count() * min(1.0, 4 * visits / tree.leaves)
    parts = F.element_at(F.array(*(F.lit(-(-held.get(x, 0) // _PART) or 1) for x in range(tree.leaves))), F.col("leaf").cast("int") + 1)
    blocks = F.lit(max(1, -(-int(asked) // _ASKED)))
    left = filed.withColumn("part", F.pmod(F.xxhash64("v"), parts)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = visiting.withColumn("block", F.pmod(F.xxhash64("qid"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    keys = ["leaf", "part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k + 1), "qid long, id long, score double")
    near = met.withColumn("n", F.expr("row_number() over (partition by qid order by score desc, id)")).where(F.col("n") <= k + 1).drop("n")
    owners = base.join(distinct, "v").select(F.col("id").alias("query_id"), "qid")
    each = owners.join(near, "qid").where("query_id <> id")
    each = each.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id)").cast("int")).where(F.col("rank") <= k)
    return each.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
