"""Nearest neighbours by vantage-point trees, one for each shard.

A tree parts a shard's vectors by their distance to a vantage point at its median;
leaves hold a few hundred. A block of queries goes down a tree together: each visits
the side it lies on, then the other side unless the triangle inequality rules it out,
that is if ``factor`` times the least distance there exceeds the distance of the worst
neighbour kept. Factor one is exact; larger ones prune more and may miss some.

Largest inner product is nearest distance once every vector x has one more component,
the root of M^2 - |x|^2 for the largest norm M, and queries have zero there. These
distances only prune, with a slack for their rounding that grows with M. Neighbours are
kept by the inner product itself and, among equal ones, by the smallest id, so vectors
of few distinct values, where hundreds tie at the border, and single huge norms are exact.

Scale: rows are dealt to shards of at most ``shard_rows`` by the hash of their id. Each
shard's tree is built once and lies as a file in the shared folder; so does each block of
queries. A task takes one block past a group of shards, one after the other, and what it
has found so far prunes the next tree from the start. So vectors are shuffled once and
queries twice, however many blocks there are; what else is shuffled is k rows a query and
group. Shards are read from the shared folder once a block. A task holds one shard and one
block. Equal vectors of a shard are one point of its tree, so a vector that a third of all
rows share adds one point; its ids beyond the first k + 1 cannot be among k neighbours.
The driver holds the names of shards and blocks, some 50 bytes each.

Edges: null, empty or zero vectors and those with null or non-finite components take
no part, and likewise rows without id and vectors of another length than the first by
id; with fewer candidates than k all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, new_dir, work_table

#: Shards that one task takes a block of queries past, at most, and tasks wanted at least.
SHARDS_A_TASK, TASKS = 64, 64
LEAF = 192
SLACK = 1e-9
#: Inner products offered, and summed in order, at once: these bound a worker's memory.
OFFERED, SUMMED = 1 << 20, 1 << 14


def build(points: np.ndarray) -> tuple:
    """A tree over rows of ``points``: ("leaf", rows) or ("node", vantage, nearest and
    farthest inside, nearest and farthest outside, inside, outside)."""

    def grow(rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return ("leaf", rows)
        vantage = rows[0]
        rest = rows[1:]
        d = np.sqrt(np.maximum(((points[rest] - points[vantage]) ** 2).sum(axis=1), 0))
        order = np.argsort(d, kind="stable")
        rest, d = rest[order], d[order]
        half = len(rest) // 2
        return ("node", vantage, (d[0], d[half - 1]), (d[half], d[-1]), grow(rest[:half]), grow(rest[half:]))

    return grow(np.arange(len(points)))


def _best(scores: np.ndarray, firsts: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's best k by score, ties to the smaller first id, owners ascending."""
    order = np.lexsort((firsts, -scores, owner))
    owner = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(owner, owner) < k]


def search(tree: tuple, points: np.ndarray, vectors: np.ndarray, firsts: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inner products, rows) of the k best of each query, unordered; row -1 pads. What is
    below a query's ``floor`` may be left out.

    ``points`` are ``vectors`` with one more component. Lifted distances only rule out
    subtrees; what is kept is decided by the inner product, summed in order as SQL does,
    and among equal ones by the least of ``firsts``. A matrix product says which
    inner products are worth summing, up to its rounding error.
    """
    nq, size = queries.shape
    best = np.full((nq, k), -np.inf)
    rows = np.full((nq, k), -1, np.int64)
    norms, qnorms = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    rounding = 4 * (size + 4) * np.finfo(float).eps
    # largest lifted norm; distances err by no more than the slack
    lifted = np.sqrt((points**2).sum(axis=1).max()) if len(points) else 0.0
    slack = SLACK + 4 * rounding * (qnorms + lifted)
    span = qnorms**2 + lifted**2 * (1 + 4 * rounding)
    floor = np.full(nq, -np.inf) if floor is None else floor

    def farthest(q: np.ndarray) -> np.ndarray:
        """How far the worst neighbour is that still counts."""
        return np.sqrt(np.maximum(span[q] - 2 * np.maximum(best[q].min(axis=1), floor[q]) + 2 * rounding * qnorms[q] * lifted, 0))

    worst = farthest(np.arange(nq))

    def offer(q: np.ndarray, r: np.ndarray) -> None:
        step = max(OFFERED // len(r), 1)
        for at in range(0, len(q), step):
            _offer(q[at : at + step], r)

    def _offer(q: np.ndarray, r: np.ndarray) -> None:
        s = queries[q] @ vectors[r].T
        error = rounding * qnorms[q, None] * norms[r]
        bar = np.maximum(best[q].min(axis=1), floor[q])
        if len(r) > k:
            bar = np.maximum(bar, np.partition(s - error, len(r) - k, axis=1)[:, len(r) - k])
        qi, at = np.nonzero(~(s + error < bar[:, None]))
        if not len(qi):
            return
        exact = np.empty(len(qi))
        for a in range(0, len(qi), SUMMED):
            part = slice(a, a + SUMMED)
            exact[part] = np.cumsum(queries[q[qi[part]]] * vectors[r[at[part]]], axis=1)[:, -1]
        touched, qi = np.unique(qi, return_inverse=True)
        mine = q[touched]
        scores = np.concatenate((best[mine].ravel(), exact))
        found = np.concatenate((rows[mine].ravel(), r[at]))
        owner = np.concatenate((np.repeat(np.arange(len(mine)), k), qi))
        keep = _best(scores, np.where(found >= 0, firsts[found], np.iinfo(np.int64).max), owner, k)
        best[mine] = scores[keep].reshape(-1, k)
        rows[mine] = found[keep].reshape(-1, k)
        worst[mine] = farthest(mine)

    def visit(node: tuple, q: np.ndarray, least: np.ndarray) -> None:
        go = ~(least * factor > worst[q] + slack[q])
        q, least = q[go], least[go]
        if not len(q):
            return
        if node[0] == "leaf":
            offer(q, node[1])
            return
        _, vantage, inner, outer, inside, outside = node
        d = np.sqrt(((queries[q] - points[vantage, :-1]) ** 2).sum(axis=1) + points[vantage, -1] ** 2)
        offer(q, np.array([vantage]))
        away = [np.maximum(least, np.maximum(d - hi, lo - d)) for lo, hi in (inner, outer)]
        nearer = away[0] <= away[1]
        for first, second, which in ((0, 1, nearer), (1, 0, ~nearer)):
            if which.any():
                sides = (inside, outside)
                visit(sides[first], q[which], away[first][which])
                visit(sides[second], q[which], away[second][which])

    if len(points):
        visit(tree, np.arange(nq), np.zeros(nq))
    return best, rows


class Shard:
    """The vectors of a shard, equal ones once, and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        unique, group = np.unique(vectors, axis=0, return_inverse=True)
        group = group.ravel()
        self.ids = ids[np.argsort(group, kind="stable")]  # ascending within a group
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(unique)))))
        more = np.sqrt(np.maximum(largest**2 - (unique**2).sum(axis=1), 0))
        self.mixed = np.random.default_rng(0).permutation(len(unique))  # vantage points at random
        self.points = np.hstack((unique, more[:, None]))[self.mixed]
        self.tree = build(self.points)

    def neighbours(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, inner product) of each query's best k here, itself left out."""
        vectors = np.ascontiguousarray(self.points[:, :-1])
        # one more than k: the query's own vector may be among them
        best, rows = search(self.tree, self.points, vectors, self.ids[self.starts[:-1]][self.mixed], queries, min(len(vectors), k + 1), factor, floor)
        qi, at = np.nonzero(rows >= 0)
        score = best[qi, at]
        hit = self.mixed[rows[qi, at]]
        n = np.minimum(self.starts[hit + 1] - self.starts[hit], k + 1)
        first = np.repeat(self.starts[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        qi, score, found = np.repeat(qi, n), np.repeat(score, n), self.ids[first]
        other = found != query_ids[qi]
        return top(qi[other], found[other], score[other], k)


def top(qi: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k, by score and then id; queries ascend."""
    order = np.lexsort((found, -score, qi))
    qi, score, found = qi[order], score[order], found[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], found[keep], score[keep]


def shard_neighbours(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, largest: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, inner product) of each query's best k in one shard."""
    qi, found, score = Shard(ids, vectors, largest).neighbours(query_ids, queries, k, factor)
    return query_ids[qi], found, score


def past_shards(shards: Iterator[Shard], query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, inner product) of each query's best k in all of ``shards``."""
    qi, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for shard in shards:
        full = np.bincount(qi, minlength=len(queries)) >= k
        floor = np.full(len(queries), -np.inf)
        last = np.flatnonzero(np.diff(qi, append=-1))  # a query's worst is its last
        floor[qi[last]] = score[last]
        floor[~full] = -np.inf
        more = shard.neighbours(query_ids, queries, k, factor, floor)
        qi, found, score = top(*(np.concatenate(x) for x in zip((qi, found, score), more)), k)
    return qi, found, score


def _files(rows: DataFrame, column: str, folder: str, make) -> list[str]:
    """Each group of ``rows`` (id, v) as a file of what ``make`` makes of it; their names.
    Only names that a finished task reported count."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        made = make(group["id"].to_numpy(), np.stack(group["v"]).astype(float))
        store, at = filesystem(folder)
        name = f"{column}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{at}/{name}") as out:
            out.write(pickle.dumps(made, protocol=5))
        return pd.DataFrame({"name": [name]})

    written = work_table(rows.groupBy(column).applyInPandas(write, "name string"), f"ann-{column}")
    return sorted(r["name"] for r in written.collect())


def nearest(vectors: DataFrame, k: int = 20, queries: F.Column | None = None, factor: float = 1.0, shard_rows: int = 32768, block_rows: int = 4096, least_shards: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product.

    ``queries`` is a condition on the id column, by default ids divisible by 20.
    """
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").where(good)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    is_query = queries if queries is not None else F.col("id") % 20 == 0
    stats = rows.select("id", norm.alias("norm"), is_query.cast("long").alias("q"), F.size("v").alias("d")).agg(F.count(F.lit(1)), F.max("norm"), F.sum("q"), F.min_by("d", "id")).first()
    n, largest, n_queries, size = stats[0], stats[1] or 1.0, stats[2] or 0, stats[3] or 0
    shards = max(math.ceil(n / shard_rows), least_shards)
    blocks = max(math.ceil(n_queries / block_rows), 1)
    rows = rows.where(F.size("v") == size)
    folder = new_dir(vectors.sparkSession, "ann")
    part = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    top_norm = largest * (1 + 1e-12)
    shard_names = _files(rows.withColumn("shard", part(shards, 1)), "shard", folder, lambda ids, v: Shard(ids, v, top_norm))
    block_names = _files(rows.where(is_query).withColumn("block", part(blocks, 2)), "block", folder, lambda ids, v: (ids, v))
    groups = min(len(shard_names), max(math.ceil(len(shard_names) / SHARDS_A_TASK), math.ceil(TASKS / max(len(block_names), 1))))

    def load(name: str):
        store, at = filesystem(folder)
        with store.open_input_stream(f"{at}/{name}") as f:
            return pickle.loads(f.read())  # our own files, in the shared folder

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n in frame["id"].tolist():
                ids, queries = load(block_names[n // groups])
                qi, found, score = past_shards(map(load, shard_names[n % groups :: groups]), ids, queries, k, factor)
                yield pd.DataFrame({"query_id": ids[qi], "vec_id": found, "score": score})

    tasks = len(block_names) * groups
    found = vectors.sparkSession.range(0, tasks, 1, max(tasks, 1)).mapInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
