"""Approximate nearest neighbours by a hierarchical k-means tree (operator 2).

The tree is fitted on a sample of about ``FIT_ROWS`` vectors (hash of the id; a documented bound) and
every vector is put into a leaf. A query walks the tree best bin first: a priority queue of nodes by the
inner product with their centre gives the leaves in order of promise. How many leaves are visited is
calibrated: about ``CALIBRATION`` queries are answered exactly against all vectors, and the visits are
widened until the visited leaves hold ``TARGET`` of their true neighbours (all leaves if need be).

Search is a shuffle: a leaf's vectors are cut into cells of about ``CELL`` rows (a leaf may hold a third
of all rows), cells go to groups, a query goes once to each group that has one of its leaves. Queries are
cut into blocks of about ``QUERY_BLOCK`` and each (group, block) is one bounded product. Among identical
vectors only the ``k + 1`` smallest ids can be anyone's neighbours, so further copies in a cell are not
scored. Scores are double-precision sums over the original components.

Null vectors, vectors with null, non-finite or only zero components, of a length other than the most
common one, or with a null id take no part. Rows that repeat an id count once (the smallest vector);
ties go to the smaller id; with fewer candidates than ``k`` all are returned; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import cut, prepare

K = 20
FIT_ROWS = 32_768
BRANCH = 16
LEAF_ROWS = 64
CALIBRATION = 256
TARGET = 0.96
CELL = 4096
GROUP_ROWS = 65_536
QUERY_BLOCK = 8192


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, one per id."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    v = v.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(fine & F.exists("embedding", lambda x: x != 0))
    top = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    v = v.filter(F.size("embedding") == (top[0]["d"] if top else 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Tree:
    """Centres of all nodes; ``children[i]`` is empty for a leaf, ``leaf[i]`` its number."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.n_leaves = [x.mean(axis=0)], [[]], [-1], 0
        waiting = [(0, x)]
        while waiting:
            node, part = waiting.pop()
            groups = self._split(part, branch, rng) if len(part) > leaf_rows else []
            if len(groups) < 2:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for g in groups:
                self.centres.append(g.mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                waiting.append((len(self.centres) - 1, g))
        self.centres = np.array(self.centres)
        self.half = 0.5 * (self.centres ** 2).sum(axis=1)

    def state(self) -> dict:
        """Plain arrays and lists: what is broadcast, so that a worker needs no importable copy of this class."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, state: dict) -> "Tree":
        tree = cls.__new__(cls)
        tree.__dict__.update(state)
        return tree

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng) -> list[np.ndarray]:
        c = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(8):
            near = (x @ c.T - 0.5 * (c ** 2).sum(axis=1)).argmax(axis=1)
            used = np.unique(near)
            c = np.stack([x[near == i].mean(axis=0) for i in used])
        near = (x @ c.T - 0.5 * (c ** 2).sum(axis=1)).argmax(axis=1)
        return [x[near == i] for i in np.unique(near)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: nearest child at every level."""
        at = np.zeros(len(x), np.int64)
        todo = [0] if len(x) else []
        while todo:
            node = todo.pop()
            kids = self.children[node]
            if not kids:
                continue
            rows = np.flatnonzero(at == node)
            if len(rows):
                kids = np.array(kids)
                at[rows] = kids[(x[rows] @ self.centres[kids].T - self.half[kids]).argmax(axis=1)]
                todo += [k for k in kids.tolist() if self.children[k]]
        return np.array(self.leaf)[at]

    def visits(self, q: np.ndarray, most: int, rows: dict[int, int] | None = None, least: int = 0) -> list[list[int]]:
        """For each query the first ``most`` leaves, best bin first; more of them until they hold ``least`` of ``rows``."""
        near, out = q @ self.centres.T, []
        for s in near:
            queue, found, holds = [(0.0, 0)], [], 0
            while queue and (len(found) < most or (rows is not None and holds < least)):
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for kid in self.children[node]:
                        heapq.heappush(queue, (-s[kid], kid))
                else:
                    found.append(self.leaf[node])
                    holds += rows.get(self.leaf[node], 0) if rows is not None else 0
            out.append(found)
        return out


def _matrix(col: pd.Series, d: int) -> np.ndarray:
    return np.stack(col.to_list()).astype(float) if len(col) else np.zeros((0, d))


def best_pairs(q_ids, q, v_ids, v, k: int, leaf=None, asked=None) -> pd.DataFrame:
    """The ``k`` best vectors for each query of one product, by exact score, ties to the smaller id.

    ``leaf`` numbers the vectors' leaves and ``asked`` lists, per query, the leaves to look into; without
    them every query meets every vector. Leaves are taken one after the other against the query's best so
    far; rounding of the product never decides: everything near the edge is scored exactly at the end.
    """
    if not len(q_ids) or not len(v_ids):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    order = np.argsort(v_ids, kind="stable")
    copies = pd.Series([r.tobytes() for r in np.ascontiguousarray(v[order]) + 0.0])
    order = order[(copies.groupby(copies).cumcount() <= k).to_numpy()]
    leaf = np.zeros(len(v_ids), np.int64) if leaf is None else leaf
    order = order[np.argsort(leaf[order], kind="stable")]
    v_ids, v, leaf = v_ids[order], np.ascontiguousarray(v[order]), leaf[order]
    place = dict(zip(v_ids.tolist(), range(len(v_ids))))
    own = np.array([place.get(i, -1) for i in q_ids.tolist()])
    if asked is None:
        which, wanted = np.arange(len(q_ids)), np.zeros(len(q_ids), np.int64)
    else:
        which, wanted = np.repeat(np.arange(len(q_ids)), [len(x) for x in asked]), np.concatenate(asked)
        by = np.argsort(wanted, kind="stable")
        which, wanted = which[by], wanted[by]
    best, edge = np.full((len(q_ids), k), -np.inf), np.full(len(q_ids), -np.inf)
    held: list[tuple] = []
    n_held = 0
    for x, lo, hi in zip(*(lambda u, i: (u, i, np.append(i[1:], len(leaf))))(*np.unique(leaf, return_index=True))):
        rows_q = which[np.searchsorted(wanted, x):np.searchsorted(wanted, x, side="right")]
        for a in range(lo, hi, CELL):
            b = min(hi, a + CELL)
            for at in range(0, len(rows_q), 1024):
                r = rows_q[at:at + 1024]
                s = q[r] @ v[a:b].T
                mine = np.flatnonzero((own[r] >= a) & (own[r] < b))
                s[mine, own[r[mine]] - a] = -np.inf
                i, j = np.nonzero(s > (edge[r] - 1e-9 * (1 + np.abs(np.where(np.isfinite(edge[r]), edge[r], 0))))[:, None])
                held.append((r[i], a + j, s[i, j]))
                n_held += len(i)
                both = np.concatenate([best[r], s], axis=1)
                best[r] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                edge[r] = best[r].min(axis=1)
                if n_held > 1_000_000:
                    held = [_near(held, edge)]
                    n_held = len(held[0][0])
    x, y, _ = _near(held, edge) if held else (np.zeros(0, np.int64),) * 3
    score = np.concatenate([(q[x[i:i + (1 << 17)]] * v[y[i:i + (1 << 17)]]).sum(axis=1) for i in range(0, len(x), 1 << 17)] or [np.zeros(0)])
    out = pd.DataFrame({"query_id": q_ids[x], "vec_id": v_ids[y], "score": score})
    return out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _near(held: list[tuple], edge: np.ndarray) -> tuple:
    """The pairs that still reach their query's edge."""
    x, y, s = (np.concatenate(c) for c in zip(*held))
    e = edge[x]
    ok = s >= e - 1e-9 * (1 + np.abs(np.where(np.isfinite(e), e, 0)))
    return x[ok], y[ok], s[ok]


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries: a product per batch, merged per query."""
    ids, d = queries["vec_id"].to_numpy(np.int64), len(queries["embedding"].iloc[0])
    q = _matrix(queries["embedding"], d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            got = best_pairs(ids, q, pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["embedding"], d), k)
            held = got if held is None else pd.concat([held, got]).sort_values(
                ["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if held is not None:
            yield held

    return _top(vectors.mapInPandas(run, "query_id long, vec_id long, score double"), k)


def calibrate(vectors: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float) -> int:
    """Leaf visits at which about CALIBRATION exactly answered queries find ``target`` of their neighbours."""
    n = queries.count()
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int(min(1.0, CALIBRATION / max(1, n)) * (1 << 20))
    some = queries.filter(part).toPandas()
    if not len(some):
        return tree.n_leaves
    truth = exact(vectors, some, k).join(vectors.select("vec_id", "embedding"), "vec_id").toPandas()
    d = len(some["embedding"].iloc[0])
    order = {i: {leaf: r for r, leaf in enumerate(o)} for i, o in zip(
        some["vec_id"], tree.visits(_matrix(some["embedding"], d), tree.n_leaves))}
    leaves = tree.assign(_matrix(truth["embedding"], d))
    ranks = np.array([order[q][leaf] for q, leaf in zip(truth["query_id"], leaves)])
    visits = 1
    while visits < tree.n_leaves and (ranks < visits).mean() < target:
        visits = min(tree.n_leaves, math.ceil(visits * 1.1))
    return visits


def search(rows: DataFrame, query_filter, k: int = K, target: float = TARGET, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest found for each row that ``query_filter`` (a condition on vec_id) picks."""
    spark = rows.sparkSession
    prepare(spark)
    vectors = cut(valid_vectors(rows))
    queries = vectors.filter(query_filter)
    n, n_queries = vectors.count(), queries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not n_queries:
        return spark.createDataFrame([], schema)
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil(min(1.0, fit_rows / n) * (1 << 20))
    fitted = vectors.filter(share).toPandas().sort_values("vec_id")
    if not len(fitted):
        fitted = vectors.orderBy("vec_id").limit(1).toPandas()
    d = len(fitted["embedding"].iloc[0])
    tree = Tree(_matrix(fitted["embedding"], d))
    visits = calibrate(vectors, queries, tree, k, target)
    held = spark.sparkContext.broadcast(tree.state())

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=Tree.of(held.value).assign(_matrix(pdf["embedding"], d)))

    placed = cut(vectors.mapInPandas(to_leaf, "vec_id long, embedding array<double>, leaf int"))
    # one number per leaf reaches the driver; the tree has a bounded number of leaves
    rows_of = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    cells = {leaf: max(1, math.ceil(c / CELL)) for leaf, c in rows_of.items()}
    groups = max(spark.sparkContext.defaultParallelism, math.ceil(n / GROUP_ROWS))

    def group_of(leaf: int, cell: int) -> int:
        return (leaf * 2654435761 + cell * 40503) % 4294967296 * groups >> 32

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree.of(held.value)
        for pdf in batches:
            out = []
            # a walk goes on until its leaves hold the query itself and k others
            walks = tree.visits(_matrix(pdf["embedding"], d), visits, rows_of, k + 1)
            for i, e, leaves in zip(pdf["vec_id"].tolist(), pdf["embedding"], walks):
                go: dict[int, list[int]] = {}
                for leaf in leaves:
                    for c in range(cells.get(leaf, 0)):
                        go.setdefault(group_of(leaf, c), []).append(leaf)
                out += [(g, i, e, sorted(set(ls))) for g, ls in go.items()]
            yield pd.DataFrame(out, columns=["grp", "query_id", "q", "leaves"])

    asked = cut(queries.mapInPandas(to_visits, "grp int, query_id long, q array<double>, leaves array<int>"))
    # a group's vectors are copied once per block of the queries that come to it, not of all queries
    blocks = {r["grp"]: math.ceil(r["count"] / QUERY_BLOCK) for r in asked.groupBy("grp").count().collect()}

    def to_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = [int(i % 1000003 % cells[leaf]) for i, leaf in zip(pdf["vec_id"], pdf["leaf"])]
            pdf = pdf.assign(grp=[group_of(leaf, c) for leaf, c in zip(pdf["leaf"].tolist(), cell)])
            copies = pdf["grp"].map(blocks).fillna(0).astype(int).to_numpy()
            for b in range(int(copies.max(initial=0))):
                yield pdf[copies > b].assign(block=b)

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(block=[i % 1000003 % blocks[g] for i, g in zip(pdf["query_id"].tolist(), pdf["grp"].tolist())])

    def product(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(q["query_id"].to_numpy(np.int64), _matrix(q["q"], d), v["vec_id"].to_numpy(np.int64),
                          _matrix(v["embedding"], d), k, v["leaf"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in q["leaves"]])

    left = placed.mapInPandas(to_groups, "vec_id long, embedding array<double>, leaf int, grp int, block int")
    right = asked.mapInPandas(to_blocks, "grp int, query_id long, q array<double>, leaves array<int>, block int")
    found = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInPandas(
        product, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
