"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted in numpy on a bounded sample (`sample_rows`); leaves that hold many rows of the table are split
further, on samples of their own, until none is large; every row is then indexed by its leaf. A query walks the tree with a priority queue: the node with the largest possible inner product (centroid product
plus radius times query norm) is opened next, and leaves come out in that order. How many leaves a query
visits is calibrated: for a bounded set of calibration queries the true neighbours over all rows are found, and
the visits widen until the mean share of them in visited leaves reaches `target_recall`. A query whose leaves
hold fewer than k rows besides its own goes on to further leaves. Candidates in visited leaves are scored exactly in
double precision. Leaves with very many rows, and the queries of a leaf, are dealt to several tasks in blocks.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components are neither indexed nor searched for. Equal scores go to the smaller id. Repeated ids are rows of
their own; a query never returns rows with its own id. Where the table has fewer than k others, all are returned. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import materialize, small


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    branching: int = 8
    #: Rows that the tree is fitted on, at most.
    sample_rows: int = 20_000
    #: Sample rows under which a node is a leaf.
    leaf_sample: int = 128
    iterations: int = 8
    calibration_queries: int = 100
    target_recall: float = 0.97
    #: Indexed rows of one leaf that one task scores; leaves of more rows are split as far as their vectors differ.
    chunk_rows: int = 10_000
    #: Rows of a large leaf that it is split on, about.
    split_sample: int = 1024
    #: Queries that one task scores against a leaf, about.
    block_queries: int = 10_000
    seed: int = 3


@dataclass
class Tree:
    centers: np.ndarray  # of all nodes
    radius: np.ndarray
    children: list[list[int]]
    leaf_of: np.ndarray  # leaf number of a node, -1 for inner nodes

    @property
    def n_leaves(self) -> int:
        return int((self.leaf_of >= 0).sum())


def _kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(iterations):
        near = _nearest(x, c)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)


def build_tree(x: np.ndarray, params: AnnParams) -> Tree:
    """Split nodes into up to `branching` clusters until they hold few sample rows or equal vectors only."""
    rng = np.random.default_rng(params.seed)
    centers, radius, children, leaf_of = [], [], [], []
    n_leaves = 0

    def add(rows: np.ndarray) -> int:
        nonlocal n_leaves
        me = len(centers)
        center = x[rows].mean(axis=0)
        centers.append(center)
        radius.append(float(np.sqrt(((x[rows] - center) ** 2).sum(1).max())))
        children.append([])
        leaf_of.append(-1)
        parts = []
        if len(rows) > params.leaf_sample:
            near = _nearest(x[rows], _kmeans(x[rows], params.branching, params.iterations, rng))
            parts = [rows[near == j] for j in np.unique(near)]
        if len(parts) < 2:
            leaf_of[me] = n_leaves
            n_leaves += 1
        else:
            children[me] = [add(p) for p in parts]
        return me

    add(np.arange(len(x)))
    return Tree(np.array(centers), np.array(radius), children, np.array(leaf_of))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector: the nearest child's center at every level."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not tree.children[node]:
            out[rows] = tree.leaf_of[node]
            continue
        kids = np.array(tree.children[node])
        near = _nearest(x[rows], tree.centers[kids])
        todo += [(int(kids[j]), rows[near == j]) for j in np.unique(near)]
    return out


def bins(tree: Tree, q: np.ndarray) -> Iterator[int]:
    """All leaves in best-bin-first order."""
    bound = tree.centers @ q + tree.radius * np.sqrt(q @ q)
    heap = [(-bound[0], 0)]
    while heap:
        _, node = heapq.heappop(heap)
        if tree.children[node]:
            for child in tree.children[node]:
                heapq.heappush(heap, (-bound[child], child))
        else:
            yield int(tree.leaf_of[node])


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> list[int]:
    """The first leaves in best-bin-first order."""
    return list(islice(bins(tree, q), visits))


def enough_bins(tree: Tree, q: np.ndarray, visits: int, sizes: dict[int, int], own: dict[int, int], k: int) -> list[int]:
    """The first `visits` leaves, and further ones while all hold fewer than k rows besides the query's own (own: by leaf)."""
    out, held = [], 0
    for leaf in bins(tree, q):
        if len(out) >= visits and held >= k:
            break
        out.append(leaf)
        held += sizes.get(leaf, 0) - own.get(leaf, 0)
    return out


def graft(tree: Tree, leaf: int, sub: Tree) -> None:
    """Put a tree of several leaves in place of a leaf; its first leaf takes over the number."""
    node, base, new = int(np.flatnonzero(tree.leaf_of == leaf)[0]), len(tree.centers) - 1, tree.n_leaves
    number = np.where(sub.leaf_of > 0, sub.leaf_of + new - 1, np.where(sub.leaf_of == 0, leaf, -1))
    tree.children[node] = [c + base for c in sub.children[0]]
    tree.children += [[c + base for c in kids] for kids in sub.children[1:]]
    tree.leaf_of[node] = -1
    tree.leaf_of = np.concatenate([tree.leaf_of, number[1:]])
    tree.centers = np.concatenate([tree.centers, sub.centers[1:]])
    tree.radius = np.concatenate([tree.radius, sub.radius[1:]])


def in_leaves(rows: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """rows (id, v) with their leaf before them."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            leaf = leaves_of(sent.value, _matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "id", "v"])

    return rows.mapInArrow(run, "leaf long, id long, v array<double>")


def leaf_sizes(indexed: DataFrame) -> dict[int, int]:
    return dict(indexed.groupBy("leaf").count().collect())  # one number for each leaf of the tree


def grow(rows: DataFrame, tree: Tree, dim: int, params: AnnParams) -> None:
    """Split leaves of more than chunk_rows rows in passes over the table, each on a bounded sample of its rows, until
    the rest hold fewer or only vectors that no split tells apart."""
    whole: set[int] = set()
    before: dict[int, int] = {}
    while True:
        indexed = in_leaves(rows, tree, dim)
        sizes = leaf_sizes(indexed)
        whole |= {leaf for leaf, n in before.items() if sizes.get(leaf) == n}
        big = {leaf: n for leaf, n in sizes.items() if n > params.chunk_rows and leaf not in whole}
        if not big:
            return
        shares = rows.sparkSession.createDataFrame([(leaf, n, min(1.0, params.split_sample / n) * 1_000_000) for leaf, n in big.items()], "leaf long, n long, share double")
        drawn = F.pmod(F.xxhash64("id", "v", F.lit(params.seed), F.lit(len(tree.centers))), F.lit(1_000_000)) < F.col("share")
        some = indexed.join(small(shares, len(big)), "leaf").where(drawn).select("leaf", "n", "v").distinct()

        def split(table: pa.Table) -> pa.Table:
            x = _matrix(table.column("v").combine_chunks(), dim)
            least = max(16, len(x) * params.chunk_rows // (2 * table.column("n")[0].as_py()))
            sub = build_tree(x, replace(params, leaf_sample=min(least, len(x) - 1)))
            return pa.table({"leaf": table.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(sub)])})

        subs = {r.leaf: pickle.loads(r.tree) for r in some.groupBy("leaf").applyInArrow(split, "leaf long, tree binary").collect()}
        for leaf, n in big.items():
            if leaf in subs and subs[leaf].n_leaves > 1:
                low = tree.n_leaves
                graft(tree, leaf, subs[leaf])
                before |= dict.fromkeys([leaf, *range(low, tree.n_leaves)], n)
            else:
                whole.add(leaf)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in component order, so that equal vectors score equally."""
    out = np.zeros((len(q), len(x)))
    for d in range(x.shape[1]):
        out += q[:, d, None] * x[None, :, d]
    return out


def top(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k largest scores of ids other than own; ties to the smaller id."""
    ok = np.flatnonzero(ids != own)
    if len(ok) > 4 * k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= cut]
    return ok[np.lexsort((ids[ok], -scores[ok]))[:k]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their length."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    dims = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = dims.n if dims else 0
    return fine.where(F.size("v") == dim), dim


def _best_of(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, dim: int, k: int) -> DataFrame:
    """The exact neighbours of a bounded set of queries over all rows: a top list in every task, then one over all."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                scores = products(queries, x)
                for i, own in enumerate(query_ids.tolist()):
                    old = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                    s, d = np.concatenate([old[0], scores[i]]), np.concatenate([old[1], ids])
                    keep = top(s, d, own, k)
                    best[i] = s[keep], d[keep]
        for i, (s, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), query_ids[i])), pa.array(d), pa.array(s)], names=["qid", "id", "score"])

    return _best_of(rows.mapInArrow(run, "qid long, id long, score double"), k)


def dealt(indexed: DataFrame, asked: DataFrame, tree: Tree, known: tuple, visits: int, dim: int, params: AnnParams) -> tuple[DataFrame, DataFrame]:
    """Queries and indexed rows by (leaf, chunk of its rows, block of the queries): a query goes to all chunks of its
    leaves, in its block, and a row to all blocks, so that neither side of a group grows with the table."""
    sc, k = indexed.sparkSession.sparkContext, params.k
    sent, sample = sc.broadcast(tree), sc.broadcast(known)
    sizes = leaf_sizes(indexed)
    blocks = max(1, -(-asked.count() // params.block_queries))
    chunks_of = {leaf: max(1, -(-c // params.chunk_rows)) for leaf, c in sizes.items()}

    def route(batches):
        for batch in (b.slice(low, 256) for b in batches for low in range(0, b.num_rows, 256)):
            qids, q, own = batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(3).to_pylist()
            leaf, at, floor = [], [], np.full(len(q), -np.inf)
            ids, x, leaf_at = sample.value
            for i, v in enumerate(q):
                found = enough_bins(sent.value, v, visits, sizes, dict(own[i] or ()), k)
                near = np.flatnonzero(np.isin(leaf_at, found))
                s = products(v[None], x[near])[0]
                best = top(s, ids[near], qids[i], k)
                floor[i] = s[best[-1]] if len(best) == k else -np.inf
                for bin_ in found:
                    for c in range(chunks_of.get(bin_, 0)):
                        leaf.append((bin_, c))
                        at.append(i)
            if at:
                pairs = np.array(leaf)
                took = batch.select([2, 0, 1]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *took.columns, pa.array(floor[at])], names=["leaf", "chunk", "block", "qid", "q", "floor"])

    # Rows with a query's own id don't count for it: how many there are in each leaf.
    own = indexed.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id", "leaf").count()
    own = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "count"))).alias("own"))
    block = F.pmod(F.xxhash64("id", "v", F.lit(10)), F.lit(blocks)).alias("block")
    spread = asked.join(own, "id", "left").select("id", "v", block, "own").repartition(max(sc.defaultParallelism, blocks), "id")
    routed = spread.mapInArrow(route, "leaf long, chunk long, block long, qid long, q array<double>, floor double")
    deal = F.create_map(*[F.lit(y) for leaf, c in chunks_of.items() if c > 1 for y in (leaf, c)]) if any(c > 1 for c in chunks_of.values()) else None
    pieces = F.coalesce(deal[F.col("leaf")], F.lit(1)) if deal is not None else F.lit(1)
    stored = indexed.withColumn("chunk", F.pmod(F.xxhash64("id", "v", F.lit(9)), pieces).cast("long"))
    return routed, stored.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", params: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank (from 1), id_col, score: neighbours of each row for which is_query (a condition on df) holds."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows, dim = usable(df, id_col, vec_col)
    asked, _ = usable(df.where(is_query), id_col, vec_col)
    n = rows.count()
    if not n or not dim:
        return empty
    asked = asked.where(F.size("v") == dim)
    drawn = F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(1_000_000)) < F.lit(min(1.0, params.sample_rows / n) * 1_000_000)
    sample = rows.where(drawn).limit(2 * params.sample_rows).toArrow().combine_chunks()
    x = _matrix(sample.column("v").combine_chunks(), dim)
    tree = build_tree(x if len(x) else np.zeros((1, dim)), params)
    grow(rows, tree, dim, params)
    indexed = materialize(in_leaves(rows, tree, dim), "ann")
    visits = calibrate(indexed, asked, tree, dim, params)
    # With the sampled rows of the visited leaves a query knows a score that its k-th best reaches at least.
    routed, stored = dealt(indexed, asked, tree, (sample.column("id").to_numpy(), x, leaves_of(tree, x)), visits, dim, params)
    k = params.k

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, out = [], []
        if left.num_rows and right.num_rows:
            ids, x = right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks(), dim)
            qid, q = left.column("qid").to_numpy(), _matrix(left.column("q").combine_chunks(), dim)
            floor = left.column("floor").to_numpy()
            step = max(1, 2_000_000 // len(ids))
            for low in range(0, len(q), step):
                s = products(q[low : low + step], x)
                for i in range(len(s)):
                    keep = top(s[i], ids, qid[low + i], k)
                    keep = keep[s[i][keep] >= floor[low + i]]
                    qs.append(np.full(len(keep), qid[low + i]))
                    out.append((ids[keep], s[i][keep]))
        return pa.table(
            {
                "qid": pa.array(np.concatenate(qs) if qs else [], pa.int64()),
                "id": pa.array(np.concatenate([o[0] for o in out]) if out else [], pa.int64()),
                "score": pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.float64()),
            }
        )

    keys = ["leaf", "chunk", "block"]
    found = routed.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(score, "qid long, id long, score double")
    return _best_of(found, k).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def calibrate(indexed: DataFrame, asked: DataFrame, tree: Tree, dim: int, params: AnnParams) -> int:
    """Fewest leaves to visit for the target recall, on calibration queries with neighbours over all rows."""
    some = asked.orderBy(F.xxhash64("id", F.lit(params.seed)), "id").limit(params.calibration_queries).collect()
    if not some:
        return 1
    q, ids = np.array([r.v for r in some], float), np.array([r.id for r in some], np.int64)
    truth = brute_force(indexed.select("id", "v"), q, ids, dim, params.k).select("qid", "id")
    where = truth.join(indexed.select("id", "leaf"), "id").select("qid", "leaf").collect()
    order = {int(i): {leaf: n for n, leaf in enumerate(best_bins(tree, v, tree.n_leaves))} for i, v in zip(ids, q, strict=True)}
    depth = np.sort([order[r.qid][r.leaf] for r in where]) if where else np.zeros(1)
    return int(depth[min(len(depth) - 1, int(np.ceil(len(depth) * params.target_recall)) - 1)]) + 1
