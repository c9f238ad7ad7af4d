"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first until a calibrated recall is reached."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, read_table, ship

TOP = 20
#: Rows that the tree is fitted on, children of a node, queries that calibrate, and the recall they need.
FIT, BRANCH, CALIBRATE, RECALL = 20_000, 8, 128, 0.97
#: Rows of a leaf that are scored at a time, the leaves that a search visits first to learn what a row must reach, and results that one
#: aggregation merges for a query.
BLOCK, PROBE, FAN = 4096, 3, 64
#: Lengths that the vectors of one table may have; each is searched by itself.
LENGTHS = 16

#: The floor of a query that has none; minus infinity stands for its own row.
LOWEST = float(np.finfo(np.float64).min)


class Tree:
    """Centroids of a hierarchical k-means; children of a node are nodes, and leaves are numbered."""

    def __init__(self, data: np.ndarray, leaf: int, seed: int = 5):
        self.random = np.random.default_rng(seed)
        self.children: list[list[int]] = []
        self.centers: list[np.ndarray | None] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        self._grow(data.astype(np.float64), leaf, 0)
        del self.random

    def _grow(self, data: np.ndarray, leaf: int, depth: int) -> int:
        node = len(self.children)
        self.children.append([])
        self.centers.append(None)
        self.leaf_of.append(-1)
        parts = self._split(data, min(BRANCH, max(2, -(-len(data) // leaf)))) if len(data) > leaf and depth < 24 else None
        if parts is None:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return node
        centers, groups = parts
        self.centers[node] = centers
        self.children[node] = [self._grow(data[g], leaf, depth + 1) for g in groups]
        return node

    def _split(self, data: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
        distinct = np.unique(data, axis=0)
        if len(distinct) < 2:
            return None
        centers = distinct[self.random.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(8):
            own = nearest(data, centers)
            used = np.unique(own)
            centers = np.stack([data[own == c].mean(axis=0) for c in used])
        own = nearest(data, centers)
        used = np.unique(own)
        return (centers[used], [np.flatnonzero(own == c) for c in used]) if len(used) > 1 else None

    def assign(self, data: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest centroid."""
        out = np.zeros(len(data), np.int64)
        todo = [(0, np.arange(len(data)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf_of[node] >= 0:
                out[rows] = self.leaf_of[node]
                continue
            own = nearest(data[rows], self.centers[node])
            for c, child in enumerate(self.children[node]):
                if (own == c).any():
                    todo.append((child, rows[own == c]))
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: the queue's best node by inner product with its centroid is opened next."""
        queue = [(-np.inf, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                yield self.leaf_of[node]
                continue
            for near, child in zip(self.centers[node] @ query, self.children[node], strict=True):
                heapq.heappush(queue, (-near, child))


def nearest(data: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1)[None, :] - 2 * data @ centers.T).argmin(axis=1)


def exact(rows: np.ndarray, query: np.ndarray) -> list[float]:
    """Inner products in double precision, correctly rounded, so that equal vectors have equal scores."""
    return [fsum(r) for r in (rows * query).tolist()]


def exact_of_many(rows: np.ndarray, query: np.ndarray) -> list[float]:
    """The same, with equal vectors computed once."""
    if len(rows) <= 64:
        return exact(rows, query)
    distinct, place = np.unique(rows, axis=0, return_inverse=True)
    return np.array(exact(distinct, query))[place.ravel()].tolist()


def reach_of(floors: np.ndarray | None, queries: int) -> np.ndarray:
    """What a rough score must reach: a little under the floor, for the error of a product."""
    out = np.full(queries, LOWEST)
    if floors is not None:
        given = floors > LOWEST
        out[given] = floors[given] - 1e-9 * (1 + np.abs(floors[given]))
    return out


def best_of(rows: np.ndarray, ids: np.ndarray, data: np.ndarray, queries: np.ndarray, asking: np.ndarray, top: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, list[float]]]:
    """(number of the query, places of its best rows in the block, exact scores) for each query with rows that reach its floor.

    rows are the rows' own numbers and asking those of the queries: a query never finds itself. Ties go to smaller ids, then rows. All
    rows whose rough score may tie with the last one that counts are scored exactly, however many they are.
    """
    rough = queries @ data.T
    rough[asking[:, None] == rows[None, :]] = -np.inf
    reach = reach_of(floors, len(queries))
    for k in np.flatnonzero((rough >= reach[:, None]).any(axis=1)):
        near, q = rough[k], queries[k]
        some = np.flatnonzero(near >= reach[k])
        if len(some) > top:
            cut = np.partition(near[some], len(some) - top)[len(some) - top]
            some = some[near[some] >= cut - 1e-9 * (1 + abs(cut))]
        scores = np.array(exact_of_many(data[some], q))
        order = np.lexsort((rows[some], ids[some], -scores))[:top]
        yield k, some[order], scores[order].tolist()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """id and v (array of double) of the vectors that take part: not null, not empty, no null or non-finite component, not all zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(~bad).where(F.exists("v", lambda x: x != 0))


FOUND = {"asking": pa.int64(), "part": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "leaf": pa.int64(), "score": pa.float64()}
FOUND_SCHEMA = "asking long, part long, row long, vec_id long, leaf long, score double"


def _found(part: int, asking: np.ndarray, rows: np.ndarray, ids: np.ndarray, leaves: np.ndarray, best: Iterator) -> Iterator[pa.RecordBatch]:
    """best_of as rows of FOUND."""
    columns: list[list] = [[] for _ in range(5)]
    for k, places, scores in best:
        for column, values in zip(columns, (np.full(len(places), asking[k]), rows[places], ids[places], leaves[places], scores), strict=True):
            column.extend(values)
    if columns[0]:
        columns.insert(1, [part] * len(columns[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.values(), strict=True)], list(FOUND))


def merge_top(found: DataFrame, top: int, parts: int) -> DataFrame:
    """asking and best: the first `top` of each query's rows as an array, by falling score, vec_id and row.

    Partial results are merged in levels, of which each brings some FAN of a query's parts together, so that no group grows with the table.
    """
    item = F.struct((F.lit(0.0) - F.col("score")).alias("s"), "vec_id", "row", "leaf")
    while True:
        parts = -(-parts // FAN)
        best = found.groupBy("asking", F.pmod(F.xxhash64("part"), F.lit(parts)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(item)), 1, top).alias("best"))
        if parts == 1:
            return best.drop("part")
        found = best.select("asking", "part", F.explode("best").alias("b")).select("asking", "part", "b.row", "b.vec_id", "b.leaf", (F.lit(0.0) - F.col("b.s")).alias("score"))


def _brute(queries: np.ndarray, asking: np.ndarray, top: int):
    """The best rows of each Arrow batch for a bounded number of queries, by all inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            rows, ids, leaves, data = *(b.column(c).to_numpy() for c in ("row", "id", "leaf")), _matrix(b.column("v"))
            for at in range(0, len(ids), BLOCK):
                cut = slice(at, at + BLOCK)
                yield from _found(part, asking, rows[cut], ids[cut], leaves[cut], best_of(rows[cut], ids[cut], data[cut], queries, asking, top))
                part += 1

    return run


def brute_force(indexed: DataFrame, asking: list, top: int) -> DataFrame:
    """merge_top of all rows for a bounded list of query rows (row and v)."""
    vectors, rows = np.array([q["v"] for q in asking], np.float64), np.array([q["row"] for q in asking], np.int64)
    return merge_top(indexed.select("row", "id", "leaf", "v").mapInArrow(lean(_brute(vectors, rows, top)), FOUND_SCHEMA), top, indexed.count() // 1000 + 1)


def calibrate(tree: Tree, indexed: DataFrame, asking: list, top: int, recall: float) -> int:
    """Leaf visits at which the given query rows, a bounded number, find that share of their true neighbours among all rows."""
    if not asking or tree.leaves < 2:
        return tree.leaves
    vectors, ranks = {q["row"]: np.array(q["v"], np.float64) for q in asking}, []
    for found in brute_force(indexed, asking, top).collect():
        place = {leaf: i for i, leaf in enumerate(tree.visit(vectors[found["asking"]]))}
        ranks += [place[x["leaf"]] for x in found["best"]]
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else tree.leaves


class Index(NamedTuple):
    """tree; indexed: row, id, v, query and leaf of every row; visits: the leaves that a search opens; total rows."""

    tree: Tree
    indexed: DataFrame
    visits: int
    total: int


def build_index(vectors: DataFrame, is_query, top: int = TOP, fit: int = FIT, leaf: int | None = None, recall: float = RECALL) -> Index:
    """vectors: id and v of one length. The tree is fitted on the first `fit` rows by hash of id; leaves should hold `leaf` rows, or the
    square root of all, and at least eight rows of the sample. Every row is indexed. CALIBRATE query rows fix the number of visits."""
    total = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id", F.lit(3)), "id", F.xxhash64("v")).limit(fit).collect()
    tree = Tree(np.array([r["v"] for r in sample], np.float64), max(8, int((leaf or total**0.5) * len(sample) / total)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = tree.assign(_matrix(b.column("v"))) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "v", "query")), pa.array(leaves)], ["row", "id", "v", "query", "leaf"])

    asks = F.coalesce(is_query(F.col("id")), F.lit(False)).alias("query")
    # the row numbers are written with the rows, so that they never change
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "id", "v", asks)
    indexed = materialize(numbered.mapInArrow(lean(index), "row long, id long, v array<double>, query boolean, leaf long"), "ann-index")
    some = indexed.where("query").select("row", "v").orderBy(F.xxhash64("row", F.lit(4)), "row").limit(CALIBRATE).collect()
    return Index(tree, indexed, calibrate(tree, indexed, some, top, recall), total)


def search_index(index: Index, top: int = TOP) -> DataFrame:
    """asking (a query's row) and best (merge_top) of every query row of an index."""
    tree, indexed, visits, _ = index
    # every leaf in blocks of rows: a hot leaf is many blocks. A row per leaf, and the sample bounds the leaves: small enough to broadcast
    sizes = materialize(indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "ann-leaves")
    blocks = sizes.agg(F.sum("blocks")).first()[0]
    block = F.pmod(F.xxhash64("row", F.lit(9)), F.col("blocks")).cast("int").alias("block")
    rows = indexed.join(F.broadcast(sizes), "leaf").select("leaf", block, "row", "id", "v", F.lit(False).alias("query"), F.lit(0.0).alias("floor"))

    def found_in(first: int, last: int, asking: DataFrame) -> DataFrame:
        """FOUND from the leaves at these places of each query's order of visits. asking: row, v and floor."""

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaves = [list(islice(tree.visit(q), first, last)) for q in _matrix(b.column("v"))]
                take = pa.array(np.repeat(np.arange(len(leaves)), [len(x) for x in leaves]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([x for y in leaves for x in y], np.int64)), *(b.column(c).take(take) for c in ("row", "v", "floor"))], ["leaf", "row", "v", "floor"])

        sent = asking.select("row", "v", "floor").mapInArrow(lean(visited), "leaf long, row long, v array<double>, floor double")
        sent = sent.join(F.broadcast(sizes), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", F.lit(0).cast("long").alias("id"), "v", F.lit(True).alias("query"), "floor")
        return rows.unionByName(sent).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "query").mapInArrow(lean(_scored(top)), FOUND_SCHEMA)

    asking = indexed.where("query").select("row", "v")
    near = materialize(found_in(0, min(PROBE, visits), asking.withColumn("floor", F.lit(LOWEST))), "ann-probed")
    if visits > PROBE:
        floors = merge_top(near, top, blocks).select(F.col("asking").alias("row"), F.when(F.size("best") == top, F.lit(0.0) - F.element_at("best", top)["s"]).otherwise(F.lit(LOWEST)).alias("floor"))
        near = near.unionByName(found_in(PROBE, visits, asking.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))))
    return merge_top(near, top, 2 * blocks)


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, top: int = TOP, fit: int = FIT, leaf: int | None = None, recall: float = RECALL) -> DataFrame:
    """For each query row its top nearest other rows by inner product: query_id, rank, vec_id, score.

    The tree is fitted on a bounded sample; all rows are indexed under its leaves. CALIBRATE queries, searched against all rows by brute
    force, fix how many leaves a search visits. Queries go to the leaves that they visit: PROBE leaves first, then the others with the
    score that a row must reach by then, so that few rows come back. Leaves are dealt out in blocks of rows, so a leaf with a third of all
    rows is scored by many tasks, and at most `top` rows of a block come back for each query, merged in levels.
    Vectors that are null, empty, zero, or hold null or non-finite components, and null ids, take no part. Vectors of different lengths
    have no product: each length is searched by itself; more than LENGTHS of them are an error. Ties go to the smaller vec_id. Rows with
    one id are rows of their own: each of them asks, with its own vector and results, and may find the other; a row never finds itself.
    Fewer candidates than top are all returned; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = usable(vectors)
    lengths = [r[0] for r in base.select(F.size("v").alias("n")).distinct().orderBy("n").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"the vectors have more than {LENGTHS} lengths")
    out = spark.createDataFrame([], RESULT)
    for n in lengths:
        index = build_index(base.where(F.size("v") == n), is_query, top, fit, leaf, recall)
        ids = index.indexed.where("query").select(F.col("row").alias("asking"), F.col("id").alias("query_id"))
        best = search_index(index, top).join(ids, "asking").select("query_id", F.posexplode("best"))
        found = best.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (F.lit(0.0) - F.col("col.s")).alias("score"))
        out = found if n == lengths[0] else out.unionByName(found)
    return out


def _scored(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by leaf, block and kind: a block's rows, some BLOCK of them, are held while its queries stream by."""
        at, held, done = None, [], None
        for b in batches:
            keys = np.stack([b.column("leaf").to_numpy(), b.column("block").to_numpy()], axis=1)
            kind = b.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (kind[1:] != kind[:-1]), True])
            rows, ids, floors = (b.column(c).to_numpy() for c in ("row", "id", "floor"))
            data = _matrix(b.column("v"))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[s])
                if key != at:
                    at, held, done = key, [], None
                if not kind[s]:
                    held.append((rows[s:e], ids[s:e], data[s:e]))
                    continue
                if not held:
                    continue
                done = done or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                for q in range(s, e, 256):
                    cut = slice(q, min(q + 256, e))
                    best = best_of(*done, data[cut], rows[cut], top, floors[cut])
                    yield from _found(int(key[0]) << 32 | int(key[1]), rows[cut], done[0], done[1], np.full(len(done[0]), key[0]), best)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
