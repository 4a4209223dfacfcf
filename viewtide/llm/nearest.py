"""Approximate nearest neighbours by inner product: a forest of random-projection trees behind one priority queue.

Vectors are grouped by equal components first; a class has its smallest ids and is indexed once, however many copies it has.
Trees are fitted on a bounded sample (``SAMPLE``): each node splits by a random direction at the sample's median. All
vectors are indexed: each goes to one leaf of every tree. Since the inner product is asked for, not an angle, vectors get one
more component that makes all of them equally long, and queries a zero there.

A query walks all trees through one queue, the node with the smallest squared distance to its cell first, until the leaves
it has taken hold ``visited`` vectors. How many that are is measured when the index is built: the sample's own neighbours,
found by brute force, tell how far down the queue they lie, and the share of vectors to visit is what finds ``recall`` of
them. Where the data have structure that is little; for vectors without any it is more than half of the data.

Leaves are dealt out in groups: the members of a group and the queries that visit it meet in one task as two matrices, and
only the best of a query in a group leave it. A member carries its leaves in all trees and a query the leaves that it visits, so
a vector that a query meets in several trees is reranked in the first of them only. Groups of many queries are dealt out by
blocks of queries. What a query has found in all groups is merged by array functions, first some groups, then all. Vectors
travel as bytes of the precision that they are stored in. Scores are sums of products in the components' order, in double
precision, so copies and trees agree to the last bit.

Defined results: vectors that are null, empty or zero, or have a null or non-finite component, take no part; neither have
those of another dimension than most vectors (the larger one of equal counts); a query doesn't find its own row, but copies
of it; ties go to the smaller vec_id; with fewer candidates than k all are returned; repeated rows of one vec_id count as
one; a null vec_id takes no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Vectors that trees are fitted on, vectors of these that the share to visit is measured with, and sample rows for each leaf.
SAMPLE, PROBES, LEAF_SAMPLE = 16_384, 128, 8
#: Members and queries that meet in one task, about.
GROUP_MEMBERS, GROUP_QUERIES = 8_192, 16_384
#: Groups whose results are merged together first, and inner products that a task has at a time.
MERGE, PRODUCTS = 64, 2_000_000


@dataclass
class Forest:
    """Trees with ``depth`` levels of splits; node i of a level has the children 2i and 2i + 1 of the next."""

    directions: list[list[np.ndarray]]
    thresholds: list[list[np.ndarray]]
    length: float

    @property
    def trees(self) -> int:
        return len(self.directions)

    @property
    def depth(self) -> int:
        return len(self.directions[0])

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """x with the component that brings all vectors to one length."""
        rest = np.maximum(self.length**2 - (x * x).sum(axis=1), 0.0)
        return np.column_stack([x, np.sqrt(rest)])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """A row for each vector, a column for each tree."""
        y = self.lengthened(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for w, h in zip(self.directions[t], self.thresholds[t], strict=True):
                side = np.einsum("ij,ij->i", y, w[node]) > h[node]
                node = 2 * node + side
            out[:, t] = node
        return out

    def walk(self, queries: np.ndarray, sizes: np.ndarray, visited: float) -> list[list[int]]:
        """For each query the leaves (tree * leaves + leaf) that it visits; sizes: vectors in each."""
        y = np.column_stack([queries, np.zeros(len(queries))])
        # Signed distances to every split of every tree, by query.
        margins = [[(y @ w.T - h).tolist() for w, h in zip(ws, hs, strict=True)] for ws, hs in zip(self.directions, self.thresholds, strict=True)]
        counts, depth, leaves = sizes.tolist(), self.depth, self.leaves
        out = []
        for q in range(len(queries)):
            queue = [(0.0, t, 0, 0) for t in range(self.trees)]
            taken, found = 0, []
            while queue and taken < visited:
                cost, t, level, node = heapq.heappop(queue)
                # Down the nearer side; the other side waits in the queue.
                while level < depth:
                    m = margins[t][level][q][node]
                    near = 2 * node + (m > 0)
                    heapq.heappush(queue, (cost + m * m, t, level + 1, near ^ 1))
                    node, level = near, level + 1
                n = counts[t * leaves + node]
                if n:
                    found.append(t * leaves + node)
                    taken += n
            out.append(found)
        return out


def fit(sample: np.ndarray, n_vectors: int, trees: int, length: float, seed: int) -> Forest:
    """Trees deep enough for n_vectors, as far as the sample has rows for their leaves."""
    depth = min(round(np.log2(max(n_vectors, 2)) / 2), int(np.log2(max(len(sample) / LEAF_SAMPLE, 1))))
    rng = np.random.default_rng(seed)
    forest = Forest([], [], length)
    y = forest.lengthened(sample)
    for _ in range(trees):
        node, ws, hs = np.zeros(len(y), np.int64), [], []
        for level in range(max(depth, 0)):
            w = rng.standard_normal((1 << level, y.shape[1]))
            w /= np.linalg.norm(w, axis=1, keepdims=True)
            p = np.einsum("ij,ij->i", y, w[node])
            h = np.zeros(1 << level)
            order = np.lexsort((p, node))
            ends = np.searchsorted(node[order], np.arange(1 << level), side="right")
            begins = np.searchsorted(node[order], np.arange(1 << level), side="left")
            full = ends > begins
            h[full] = p[order[(begins[full] + ends[full] - 1) // 2]]
            node = 2 * node + (p > h[node])
            ws.append(w)
            hs.append(h)
        forest.directions.append(ws)
        forest.thresholds.append(hs)
    return forest


def share_to_visit(forest: Forest, sample: np.ndarray, k: int, recall: float, n_vectors: int) -> float:
    """The vectors to visit, over all vectors, that find the share ``recall`` of the sample's own neighbours."""
    n = len(sample)
    probes = sample[np.linspace(0, n - 1, min(PROBES, n)).astype(int)]
    k = min(k, n - 1)
    if k < 1:
        return float(forest.trees)
    scores = probes @ sample.T
    # The first is the probe itself, mostly.
    nearest = np.argpartition(-scores, min(k, n - 1), axis=1)[:, : k + 1]
    leaf = forest.leaf_of(sample)
    ids = leaf + np.arange(forest.trees) * forest.leaves
    sizes = np.bincount(ids.ravel(), minlength=forest.trees * forest.leaves)
    needed = []
    for p, path in enumerate(forest.walk(probes, sizes, np.inf)):
        place = np.full(forest.trees * forest.leaves, np.inf)
        place[path] = np.cumsum(sizes[path])
        needed.append(place[ids[nearest[p]]].min(axis=1))
    return float(np.quantile(np.concatenate(needed), recall) / n)


def _usable(v: Column, size: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) == size) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _best(column: str | Column, k: int) -> Column:
    """The k first of arrays of (score negated, id), without repeats."""
    return F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list(column)))), 1, k)


def _matrix(column, kind: str, d: int) -> np.ndarray:
    """Vectors as bytes (a Python list or a pandas column of them) -> a row for each, in double precision."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, d).astype(np.float64)


def packed(rows: DataFrame, kind: str, d: int) -> DataFrame:
    """rows (vec_id, v) -> vec_id, v as bytes, its squared length."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Zeros have no sign, so equal vectors have equal bytes.
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(kind) + np.array(0, kind)
            square = (x.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(square)], ["vec_id", "v", "square"])

    return rows.mapInArrow(run, "vec_id long, v binary, square double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 4, recall: float = 0.93, seed: int = 7, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that is_query (a condition on vec_id) holds for."""
    import pandas as pd
    import pyarrow as pa

    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    dimension = known.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if dimension is None:
        return empty
    d = dimension["n"]
    single = known.schema["v"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    usable = known.where(_usable(F.col("v"), d)).select("vec_id", F.col("v").cast("array<float>" if single else "array<double>").alias("v"))
    rows = cut(packed(usable, kind, d))
    # A class's k + 1 smallest ids are all that any query can need of it: its own row may be one of them.
    by_class = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1)
    classes = cut(firsts.groupBy("v").agg(F.min("vec_id").alias("c"), F.first("square").alias("square"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    stats = classes.agg(F.count("*").alias("n"), F.sqrt(F.max("square")).alias("length")).first()
    n = stats["n"]
    if not n:
        return empty
    sample = _matrix([bytes(r["v"]) for r in classes.select("v").orderBy(F.xxhash64("c"), "c").limit(SAMPLE).collect()], kind, d)
    forest = fit(sample, n, trees, stats["length"], seed)
    visited = min(1.0 * trees, share_to_visit(forest, sample, k, recall, n)) * n
    leaves = forest.leaves

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = forest.leaf_of(_matrix(b.column(1).to_pylist(), kind, d)) + np.arange(trees) * leaves
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * trees, pa.int32()), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["c", "v", "leaves"])

    placed = cut(classes.select("c", "v").mapInArrow(place, "c long, v binary, leaves array<long>"))
    sizes = np.zeros(trees * leaves, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    # Leaves in groups of about GROUP_MEMBERS vectors, none across trees; a larger leaf is dealt out in parts.
    group, parts, at = np.zeros(trees * leaves, np.int64), np.maximum(1, -(-sizes // GROUP_MEMBERS)), -1
    full = GROUP_MEMBERS
    for i, size in enumerate(sizes.tolist()):
        if i % leaves == 0 or full + size > GROUP_MEMBERS:
            at, full = at + 1, 0
        group[i] = at
        full += size
    asked = rows.where(is_query).select("vec_id", "v").distinct()
    queries = cut(asked.join(classes.select("v", "c"), "v").select("vec_id", "c"))
    query_classes = queries.select("c").distinct().join(classes.select("c", "v"), "c")
    blocks = max(1, -(-query_classes.count() // GROUP_QUERIES))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                vectors_ = s.column(1).to_pylist()
                out: list[tuple] = []
                for c, v, path in zip(s.column(0).to_pylist(), vectors_, forest.walk(_matrix(vectors_, kind, d), sizes, visited), strict=True):
                    bits = np.zeros(trees * leaves, bool)
                    bits[path] = True
                    seen = np.packbits(bits).tobytes()
                    out += [(g, part, c % blocks, c, v, seen) for g, part in {(int(group[leaf]), part) for leaf in path for part in range(parts[leaf])}]
                kinds = [pa.int64()] * 4 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "part", "block", "q", "x", "seen"])

    visits = query_classes.repartition(spark.sparkContext.defaultParallelism, "c").mapInArrow(walk, "g long, part long, block long, q long, x binary, seen binary")
    # A row for each leaf, of which the sample's size bounds the number.
    table = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(group)), "g": group, "parts": parts}))
    members = placed.select("c", "v", "leaves", F.explode("leaves").alias("leaf")).join(F.broadcast(table), "leaf")
    members = members.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    members = members.select("g", "part", "block", "leaf", "leaves", "c", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"q": pd.Series([], dtype="int64"), "best": pd.Series([], dtype=object)})
        if left.empty or right.empty:
            return nothing
        left = left.sort_values("leaf", kind="stable")
        x, ids, leaf = _matrix(left["v"], kind, d), left["c"].to_numpy(), left["leaf"].to_numpy()
        y, q = _matrix(right["x"], kind, d), right["q"].to_numpy()
        all_leaves = np.stack(left["leaves"].to_numpy())
        seen = np.unpackbits(np.frombuffer(b"".join(right["seen"]), np.uint8).reshape(len(right), -1), axis=1, count=trees * leaves).astype(bool)
        which, what = [], []
        for v in np.unique(leaf):
            a, z = np.searchsorted(leaf, v), np.searchsorted(leaf, v, side="right")
            who = np.flatnonzero(seen[:, v])
            if not len(who):
                continue
            keep, step = min(k + 1, z - a), max(1, PRODUCTS // (z - a))
            for some in (who[w : w + step] for w in range(0, len(who), step)):
                s = y[some] @ x[a:z].T
                for t in range(int(v) // leaves):
                    # In an earlier tree the query has met it already.
                    s[seen[some][:, all_leaves[a:z, t]]] = -np.inf
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                # Ties with the last one kept stay too: which of them come first is decided by id.
                least = np.take_along_axis(s, top, 1).min(axis=1)
                bound = np.where(np.isfinite(least), least - 1e-9 * np.abs(least), -np.finfo(np.float64).max)
                i, j = np.nonzero(s >= bound[:, None])
                which.append(some[i])
                what.append(a + j)
        if not which or not sum(map(len, which)):
            return nothing
        i, j = np.concatenate(which), np.concatenate(what)
        score = np.zeros(len(i))
        for c in range(d):
            score += y[i, c] * x[j, c]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        cuts = np.flatnonzero(np.diff(i)) + 1
        best = [[{"s": -float(a), "c": int(b)} for a, b in zip(sc[: k + 1], ids[jj[: k + 1]], strict=True)] for sc, jj in zip(np.split(score, cuts), np.split(j, cuts), strict=True)]
        return pd.DataFrame({"q": q[i[np.concatenate([[0], cuts])]], "best": best})

    key = ["g", "part", "block"]
    met = members.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(meet, "q long, best array<struct<s:double,c:long>>")
    some = met.withColumn("merge", F.pmod(F.xxhash64("q", F.size("best"), F.element_at("best", 1)["c"]), F.lit(max(1, (at + 1) // MERGE))))
    some = some.groupBy("q", "merge").agg(_best("best", k + 1).alias("best"))
    found = cut(some.groupBy("q").agg(_best("best", k + 1).alias("best")))
    # From classes to their members' ids.
    each = found.select("q", F.explode("best").alias("b")).select("q", F.col("b.s").alias("s"), F.col("b.c").alias("c"))
    each = each.join(classes.select("c", "ids"), "c").select("q", F.transform("ids", lambda i: F.struct(F.col("s").alias("s"), i.alias("c"))).alias("entries"))
    lists = each.groupBy("q").agg(_best("entries", k + 1).alias("best"))
    result = queries.join(lists, queries["c"] == lists["q"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["c"] != F.col("vec_id")), 1, k).alias("best"))
    result = result.select("query_id", F.posexplode("best").alias("at", "b"))
    return result.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.c").alias("vec_id"), (-F.col("b.s")).alias("score"))
