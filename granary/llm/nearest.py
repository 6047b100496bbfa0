"""Approximate nearest neighbours: stable projections in a few dimensions, indexed by kd-trees.

Largest inner product is made nearest distance. Vectors are dealt into bands of like norms, M being the largest
squared norm of a band; divided by sqrt(M) they get one more component, so that all have length 1, and queries are brought
to length 1 too: then distance**2 = 2 - 2 q.v / (|q| sqrt(M)). DIM Gaussian (2-stable) projections keep distances: the
ratio of squares follows a chi-square law of DIM degrees.

A kd-tree over the projections, its splits fitted on a bounded sample (SAMPLE), deals every vector to a cell; a cell is
dealt to tasks in blocks of at most about SHARD vectors. A task indexes its block by a kd-tree of its own (leaves of at
most LEAF vectors, tight boxes) and takes the leaves of each query in order of projected distance, verifying on the
originals those vectors that pass the test: projected distance**2 <= chi-square quantile(SURE) * (distance**2 of the
K-th best so far). The bound tightens with each leaf; a query stops at the first leaf beyond it. So a true neighbour
is missed with a probability of at most 1 - SURE.

The first round opens the cell in which a query itself lies, which bounds its K-th best; the second deals the query to
all further cells that the test lets in. More than SAMPLE / 8 cells aren't made: beyond that many times SHARD vectors
cells have several blocks, and each block is searched through its own tree as before.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component (or whose squares have no finite sum) take no part, nor do those
whose length isn't the most common one (ties: the smaller); with fewer than K candidates all are returned; ties go to the
smaller vec_id; repeated rows are candidates of their own, but for rows of the query's own vec_id; an empty table
gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The contract's neighbours and queries.
K, EVERY = 20, 20
#: Projected dimensions, vectors that the cells are fitted on, vectors to a block, vectors to a leaf, queries to a part.
DIM, SAMPLE, SHARD, LEAF, PART = 24, 16384, 8192, 128, 4096
#: Chance with which the test keeps a true neighbour, and the chi-square quantile of DIM = 24 degrees there (a fixed value).
SURE, QUANTILE = 0.88, 32.288425


def tree(points: np.ndarray, leaves: int) -> tuple[list[tuple[int, float, int, int]], np.ndarray]:
    """(nodes, boxes): a node is (axis, split, left, right), leaves being ~number; boxes[leaf] is (low, high)."""
    nodes, boxes = [], []

    def grow(own: np.ndarray, low: np.ndarray, high: np.ndarray, count: int) -> int:
        spread = own.max(0) - own.min(0) if len(own) else np.zeros(points.shape[1])
        if count < 2 or not spread.any():
            boxes.append((low, high))
            return ~(len(boxes) - 1)
        axis = int(spread.argmax())
        split = float(np.median(own[:, axis]))
        if not (own[:, axis] > split).any():
            split = float(own[own[:, axis] < split, axis].max())
        at = len(nodes)
        nodes.append(())
        lower, upper = high.copy(), low.copy()
        lower[axis] = upper[axis] = split
        side = own[:, axis] <= split
        nodes[at] = (axis, split, grow(own[side], low, lower, count // 2), grow(own[~side], upper, high, count - count // 2))
        return at

    far = np.full(points.shape[1], np.inf)
    grow(points, -far, far, leaves)
    return nodes, np.array(boxes)


def leaf_of(nodes: list, points: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1)
    for _ in range(len(nodes)):
        inner = at >= 0
        if not inner.any():
            break
        for n in np.unique(at[inner]):
            axis, split, left, right = nodes[n]
            own = at == n
            at[own] = np.where(points[own, axis] <= split, left, right)
    return ~at


def halved(points: np.ndarray, own: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """The rows `own` of points as leaves of at most `most`, cut at medians; equal points stay together."""
    spread = points[own].max(0) - points[own].min(0)
    if len(own) <= most or not spread.any():
        return [own]
    axis = int(spread.argmax())
    order = own[np.argsort(points[own, axis], kind="stable")]
    return [*halved(points, order[: len(order) // 2], most), *halved(points, order[len(order) // 2 :], most)]


def gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each of p from each box."""
    out = np.empty((len(p), len(low)))
    for i in range(len(low)):
        out[:, i] = (np.maximum(np.maximum(low[i] - p, p - high[i]), 0.0) ** 2).sum(1)
    return out


def incremental(ids: np.ndarray, v: np.ndarray, p: np.ndarray, asked: np.ndarray, q: np.ndarray, qp: np.ndarray, reach: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scores, verified): the k best of a block for each query, -inf where there are fewer, and how many vectors were
    verified. reach is |q| sqrt(M); below worst nothing counts."""
    found, score = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -np.inf)
    verified = np.zeros(len(q), np.int64)
    leaves = halved(p, np.arange(len(p)))
    low, high = np.array([p[x].min(0) for x in leaves]), np.array([p[x].max(0) for x in leaves])
    gap = gaps(qp, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    live, p2, qp2 = np.arange(len(q)), (p**2).sum(1), (qp**2).sum(1)
    for step in range(len(leaves)):
        kth = np.maximum(worst[live], score[live, k - 1])
        with np.errstate(invalid="ignore"):
            limit = np.where(np.isinf(kth), np.inf, np.maximum(2 - 2 * kth / reach[live], 0.0) * QUANTILE * (1 + 1e-9))
        at = order[live, step]
        go = gap[live, at] <= limit
        live, limit, at = live[go], limit[go], at[go]
        if not len(live):
            break
        for leaf in np.unique(at):
            rows, own = live[at == leaf], leaves[leaf]
            near = p2[own] + qp2[rows, None] - 2 * (qp[rows] @ p[own].T) <= limit[at == leaf, None] + 1e-9
            near &= ids[own] != asked[rows, None]
            verified[rows] += near.sum(1)
            # of the products those that can get among the k best are taken once more, each in the same way wherever it stands
            least = np.maximum(worst[rows], score[rows, k - 1]) - 1e-9 * reach[rows]
            near &= q[rows] @ v[own].T >= least[:, None]
            better = near.any(1)
            if not better.any():
                continue
            rows, near = rows[better], near[better]
            i, j = np.nonzero(near)
            s = np.full(near.shape, -np.inf)
            s[i, j] = np.einsum("ij,ij->i", q[rows[i]], v[own[j]])
            s[s < worst[rows, None]] = -np.inf
            all_s, all_ids = np.hstack([score[rows], s]), np.hstack([found[rows], np.broadcast_to(ids[own], s.shape)])
            best = np.lexsort((all_ids, -all_s), axis=1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_ids, best, 1)
    return found, score, verified


class Search:
    def __init__(self, vectors: DataFrame, k: int = K, every: int = EVERY, seed: int = 7, shard: int = SHARD):
        self.k, self.every, self.spark = k, every, vectors.sparkSession
        e = F.col("embedding")
        fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        v = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").where(fine).select("vec_id", F.transform(e, lambda x: x.cast("double")).alias("v"))
        v = v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).where(f"norm2 > 0 AND norm2 < double('inf')")
        v = v.withColumn("band", F.floor(F.log2("norm2") / 2))
        # a row for each length and power of four
        stats = v.groupBy(F.size("v").alias("d"), "band").agg(F.max("norm2").alias("m"), F.count("*").alias("n")).collect()
        counts: dict[int, int] = {}
        for r in stats:
            counts[r["d"]] = counts.get(r["d"], 0) + r["n"]
        self.n = max(counts.values(), default=0)
        if self.n:
            d = min(d for d, n in counts.items() if n == self.n)
            self.vectors = v.where(F.size("v") == d)
            self.bands = {r["band"]: r["m"] for r in sorted(stats, key=lambda r: r["band"]) if r["d"] == d}
            self.matrix = np.random.default_rng(seed).standard_normal((d + 1, DIM))
            rows = self.vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v", "norm2", "band").limit(SAMPLE).collect()
            points = self.projection()(np.array([r["v"] for r in rows]), np.array([r["norm2"] for r in rows]), np.array([r["band"] for r in rows]))
            cells = 1 << int(np.ceil(np.log2(max(self.n / shard, 1))))
            self.nodes, self.boxes = tree(points, max(1, min(cells, SAMPLE // 8)))
            self.shard = shard

    def projection(self):
        """(vectors, squared norms, bands) -> projections of the vectors, divided by sqrt(M), with their further component."""
        matrix, keys, most = self.matrix, np.array(list(self.bands)), np.array(list(self.bands.values()))

        def project(v: np.ndarray, norm2: np.ndarray, band: np.ndarray) -> np.ndarray:
            m = most[np.searchsorted(keys, band)]
            return np.hstack([v / np.sqrt(m)[:, None], np.sqrt(np.maximum(1 - norm2 / m, 0.0))[:, None]]) @ matrix

        return project

    def run(self) -> DataFrame:
        """(query_id, rank, vec_id, score, verified): verified is how many vectors the query was held against."""
        k = self.k
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
        matrix, nodes, boxes, shard = self.matrix, self.nodes, self.boxes, self.shard
        keys, most, project = np.array(list(self.bands)), np.array(list(self.bands.values())), self.projection()
        size = len(boxes)  # a cell is the place of its band times size, and its leaf

        def arrays(column) -> np.ndarray:
            return np.array(column.combine_chunks().flatten()).reshape(len(column), -1)

        def place(batches):
            for b in batches:
                if b.num_rows:
                    t = pa.Table.from_batches([b])
                    band = np.array(t["band"])
                    p = project(arrays(t["v"]), np.array(t["norm2"]), band)
                    cell = np.searchsorted(keys, band) * size + leaf_of(nodes, p)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(p), pa.list_(pa.float64())), pa.array(cell)], ["vec_id", "v", "p", "cell"])

        indexed = written(self.vectors.mapInArrow(place, "vec_id long, v array<double>, p array<double>, cell long"), "indexed")
        count = indexed.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("blocks"))
        indexed = indexed.join(count, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        asked = self.vectors.where(F.col("vec_id") % self.every == 0).dropDuplicates(["vec_id"]).select("vec_id", "v", "norm2")
        names = ["vec_id", "v", "p", "norm2", "cells", "worst"]
        schema = "vec_id long, v array<double>, p array<double>, norm2 double, cells array<long>, worst double"

        def homes(batches):
            for b in batches:
                if b.num_rows:
                    t = pa.Table.from_batches([b])
                    p = arrays(t["v"]) / np.sqrt(np.array(t["norm2"]))[:, None] @ matrix[:-1]
                    cells = leaf_of(nodes, p)[:, None] + np.arange(len(keys)) * size
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(p), pa.list_(pa.float64())), b.column(2), pa.array(list(cells), pa.list_(pa.int64())), pa.nulls(len(p), pa.float64())], names)

        first = written(asked.mapInArrow(homes, schema), "queries")

        def verify(key, left: pa.Table, right: pa.Table) -> pa.Table:
            """left: vectors of a block; right: queries dealt to it. A row without vec_id says how many vectors were verified."""
            own, cell = np.array(right["vec_id"]), key[0].as_py()
            found, score, verified = np.empty((0, k), np.int64), np.empty((0, k)), np.empty(0, np.int64)
            if left.num_rows and right.num_rows:
                worst = np.array([-np.inf if x is None else x for x in right["worst"].to_pylist()])
                reach = np.sqrt(np.array(right["norm2"]) * most[cell // size])
                found, score, verified = incremental(np.array(left["vec_id"]), arrays(left["v"]), arrays(left["p"]), own, arrays(right["v"]), arrays(right["p"]), reach, worst, k)
            else:
                own = own[:0]
            real = score > -np.inf
            ids = pa.concat_arrays([pa.array(found[real], pa.int64()), pa.nulls(len(own), pa.int64())])
            return pa.table({"query_id": np.concatenate([np.repeat(own, k).reshape(-1, k)[real], own]), "vec_id": ids, "score": np.concatenate([score[real], verified.astype(float)])})

        def searched(queries: DataFrame) -> DataFrame:
            dealt = queries.withColumn("cell", F.explode("cells")).select("vec_id", "v", "p", "norm2", "worst", "cell")
            parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
            dealt = dealt.join(count, "cell").join(parts, "cell")
            right = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).select("cell", "block", "part", "vec_id", "v", "p", "norm2", "worst")
            left = indexed.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "block", "part", "vec_id", "v", "p")
            by = ["cell", "block", "part"]
            return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(verify, "query_id long, vec_id long, score double")

        def top(rows: DataFrame) -> DataFrame:
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            return rows.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

        home = written(searched(first), "home")
        # the K-th best so far; without K so far: no bound
        bound = top(home).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        bound = bound.select("query_id", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))

        def further(batches):
            for b in batches:
                if b.num_rows:
                    t = pa.Table.from_batches([b])
                    p, norm2 = arrays(t["p"]), np.array(t["norm2"])
                    worst = np.array([-np.inf if x is None else x for x in t["worst"].to_pylist()])
                    gap = gaps(p, boxes[:, 0], boxes[:, 1])
                    ok = []
                    for m in most:
                        limit = np.where(np.isinf(worst), np.inf, (2 - 2 * worst / np.sqrt(norm2 * m)) * QUANTILE * (1 + 1e-9))
                        ok.append((gap <= limit[:, None]) & (limit >= 0)[:, None])
                    ok = np.hstack(ok)
                    cells = [sorted(set(np.flatnonzero(o).tolist()) - set(h)) for o, h in zip(ok, t["cells"].to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cells, pa.list_(pa.int64())), b.column(5)], names)

        joined = first.drop("worst").join(bound, F.col("vec_id") == F.col("query_id"), "left").select(*names)
        second = written(joined.mapInArrow(further, schema), "second")
        found = written(home.unionAll(searched(second)), "found")
        verified = found.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("verified"))
        return top(found).join(verified, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return Search(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).run()


QUERIES, ORACLE = {"op5_nearest": op5_nearest}, {}
