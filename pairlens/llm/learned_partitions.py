"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is linked to its nearest neighbours, and that graph is cut into
balanced parts by recursive bisection: a smoothed vector over the graph orders the vertices, the
median splits them, and swaps across the cut lower the number of cut links. A small classifier is
then trained to give, for a vector, the parts its neighbours are in. It puts every row into its most
probable part and sends a query to several most probable ones, as many as the sample's own links
need for the recall asked for. Rows of the parts are reranked exactly.

Graph, cut and classifier see the sample only. All rows are indexed by Spark; a part of many rows is
split into blocks, and every query of the part visits all of them, so no group outgrows a task
however often one vector occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import map_batches, stored, table

#: Largest number of vectors that graph, cut and classifier are fitted on.
SAMPLE = 8192
#: Rows a part should have, and fewest sample rows of a part (which bounds the number of parts).
ROWS_PER_PART, SAMPLE_PER_PART = 640, 64
NEIGHBOURS, LINKS = 20, 12
#: Share of a sample row's links that the parts sent to must hold.
RECALL = 0.94
#: Rows and queries of one rerank group.
BLOCK = 4096
HIDDEN, EPOCHS, BATCH, RATE, SEED = 96, 10, 128, 1e-3, 3


def neighbour_graph(x: np.ndarray, links: int) -> np.ndarray:
    """Per row the ``links`` rows of largest inner product, itself left out."""
    out = np.empty((len(x), min(links, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 1024):
        scores = x[lo : lo + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(lo, lo + len(scores))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-scores, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _bisect(links: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Side (False, True) of every vertex; the sides differ by one vertex at most."""
    n = len(links)
    degree = np.full(n, links.shape[1], float)
    np.add.at(degree, links.ravel(), 1)
    heads = np.repeat(np.arange(n), links.shape[1])
    value = rng.normal(size=n)
    for _ in range(60):
        value -= (value * degree).sum() / degree.sum()
        spread = value[links].sum(1) + np.bincount(links.ravel(), value[heads], n)
        value = 0.5 * value + 0.5 * spread / degree
        value /= np.abs(value).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(value, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        sign = np.where(side, 1.0, -1.0)
        pull = (sign[links].sum(1) + np.bincount(links.ravel(), sign[heads], n)) * -sign
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-pull[left])], right[np.argsort(-pull[right])]
        m = min(len(left), len(right))
        gain = pull[left[:m]] + pull[right[:m]]
        swaps = min(int((gain > 0).sum()), max(1, n // 20))
        if not (gain > 0).any():
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side


def balanced_parts(links: np.ndarray, depth: int, seed: int = SEED) -> np.ndarray:
    """Part of every vertex, 2**depth parts of equal size up to one per level."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(links), np.int64)
    for level in range(depth):
        halves = part * 2
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            local = np.full(len(links), -1)
            local[own] = np.arange(len(own))
            near = local[links[own]]
            # Links that leave the part point back to their own vertex and so count for nothing.
            near = np.where(near < 0, np.arange(len(own))[:, None], near)
            halves[own] += _bisect(near, rng)
        part = halves
    return part


@dataclass
class Router:
    """A classifier from vectors to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    dim: int
    sent: int = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, seed: int = SEED) -> Router:
    """One hidden layer, fitted by Adam to the shares of parts among each row's links."""
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1], target.shape[1]
    scale = 1 / max(np.sqrt((x**2).sum(1).mean()), 1e-300)
    theta = [
        rng.normal(0, 2 * scale, (dim, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts),
    ]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(EPOCHS if parts > 1 else 0):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            rows = order[lo : lo + BATCH]
            hidden = np.maximum(x[rows] @ theta[0] + theta[1], 0)
            z = hidden @ theta[2] + theta[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[rows]) / len(rows)
            back = (g @ theta[2].T) * (hidden > 0)
            step += 1
            for k, grad in enumerate((x[rows].T @ back, back.sum(0), hidden.T @ g, g.sum(0))):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad**2 - second[k])
                rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                theta[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Router(*theta, dim)


def fit(vectors: DataFrame, rows: int, dim: int, recall: float = RECALL) -> Router:
    """Graph, cut and classifier from the ``SAMPLE`` rows of smallest hash."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()
    x = np.array(sample["vector"].tolist(), np.float64).reshape(len(sample), dim)
    wanted = min(rows // ROWS_PER_PART, len(x) // SAMPLE_PER_PART)
    depth = max(0, int(np.log2(wanted))) if wanted > 1 else 0
    if depth == 0:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), dim)
    links = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(links[:, :LINKS], depth)
    parts = 1 << depth
    target = np.zeros((len(x), parts))
    near = part[links]
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()), 1.0)
    target[np.arange(len(x)), part] += 1
    # A tenth is kept from training to see how many parts unseen vectors have to be sent to.
    unseen = np.arange(len(x)) % 10 == 0
    router = train_router(x[~unseen], target[~unseen] / target[~unseen].sum(1, keepdims=True))
    p = router.probabilities(x)
    placed = p.argmax(1)
    rank = np.argsort(np.argsort(-p, axis=1), axis=1)
    needed = np.take_along_axis(rank, placed[links], 1)[unseen]
    share = (needed[:, :, None] < np.arange(1, parts + 1)).mean((0, 1))
    router.sent = int(np.searchsorted(share, recall) + 1) if share[-1] >= recall else parts
    router.sent = min(router.sent, parts)
    return router


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector): without null, zero, or not wholly finite vectors, and without null ids."""
    v = F.col(vector_column).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (
        rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
        .where("vec_id is not null and vector is not null")
        .where(~F.exists("vector", bad) & F.exists("vector", lambda c: c != 0))
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(-1, dim)


def _grouped(router, rows: DataFrame, sent: int, counts: np.ndarray | None = None) -> DataFrame:
    """(part, nth, vec_id, vector): each row once per part it is sent to, the nth most probable.

    With the parts' row counts, rows are sent to further parts until those hold more rows than are
    asked for.
    """
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batch):
        model = shared.value
        x = _matrix(batch.column("vector"), model.dim)
        order = np.argsort(-model.probabilities(x), axis=1, kind="stable")
        use = np.broadcast_to(np.arange(order.shape[1]) < sent, order.shape)
        if counts is not None:
            use = use | (np.cumsum(counts[order], axis=1) - counts[order] <= NEIGHBOURS)
        row, place = np.nonzero(use)
        yield {
            "part": order[row, place].astype(np.int32), "nth": place.astype(np.int32),
            "vec_id": batch.column("vec_id").take(pa.array(row)),
            "vector": batch.column("vector").take(pa.array(row)),
        }

    return map_batches(rows.select("vec_id", "vector"), run, "part int, nth int, vec_id long, vector array<double>")


def _rerank(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            dim = len(queries.column("vector")[0])
            q = _matrix(queries.column("vector").combine_chunks(), dim)
            d = _matrix(rows.column("vector").combine_chunks(), dim)
            qid, did = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
            asked = queries.column("least").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            for lo in range(0, len(q), 256):
                scores = q[lo : lo + 256] @ d.T
                scores[qid[lo : lo + 256, None] == did[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                least = np.maximum(least, asked[lo : lo + 256])
                # The product's last bits depend on where a row stands: near ties are summed again.
                slack = 1e-9 * np.maximum(np.abs(least), 1)
                row, col = np.nonzero((scores >= (least - np.nan_to_num(slack, posinf=0))[:, None]) & (scores > -np.inf))
                exact = (q[lo + row] * d[col]).sum(axis=1)
                order = np.lexsort((did[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.searchsorted(row, np.arange(len(scores)))
                top = np.arange(len(row)) - first[row] < k
                found["query_id"].append(qid[lo + row[top]])
                found["vec_id"].append(did[col[top]])
                found["score"].append(exact[top])
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in found.items()})

    return run


def search(
    rows: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    k: int = NEIGHBOURS, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): per query the k rows found of largest inner product.

    Vectors null, zero or with null or non-finite components take no part, nor do those without an
    id or of another length than most. Rows with the query's own id are left out; ties go to the
    smaller vec_id. Repeated rows are found as often as they come. No rows give no rows.
    """
    every = stored(usable(rows, id_column, vector_column))
    dims = {r.dim: r.n for r in every.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return rows.sparkSession.createDataFrame([], schema)
    dim = max(dims, key=lambda d: (dims[d], -d))
    every = every.where(F.size("vector") == dim)
    asked = usable(queries, id_column, vector_column).where(F.size("vector") == dim)
    router = fit(every, dims[dim], dim, recall)
    parts = len(router.b2)
    indexed = stored(_grouped(router, every, 1))
    counts = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.part] = r.n
    sent = stored(_grouped(router, asked, router.sent, counts))
    asking = np.zeros(parts, np.int64)
    for r in sent.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        asking[r.part] = r.n

    def blocks(n: np.ndarray):
        """Blocks of every part, at most 2**depth numbers."""
        return F.element_at(F.array(*[F.lit(int(max(1, -(-x // BLOCK)))) for x in n]), F.col("part") + 1)

    def dealt(df: DataFrame, own: np.ndarray, other: np.ndarray, names: tuple[str, str], *more: str) -> DataFrame:
        """Rows in one block of their side, and once for every block of the other side."""
        mine = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), blocks(own)).cast("int").alias(names[0])
        others = F.explode(F.sequence(F.lit(0), blocks(other) - 1)).alias(names[1])
        return df.select("part", mine, others, "vec_id", "vector", *more)

    keys = ["part", "q", "b"]
    right = dealt(indexed, counts, asking, ("b", "q"))

    def reranked(some: DataFrame) -> DataFrame:
        left = dealt(some, asking, counts, ("q", "b"), "least").groupBy(*keys)
        return left.cogroup(right.groupBy(*keys)).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")

    # The most probable part comes first: what the others have below its k-th score is not sent on.
    first = stored(reranked(sent.where("nth = 0").withColumn("least", F.lit(None).cast("double"))))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(own)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    found = first.unionByName(reranked(sent.where("nth > 0").join(kth, "vec_id", "left")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op5_learned_partitions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
