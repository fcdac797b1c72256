"""Approximate nearest neighbours by learned partitions.

On a bounded sample: an exact neighbour graph, a balanced partitioning of that graph, and a softmax classifier that
predicts a vector's partition. Every row is indexed under its most probable partition. A query goes to its most
probable partitions, as many as reach the wanted recall on the sample, and is reranked there by the exact inner product.
Partitions grow in number with the rows, up to MAX_PARTS; beyond that they are cut into blocks of bounded size, and
queries meet each block of a partition they are sent to.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of the sample for each partition, and at most: the partitioning and the classifier are fitted on it.
SAMPLE_OF_PART, SAMPLE = 128, 16_384
GRAPH_K = 10
#: Rows for each partition, about, and partitions at least and at most.
PART_ROWS, MIN_PARTS, MAX_PARTS = 4000, 2, 256
BLOCK_ROWS = 8192
TARGET_RECALL = 0.95
#: Different dimensions of vectors; each is searched by itself.
MAX_DIMENSIONS = 16


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """[n, k] nearest others by inner product of unit vectors."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((len(u), min(k, len(u) - 1)), np.int64)
    for at in range(0, len(u), 256):
        s = u[at : at + 256] @ u.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 256] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex, few graph edges between parts and none larger than slack * n / parts.

    Recursive bisection along principal directions gives equal parts; vertices then move to the part that most of
    their neighbours are in, while it has room.
    """
    n, rng = len(x), np.random.default_rng(7)
    part = np.zeros(n, np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
        left = count // 2
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(n), 0, parts)
    both = [[] for _ in range(n)]
    for v in range(n):
        for w in graph[v].tolist():
            both[v].append(w)
            both[w].append(v)
    near = [np.array(b) for b in both]
    room = int(np.ceil(slack * n / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n).tolist():
            votes = np.bincount(part[near[v]], minlength=parts)
            best = int(np.where(sizes < room, votes, -1).argmax())
            if best != part[v] and votes[best] > votes[part[v]]:
                sizes[part[v]] -= 1
                sizes[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


def fit_softmax(x: np.ndarray, y: np.ndarray, parts: int, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights [dim + 1, parts] of a multinomial logistic regression, by Adam on the whole sample."""
    x1 = np.c_[x, np.ones(len(x))]
    w, m, v = (np.zeros((x1.shape[1], parts)) for _ in range(3))
    goal = np.eye(parts)[y]
    for t in range(1, rounds + 1):
        z = x1 @ w
        z = np.exp(z - z.max(1, keepdims=True))
        g = x1.T @ (z / z.sum(1, keepdims=True) - goal) / len(x1) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def parts_for(rows: int, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> int:
    return int(min(max_parts, max(MIN_PARTS, -(-rows // part_rows))))


def fit(sample: np.ndarray, parts: int, neighbours: int = 20, recall: float = TARGET_RECALL) -> tuple[np.ndarray, int]:
    """(classifier, partitions to probe) for a sample of at least two vectors."""
    parts = min(parts, len(sample))
    scale = sample / max(1e-12, float(np.linalg.norm(sample, axis=1).mean())) * np.sqrt(sample.shape[1])
    part = balanced_partition(scale, neighbour_graph(sample), parts)
    w = fit_softmax(scale, part, parts)
    w[:-1] *= np.sqrt(sample.shape[1]) / max(1e-12, float(np.linalg.norm(sample, axis=1).mean()))
    z = _logits(sample, w)
    home, order = z.argmax(1), np.argsort(-z, axis=1)
    asked = np.linspace(0, len(sample) - 1, min(500, len(sample))).astype(int)
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-s, min(neighbours, len(sample) - 1) - 1, axis=1)[:, : min(neighbours, len(sample) - 1)]
    rank_of = np.argsort(order, axis=1)  # part -> its rank for each row
    ranks = rank_of[asked[:, None], home[near]]
    return w, next((m for m in range(1, parts) if (ranks < m).mean() >= recall), parts)


def _valid(df: DataFrame) -> DataFrame:
    """vec_id, v (doubles as floats were given): vectors without null or non-finite components, not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _smallest_ids(x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Rows to keep so that each distinct vector has its ``keep`` smallest ids: no more can be among the nearest."""
    kind = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, of = np.unique(kind, return_inverse=True)
    order = np.lexsort((ids, of))
    o, i = of[order], ids[order]
    first = np.r_[True, o[1:] != o[:-1]]
    again = np.r_[False, (o[1:] == o[:-1]) & (i[1:] == i[:-1])]
    order, o, first = order[~again], o[~again], first[~again]
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    return np.sort(order[rank < keep])


def _place(w: np.ndarray, blocks: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch), batch.column(0).to_numpy()
            rows = _smallest_ids(x, ids, keep)
            x, ids = x[rows], ids[rows]
            part = _logits(x, w).argmax(1)
            blk = _hash(ids) % blocks
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blk, pa.int32()), pa.array(np.zeros(len(x)), pa.int32()), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], names=["part", "blk", "asks", "id", "x"])

    return run


def _hash(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _route(w: np.ndarray, probes: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch), batch.column(0).to_numpy()
            top = np.argsort(-_logits(x, w), axis=1)[:, :probes]
            own = np.repeat(np.arange(len(x)), top.shape[1] * blocks)
            part = np.repeat(top.ravel(), blocks)
            blk = np.tile(np.arange(blocks), top.size)
            blobs = [r.tobytes() for r in x]
            for at in range(0, len(own), 5000):
                s = slice(at, at + 5000)
                yield pa.RecordBatch.from_arrays([pa.array(part[s], pa.int32()), pa.array(blk[s], pa.int32()), pa.array(np.ones(len(own[s])), pa.int32()), pa.array(ids[own[s]]), pa.array([blobs[k] for k in own[s].tolist()], pa.binary())], names=["part", "blk", "asks", "id", "x"])

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, each with its best score, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], scores[order]


def _rerank(k: int):
    """Rows sorted by (part, blk, asks), a block's vectors before the queries that meet it, to one row for each query and block."""

    def nearest(ids: np.ndarray, x: np.ndarray, again: int, q_ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(q), 512):
            s = q[at : at + 512] @ x.T
            s[q_ids[at : at + 512, None] == ids[None, :]] = -np.inf
            take = min(k + again, len(ids))
            edge = -np.partition(-s, take - 1, axis=1)[:, take - 1]
            row, col = np.nonzero((s >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & (s > -np.inf))
            best = [_best(ids[col[a:b]], (q[at + r] * x[col[a:b]]).sum(1), k) for r, (a, b) in enumerate(itertools.pairwise(np.searchsorted(row, np.arange(len(s) + 1)).tolist()))]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at : at + 512]), pa.array([i.tobytes() for i, _ in best], pa.binary()), pa.array([v.tobytes() for _, v in best], pa.binary())], names=["query_id", "ids", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, held = None, [], [], None
        for batch in batches:
            part, blk, asks, own = (batch.column(c).to_numpy() for c in range(4))
            blobs = batch.column(4)
            change = np.flatnonzero((part[1:] != part[:-1]) | (blk[1:] != blk[:-1]) | (asks[1:] != asks[:-1])) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                x = np.frombuffer(b"".join(blobs.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                if at != (part[a], blk[a]):
                    at, ids, rows, held = (part[a], blk[a]), [], [], None
                if not asks[a]:
                    ids.append(own[a:b])
                    rows.append(x)
                elif ids:
                    if held is None:
                        held = np.concatenate(ids), np.concatenate(rows)
                        pick = _smallest_ids(held[1], held[0], k + 1)
                        held = held[0][pick], held[1][pick], len(pick) - len(np.unique(held[0][pick]))
                    yield from nearest(*held, own[a:b], x)

    return run


def _merge(k: int):
    """Rows sorted by query to its k best, kept while they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, scores, done = None, np.zeros(0, np.int64), np.zeros(0), []

        def out():
            cut = [(q, rank, i, s) for q, own, values in done for rank, (i, s) in enumerate(zip(own.tolist(), values.tolist(), strict=True), 1)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in cut], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, more, values in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if query != at:
                    if at is not None:
                        done.append((at, ids, scores))
                    at, ids, scores = query, np.zeros(0, np.int64), np.zeros(0)
                ids, scores = _best(np.r_[ids, np.frombuffer(more, np.int64)], np.r_[scores, np.frombuffer(values, np.float64)], k)
            yield out()
            done = []
        if at is not None:
            done.append((at, ids, scores))
        yield out()

    return run


def model_of(base: DataFrame, rows: int, k: int = 20, recall: float = TARGET_RECALL, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> tuple[np.ndarray, int]:
    """The classifier [dimension + 1, partitions] and the partitions to probe, fitted on the rows of least hash."""
    parts = parts_for(rows, part_rows, max_parts)
    sample = min(SAMPLE, max(1024, parts * SAMPLE_OF_PART))
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    x = np.array(drawn.column("v").to_pylist(), np.float64)
    return fit(x, parts, k, recall) if len(x) > 1 else (np.zeros((x.shape[1] + 1, 1)), 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = TARGET_RECALL, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` (vec_id, embedding) its k nearest rows found.

    Nearest is by largest inner product in double precision, ties to the smaller vec_id; a row with the query's own
    vec_id is no candidate. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
    do rows without a vec_id. A query's candidates have its dimension; more than MAX_DIMENSIONS of them raise. Rows that
    repeat a vec_id are one candidate, with their best score. Other columns are ignored; no vectors or no queries give
    an empty result. Every valid row is indexed; the model is fitted on at most SAMPLE rows of least hash. Recall is
    aimed at, not bound: the number of partitions asked reaches ``recall`` on the sample.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common.small_batches(spark)
    every, asking = _valid(vectors), _valid(queries)
    sizes = sorted((r["dim"], r["n"]) for r in every.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).limit(MAX_DIMENSIONS + 1).collect())
    if len(sizes) > MAX_DIMENSIONS:
        raise ValueError(f"vectors of more than {MAX_DIMENSIONS} dimensions")
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    layout, found = "part int, blk int, asks int, id long, x binary", None
    for dim, rows in sizes:
        base = every.where(F.size("v") == dim)
        w, probes = model_of(base, rows, k, recall, part_rows, max_parts)
        blocks = max(1, -(-rows // (w.shape[1] * block_rows)))
        placed = base.mapInArrow(_place(w, blocks, k + 1), layout)
        asked = asking.where(F.size("v") == dim).mapInArrow(_route(w, probes, blocks), layout)
        met = placed.unionByName(asked).repartition(n, "part", "blk").sortWithinPartitions("part", "blk", "asks")
        own = met.mapInArrow(_rerank(k), "query_id long, ids binary, scores binary")
        found = own if found is None else found.unionByName(own)
    ranked = found.repartition(n, "query_id").sortWithinPartitions("query_id")
    return ranked.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
