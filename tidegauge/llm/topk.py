"""Exact top-k search by distributed histogram selection.

Queries run in blocks of BLOCK rows, the only thing broadcast. For a block, every candidate is
scored against every query, and the k-th best score of each query is located by histograms: tasks
count scores into BINS bins of the interval that still can hold the k-th value, Spark adds the
counts, and the interval shrinks to the bin where the k-th value falls, until that bin is one
score wide. Where more candidates tie at that score than are wanted, the same selection over their
vec_ids finds the last one taken. A last pass keeps just what is at or above both limits.

A task sends, per query, only the bins down to its own k-th candidate, as lower ones cannot hold
the k-th of all; so no task or driver ever gathers scores.

Defined cases: vectors that are null, or hold a null or a component that is not finite, and rows
without vec_id take no part; vectors of different length have no score; rows that share the
query's vec_id are its own; repeated candidates are candidates each; a query repeated with the
same vector runs once, and queries that share a vec_id but not a vector have a full answer each. Scores that a long may not hold raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm._shared import durable_table, shared_folder

BLOCK = 1024
BINS = 1024
CHUNK = 2048
SCALE = 1024


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantised(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v)``: floor(1024 x) of each component x, as a double before the product."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


class Block:
    """Queries, and for each what is known of its last taken candidate."""

    def __init__(self, ids: np.ndarray, vectors: list, bound: int, first: int = 0):
        self.ids, self.bound, self.numbers = ids, bound, first + np.arange(len(ids))  # rows may share an id, not a number
        self.by_size = {n: np.array([i for i, v in enumerate(vectors) if len(v) == n]) for n in {len(v) for v in vectors}}
        kind = np.float64 if bound < 2**53 else np.int64
        self.matrices = {n: np.array([vectors[i] for i in at], kind).reshape(len(at), n) for n, at in self.by_size.items()}
        self.kth = np.full(len(ids), -bound, np.int64)  # all scores from here on, above those at the limit
        self.last_id = np.full(len(ids), np.iinfo(np.int64).max)

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query numbers, candidate ids, scores (query by candidate), and which are candidates."""
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNK):
                part = batch.slice(k, CHUNK)
                ids, column = part.column("vec_id").to_numpy(), part.column("v")
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for n, at in self.by_size.items():
                    rows = np.flatnonzero(sizes == n)
                    if len(rows):
                        matrix = flat[starts[rows][:, None] + np.arange(n)[None, :]]
                        score = (self.matrices[n] @ matrix.T.astype(self.matrices[n].dtype)).astype(np.int64)
                        yield at, ids[rows], score, self.ids[at][:, None] != ids[rows][None, :]


def _select(vectors: DataFrame, block: Block, k: np.ndarray, low: np.ndarray, high: np.ndarray, by_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-th smallest key of each query within [low, high]; how many are below it, and at it.

    The key is bound - score, or for ``by_id`` the vec_id among candidates at the k-th score.
    Queries with k = 0 are left alone. Python integers keep wide intervals exact.
    """
    spark = vectors.sparkSession
    low, high = [int(x) for x in low], [int(x) for x in high]
    below, at = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    open_ = k > 0
    while open_.any():
        width = [max(1, -(-(h - lo + 1) // BINS)) for lo, h in zip(low, high)]
        shared = spark.sparkContext.broadcast((block, np.array(low), np.array(high), np.array(width), open_, k - below))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, low, high, width, open_, need = shared.value
            counts = np.zeros((len(low), BINS), np.int64)
            for at, ids, score, candidate in block.scored(batches):
                if not open_[at].any():
                    continue
                key = np.broadcast_to(ids[None, :], score.shape) if by_id else block.bound - score
                inside = candidate & open_[at][:, None] & (key >= low[at][:, None]) & (key <= high[at][:, None])
                if by_id:
                    inside &= score == block.kth[at][:, None]
                q, c = np.nonzero(inside)
                place = (key[q, c] - low[at][q]) // width[at][q]
                counts += np.bincount(at[q] * BINS + place, minlength=counts.size).reshape(counts.shape)
            before = np.cumsum(counts, 1) - counts
            q, b = np.nonzero((counts > 0) & (before < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "b", "n"])

        found = vectors.mapInArrow(run, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        upto = found.withColumn("upto", F.sum("n").over(Window.partitionBy("q").orderBy("b")))
        need = spark.createDataFrame([(int(q), int(k[q] - below[q])) for q in np.flatnonzero(open_)], "q long, need long")
        first = upto.join(F.broadcast(need), "q").where("upto >= need and upto - n < need")
        hits = {r.q: r for r in first.collect()}  # a row for each query of the block
        for q in np.flatnonzero(open_):
            if q not in hits:  # fewer candidates than wanted: all are taken
                low[q], at[q], open_[q] = high[q], 0, False
                continue
            r = hits[q]
            below[q] += r.upto - r.n
            low[q] += r.b * width[q]
            high[q] = min(high[q], low[q] + width[q] - 1)
            if high[q] <= low[q]:
                at[q], open_[q] = r.n, False
        shared.unpersist()
    return np.array(low), below, at


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each row whose vec_id ``every`` divides."""
    spark = embeddings.sparkSession
    vectors = durable_table(quantised(embeddings), "topk-vectors")
    size = F.transform("v", lambda x: F.abs(x).cast("double"))
    limits = vectors.select(
        "vec_id", F.coalesce(F.array_max(size), F.lit(0.0)).alias("most"), F.aggregate(size, F.lit(0.0), lambda a, x: a + x).alias("total")
    ).agg(F.max("most"), F.max("total"), F.min("vec_id"), F.max("vec_id")).first()
    most, total, least_id, most_id = limits
    out = f"{shared_folder(spark).rstrip('/')}/topk-{uuid.uuid4().hex}"
    schema = "number long, query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    if most is not None:
        bound = int(most * total) + 1
        if bound >= 2**62:
            raise ArithmeticError("scores exceed a long")
        queries = vectors.where(F.col("vec_id") % every == 0).distinct()
        seen, done = None, 0
        while True:
            ordered = queries
            if seen is not None:
                after = F.array(*[F.lit(x) for x in seen.v]).cast("array<bigint>")
                ordered = queries.where((F.col("vec_id") > seen.vec_id) | ((F.col("vec_id") == seen.vec_id) & (F.col("v") > after)))
            rows = ordered.orderBy("vec_id", "v").limit(BLOCK).collect()
            if not rows:
                break
            seen = rows[-1]
            block = Block(np.array([r.vec_id for r in rows]), [r.v for r in rows], bound, done)
            n = len(rows)
            done += n
            key, below, ties = _select(vectors, block, np.full(n, k), np.zeros(n, np.int64), np.full(n, 2 * bound), False)
            block.kth = bound - key
            wanted = np.where(ties > k - below, k - below, 0)
            if wanted.any():
                last, _, _ = _select(vectors, block, wanted, np.full(n, least_id), np.full(n, most_id), True)
                block.last_id = np.where(wanted > 0, last, block.last_id)
            shared = spark.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                block = shared.value
                for at, ids, score, candidate in block.scored(batches):
                    kth, last = block.kth[at][:, None], block.last_id[at][:, None]
                    q, c = np.nonzero(candidate & ((score > kth) | ((score == kth) & (ids[None, :] <= last))))
                    columns = [pa.array(block.numbers[at][q]), pa.array(block.ids[at][q]), pa.array(ids[c]), pa.array(score[q, c])]
                    yield pa.RecordBatch.from_arrays(columns, names=["number", "query_id", "vec_id", "score"])

            vectors.mapInArrow(run, schema).write.mode("append").parquet(out)
    taken = spark.read.schema(schema).parquet(out)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return taken.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
