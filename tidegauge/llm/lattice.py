"""Near-duplicate vectors by E8 lattice hashing.

Each of TABLES tables turns the unit vectors by a random rotation, takes BLOCKS times eight
coordinates, and decodes each eight to the nearest point of the E8 lattice; the points are the
cell. A vector is put into its own cell and into those where one or both points are replaced by
the neighbouring lattice point next nearest. Vectors that share a cell (and label and length) are
compared by cosine, in double precision.

Equal vectors are one node. A cell yields a spanning tree of its links, and components follow from
those. Links are then counted exactly among all members of a component, in tiles of bounded size,
so pairs are never emitted; this also counts pairs that no cell held together.

Defined cases: vectors that are null, zero, or hold a null or a component that is not finite, and
rows whose label or vec_id is null, link with nothing and are their own component; rows that
repeat a vec_id are vectors of their own; vectors of different length do not link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm._shared import connected_components, durable, durable_table
from tidegauge.llm.topk import usable

COSINE = 0.93
TABLES, BLOCKS = 8, 2
SCALE = 3.4  # lattice units in the length of a unit vector
GROUP_LIMIT = 2048
SEED = 20_240_607


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    gap = x - near
    worst = np.abs(gap).argmax(1)
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    near[rows, worst[rows]] += np.where(gap[rows, worst[rows]] < 0, -1, 1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8, or of D8 moved by one half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, from a point to its neighbours."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([0.5 if signs >> k & 1 else -0.5 for k in range(8)])
        if signs.bit_count() % 2 == 0:
            out.append(v)
    return np.array(out)


NEIGHBOURS = _shortest()


def rotations(size: int) -> np.ndarray:
    """For each table and block, eight orthonormal directions (as many as there are dimensions)."""
    rng = np.random.default_rng(SEED + size)
    tables = []
    for _ in range(TABLES):
        blocks = []
        while len(blocks) < BLOCKS:
            basis = np.linalg.qr(rng.normal(size=(size, max(size, 8))))[0].T if size >= 8 else rng.normal(size=(8, size)) / np.sqrt(size)
            blocks += [basis[k : k + 8] for k in range(0, len(basis) - 7, 8)][: BLOCKS - len(blocks)]
        tables.append(np.concatenate(blocks))
    return np.stack(tables) * SCALE * np.sqrt(max(size, 8) / 64)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Cell hashes, one row per vector: each table's own cell and the probed ones."""
    size = unit.shape[1]
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 2**62, (BLOCKS, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for t, turn in enumerate(rotations(size)):
        choices = []
        for b in range(BLOCKS):
            x = unit @ turn[8 * b : 8 * b + 8].T
            own = nearest_e8(x)
            second = own + NEIGHBOURS[((x - own) @ NEIGHBOURS.T).argmax(1)]
            choices.append([((2 * p).astype(np.int64).astype(np.uint64) * factors[b]).sum(1, dtype=np.uint64) for p in (own, second)])
        base = label.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size * 1000 + t)
        for first in choices[0]:
            for last in choices[1]:
                h = (first * np.uint64(31) ^ (last >> np.uint64(7)) ^ last) + base
                h ^= h >> np.uint64(33)
                out.append(h * np.uint64(0xFF51AFD7ED558CCD) ^ (h >> np.uint64(29)))
    return np.stack(out, 1).view(np.int64)


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, unit vectors)`` of each length in a list column."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy().astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        matrix = flat[starts[rows][:, None] + np.arange(n)[None, :]]
        yield rows, matrix / np.linalg.norm(matrix / np.abs(matrix).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(matrix).max(1, keepdims=True)


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            ids, label = part.column("id").to_numpy(), part.column("label").to_numpy()
            for rows, unit in _unit(part.column("v")):
                found = cells(unit, label[rows])
                pairs = np.unique(np.stack([found.ravel(), np.repeat(ids[rows], found.shape[1])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["cell", "id"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by ``key``; groups are bounded by how they were dealt."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(key)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _tiled(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Groups by ``key`` as tiles of bounded size: every two rows of a group meet in one tile.

    A group within the limit is one tile. A larger one is cut into parts, and each pair of parts is
    a tile; ``part`` is the row's part and ``cross`` tells a pair of two different parts.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    parts = sizes.select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = rows.join(parts, key).withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    return dealt.select("*", (F.col("part") != F.col("other")).alias("cross"), F.xxhash64(F.col(key), i, j).alias("tile")).drop("parts", "other", key)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning trees of the links in each tile."""
    for group in _groups(batches, "tile"):
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        for rows, unit in _unit(group.column("v").chunk(0)):
            left, a, b = np.arange(len(rows)), [], []
            while len(left) > 1:
                root, queue, left = left[0], [left[0]], left[1:]
                while queue and len(left):
                    near = unit[left] @ unit[queue.pop()] >= COSINE
                    if near.any():
                        found, left = left[near], left[~near]
                        queue.extend(found)
                        a.append(np.full(len(found), ids[rows[root]]))
                        b.append(ids[rows[found]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each member with the others of its tile, weighted by how often each vector occurs."""
    for group in _groups(batches, "tile"):
        group = group.combine_chunks()
        ids, copies, part = (group.column(c).to_numpy() for c in ("id", "copies", "part"))
        cross = group.column("cross")[0].as_py()
        for rows, unit in _unit(group.column("v").chunk(0)):
            links = np.zeros(len(rows), np.int64)
            for k in range(0, len(rows), 512):
                near = unit[k : k + 512] @ unit.T >= COSINE
                if cross:
                    near &= part[rows[k : k + 512]][:, None] != part[rows][None, :]
                else:
                    near[np.arange(len(near)), np.arange(k, k + len(near))] = False
                links[k : k + 512] = near @ copies[rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(links)], names=["id", "links"])


def _by_tile(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("tile").sortWithinPartitions("tile")


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.coalesce(whole, F.lit(False)).alias("whole"))
    hashed = rows.where("whole").select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("second"), "label", "embedding").alias("h2"))
    nodes = hashed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("embedding").alias("v"))
    nodes = durable_table(nodes.withColumn("id", F.monotonically_increasing_id()), "lattice-nodes")
    cell_rows = nodes.select("id", "label", "v").mapInArrow(_to_cells, "cell long, id long")
    shared = _tiled(durable(cell_rows), "cell", GROUP_LIMIT).select("id", "tile")
    edges = _by_tile(shared.join(nodes.select("id", "v"), "id")).mapInArrow(_trees, "a long, b long")
    roots = connected_components(edges).withColumnRenamed("node", "id")
    placed = durable(nodes.select("id", "h1", "h2", "first", "copies").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    members = _tiled(placed.select("id", "root", "copies"), "root", GROUP_LIMIT).join(nodes.select("id", "v"), "id")
    counted = _by_tile(members).mapInArrow(_count_links, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(least, "root").join(counted, "id", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = hashed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not whole").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
