"""SimHash near-duplicates found exactly, by anchor points of a covering code.

Fingerprints that differ in at most four of 64 bits differ in at most two bits of one 32-bit half.
The anchors of a half are the words of the [31, 26] Hamming code with the last bit free: every
32-bit word has one within COVERING_RADIUS = 1. Two halves at distance two have a point midway,
one step from each; its anchor is within 1 + 1 = 2 of both. So each fingerprint goes to every
anchor within the covering radius plus its side's share (one bit) of the half's threshold, 2 or 17
anchors a half, and fingerprints are compared, over all 64 bits, only where they share an anchor.
No link is lost, and a cell of 2 ** 27 sees its neighbourhood of 529 words only.

Equal fingerprints are one node. A cell yields the edges of spanning trees, not pairs; a cell of
over CELL_LIMIT fingerprints is not gathered: it is dealt out again as tiles, pairs of parts of
bounded size, each compared by a task of its own.

Defined cases: null text is as empty; no words give fingerprint zero, which links like any other;
under four words the whole sequence is the only shingle; repeated rows get the same class; a row
without doc_id takes the class of its fingerprint but never names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import connected_components, durable, masked

WIDTH = 4
SEED = 42
MAX_DISTANCE = 4
COVERING_RADIUS = 1
CELL_LIMIT = 20_000


def fingerprint(raw: bytes | None) -> int:
    """SimHash of UTF-8 text, unsigned; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    if len(words) <= WIDTH:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), SEED) for s in zip(*(words[k:] for k in range(WIDTH)))]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column("raw")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


def _flips() -> list[np.ndarray]:
    """By syndrome, the bits to flip for each anchor within two steps."""
    free, out = 1 << 31, []
    for s in range(32):
        if s == 0:
            out.append(np.array([0, free], np.uint64))
            continue
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        out.append(np.array([1 << (s - 1), (1 << (s - 1)) | free, *pairs], np.uint64))
    return out


def _syndrome_tables() -> np.ndarray:
    """XOR of the positions (1 to 31) of the set bits, for each value of each byte."""
    table = np.zeros((4, 256), np.uint8)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                position = 8 * byte + bit + 1
                if value >> bit & 1 and position < 32:
                    table[byte, value] ^= position
    return table


FLIPS, SYNDROMES = _flips(), _syndrome_tables()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cell, row)``: cells of signed fingerprints; a cell is the half's number and the anchor."""
    cells, rows = [], []
    for half in (0, 1):
        word = (fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(word), np.uint8)
        for byte in range(4):
            syndrome ^= SYNDROMES[byte, ((word >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                found = word[at][:, None] ^ FLIPS[s][None, :]
                cells.append((found | np.uint64(half << 32)).ravel())
                rows.append(np.repeat(at, len(FLIPS[s])))
    if not cells:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(cells).view(np.int64), np.concatenate(rows)


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for k in range(0, len(fp), 4096):
            cell, row = anchors(fp[k : k + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[k : k + 4096][row])], names=["cell", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_DISTANCE


def spanning_edges(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links connect: each sweep takes all that is near from what is left."""
    left, a, b = fp, [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = _near(left, queue.pop())
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                a.append(np.full(len(found), root))
                b.append(found)
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _scan(limit: int | None):
    """Rows sorted by cell in, edges out; the rows of a cell beyond ``limit`` pass with their cell."""

    def rows(a: np.ndarray, b: np.ndarray, cell: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cell) if cell is not None else pa.nulls(len(a), pa.int64())], names=["a", "b", "cell"])

    def whole(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole cells only: pairs of neighbours in small cells, spanning trees in others."""
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.concatenate([start, [len(cell)]]))
        small = np.repeat(size <= 8, size)
        for step in range(1, min(8, len(cell))):
            hit = np.flatnonzero((cell[step:] == cell[:-step]) & small[step:] & _near(fp[step:], fp[:-step]))
            if len(hit):
                yield rows(fp[hit], fp[hit + step])
        for k, n in zip(start[size > 8], size[size > 8]):
            if limit is not None and n > limit:
                yield rows(fp[k : k + n], fp[k : k + n], cell[k : k + n])
            else:
                yield rows(*spanning_edges(fp[k : k + n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held, hot = 0, None  # rows kept; the cell that is passed on as it comes
        for batch in batches:
            cell, fp = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            if hot is not None:
                n = int(np.searchsorted(cell, hot, side="right"))
                if n:
                    yield rows(fp[:n], fp[:n], cell[:n])
                cell, fp = cell[n:], fp[n:]
            if not len(cell):
                continue
            hot = None
            n = int(np.searchsorted(cell, cell[-1], side="left"))
            if n or (kept and kept[-1][0][-1] != cell[0]):
                kept.append((cell[:n], fp[:n]))
                yield from whole(*(np.concatenate(x) for x in zip(*kept)))
                kept, held = [], 0
            kept.append((cell[n:], fp[n:]))
            held += len(cell) - n
            if limit is not None and held > limit:
                hot = cell[-1]
                for c, f in kept:
                    yield rows(f, f, c)
                kept, held = [], 0
        if kept:
            yield from whole(*(np.concatenate(x) for x in zip(*kept)))

    return run


def links(fps: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect just the fingerprints that links connect; ``fps(fp)`` distinct."""
    schema = "a long, b long, cell long"
    cells = fps.mapInArrow(_to_cells, "cell long, fp long")
    found = durable(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_scan(cell_limit), schema))
    crowded = found.where("cell is not null").select("cell", F.col("a").alias("fp"))
    parts = crowded.groupBy("cell").agg(F.ceil(F.count("*") / cell_limit).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tile = F.struct(F.col("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiles = (
        crowded.join(parts, "cell").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64(tile).alias("cell"), "fp")
    )
    more = tiles.repartition("cell").sortWithinPartitions("cell").mapInArrow(_scan(None), schema)
    return found.where("cell is null").select("a", "b").union(more.select("a", "b"))


def _placed(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id, root)`` for every row; root, a fingerprint, tells classes with the same smallest doc_id apart."""
    fps = durable(with_fingerprints(docs))
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = durable(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(placed.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row."""
    return _placed(docs).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest doc_id; rows without one stay.

    Of rows of a class that share this doc_id, one of the smallest fingerprint stays, the first by digest of its text.
    """
    hidden = masked(docs, "doc_id", "text")
    keep = _placed(docs).where("doc_id = component_id").groupBy("root", F.col("doc_id").alias("__id")).agg(F.min("fp").alias("__fp")).drop("root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((x.as_py() or "").encode()) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "__fp"])

    first = hidden.join(keep.select("__id").distinct(), F.col("doc_id") == F.col("__id"), "left_semi")
    first = first.mapInArrow(run, T.StructType([*hidden.schema.fields, T.StructField("__fp", T.LongType())]))
    first = first.join(keep.toDF("__id", "__kept"), (F.col("doc_id") == F.col("__id")) & (F.col("__fp") == F.col("__kept")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__fp").orderBy(F.sha2("text", 256)))
    first = first.withColumn("__copy", nth).where("__copy = 1").select(*hidden.columns)
    return first.unionByName(hidden.where("doc_id is null")).toDF(*docs.columns)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
