"""Importance resampling towards a target: hashed word runs, bucket gains, Gumbel-perturbed draw.

A streaming CRC ring reads each document once: it keeps the running CRC-32 of the word runs that
began at the last n words, extends each by a space and the next word, and emits every state's
bucket as it stands. So a run costs one short update, whatever its length, and no run is ever built.
The buckets of a document are kept in the shared folder as a binary column (two bytes a feature up
to 65,536 buckets, otherwise four), beside its other results, and read from there both to count
them over all documents and to score each document; the texts are not read again.

What is gathered is one count per bucket (BUCKETS, a parameter): each task adds up its own and
Spark adds the tasks' sums. The gains go to the tasks as one broadcast array of that size.

Ranks over all documents come from a range sort: each row is stored with its place in its
part, and the sizes of the parts (as many as there are shuffle partitions) shift the places.

Defined cases: a null text is as an empty one: no words, no features, weight 0; null target texts
likewise; repeated rows are documents each; a null doc_id counts as the text "" in the seed and
comes after others on ties; runs longer than the text do not exist; bytes that are not UTF-8 are
hashed as they are; other columns do not matter to the scores; an empty table gives an empty one, and
with an empty target all gains follow from T = 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm._shared import discard, durable_table
from tidegauge.llm.bpe import _slices

BUCKETS = 10_000
LONGEST_RUN = 2
LEAST_WORDS = 20
SEED = 7
#: Digits, small letters and all bytes of characters beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Upper-case ASCII letters to lower case, all other bytes as they are.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bucket_type(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def ring(raw: bytes, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every run of 1 to ``longest`` words, in the order of their ends."""
    crc, states, out, n = zlib.crc32, [], [], 0
    for match in _WORD.finditer(raw.translate(_LOWER)):
        word = match[0]
        spaced = b" " + word
        states = [crc(word), *[crc(spaced, s) for s in states[: longest - 1]]]
        out += states
        n += 1
    return n, (np.array(out, np.uint32) % np.uint32(buckets)).astype(bucket_type(buckets))


def _bucketed(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``(doc_id, n_words, found)``: each text's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "raw"):
            found = [ring(raw or b"", longest, buckets) for raw in batch.column("raw").to_pylist()]
            new = [pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "n_words", "found"])

    schema = "n_words long, found binary"
    if "doc_id" in texts.columns:
        schema = f"doc_id long, {schema}"
    return texts.mapInArrow(run, schema)


def bucket_counts(bucketed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: tasks add up their own, Spark their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column("found").to_pylist():
                total += np.bincount(np.frombuffer(found, bucket_type(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = bucketed.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1)(S + B)) / ((s + 1)(T + B)))) of each of B buckets."""
    size = float(len(source))
    all_s, all_t = float(source.sum()) + size, float(target.sum()) + size
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t))) for s, t in zip(source, target)], np.int64)


def _ranked(scored: DataFrame, eligible: int, share: int) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3 … for the best floor(share * eligible / 100) eligible rows, null elsewhere."""
    spark = scored.sparkSession
    rows = scored.where("eligible").drop("eligible")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = durable_table(placed.select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("place")), "resample-order")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= share * eligible // 100, rank).alias("rank"))
    rest = scored.where("NOT eligible").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, share: int = 25, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document of ``docs(doc_id, text)``, drawn towards ``target(text)``.

    Of the documents with at least ``least_words`` words, ``share`` percent are drawn and have a rank.
    """
    spark = docs.sparkSession
    raw = F.col("text").cast("binary").alias("raw")
    bucketed = durable_table(_bucketed(docs.select(F.col("doc_id").cast("long"), raw), longest, buckets), "resample-buckets")
    wanted = bucket_counts(_bucketed(target.select(raw), longest, buckets), buckets)
    shared = spark.sparkContext.broadcast(gains(bucket_counts(bucketed, buckets), wanted))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, kind = shared.value, bucket_type(buckets)
        for batch in batches:
            found = [np.frombuffer(b, kind) for b in batch.column("found").to_pylist()]
            weights = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in found]
            new = [pa.array([len(b) for b in found], pa.int64()), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *new], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = bucketed.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.select("doc_id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    scored = durable_table(scored, "resample-scores")
    discard(bucketed)
    return _ranked(scored, scored.where("eligible").count(), share)
