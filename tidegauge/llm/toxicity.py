"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

A word is read letter by letter. For the toxic and for the ordinary class apart, the five-letter
sequences of labelled texts are counted; where a class has not seen a sequence, it backs off to
shared Kneser-Ney continuation counts, pooled over both classes, of four letters down to one.
A word's evidence is the difference of its two log-likelihoods as far as it exceeds MARGIN: below
that, the difference says more about which names and languages a class happened to hold than about
the word. A text's score is its evidence per word, put on the scale 0 to 1 by a logistic curve
fitted on labelled rows that the counts have not seen.

Counting and smoothing are Spark aggregations over all labelled rows. What the scoring tasks
get is two tables of at most ``2 ** bits`` half floats, whatever the size of the corpus, so broadcasting
them is bounded.

Defined cases: null and empty texts, and texts without letters, have no evidence;
labels that are null are ignored, a document labelled twice is toxic if one label says so;
repeated rows are scored each; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import durable, fresh, masked, without

ORDER = 5
DISCOUNT = 0.75
THRESHOLD = 0.7
MARGIN = 2.0  # nats
PIECE_CHARS = 2_000_000
_GAP = re.compile(r"[\W\d_]+")
_PAD = "\0" * (ORDER - 1)
_FACTOR, _ROOM = 65_599, (1 << 40) - 1
SLOTS = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _letters(text: str | None) -> str:
    return _PAD + _GAP.sub(_PAD, (text or "").lower()) + _PAD


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ORDER letters that end at each position, and of the ORDER - 1 before it."""
    x = codes.astype(np.int64)
    n = len(x) - ORDER + 1
    h = np.zeros(n, np.int64)
    for k in range(ORDER - 1):
        h = (h * _FACTOR + x[k : k + n]) & _ROOM
    full = (h * _FACTOR + x[ORDER - 1 :]) & _ROOM
    return full ^ (full >> 17), h ^ (h >> 17)


def _hash_of(gram: str, n: int) -> Column:
    """The same hash of the first ``n`` letters of a column."""
    h = F.lit(0).cast("long")
    for k in range(n):
        h = (h * _FACTOR + F.ascii(F.substring(gram, k + 1, 1))).bitwiseAND(F.lit(_ROOM))
    return h.bitwiseXOR(F.shiftright(h, 17))


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str, list[int]]]:
    """Runs of texts of about PIECE_CHARS letters: first row, joined letters, where each ends."""
    first, parts, ends, size = 0, [], [], 0
    for i, text in enumerate(texts):
        parts.append(_letters(text))
        size += len(parts[-1])
        ends.append(size)
        if size >= PIECE_CHARS:
            yield first, "".join(parts), ends
            first, parts, ends, size = i + 1, [], [], 0
    if parts:
        yield first, "".join(parts), ends


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)


def _count_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        texts = batch.column("text").to_pylist()
        for label in (0, 1):
            for _, letters, _ in _pieces([t for t, y in zip(texts, toxic) if y == label]):
                codes = _codes(letters)
                full, _ = _hashes(codes)
                real = np.flatnonzero((codes[ORDER - 1 :] != 0) | (codes[ORDER - 2 : -1] != 0))
                _, at, n = np.unique(full[real], return_index=True, return_counts=True)
                at = real[at]
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "gram": pa.array([letters[i : i + ORDER] for i in at], pa.string()),
                        "ordinary": pa.array(zero if label else n),
                        "toxic": pa.array(n if label else zero),
                    }
                )


def _backoff(grams: DataFrame) -> DataFrame:
    """``(tail, p)``: shared Kneser-Ney probability of the last letter of each shorter sequence."""
    counts = [grams.select("gram")]
    for k in range(ORDER - 1, 0, -1):
        counts.append(counts[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    single = counts[-1]
    total = single.agg(F.sum("n").alias("all"), F.count("*").alias("letters"))
    p = single.crossJoin(F.broadcast(total)).select("gram", ((F.col("n") + 1) / (F.col("all") + F.col("letters"))).alias("p"))
    for k, level in zip(range(2, ORDER), reversed(counts[1:-1])):
        level = level.withColumn("head", F.substring("gram", 1, k - 1)).withColumn("tail", F.substring("gram", 2, k - 1))
        heads = level.groupBy("head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        p = (
            level.join(heads, "head")
            .join(p.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
            .select("gram", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")).alias("p"))
        )
    return p.select(F.col("gram").alias("tail"), "p")


class Model:
    """Two tables of log-likelihood differences: of sequences, and by context of those not seen after it."""

    def __init__(self, seen: np.ndarray, unseen: np.ndarray):
        self.seen, self.unseen = seen, unseen

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Logarithm of the evidence per word of each text."""
        out = np.zeros(len(texts))
        seen_mask, unseen_mask = len(self.seen) - 1, len(self.unseen) - 1
        for first, letters, ends in _pieces(texts):
            codes = _codes(letters)
            full, context = _hashes(codes)
            value = self.seen[full & seen_mask].astype(np.float32)
            blank = np.isnan(value)
            value[blank] = self.unseen[context[blank] & unseen_mask]
            last = codes[ORDER - 1 :] == 0
            before = codes[ORDER - 2 : -1] == 0
            value[last & before] = 0
            starts = np.flatnonzero(before & ~last)
            if len(starts):
                evidence = np.maximum(np.add.reduceat(value.astype(np.float64), starts) - MARGIN, 0)
                rows = np.searchsorted(np.array(ends) - ORDER + 1, starts, side="right")
                words = np.bincount(rows, minlength=len(ends))
                out[first : first + len(ends)] = np.bincount(rows, evidence, minlength=len(ends)) / np.maximum(words, 1)
        return np.log(out + 0.01)


def _table(rows: DataFrame, bits: int, empty: float) -> np.ndarray:
    """At most ``2 ** bits`` rows come to the driver; sequences that share a place are averaged."""
    place = F.col("h").bitwiseAND((1 << bits) - 1).cast("int").alias("place")
    found = rows.groupBy(place).agg((F.sum(F.col("llr") * F.col("n")) / F.sum("n")).cast("float").alias("llr")).toArrow()
    table = np.full(1 << bits, empty, np.float16)
    table[found.column("place").to_numpy()] = found.column("llr").to_numpy().astype(np.float16)
    return table


def _fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset by Newton's method over binned means: (mean, ordinary, toxic)."""
    x = np.array([p[0] for p in points])
    n0, n1 = (np.array([p[k] for p in points], float) for k in (1, 2))
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ ((n0 + n1) * q - n1) + 1e-3 * w
        hessian = (design * ((n0 + n1) * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` with their mark. Texts that cannot have one stay out of the shuffle: at most SLOTS hashes of marked ids are broadcast."""
    slot = F.crc32(F.col("doc_id").cast("string")).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    near = docs.withColumn("slot", slot).join(F.broadcast(marks.select(slot.alias("slot")).distinct()), "slot", "left_semi")
    return near.drop("slot").join(marks.hint("merge"), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, bits: int = 22):
    """``(broadcast Model, slope, offset)`` learned from labelled rows that are not held out, or None.

    One in five of these rows sets the curve, and the others are counted.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    known = _labelled(docs.select("doc_id", "text"), marks)
    for_curve = F.floor(F.crc32(F.col("doc_id").cast("string")) / 3) % 5 == 0
    raw = known.where(~for_curve).select("text", "toxic").mapInArrow(_count_sequences, "gram string, ordinary long, toxic long")
    grams = raw.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    grams = durable(grams.select("*", _hash_of("gram", ORDER).alias("h"), _hash_of("gram", ORDER - 1).alias("hc")))
    have = grams.agg(F.sum("ordinary"), F.sum("toxic")).first()
    if not have[0] or not have[1]:
        return None
    contexts = grams.groupBy("hc").agg(
        F.sum("ordinary").alias("total_o"), F.sum("toxic").alias("total_t"),
        F.count_if(F.col("ordinary") > 0).alias("kinds_o"), F.count_if(F.col("toxic") > 0).alias("kinds_t"),
    )

    def p(which: str, n: str) -> Column:
        own = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{which}") * F.col("p")) / F.col(f"total_{which}")
        return F.when(F.col(f"total_{which}") > 0, own).otherwise(F.col("p"))

    def rest(which: str) -> Column:
        return F.when(F.col(f"total_{which}") > 0, DISCOUNT * F.col(f"kinds_{which}") / F.col(f"total_{which}")).otherwise(1.0)

    seen = (
        grams.withColumn("tail", F.substring("gram", 2, ORDER - 1)).join(_backoff(grams), "tail").join(contexts, "hc")
        .select("h", (F.col("ordinary") + F.col("toxic")).alias("n"), F.log(p("t", "toxic") / p("o", "ordinary")).alias("llr"))
    )
    unseen = contexts.select(F.col("hc").alias("h"), (F.col("total_o") + F.col("total_t")).alias("n"), F.log(rest("t") / rest("o")).alias("llr"))
    model = Model(_table(seen, bits, math.nan), _table(unseen, bits - 1, 0.0))
    shared = spark.sparkContext.broadcast(model)
    binned = (
        apply_means(known.where(for_curve), shared)
        .groupBy(F.round(F.least(F.greatest("evidence", F.lit(-10.0)), F.lit(10.0)), 3).alias("x"))
        .agg(F.count_if(F.col("toxic") == 0).alias("o"), F.count_if(F.col("toxic") != 0).alias("t"))
    )
    points = [(r.x, r.o, r.t) for r in binned.collect()]  # at most 20,001 bins
    return shared, *(_fit_curve(points) if points else (1.0, 0.0))


def apply_means(docs: DataFrame, model, name: str = "evidence") -> DataFrame:
    """``docs`` with evidence (logarithm, per word) as the column ``name``; ``model`` is a broadcast :class:`Model`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = model.value.means(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(means)], names=[*batch.schema.names, name])

    docs = without(docs, name)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (replacing columns so named)."""
    docs = without(docs, "held_out", "score", "predicted")
    model = fit(docs, labels)
    out = docs.withColumn("held_out", held_out(F.col("doc_id")))
    if model is None:
        return out.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared, slope, offset = model
    name = fresh(out, "evidence")
    scored = apply_means(out, shared, name)
    score = 1.0 / (1.0 + F.exp(-(F.col(name) * slope + offset)))
    return scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(name)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with the columns they came with."""
    hidden = masked(docs, "doc_id", "text")
    kept = score_toxicity(hidden, labels, threshold).where("predicted = 0")
    return kept.select(*hidden.columns).toDF(*docs.columns)
