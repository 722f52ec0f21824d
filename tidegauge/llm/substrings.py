"""Substring dedup by content-defined chunks.

Every text is cut where a gear rolling hash has a local least, so limits depend on the text nearby
alone and an insertion moves only the limits around it. Chunks are equal if their 128-bit digests
are. Spark finds, for each digest, where it occurs first (smallest doc_id, then position); the
minima combine before the shuffle. Consecutive chunks of a document that occurred earlier form
a run. Runs are only seeds: each is extended to left and right, byte by byte, as far as the text
agrees with that around a first occurrence of its chunks, and passages of at least PASSAGE_WORDS
words to their true ends are reported or removed. To compare, CONTEXT bytes of either text are
fetched for each end, and more only where all of them agree, so hot passages are keys of joins and
their texts are fetched once. :func:`repeats` gives the bare runs of at least LEAST_WORDS words.

Defined cases: null and empty texts have no chunks; rows without doc_id take no part and stay as
they are; rows that share a doc_id count as one document, so a row repeated under its own id is
no copy; other columns pass through :func:`remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import durable_table, masked
from tidegauge.llm.chunks import least_limits

REACH = 24
LEAST_WORDS = 20
PASSAGE_WORDS = 50
CONTEXT = 128


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row").to_numpy(), batch.column("raw")):
            raw = text.as_py() or b""
            limits = least_limits(raw, REACH)
            n = len(limits) - 1
            if not n:
                continue
            digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in pairwise(limits)])
            high, low = np.frombuffer(digests, ">i8").astype(np.int64).reshape(n, 2).T
            spaces = np.concatenate([[0], np.cumsum(np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \n\t\r", np.uint8)))])
            ends = np.array(limits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ends[:-1].astype(np.int32)), pa.array(ends[1:].astype(np.int32)),
                    pa.array((spaces[ends[1:]] - spaces[ends[:-1]]).astype(np.int32)), pa.array(np.ascontiguousarray(high)), pa.array(np.ascontiguousarray(low)),
                ],
                names=["row", "nth", "start", "end", "words", "high", "low"],
            )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(row, nth, start, end, words, first_row, first_start)`` of chunks that occurred earlier; byte offsets."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("binary").alias("raw"))
    schema = "row long, nth int, start int, end int, words int, high long, low long"
    chunks = durable_table(ids.mapInArrow(_cut, schema), "substring-chunks")
    first = chunks.groupBy("high", "low").agg(F.min(F.struct("row", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = chunks.join(first, ["high", "low"]).where("row <> first.row or start <> first.start")
    return found.select("row", "nth", "start", "end", "words", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start"))


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, start, end, words, first_doc_id)`` of repeated passages, in byte offsets.

    ``first_doc_id`` is the smallest doc_id in which a chunk of the passage occurs first.
    """
    found = repeated_chunks(docs).drop("first_start").distinct()
    run = F.col("nth") - F.row_number().over(Window.partitionBy("row").orderBy("nth"))
    runs = found.withColumn("run", run).groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("first_row").alias("first_row")
    )
    long_enough = runs.where(F.col("words") >= least_words)
    return long_enough.select(F.col("row").alias("doc_id"), "start", "end", "words", F.col("first_row").alias("first_doc_id"))


def _agreement(mine: bytes, other: bytes, side: int) -> int:
    """How many bytes agree at the end (side 0) or the start (1), in whole characters of ``mine``."""
    n = min(len(mine), len(other))
    a, b = (mine[len(mine) - n :][::-1], other[len(other) - n :][::-1]) if side == 0 else (mine[:n], other[:n])
    if a != b:
        differ = np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)
        n = int(differ.argmax())
    if side == 0:
        while n and a[n - 1] & 0xC0 == 0x80:
            n -= 1
    else:
        while n and n < len(mine) and mine[n] & 0xC0 == 0x80:
            n -= 1
    return n


def _fetch(length: int):
    """Up to ``length`` bytes before (side 0) or from (1) each wanted place of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sides, places, found, size = [], [], [], [], 0
            for row, raw, wanted in zip(batch.column("row").to_pylist(), batch.column("raw"), batch.column("wanted")):
                text = raw.as_py() or b""
                for w in wanted.as_py():
                    side, at = w["side"], w["at"]
                    part = text[at : at + length] if side == 1 else text[max(0, at - length) : at] if at <= len(text) else b""
                    rows.append(row), sides.append(side), places.append(at), found.append(part)
                    size += len(part)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sides, pa.int32()), pa.array(places, pa.int32()), pa.array(found, pa.binary())], names=["row", "side", "at", "part"])
                        rows, sides, places, found, size = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sides, pa.int32()), pa.array(places, pa.int32()), pa.array(found, pa.binary())], names=["row", "side", "at", "part"])

    return run


def _compare(length: int):
    """By how much each end of a run extends, where white space stands there, and whether all that was fetched agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, spaces, more = [], [], []
            for side, at, mine, other in zip(*(batch.column(c).to_pylist() for c in ("side", "at", "mine", "other"))):
                mine, other = mine or b"", other or b""
                n = _agreement(mine, other, side)
                part, low = (mine[len(mine) - n :], at - n) if side == 0 else (mine[:n], at)
                by.append(n)
                spaces.append([low + k for k, c in enumerate(part) if c in b" \n\t\r"])
                more.append(len(mine) == length == len(other) and n >= length - 3)
            kept = [batch.column(c) for c in ("row", "side", "at", "first_row", "first_at")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(by, pa.int32()), pa.array(spaces, pa.list_(pa.int32())), pa.array(more, pa.bool_())], names=["row", "side", "at", "first_row", "first_at", "by", "spaces", "more"])

    return run


def _extensions(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``(row, side, at, by, spaces)``: the longest extension of each end of a run, over its first occurrences."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("binary").alias("raw"))
    length, done = CONTEXT, []
    while True:
        wanted = ends.select("row", "side", "at").union(ends.select("first_row", "side", "first_at")).distinct()
        wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("side", "at")).alias("wanted"))
        parts = texts.join(wanted, "row").mapInArrow(_fetch(length), "row long, side int, at int, part binary")
        parts = durable_table(parts.groupBy("row", "side", "at").agg(F.min("part").alias("part")), "substring-contexts")
        pairs = ends.join(parts.withColumnRenamed("part", "mine"), ["row", "side", "at"])
        pairs = pairs.join(parts.toDF("first_row", "side", "first_at", "other"), ["first_row", "side", "first_at"])
        schema = "row long, side int, at int, first_row long, first_at int, by int, spaces array<int>, more boolean"
        found = durable_table(pairs.mapInArrow(_compare(length), schema), "substring-extensions")
        done.append(found.where("not more"))
        ends = found.where("more").select("row", "side", "at", "first_row", "first_at")
        if ends.isEmpty():
            break
        length *= 16
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return every.groupBy("row", "side", "at").agg(F.max(F.struct("by", "spaces")).alias("longest")).select("row", "side", "at", "longest.by", "longest.spaces")


def passages(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """``(doc_id, start, end, words, first_doc_id)`` of repeated passages to their true ends, in byte offsets.

    ``words`` counts the white space in the passage; ``first_doc_id`` is as in :func:`repeats`.
    """
    by_row = Window.partitionBy("row")
    run = F.col("nth") - F.row_number().over(by_row.orderBy("nth"))
    found = durable_table(repeated_chunks(docs).distinct(), "substring-repeated")
    found = found.withColumn("run", run).withColumn("shift", F.col("first_start") - F.col("start"))
    # the places of a run's chunks in each text where they occur first, and the run they belong to
    runs = found.groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("first_row").alias("first_row"),
        F.collect_set(F.struct("first_row", "shift")).alias("firsts"),
    )
    runs = durable_table(runs.drop("run"), "substring-runs")
    each = runs.select("row", "start", "end", F.explode("firsts").alias("f"))
    ends = each.select("row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("at")), F.struct(F.lit(1).alias("side"), F.col("end").alias("at")))).alias("e"), "f")
    ends = ends.select("row", "e.side", "e.at", "f.first_row", (F.col("e.at") + F.col("f.shift")).alias("first_at")).where("first_at >= 0")
    longest = _extensions(docs, ends)
    left = longest.where("side = 0").select("row", F.col("at").alias("start"), F.col("by").alias("left"), F.col("spaces").alias("left_spaces"))
    right = longest.where("side = 1").select("row", F.col("at").alias("end"), F.col("by").alias("right"), F.col("spaces").alias("right_spaces"))
    wide = runs.drop("firsts").join(left, ["row", "start"], "left").join(right, ["row", "end"], "left")
    nth = by_row.orderBy("start")
    wide = wide.withColumn("before", F.coalesce(F.lag("end").over(nth), F.lit(0))).withColumn("after", F.coalesce(F.lead("start").over(nth), F.lit(2**31 - 1)))
    wide = wide.select(
        "row", "words", "first_row", F.greatest(F.col("start") - F.coalesce("left", F.lit(0)), "before").alias("start"), F.least(F.col("end") + F.coalesce("right", F.lit(0)), "after").alias("end"),
        F.expr("filter(concat(coalesce(left_spaces, array()), coalesce(right_spaces, array())), x -> x >= before and x < after)").alias("spaces"),
    )
    # extended runs that meet are one passage; white space between them counts once
    reached = F.max("end").over(by_row.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    wide = wide.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    wide = wide.withColumn("passage", F.sum("new").over(by_row.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = wide.groupBy("row", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("words") + F.size(F.array_distinct(F.flatten(F.collect_list("spaces"))))).alias("words"), F.min("first_row").alias("first_row")
    )
    return whole.where(F.col("words") >= least_words).select(F.col("row").alias("doc_id"), "start", "end", "words", F.col("first_row").alias("first_doc_id"))


def remove_repeats(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with the passages that :func:`passages` finds cut out of their texts."""
    hidden = masked(docs, "doc_id", "text")
    spans = passages(hidden, least_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if spans and text:
                    raw = text.encode()
                    for span in reversed(spans):
                        raw = raw[: span["start"]] + raw[span["end"] :]
                    text = raw.decode("utf-8", "ignore")
                texts.append(text)
            i = batch.schema.get_field_index("text")
            out = batch.set_column(i, batch.schema.field(i), pa.array(texts, pa.string()))
            yield out.drop_columns(["__spans"])

    joined = hidden.join(spans, "doc_id", "left").select(*hidden.columns, "__spans")
    return joined.mapInArrow(run, T.StructType(list(hidden.schema.fields))).toDF(*docs.columns)
