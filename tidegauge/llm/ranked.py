"""Ranked lexical search over a tiered index, with proofs of exactness.

Items are searched in blocks with at most TERMS different terms (one item at least). For a block,
tasks read each document once and store postings of the block's terms by groups of documents, so
that no term, however common, has a place of its own that grows with the corpus. From the counts
over all documents follow the weights, and with them each posting's impact: what it adds to a score
per occurrence in an item. Postings are dealt to tiers by impact, the highest first, each tier with
its own columns, so that reading a tier reads no lower one.

A round reads the tiers from the first down to its own. Its best k documents of each item by what is seen so
far are scored in full, and the k-th of these scores is a bound that the item's answer must reach. A term's
residual is its highest impact in the tiers not read. An item is proven once the residuals of all
its terms add up to less than the bound: no document without a posting in the tiers read can be in the
answer. Then those documents whose seen impacts, plus the residuals of the terms they
were not seen with, reach the bound are scored in full, and the best k of them are the answer. Items without
proof fall through to the next tier; after the last one residuals are 0 and every item is proven.

Groups hold at most GROUP_DOCS documents and about GROUP_POSTINGS postings. The driver gets at most one row
per term of a block, per bin of the impacts, and k rows per item of it. Where the tiers are cut changes what is read,
never the answer.

Defined cases: null texts have no terms; items without terms, and items whose terms no document
holds, have no rows; repeated documents and items are rows of their own, so a doc_id or an item_id may
occur more than once; a null doc_id comes after others on equal scores; texts of any length count whole;
terms that more than half of the documents hold can weigh 0 and then add nothing; other columns do
not matter; with an empty table on either side there are no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm._shared import discard, durable_table
from tidegauge.llm.bpe import _slices

TERMS = 1 << 17
GROUP_DOCS = 8192
GROUP_POSTINGS = 1 << 19
#: Shares of all postings down to the end of each tier but the last.
CUTS = (1 / 8, 1 / 2, 3 / 4, 15 / 16)
#: Items scored at a time in a task.
ITEMS = 256
#: Bins of impacts for each doubling, to find the cuts.
FINE = 64
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Upper-case ASCII letters to lower case, all other bytes as they are.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    return _TERM.findall((raw or b"").translate(_LOWER))


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items: their numbers, and for each term the items that hold it and how often."""

    def __init__(self, numbers: list[int], ids: list[int | None], holders: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.numbers, self.ids, self.holders = np.array(numbers, np.int64), ids, holders

    def part(self, at: np.ndarray) -> Items:
        """Only the items at these places."""
        place = np.full(len(self.numbers), -1)
        place[at] = np.arange(len(at))
        holders = {}
        for term, (who, times) in self.holders.items():
            mine = place[who] >= 0
            if mine.any():
                holders[term] = place[who[mine]], times[mine]
        return Items(self.numbers[at].tolist(), [self.ids[i] for i in at], holders)

    def parts(self) -> Iterator[tuple[np.ndarray, Items]]:
        for start in range(0, len(self.numbers), ITEMS):
            at = np.arange(start, min(start + ITEMS, len(self.numbers)))
            yield at, self.part(at)

    def totals(self, of_term: np.ndarray) -> np.ndarray:
        """The sum over each item's terms, repeats included."""
        out = np.zeros(len(self.numbers), np.int64)
        for term, (who, times) in self.holders.items():
            out[who] += times * of_term[term]
        return out


def item_blocks(items: DataFrame, most_terms: int = TERMS) -> Iterator[tuple[Items, dict[bytes, int]]]:
    """Blocks of items in turn, with the numbers of their terms; the driver holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item_id").to_pylist(), batch.column("raw").to_pylist()):
                found = Counter(terms_of(raw))
                if found:
                    columns = [pa.array([item], pa.int64()), pa.array([list(found)], pa.list_(pa.binary())), pa.array([list(found.values())], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "terms", "times"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("raw"))
    rows = rows.mapInArrow(run, "item_id long, terms array<binary>, times array<long>")
    numbers, ids, known, holders, n = [], [], {}, {}, 0
    for row in rows.toLocalIterator():
        terms = [bytes(t) for t in row.terms]
        if ids and len(known) + sum(t not in known for t in terms) > most_terms:
            yield _block(numbers, ids, holders), known
            numbers, ids, known, holders = [], [], {}, {}
        for term, times in zip(terms, row.times):
            holders.setdefault(known.setdefault(term, len(known)), []).append((len(ids), times))
        numbers.append(n)
        ids.append(row.item_id)
        n += 1
    if ids:
        yield _block(numbers, ids, holders), known


def _block(numbers: list[int], ids: list[int | None], holders: dict[int, list[tuple[int, int]]]) -> Items:
    return Items(numbers, ids, {t: tuple(np.array(x, np.int64) for x in zip(*found)) for t, found in holders.items()})


def _by_term(term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by term, the terms there are, and how many postings each has."""
    order = np.argsort(term, kind="stable")
    found, sizes = np.unique(term, return_counts=True)
    return order, found.astype(np.int32), sizes.astype(np.int32)


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Groups of documents: ids, lengths, and the postings of known terms; n_docs and n_terms count all of the group."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["place", "doc_ids", "lengths", "n_docs", "n_terms", "term", "doc", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, group = shared.value, TaskContext.get().partitionId() << 32, 0
        ids, lengths, n_docs, n_terms = [], [], 0, 0
        flat = [array("i"), array("i"), array("i")]

        def row() -> pa.RecordBatch:
            columns = [pa.array([task | group], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))]
            columns += [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())]
            columns += [pa.array([f.tobytes()], pa.binary()) for f in flat]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in _slices(batches, "raw"):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()):
                words = terms_of(raw)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                found = [(known[w], n) for w, n in Counter(words).items() if w in known]
                if not found:
                    continue
                for term, n in found:
                    flat[0].append(term)
                    flat[1].append(len(ids))
                    flat[2].append(n)
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) >= GROUP_DOCS or len(flat[0]) >= GROUP_POSTINGS:
                    yield row()
                    ids, lengths, n_docs, n_terms, group = [], [], 0, 0, group + 1
                    flat = [array("i"), array("i"), array("i")]
        if n_docs:
            yield row()

    schema = "place long, doc_ids array<long>, lengths array<long>, n_docs long, n_terms long, term binary, doc binary, tf binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)


def _summed(groups: DataFrame, size: int, count: Callable[[pa.RecordBatch, int], np.ndarray]) -> np.ndarray:
    """The sums over all groups of an array of ``size`` numbers; tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += count(batch, i)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for r in groups.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _ints(batch: pa.RecordBatch, name: str, i: int, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


class Index:
    """The stored tiers of one block's terms, and each term's highest impact in each tier."""

    def __init__(self, docs: DataFrame, known: dict[bytes, int]):
        size = len(known)
        groups = durable_table(postings(docs, known), "ranked-postings")

        def counted(batch: pa.RecordBatch, i: int) -> np.ndarray:
            both = [batch.column("n_docs")[i].as_py(), batch.column("n_terms")[i].as_py()]
            return np.concatenate([np.bincount(_ints(batch, "term", i), minlength=size), both])

        *df, n_docs, n_terms = _summed(groups.select("n_docs", "n_terms", "term"), size + 2, counted).tolist()
        self.weights = np.array([weight(n, n_docs) for n in df], np.int64)
        self.bounds = self._bounds(groups, n_docs, n_terms)
        self.tiers = len(self.bounds) + 1
        self.table = durable_table(self._tiered(groups, n_docs, n_terms), "ranked-index")
        discard(groups)
        self.tops = self._tops(size)

    def _impacts(self, n_docs: int, n_terms: int) -> Callable[[pa.RecordBatch, int], np.ndarray]:
        weights = self.weights

        def impacts(batch: pa.RecordBatch, i: int) -> np.ndarray:
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column("lengths")[i].as_py()], np.int64)
            tf = _ints(batch, "tf", i).astype(np.int64)
            return weights[_ints(batch, "term", i)] * (1_000_000_000 * tf // (1000 * tf + 8 * m[_ints(batch, "doc", i)]))

        return impacts

    def _bounds(self, groups: DataFrame, n_docs: int, n_terms: int) -> list[int]:
        """The least impact of each tier but the last, from a histogram over all postings."""
        impacts = self._impacts(n_docs, n_terms)

        def bins(batch: pa.RecordBatch, i: int) -> np.ndarray:
            found = impacts(batch, i)
            return np.bincount((FINE * np.log2(found[found > 0])).astype(int), minlength=64 * FINE)

        down = np.cumsum(_summed(groups.select("lengths", "term", "doc", "tf"), 64 * FINE, bins)[::-1])
        if not down[-1]:
            return [1] * len(CUTS)
        ends = [64 * FINE - 1 - int(np.searchsorted(down, cut * down[-1])) for cut in CUTS]
        return [int(np.ceil(2.0 ** (end / FINE))) for end in ends]

    def _tiered(self, groups: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
        impacts, bounds, tiers = self._impacts(n_docs, n_terms), np.array(self.bounds), self.tiers
        kinds = ["terms", "sizes", "docs", "impacts", "tops"]
        names = ["place", "doc_ids", *[f"{kind}{k}" for k in range(tiers) for kind in kinds]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    found, columns = impacts(batch, i), [batch.column("place").slice(i, 1), batch.column("doc_ids").slice(i, 1)]
                    term, doc = _ints(batch, "term", i), _ints(batch, "doc", i)
                    tier = (found[:, None] < bounds[None, :]).sum(1)
                    for k in range(tiers):
                        mine = (tier == k) & (found > 0)
                        order, terms, sizes = _by_term(term[mine])
                        sorted_ = found[mine][order]
                        tops = np.maximum.reduceat(sorted_, np.cumsum(sizes) - sizes) if len(sizes) else sorted_
                        columns += [pa.array([x.tobytes()], pa.binary()) for x in (terms, sizes, doc[mine][order], sorted_, tops)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = ", ".join(["place long, doc_ids array<long>", *[f"{name} binary" for name in names[2:]]])
        return groups.select("place", "doc_ids", "lengths", "term", "doc", "tf").mapInArrow(run, schema)

    def _tops(self, size: int) -> np.ndarray:
        tiers = self.tiers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops = np.zeros((tiers, size), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    for k in range(tiers):
                        at = _ints(batch, f"terms{k}", i)
                        tops[k, at] = np.maximum(tops[k, at], _ints(batch, f"tops{k}", i, np.int64))
            k, at = np.nonzero(tops)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(tops[k, at])], names=["k", "at", "top"])

        columns = [f"{kind}{k}" for k in range(tiers) for kind in ("terms", "tops")]
        found = self.table.select(*columns).mapInArrow(run, "k long, at long, top long").groupBy("k", "at").agg(F.max("top").alias("top"))
        out = np.zeros((tiers, size), np.int64)
        for r in found.collect():
            out[r.k, r["at"]] = r.top
        return out

    def residual(self, k: int) -> np.ndarray:
        """Each term's highest impact in the tiers below tier ``k``."""
        below = self.tops[k + 1 :]
        return below.max(0) if len(below) else np.zeros(self.tops.shape[1], np.int64)

    def read(self, upto: int) -> DataFrame:
        """The tiers from the first to ``upto``."""
        columns = [f"{kind}{k}" for k in range(upto + 1) for kind in ("terms", "sizes", "docs", "impacts")]
        return self.table.select("place", "doc_ids", *columns)


def _add(batch: pa.RecordBatch, i: int, tiers: range, items: Items, seen: np.ndarray, residual: np.ndarray | None = None, owed: np.ndarray | None = None, column: np.ndarray | None = None) -> None:
    """Add the postings of these tiers to ``seen`` (items by documents), and what their terms' residuals were to ``owed``.

    With ``column``, only documents that have one there, under that number.
    """
    for k in tiers:
        sizes = _ints(batch, f"sizes{k}", i)
        ends = np.cumsum(sizes)
        docs, impacts = _ints(batch, f"docs{k}", i), _ints(batch, f"impacts{k}", i, np.int64)
        for term, start, end in zip(_ints(batch, f"terms{k}", i).tolist(), (ends - sizes).tolist(), ends.tolist()):
            holders = items.holders.get(term)
            if holders is None:
                continue
            at, found = docs[start:end], impacts[start:end]
            if column is not None:
                at = column[at]
                found, at = found[at >= 0], at[at >= 0]
                if not len(at):
                    continue
            who, times = holders
            cells = (who[:, None], at[None, :])
            seen[cells] += times[:, None] * found[None, :]
            if owed is not None and residual[term]:
                owed[cells] += (times * residual[term])[:, None]


class Best:
    """The best k rows of each item that a task has met; all that any answer can need of it."""

    def __init__(self, k: int):
        self.k, self.rows = k, None

    def offer(self, item: np.ndarray, score: np.ndarray, tie: np.ndarray, *more: np.ndarray) -> None:
        """Rows of an item with the highest scores stay, and of equal scores those with the least tie."""
        new = [item, score, tie, *more]
        rows = new if self.rows is None else [np.concatenate(pair) for pair in zip(self.rows, new)]
        order = np.lexsort((rows[2], -rows[1], rows[0]))
        item = rows[0][order]
        first = np.searchsorted(item, item)
        self.rows = [r[order][np.arange(len(item)) - first < self.k] for r in rows]


def _partial(index: Index, items: Items, upto: int, k: int) -> list:
    """The best k documents of each item by the tiers seen: rows of (item, place, doc, score)."""
    shared = index.table.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, parts = Best(k), list(shared.value.parts())
        for batch in batches:
            for i in range(batch.num_rows):
                n, place = len(batch.column("doc_ids")[i]), batch.column("place")[i].as_py()
                for at, part in parts:
                    seen = np.zeros((len(at), n), np.int64)
                    _add(batch, i, range(upto + 1), part, seen)
                    if n > k:
                        doc = np.argpartition(-seen, k - 1, 1)[:, :k]
                    else:
                        doc = np.broadcast_to(np.arange(n), seen.shape)
                    who = np.broadcast_to(at[:, None], doc.shape)
                    score = np.take_along_axis(seen, doc, 1)
                    some = score > 0
                    best.offer(who[some], score[some], np.full(int(some.sum()), place), doc[some])
        if best.rows is not None:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in best.rows], names=["item", "score", "place", "doc"])

    rows = index.read(upto).mapInArrow(run, "item long, score long, place long, doc long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "place", "doc")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()


def _limits(index: Index, items: Items, found: list, upto: int, k: int) -> np.ndarray:
    """The k-th full score of each item's candidates, or 0 if it has fewer."""
    out, scores = np.zeros(len(items.numbers), np.int64), [[] for _ in items.numbers]
    if upto + 1 == index.tiers:
        for r in found:
            scores[r["item"]].append(r.score)
    elif found:
        wanted = {}
        for r in found:
            wanted.setdefault(r.place, []).append((r["item"], r.doc))
        shared = index.table.sparkSession.sparkContext.broadcast((items, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, wanted = shared.value
            parts = list(items.parts())
            for batch in batches:
                for i in range(batch.num_rows):
                    item, doc = np.array(wanted[batch.column("place")[i].as_py()]).T
                    for at, part in parts:
                        mine = (item >= at[0]) & (item <= at[-1])
                        docs, where = np.unique(doc[mine], return_inverse=True)
                        column = np.full(len(batch.column("doc_ids")[i]), -1)
                        column[docs] = np.arange(len(docs))
                        seen = np.zeros((len(at), len(docs)), np.int64)
                        _add(batch, i, range(index_tiers), part, seen, column=column)
                        yield pa.RecordBatch.from_arrays([pa.array(item[mine]), pa.array(seen[item[mine] - at[0], where])], names=["item", "score"])

        index_tiers = index.tiers
        rows = index.read(index_tiers - 1).where(F.col("place").isin(list(wanted)))
        for r in rows.mapInArrow(run, "item long, score long").collect():
            scores[r["item"]].append(r.score)
    for i, s in enumerate(scores):
        if len(s) >= k:
            out[i] = sorted(s, reverse=True)[k - 1]
    return out


NO_ID = np.iinfo(np.int64).max


def _finished(index: Index, items: Items, limits: np.ndarray, upto: int, k: int) -> DataFrame:
    """``(item, item_id, doc_id, score)`` of proven items: the best of those that can reach the limit, scored in full."""
    residual = index.residual(upto)
    tiers, shared = index.tiers, index.table.sparkSession.sparkContext.broadcast((items, limits, residual, items.totals(residual)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, limits, residual, unseen = shared.value
        best, parts = Best(k), list(items.parts())
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].values
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(NO_ID).to_numpy()
                for at, part in parts:
                    seen, owed = np.zeros((len(at), len(ids)), np.int64), None
                    if upto + 1 < tiers:
                        owed = np.zeros_like(seen)
                    _add(batch, i, range(upto + 1), part, seen, residual, owed)
                    most = seen if owed is None else seen - owed + unseen[at][:, None]
                    able = (seen > 0) & (most >= limits[at][:, None])
                    docs = np.flatnonzero(able.any(0))
                    if not len(docs):
                        continue
                    full = seen[:, docs]
                    if upto + 1 < tiers:
                        column = np.full(len(ids), -1)
                        column[docs] = np.arange(len(docs))
                        _add(batch, i, range(upto + 1, tiers), part, full, column=column)
                    who, which = np.nonzero(able[:, docs])
                    best.offer(at[who], full[who, which], ids[docs[which]], null[docs[which]])
        if best.rows is not None:
            item, score, doc_id, null = best.rows
            columns = [pa.array(items.numbers[item]), pa.array([items.ids[n] for n in item], pa.int64()), pa.array(doc_id, mask=null > 0), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return index.read(tiers - 1).mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, proofs: list[int] | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    ``proofs`` gets the number of items that each round proved.
    """
    spark, answers = docs.sparkSession, []
    for block, known in item_blocks(items):
        index = Index(docs, known)
        left = block
        for upto in range(index.tiers):
            limits = _limits(index, left, _partial(index, left, upto, k), upto, k)
            proven = left.totals(index.residual(upto)) < limits
            if upto + 1 == index.tiers:
                proven[:] = True
            if proofs is not None:
                proofs.append(int(proven.sum()))
            if proven.any():
                at = np.flatnonzero(proven)
                answers.append(durable_table(_finished(index, left.part(at), limits[at], upto, k), "ranked-answers"))
                left = left.part(np.flatnonzero(~proven))
            if not len(left.numbers):
                break
        discard(index.table)
    found = _union(spark, answers)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _union(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for table in tables:
        out = out.unionByName(table)
    return out


#: The same ranking as plain SQL over all pairs, for comparison.
ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark),
sizes AS (SELECT count(*) AS all_docs, sum(len(words))::BIGINT AS all_terms FROM docs WHERE len(words) > 0),
asked AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(words) AS term FROM items) GROUP BY ALL),
held AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(words) AS term FROM docs) GROUP BY ALL),
spread AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, sizes GROUP BY term, all_docs),
scores AS (
  SELECT item, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN spread USING (term) JOIN docs USING (doc), sizes GROUP BY item, doc),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores JOIN items USING (item) JOIN docs USING (doc) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
