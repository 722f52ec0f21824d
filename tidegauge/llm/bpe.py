"""BPE encoding and decoding with reuse of chunks that documents share.

Texts are cut into content-defined chunks by a gear rolling hash. Spark counts in how many
documents each chunk occurs; the DICTIONARY chunks that save most are encoded once, by the tasks
that hold them, and their ids are broadcast under 128 bits of hash (a fixed number of chunks of about
CHUNK bytes, so of bounded size; neither the chunks nor what they decode to go through the driver).
All other chunks, however many, are encoded in place.

A chunk may begin and end within a word. The dictionary keeps what lies between a chunk's first
and last white space; at a join, the tail of one chunk and the head of the next are encoded
again as one text. The window of this repair reaches out to white space on both sides, over whole
chunks if they hold none, because there the encodings agree exactly: the tokenizer drops white
space, and none of its steps (normalising, splitting, merging, special tokens) looks across it.

A slice of documents is encoded at a time, and in it each distinct word once. Decoding joins what each piece decodes to.

Defined cases: null is as empty: no tokens and empty text; repeated rows are encoded each; texts
of any length are encoded whole; other columns pass through, unless named as a result is.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import fresh, without
from tidegauge.llm.chunks import mask_limits

CHUNK = 512
LONGEST_SHARED = 8 * CHUNK
DICTIONARY = 8192
WORDS_KEPT = 100_000
SLICE_BYTES = 2 << 20
#: White space that ends a word for the tokenizer and for nothing else.
SPACE = b" \n\t\r"
_SPACES = re.compile(rb"[ \n\t\r]")
_OTHER_SPACES = re.compile(rb"[\x0b\x0c\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """A tokenizer that keeps what each word gives: ids (little-endian, 32 bits) and decoded text, or None if nothing."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use all cores as it is
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.decoder is not None:
            raise ValueError("the tokenizer must decode by joining its tokens with spaces")
        self.words: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.tokens: dict[int, bytes] = {}

    def _learn(self, words: Iterable[bytes]) -> None:
        tokens = self.tokens
        for part in batched(words, 4096):
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                ids = e.ids
                for i in ids:
                    if i not in tokens:
                        tokens[i] = self.tokenizer.id_to_token(i).encode()
                self.words[w] = (struct.pack(f"<{len(ids)}I", *ids), b" ".join([tokens[i] for i in ids])) if ids else None

    def joined(self, ids: bytes) -> bytes:
        """What ids decode to."""
        tokens, numbers = self.tokens, np.frombuffer(ids, "<u4").tolist()
        for i in [i for i in set(numbers) if i not in tokens]:
            tokens[i] = self.tokenizer.id_to_token(i).encode()
        return b" ".join([tokens[i] for i in numbers])

    def whole(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """``(ids, decoded)`` of texts that start and end at white space.

        Of all words, WORDS_KEPT stay known: those that came again, then the latest.
        """
        split = [words_of(t) for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(split))
        again = [w for w in distinct if w in self.words]
        self._learn([w for w in distinct if w not in self.words])
        out = []
        for words in split:
            found = [p for p in map(self.words.__getitem__, words) if p]
            out.append((b"".join([p[0] for p in found]), b" ".join([p[1] for p in found])))
        if len(self.words) > WORDS_KEPT:
            self.words = {w: self.words[w] for w in islice(dict.fromkeys(chain(again, distinct)), WORDS_KEPT)}
        return out


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks that a Python worker runs."""
    return Encoder(path)


def words_of(raw: bytes) -> list[bytes]:
    return raw.split() if raw.isascii() and not _OTHER_SPACES.search(raw) else [w for w in _SPACES.split(raw) if w]


class Shared:
    """What the dictionary holds of a chunk: the ids between its outer white spaces. A worker decodes them when it first meets the chunk."""

    def __init__(self, head: int, tail: int, ids: bytes):
        self.head, self.tail, self.ids, self.decoded = head, tail, ids, None

    def results(self, encoder: Encoder) -> tuple[bytes, bytes]:
        if self.decoded is None:
            self.decoded = encoder.joined(self.ids)
        return self.ids, self.decoded


def key_of(chunk: bytes) -> bytes:
    """128 bits that stand for a chunk in the dictionary."""
    return xxhash.xxh3_128_digest(chunk)


def inner(chunk: bytes) -> tuple[int, int] | None:
    """From after the first white space to the last one."""
    first = _SPACES.search(chunk)
    if first is None:
        return None
    return first.end(), max(chunk.rfind(bytes([c])) for c in SPACE)


def parts_of(raw: bytes, dictionary: dict[bytes, Shared]) -> list[bytes | Shared]:
    """A document as shared chunks and, between them, the text that none covers, joins included."""
    parts, open_from = [], 0
    if dictionary:
        for a, b in pairwise(mask_limits(raw, CHUNK)):
            known = dictionary.get(key_of(raw[a:b])) if b - a <= LONGEST_SHARED else None
            if known is not None:
                parts += [raw[open_from : a + known.head], known]
                open_from = a + known.tail
    return [*parts, raw[open_from:]]


def encode(raws: list[bytes], encoder: Encoder, dictionary: dict[bytes, Shared]) -> list[tuple[bytes, bytes]]:
    """Ids and decoded text of each document."""
    documents = [parts_of(raw, dictionary) for raw in raws]
    between = iter(encoder.whole([p for parts in documents for p in parts if isinstance(p, bytes)]))
    out = []
    for parts in documents:
        found = [next(between) if isinstance(p, bytes) else p.results(encoder) for p in parts]
        out.append((b"".join([i for i, _ in found]), b" ".join([d for i, d in found if i])))
    return out


def _texts(batch: pa.RecordBatch, column: str = "raw") -> list[bytes]:
    return [x or b"" for x in batch.column(column).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of text, so that what they encode to takes bounded memory."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk of each document once: digest and length."""
    for batch in batches:
        found = []
        for raw in _texts(batch):
            chunks = {raw[a:b] for a, b in pairwise(mask_limits(raw, CHUNK)) if 64 <= b - a <= LONGEST_SHARED}
            found += [(xxhash.xxh3_64_intdigest(c), len(c)) for c in chunks]
        digest, n = (np.array([f[k] for f in found], np.uint64).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(n)], names=["digest", "n"])


def shared_chunks(texts: DataFrame, path: str, size: int = DICTIONARY) -> dict[bytes, Shared]:
    """The chunks that save most by being encoded once, of those in several documents."""
    spark = texts.sparkSession
    counts = texts.mapInArrow(_digests, "digest long, n long").groupBy("digest").agg(F.count("*").alias("docs"), F.max("n").alias("n")).where("docs > 1")
    best = [r.digest for r in counts.orderBy(F.desc((F.col("docs") - 1) * F.col("n")), "digest").limit(size).select("digest").collect()]
    if not best:
        return {}
    wanted = spark.sparkContext.broadcast(frozenset(best))

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted.value)
        for batch in batches:
            found = {}
            for raw in _texts(batch):
                for a, b in pairwise(mask_limits(raw, CHUNK)):
                    if 64 <= b - a <= LONGEST_SHARED:
                        digest = int(np.uint64(xxhash.xxh3_64_intdigest(raw[a:b])).astype(np.int64))
                        if digest in left:
                            left.discard(digest)
                            found[digest] = raw[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["digest", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            rows = []
            for chunk in batch.column("chunk").to_pylist():
                span = inner(chunk)
                if span is not None:
                    rows.append((chunk, *span))
            rows = [(key_of(c), i, j, ids) for (c, i, j), (ids, _) in zip(rows, encoder.whole([c[i:j] for c, i, j in rows]))]
            if rows:
                types = [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["key", "head", "tail", "ids"])

    held = texts.mapInArrow(holders, "digest long, chunk binary").groupBy("digest").agg(F.min("chunk").alias("chunk"))
    rows = held.select("chunk").mapInArrow(encoded, "key binary, head int, tail int, ids binary").collect()
    return {bytes(r.key): Shared(r.head, r.tail, bytes(r.ids)) for r in rows}


RESULTS = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (32-bit little-endian numbers) and ``decoded`` text.

    With ``digests``, ``text`` goes and the results are n_tokens, ids_sha256 and decoded_sha256.
    """
    path = path or default_tokenizer()
    added = RESULTS
    if digests:
        added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    docs = without(docs, *[f.name for f in added])
    raw = F.col("text").cast("binary")
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs.select(raw.alias("raw")), path))
    own = fresh(docs, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in _slices(batches, own):
            found = encode(_texts(batch, own), encoder, shared.value)
            if digests:
                new = [
                    pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in found], pa.string()),
                ]
            else:
                new = [pa.array([i for i, _ in found], pa.binary()), pa.array([d.decode() for _, d in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *[f.name for f in added]])

    kept = [f for f in docs.schema.fields if not (digests and f.name == "text")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], raw.alias(own))
    return rows.mapInArrow(run, T.StructType([*kept, *added]))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(…, ids)`` with ``decoded``, straight from the ids."""
    path = path or default_tokenizer()
    encoded = without(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder_of(path).tokenizer
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column("ids").to_pylist()]
            texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
