"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

A rank file lists byte strings and their ranks. Each becomes a piece of a sentencepiece BPE model
whose characters stand for bytes (byte b is the character 256 + b), scored by its negative rank,
with identity normalisation and nothing added or removed around it. Such a model merges as the
ranks ask: the adjacent pair whose joined piece has the least rank first, the leftmost of equals.
The driver writes the model once and broadcasts it: its size is that of the vocabulary.

Texts are split into pre-tokens by a pattern; a pre-token that is itself a piece is its own token,
as the pieces need not all be reachable by merges. Each distinct pre-token of a slice of documents is
encoded once, and those of up to LONGEST_KEPT characters stay known to the worker, until there are
WORDS_KEPT of them. Decoding maps ids back to byte strings and joins them. Nothing is shuffled.

Texts beyond WINDOW characters are split a window at a time. A window ends between a character
that is not white space and one that is: no alternative of the pattern matches across, and none
looks back, so the pre-tokens are those of the whole text.

Defined cases: null is as empty: no tokens and empty text; repeated rows are encoded each; texts
of any length are encoded whole; bytes that are not UTF-8 count as U+FFFD; other columns pass
through, unless named as a result is; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import fresh, without
from tidegauge.llm.bpe import _slices

WORDS_KEPT = 200_000
LONGEST_KEPT = 64
WINDOW = 1 << 20
#: Character 256 + b for byte b: letters all, none of them white space or special to sentencepiece.
BYTE_CHARS = "".join(chr(256 + b) for b in range(256))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in the order of their ranks, which must be 0, 1, 2 …"""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(raw) for raw, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    if sorted(ranks) != list(range(len(ranks))) or len(ranks) >= 1 << 24:
        raise ValueError("ranks must be 0, 1, 2 … and fewer than 2^24, which scores hold exactly")
    pieces = [ranks[i] for i in range(len(ranks))]
    if len(set(pieces)) != len(pieces) or not {bytes([b]) for b in range(256)} <= set(pieces):
        raise ValueError("byte strings must be distinct and cover all single bytes")
    return pieces


def byte_text(raw: bytes) -> str:
    return codecs.charmap_decode(raw, "strict", BYTE_CHARS)[0]


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a protocol buffer message: a whole number, or bytes with their length."""
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


#: Field numbers and values of sentencepiece's published model format (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE_TAG, PIECE_TYPE = 1, b"\x15", 3  # the score is field 2, a 32-bit float
NORMAL_PIECE, UNKNOWN_PIECE = 1, 2
MODEL_TYPE, BPE_MODEL, VOCABULARY_SIZE, UNKNOWN_ID, BEGIN_ID, END_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
NO_ID = (1 << 64) - 1  # -1


def model_of(pieces: list[bytes]) -> bytes:
    """The serialised model: ids are ranks, and one more id stands for unknown characters, of which there are none."""
    out = []
    for rank, raw in enumerate(pieces):
        piece = _field(PIECE_TEXT, byte_text(raw).encode()) + PIECE_SCORE_TAG + struct.pack("<f", -float(rank)) + _field(PIECE_TYPE, NORMAL_PIECE)
        out.append(_field(PIECES, piece))
    out.append(_field(PIECES, _field(PIECE_TEXT, b"<unk>") + PIECE_SCORE_TAG + struct.pack("<f", 0.0) + _field(PIECE_TYPE, UNKNOWN_PIECE)))
    trainer = [(MODEL_TYPE, BPE_MODEL), (VOCABULARY_SIZE, len(pieces) + 1), (UNKNOWN_ID, len(pieces)), (BEGIN_ID, NO_ID), (END_ID, NO_ID), (PAD_ID, NO_ID)]
    out.append(_field(TRAINER, b"".join(_field(k, v) for k, v in trainer)))
    plain = [(NAME, b"identity"), (DUMMY_PREFIX, 0), (REMOVE_SPACES, 0), (ESCAPE_SPACES, 0)]
    out.append(_field(NORMALIZER, b"".join(_field(k, v) for k, v in plain)))
    return b"".join(out)


class Codec:
    """Encodes pre-tokens by the model, and keeps what short ones gave."""

    def __init__(self, pieces: list[bytes], model: bytes, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces, self.ranks = pieces, {raw: i for i, raw in enumerate(pieces)}
        self.digits = [b"%d" % i for i in range(len(pieces))]
        self.model = SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.edge = regex.compile(r"(?<=\S)\s")
        self.known: dict[str, tuple[int, ...]] = {}

    def windows(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > WINDOW:
            edge = self.edge.search(text, start + WINDOW)
            if edge is None:
                break
            yield text[start : edge.start()]
            start = edge.start()
        yield text[start:] if start else text

    def learn(self, words: list[str]) -> None:
        merged = []
        for word in words:
            rank = self.ranks.get(word.encode())
            if rank is None:
                merged.append(word)
            else:
                self.known[word] = (rank,)
        for word, ids in zip(merged, self.model.encode([byte_text(w.encode()) for w in merged], out_type=int, num_threads=1)):
            self.known[word] = tuple(ids)

    def _windows(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(text) for text in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = [w for w in set(chain.from_iterable(split)) if w not in self.known]
        if new:
            self.learn(new)
        ids = [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in split]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del self.known[word]
        return ids

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; texts within a window all at once, the others a window at a time."""
        short = iter(self._windows([t for t in texts if len(t) <= WINDOW]))
        return [next(short) if len(t) <= WINDOW else [i for w in self.windows(t) for i in self._windows([w])[0]] for t in texts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def written(self, ids: list[int]) -> bytes:
        return b",".join(map(self.digits.__getitem__, ids))


@lru_cache(1)
def _codec(key: str, shared) -> Codec:
    return Codec(*shared.value)


def _shared(docs: DataFrame, path: str | None, pattern: str | None):
    pieces = read_ranks(path or default_ranks())
    model = model_of(pieces)
    pattern = pattern or default_pattern()
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((pieces, model, pattern))
    return lambda: _codec(key, shared)


IDS = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with the ``ids`` of each text's tokens.

    With ``digests``, ``text`` goes and the results are n_tokens, ids_sha256 (of decimal ids joined by
    commas) and decoded_sha256 (of the bytes that the ids decode to).
    """
    added = DIGESTS if digests else IDS
    docs = without(docs, *[f.name for f in added])
    codec_of, own = _shared(docs, path, pattern), fresh(docs, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in _slices(batches, own):
            found = codec.ids([(raw or b"").decode("utf-8", "replace") for raw in batch.column(own).to_pylist()])
            if digests:
                new = [
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(codec.written(ids)).hexdigest() for ids in found], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(ids)).hexdigest() for ids in found], pa.string()),
                ]
            else:
                new = [pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *[f.name for f in added]])

    kept = [f for f in docs.schema.fields if not (digests and f.name == "text")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("text").cast("binary").alias(own))
    return rows.mapInArrow(run, T.StructType([*kept, *added]))


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded(…, ids)`` with ``decoded``, the bytes that the ids stand for; null ids give null."""
    encoded = without(encoded, "decoded")
    codec_of = _shared(encoded, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            raws = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raws, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
