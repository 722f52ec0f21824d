"""Secrets in texts, also where they are URL-encoded, escaped, base64-encoded or compressed.

Every text is a worklist of layers. The text itself comes first; a layer in which percent escapes,
Unicode escapes or character references stand gives a layer with these resolved, and each base64
run gives the layer it decodes to, decompressed if it is gzip, zlib, bz2, xz or zstd. Each new
layer is scanned and unwrapped in turn until none is new: a layer that was seen with the same
origin (a cycle, as in data that decompress to themselves) is not taken up again. All members of
compressed data count, and data compressed again are unwrapped layer by layer, however many. Every layer
carries, for each character, the span of the original text it comes from, so what is found in it
is reported as a span of the original.

Spark deals out the rows; a task holds one text and its layers. Decompressed data are scanned in
windows of WINDOW bytes that overlap by OVERLAP, and a base64 run over their limits goes through a
temporary file, so a layer of any size takes bounded memory; a secret in them is reported as the
span of the whole encoded run. Not unwrapped: deflate data without a header, and UTF-16.

Defined cases: null is as empty and has no spans; a span found in several ways counts once;
repeated rows are scanned each; other columns of the input pass through, unless they are named as
a result is.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import lzma
import re
import tempfile
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import IO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm._shared import without

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds and the least length of what counts.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so those under 24 need not be matched
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Where the name of an assigned secret ends, so that one fast search finds all places to try.
_ASSIGN_HINT = re.compile(r"""(?:[dD]|[tT]|[nN]|[yY])["']?\x20*[:=]""")
_PERCENT = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(
    r"\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
#: Each line but the last has 60 letters at least, and the last may have any number.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:(?<=[A-Za-z0-9+/_-]{60})\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_BASE64_BYTES = re.compile(_BASE64.pattern.encode())
#: What of a base64 run may follow its first part.
_MORE_BYTES = re.compile(rb"[A-Za-z0-9+/_-]*(?:(?<=[A-Za-z0-9+/_-]{60})\r?\n[A-Za-z0-9+/_-]+)*(?:(?<=[A-Za-z0-9+/_-]{60})\r?\n?\Z)?")
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: How gzip, bz2, xz, zstd and zlib data begin in base64.
_PACKED = re.compile(rb"H4[s-v]|Qlpo|/Td6WFoA|KLUv/|e[A-P]")
_PACKED_AFTER = re.compile(rb"(?<=[+/])(?=" + _PACKED.pattern + rb")")
_STRETCH = re.compile(rb"[\t\r\n -~]{12,}")  # shorter than any secret
_ZSTD = type(zstandard.ZstdDecompressor().decompressobj())
WINDOW, OVERLAP, FEED, ZSTD_FEED, HELD = 1 << 20, 1 << 12, 1 << 16, 1 << 9, 1 << 24

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, less those that are too short."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text, and for each character the span of the original (None: the original itself).

    A layer out of a base64 run has one span for all of it: ``whole``.
    """

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None, whole: tuple[int, int] | None = None):
        self.text, self.low, self.high, self.whole = text, low, high, whole

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.low is None:
            return start, end
        return int(self.low[start:end].min()), int(self.high[start:end].max())

    def key(self) -> tuple:
        ends = self.whole if self.whole is not None else None if self.low is None else hashlib.sha1(self.low.tobytes() + self.high.tobytes()).digest()
        return hashlib.sha1(self.text.encode("utf-8", "surrogatepass")).digest(), ends


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer:
    """The layer with pieces (start, end, text, the part of the layer behind each character) put in."""
    n = len(layer.text)
    parts, low, high, last = [], [], [], 0
    own_low = layer.low if layer.low is not None else np.arange(n)
    own_high = layer.high if layer.high is not None else np.arange(1, n + 1)
    for start, end, text, behind in pieces:
        parts += [layer.text[last:start], text]
        if layer.whole is None:
            low += [own_low[last:start], np.array([own_low[a:b].min() for a, b in behind], np.int64)]
            high += [own_high[last:start], np.array([own_high[a:b].max() for a, b in behind], np.int64)]
        last = end
    parts.append(layer.text[last:])
    if layer.whole is not None:
        return Layer("".join(parts), whole=layer.whole)
    return Layer("".join(parts), np.concatenate([*low, own_low[last:]]), np.concatenate([*high, own_high[last:]]))


def _url(layer: Layer) -> Layer | None:
    """Percent escapes resolved; ``%25`` before an escape is unwrapped down to it at once."""
    runs: list[list[re.Match]] = []
    for m in _PERCENT.finditer(layer.text):
        if runs and runs[-1][-1].end() == m.start():
            runs[-1].append(m)
        else:
            runs.append([m])
    pieces = []
    for run in runs:
        raw = bytes(int(m.group()[-2:], 16) for m in run)
        text, behind, i = [], [], 0
        while i < len(raw):  # character by character, so that each keeps its own escapes
            width = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
            try:
                text.append(raw[i : i + width].decode())
            except UnicodeDecodeError:
                width = 1
                text.append(chr(raw[i]))
            behind.append((run[i].start(), run[min(i + width, len(raw)) - 1].end()))
            i += width
        pieces.append((run[0].start(), run[-1].end(), "".join(text), behind))
    return _replaced(layer, pieces) if pieces else None


def _unicode(layer: Layer) -> Layer | None:
    """Backslash escapes and numeric character references resolved; surrogate pairs are joined."""
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        x, at = m.group(), m.start()
        if x.startswith("\\u") and x[2] != "{":
            units = [int(x[k + 2 : k + 6], 16) for k in range(0, len(x), 6)]
            text, behind, k = [], [], 0
            while k < len(units):
                pair = 0xD800 <= units[k] < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1] < 0xE000
                text.append(chr(0x10000 + (units[k] - 0xD800 << 10) + units[k + 1] - 0xDC00) if pair else chr(units[k]))
                behind.append((at + 6 * k, at + 6 * (k + 1 + pair)))
                k += 1 + pair
            pieces.append((at, m.end(), "".join(text), behind))
            continue
        code = int(x[2:-1]) if x[:2] == "&#" and x[2] not in "xX" else int(re.sub(r"[^0-9A-Fa-f]", "", x[2:].lstrip("xX")), 16)
        if code <= 0x10FFFF:
            pieces.append((at, m.end(), chr(code), [(at, m.end())]))
    return _replaced(layer, pieces) if pieces else None


def _codec(head: bytes):
    """A decompressor for what begins so; None if it is not compressed."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd" or (head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What all members of a compressed stream hold, one after the other, each of any kind."""
    codec, rest = None, b""
    blocks = (piece[k : k + FEED] for piece in pieces for k in range(0, len(piece), FEED))
    for block in chain(blocks, [b""]):
        rest += block
        while True:
            if codec is None:
                rest = rest.lstrip(b"\0")
                if len(rest) < 6 and block:
                    break  # too short to tell
                codec = _codec(rest)
                if codec is None:
                    return
            if isinstance(codec, _ZSTD):  # knows no limit, so it gets little at a time
                out, rest = codec.decompress(rest[:ZSTD_FEED]), rest[ZSTD_FEED:]
            else:
                out = codec.decompress(rest, WINDOW)
                rest = getattr(codec, "unconsumed_tail", b"")
            if out:
                yield out
            if codec.eof:
                codec, rest = None, codec.unused_data + rest
            elif not rest and not out:
                break


def _inflated(raw: bytes, more: Iterator[bytes] = iter(())) -> Iterator[bytes] | None:
    """What a compressed stream, ``raw`` and what follows, holds, in pieces; None if it is not compressed."""
    return _full(_members(chain([raw], more))) if _codec(raw) is not None else None


def _opened(pieces: Iterator[bytes]) -> Iterator[bytes] | None:
    head, second = next(pieces, b""), next(pieces, None)
    return _inflated(head) if second is None else _inflated(head, chain([second], pieces))


def _full(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces joined to WINDOW bytes at least, but for the last; data that end in an error end there."""
    held, size = [], 0
    try:
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size >= WINDOW:
                yield b"".join(held)
                held, size = [], 0
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        pass
    if size:
        yield b"".join(held)


def _open_run(window: bytes) -> int:
    """Where a base64 run begins that may go on after the window; else the window's length."""
    near = len(window.rstrip(_LETTERS + b"\r\n"))
    last = len(window.rstrip(b"\r\n"))
    for m in _BASE64_BYTES.finditer(window, near):
        if m.end() >= last:
            return m.start()
    return len(window)


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """Texts of a stream by windows; a base64 run that goes over their limits is unwrapped as a whole."""
    tail, run, line = b"", None, b""
    for piece in pieces:
        if run is not None:
            more = _MORE_BYTES.match(line + piece).end() - len(line)
            run.write(piece[:more].translate(None, b"\r\n"))
            line = (line + piece[:more])[-62:]
            if more < len(piece):
                yield from _decoded(run)
                run = None
        window = tail + piece
        text = _stretches(window)
        if text is not None:
            yield text
        if run is None and len(window) >= WINDOW and len(window) - (at := _open_run(window)) > OVERLAP:
            run = tempfile.SpooledTemporaryFile(max_size=4 * WINDOW)
            run.write(window[at:].translate(None, b"\r\n"))
            line = window[-62:]
        tail = window[-OVERLAP:]
    if run is not None:
        yield from _decoded(run)


def _stretches(raw: bytes) -> str | None:
    """The stretches of ASCII text that could hold a secret or a layer, apart by NUL; None if there are none."""
    found = _STRETCH.findall(raw)
    return b"\0".join(found).decode() if found else None


def _unlettered(letters: IO[bytes], at: int) -> Iterator[bytes]:
    """The bytes that base64 letters stand for, from one of them on."""
    while True:
        letters.seek(at)
        block = letters.read(WINDOW).translate(_STANDARD)
        at += len(block)
        if len(block) < WINDOW:
            block = block[: len(block) - (len(block) % 4 == 1)]
            if block:
                yield base64.b64decode(block + b"=" * (-len(block) % 4))
            return
        yield base64.b64decode(block)


def _packed_starts(letters: IO[bytes]) -> Iterator[int]:
    """The letters at which compressed data may begin: the first four, and any behind one of ``/``, ``-``, ``_`` and ``+``."""
    at, last, before = 0, -1, b""
    while True:
        letters.seek(at)
        block = letters.read(WINDOW).translate(_STANDARD)
        if not block:
            return
        low = at - len(before)
        for m in _PACKED_AFTER.finditer(before + block):
            if low + m.start() > max(last, 3):
                last = low + m.start()
                yield last
        if not at:
            yield from (k for k in range(4) if _PACKED.match(block, k))
        at += len(block)
        before = block[-16:]


def _decoded(letters: IO[bytes]) -> Iterator[str]:
    """Texts that a base64 run decodes to, wherever in it the encoded data begin."""
    for skip in range(4):
        yield from _texts(_unlettered(letters, skip))
    for start in _packed_starts(letters):
        yield from _unpacked(lambda start=start: _unlettered(letters, start))


def _unpacked(source: Callable[[], Iterator[bytes]]) -> Iterator[str]:
    """Texts in what a stream holds if it is compressed, and in what that holds, until a layer is not compressed or was there before.

    A layer that is compressed itself is kept to inflate it from, up to HELD bytes; beyond that it is inflated anew from the one before.
    """
    seen = set()
    while (opened := _opened(source())) is not None:
        digest = hashlib.sha1()
        for piece in source():
            digest.update(piece)
        if digest.digest() in seen:
            return
        seen.add(digest.digest())
        first = next(opened, b"")
        layer = _Kept(chain([first], opened)) if _codec(first) is not None else None
        yield from _texts(layer or chain([first], opened))
        if layer is None:
            return
        source = layer.again if layer.size <= HELD else lambda before=source: _opened(before())


class _Kept:
    """An iterator that keeps what went through, if that is no more than HELD bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.size = pieces, [], 0

    def __iter__(self) -> Iterator[bytes]:
        for piece in self.pieces:
            self.size += len(piece)
            self.held = [*self.held, piece] if self.size <= HELD else []
            yield piece

    def again(self) -> Iterator[bytes]:
        return iter(self.held)


def _children(layer: Layer) -> Iterator[Layer]:
    """The layers that a layer holds, one at a time."""
    if "%" in layer.text and (child := _url(layer)) is not None:
        yield child
    if ("\\" in layer.text or "&#" in layer.text) and (child := _unicode(layer)) is not None:
        yield child
    for m in _BASE64.finditer(layer.text):
        origin = layer.origin(m.start(), m.end())
        for text in _decoded(io.BytesIO(m.group().encode().translate(None, b"\r\n="))):
            yield Layer(text, whole=origin)


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """The base spans and what deeper layers add, by start, then kind, then end.

    The worklist holds, for each layer on the way down, what it has yet to give; so only the layers on that way are in memory.
    """
    found = set(base)
    first = Layer(text)
    seen = {first.key()} if "%" in text or "\\" in text or "&#" in text or _BASE64.search(text) else set()
    work = [_children(first)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            for start, kind, end in base_spans(layer.text):
                low, high = layer.origin(start, end)
                found.add((low, kind, high))
            work.append(_children(layer))
    return sorted(found)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


RESULTS = [
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()),
]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` less ``text``, with counts by kind and ``kind:start:end`` lists of base and of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*counts, _written(base), _written(all_spans(text, base))))
            cols = list(zip(*rows)) if rows else [()] * 5
            added = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2)]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *added], names=[*[batch.schema.names[i] for i in keep], *[f.name for f in RESULTS]])

    docs = without(docs, *[f.name for f in RESULTS])
    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*kept, *RESULTS]))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document, with the base spans as a digest."""
    found = scan_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
