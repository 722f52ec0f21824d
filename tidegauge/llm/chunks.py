"""Content-defined chunk limits by a gear rolling hash."""

from __future__ import annotations

import numpy as np

#: A random 32-bit number for each byte. A byte leaves the hash after 32 shifts.
GEAR = np.random.default_rng(20_231_105).integers(0, 2**32, 256).astype(np.uint32)


def gear_hash(raw: bytes) -> np.ndarray:
    """At each byte, the sum of the gear numbers of the last 32 bytes, the k-th last shifted by k."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
    return h


def _char_starts(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The places where a UTF-8 character begins."""
    view = np.frombuffer(raw, np.uint8)
    return at[(view[at] & 0xC0) != 0x80]


def mask_limits(raw: bytes, mean: int) -> list[int]:
    """Chunk limits, from 0 to the length, after bytes where the hash is a multiple of ``mean``."""
    if not raw:
        return [0]
    at = np.flatnonzero(gear_hash(raw)[:-1] & np.uint32(mean - 1) == 0) + 1
    return [0, *_char_starts(raw, at).tolist(), len(raw)]


def least_limits(raw: bytes, reach: int) -> list[int]:
    """Chunk limits where the hash is the only least within ``reach`` bytes on either side.

    Limits are over ``reach`` apart, and as a rule not far more, so that a passage of a few
    times ``reach`` holds whole chunks wherever it stands.
    """
    if len(raw) < 2 * reach:
        return [0, len(raw)] if raw else [0]
    h = gear_hash(raw).astype(np.uint64) << np.uint64(8)
    low, span = h, 1
    while span < reach:  # least of the next ``reach`` bytes, this one included
        step = min(span, reach - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    n = len(h)
    after = low[1 : n - reach + 1]  # of bytes i + 1 .. i + reach, for i from 0
    before = low[: n - reach]  # of bytes i - reach .. i - 1, for i from reach
    i = np.arange(reach, n - reach)
    at = i[(h[i] < after[i]) & (h[i] < before[i - reach])] + 1
    return [0, *_char_starts(raw, at[at < n]).tolist(), n]
