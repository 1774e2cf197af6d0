"""Ring elements: a level k of 0 to 3, then k + 1 bytes of a coefficient, the low byte first."""

from __future__ import annotations

from .base import Rejected


def canonicalize(raw: bytes) -> bytes:
    if not raw or raw[0] > 3 or len(raw) != raw[0] + 2:
        raise Rejected("invalid_ring_element")
    return raw


def from_components(k: int, coefficient: int) -> bytes:
    if not 0 <= k <= 3:
        raise Rejected("invalid_ring_element")
    return bytes([k]) + (coefficient & ((1 << 8 * (k + 1)) - 1)).to_bytes(k + 1, "little")
