"""Hashed byte n-gram counts of whole texts, vectorised; what both classifiers start from."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, one for each n-gram length.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: The most that 16 bits hold.
MOST = 65535


def ngram_counts(data: bytes, sizes: tuple[int, ...], bits: int, block: int = 1 << 20) -> np.ndarray:
    """Counts of all n-grams in 2^bits buckets, long texts in blocks that overlap. A count stops at
    MOST, in learning and in use alike: higher ones say no more to a logarithm or root."""
    out = np.zeros(1 << bits, np.float32)
    for start in range(0, max(1, len(data)), block):
        a = np.frombuffer(data[start : start + block + max(sizes) - 1], np.uint8).astype(np.uint32)
        left = min(block, len(data) - start)
        for n in sizes:
            m = min(left, len(a) - n + 1)
            if m <= 0:
                continue
            code = a[:m].copy()
            for k in range(1, n):
                code = (code << np.uint32(8)) ^ a[k : k + m] if k < 4 else code * np.uint32(31) + a[k : k + m]
            code *= np.uint32(MULTIPLIERS[(n - 1) % 4])
            code ^= code >> np.uint32(15)
            code *= np.uint32(MULTIPLIERS[n % 4])
            out += np.bincount(code >> np.uint32(32 - bits), minlength=1 << bits)
    return np.minimum(out, MOST)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def pack(counts: np.ndarray) -> bytes:
    """Counts on their way to the driver."""
    return counts.astype(np.uint16).tobytes()


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), width).astype(np.float32)
