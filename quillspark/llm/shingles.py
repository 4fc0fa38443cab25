"""Hashes of a text's word shingles, vectorised over its bytes."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Weights of the bytes of a word by place, of the words of a shingle by place.
_BYTE = np.random.default_rng(2024).integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)
_WORD = np.random.default_rng(2025).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, block: int = 1 << 22, table: bytes = _FOLD) -> np.ndarray:
    """One 64-bit hash for each word, A-Z as a-z; long texts in blocks that end at blanks. table: what
    each byte counts as."""
    data, out, start = text.encode().translate(table), [], 0
    while start < len(data):
        end = len(data) if start + block >= len(data) else data.find(b" ", start + block)
        end = len(data) if end < 0 else end
        a = np.frombuffer(data, np.uint8, end - start, start)
        blank = a == 32
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if len(starts):
            ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
            base = np.zeros(len(a), np.int64)
            base[starts] = np.diff(starts, prepend=0)
            place = np.arange(len(a)) - np.cumsum(base)
            far = place >> 12
            weight = _BYTE[place & 4095] if not far.any() else mixed(_BYTE[place & 4095] + far.astype(np.uint64)) | np.uint64(1)
            value = (a.astype(np.uint64) + np.uint64(1)) * weight
            value[blank] = 0
            out.append(mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes; of fewer words than WORDS, one for the whole sequence."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < WORDS:
        return mixed((w * _WORD[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))
    m = len(w) - WORDS + 1
    total = w[:m] * _WORD[0]
    for k in range(1, WORDS):
        total += w[k : k + m] * _WORD[k]
    return np.unique(mixed(total))


def digest(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
