"""Hashed word shingles of a batch of texts, without a Python loop over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
HASH_BITS = 53
PIECE, KEPT_POWERS = 1 << 20, 1 << 21
_SPACE = re.compile(rb"[\t-\r ]")
_POWERS: dict[int, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2 to the 64; tables of up to ``KEPT_POWERS`` are kept."""
    if base in _POWERS and len(_POWERS[base]) >= n:
        return _POWERS[base][:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    out = np.cumprod(out)
    if n <= KEPT_POWERS:
        _POWERS[base] = out
    return out[:n]


def groups(raws: list[bytes], size: int = PIECE, most: int = 1 << (63 - HASH_BITS)) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` texts, and ``size`` bytes unless one text is longer."""
    start, held = 0, 0
    for k, raw in enumerate(raws):
        if k > start and (held + len(raw) > size or k - start >= most):
            yield start, k
            start, held = k, 0
        held += len(raw)
    if start < len(raws):
        yield start, len(raws)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text cut at white space about every ``size`` bytes."""
    at = 0
    while len(raw) - at > size:
        cut = _SPACE.search(raw, at + size)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words in each text); words end at ASCII white space.

    Worked out over about a megabyte at a time: the numbers beside a byte take many times its room.
    """
    owned = [(k, piece) for k, raw in enumerate(raws) for piece in pieces(raw)]
    counts, words = np.zeros(len(raws), np.int64), [np.zeros(0, np.uint64)]
    for a, b in groups([piece for _, piece in owned]):
        found, per_piece = _word_hashes([piece for _, piece in owned[a:b]])
        words.append(found)
        np.add.at(counts, [k for k, _ in owned[a:b]], per_piece)
    return np.concatenate(words), counts


def _word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    lengths = np.array([len(r) + 1 for r in raws], np.int64)
    bounds = np.cumsum(lengths)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, bounds)]))
    rng = np.random.default_rng(7)
    codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes[joined] * powers(_BASE, len(joined)))])
    words = (sums[end] - sums[start]) * powers(_INVERSE, len(joined) + 1)[start]
    return mix(words + (end - start).astype(np.uint64)), counts


def shingle_hashes(raws: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingles in each text), in the order of the texts.

    A text of fewer words than ``size`` has its words together as its one shingle; a text
    without words has none.
    """
    words, counts = word_hashes(raws)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    factor = powers(0xD6E8FEB86659FD93, size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole += padded[k:k + n] * factor[k]
    owner = np.repeat(np.arange(len(raws)), counts)
    full = np.arange(n) + size <= starts[owner + 1]
    first = np.arange(n) == starts[owner]
    short = first & (counts[owner] < size)
    for i in np.flatnonzero(short):  # fewer than ``size`` words: only what belongs to the text
        part = words[i:starts[owner[i] + 1]]
        whole[i] = (part * factor[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    keep = full | short
    per_text = np.bincount(owner[keep], minlength=len(raws))
    return mix(whole[keep]) >> np.uint64(64 - HASH_BITS), per_text


def sorted_by_text(hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash): (text number, hash, times), sorted by text and hash.

    Both fit one 64-bit number, for at most 2,048 texts at a time.
    """
    if len(per_text) > 1 << (64 - HASH_BITS):
        raise ValueError("too many texts at a time")
    owner = np.repeat(np.arange(len(per_text), dtype=np.uint64), per_text)
    keys = np.sort((owner << np.uint64(HASH_BITS)) | hashes)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    keys = keys[at]
    return (
        (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1),
        np.diff(np.concatenate([at, [len(hashes)]])),
    )
