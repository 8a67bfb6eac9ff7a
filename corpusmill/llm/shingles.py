"""Word shingles of whole texts as 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

import numpy as np

#: Bytes that one vectorised step takes at most; longer texts go through it in pieces cut at white space.
STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), np.uint64(base))
        out[0] = 1
        have = _powers[str(base)] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and last two bytes of each word of some lower-cased bytes."""
    b = np.frombuffer(data, dtype=np.uint8)
    word = ~_space[b]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64), start, np.empty(0, dtype=np.int32)
    # each pair of a byte and its place in the word has a scrambled value of its own, and a word the sum of
    # these: unlike a polynomial modulo 2**64 this has no strings that are alike whatever the base
    length = stop - start
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    value = mixed((place.astype(np.uint64) << np.uint64(8) | b[word]) * np.uint64(_BASE) + np.uint64(1))
    total = np.add.reduceat(value, np.cumsum(length) - length)
    tail = b[np.maximum(stop - 2, start)].astype(np.int32) * 256 + b[stop - 1]
    return mixed(total + length.astype(np.uint64)), start, tail


def _pieces(body: bytes) -> list[bytes]:
    out, at = [], 0
    while len(body) - at > STEP:
        cut = at + STEP
        while cut > at and not _space[body[cut]]:
            cut -= 1
        if cut == at:  # one word of over STEP bytes: taken whole
            cut = at + STEP
            while cut < len(body) and not _space[body[cut]]:
                cut += 1
        out.append(body[at:cut])
        at = cut
    out.append(body[at:])
    return out


def word_parts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and last two bytes of the words of all texts, lower-cased from A to Z, in order, and the number of words of each text."""
    hashes: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    sizes: list[int] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            found, start, tail = _word_hashes(b" ".join(group))
            ends = np.searchsorted(start, np.cumsum([len(g) + 1 for g in group]))
            sizes.extend(np.diff(ends, prepend=0).tolist())
            hashes.append(found)
            tails.append(tail)
            group.clear()
            held = 0

    for text in texts:
        body = (text or "").encode("utf-8", "replace").lower()
        if held + len(body) > STEP:
            flush()
        if len(body) > STEP:
            parts = [_word_hashes(p) for p in _pieces(body)]
            hashes.extend(p[0] for p in parts)
            tails.extend(p[2] for p in parts)
            sizes.append(sum(len(p[0]) for p in parts))
            continue
        group.append(body)
        held += len(body) + 1
    flush()
    none = np.empty(0, dtype=np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([none.astype(np.int32), *tails]), np.array(sizes, dtype=np.int64)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text, lower-cased from A to Z, in order."""
    hashes, _, sizes = word_parts(texts)
    return np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of fewer words, one hash of the whole sequence."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    k = min(n, width)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total = total * np.uint64(_BASE) + words[i : n - k + 1 + i]
    return np.unique(mixed(total))
