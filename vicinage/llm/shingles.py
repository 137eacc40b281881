"""Word shingles of whole texts as 64-bit hashes, computed on arrays of bytes.

Words are runs of anything but ASCII white space, with A-Z lower-cased.  All
white space is ASCII, so UTF-8 bytes can be cut without decoding.  The hash of a
word is a polynomial over random 64-bit letters; prefix sums give every word of a
text at once.  Hashes of neighbouring words combine to the hash of a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(0x5EED)
_LETTERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = [np.uint64(x) for x in _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)]
#: Bytes that are hashed at once, so that the arrays stay small.
CHUNK = 1 << 18
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_words(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """One hash a word, in text order.  A long text is hashed in chunks that end
    at white space, so memory does not follow the length of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if len(data) <= CHUNK:
        return _hash_words(data)
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        parts.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of the whole sequence if it is
    shorter; none without words.  In text order, repeats included."""
    n = len(words)
    if not n:
        return words
    width_here = min(width, n)
    out = np.full(n - width_here + 1, width_here, np.uint64)
    for k in range(width_here):
        out = mixed(out * _MIX[0] + words[k : n - width_here + 1 + k])
    return out


def texts(rows) -> Iterator[tuple]:
    """(id, text) of a record batch with these two columns; null text is empty."""
    for i, t in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        yield i, t.as_py() or ""


def batched(rows: Iterator[tuple], weight, most: int) -> Iterator[list[tuple]]:
    """Rows in lists whose weights add up to about ``most``."""
    some, total = [], 0
    for row in rows:
        some.append(row)
        total += weight(row)
        if total >= most:
            yield some
            some, total = [], 0
    if some:
        yield some
