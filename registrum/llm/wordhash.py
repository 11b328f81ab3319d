"""Word and shingle hashes over whole Arrow batches of text, in numpy. Words are runs of bytes other than ASCII white
space, ASCII letters folded to lower case."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from registrum.llm._shared import text_buffers

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_PIECE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    size = max(_PIECE, 1 << (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each row, and the 64-bit hashes of all words in order."""
    data, bounds = text_buffers(column)
    n = len(data)
    if not n:
        return np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    opens, closes = edge[:n].copy(), edge[1:].copy()
    opens[1:] |= space[:-1]
    closes[:-1] |= space[1:]
    opens[0] = closes[-1] = True
    start, end = np.flatnonzero(opens & ~space), np.flatnonzero(closes & ~space) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((_FOLD[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        out[i:j] = mix((sums[end[i:j] - lo] - sums[start[i:j] - lo]) * down[start[i:j] - lo])
        i = j
    return np.diff(np.searchsorted(start, bounds)), out


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 48-bit hash of every shingle of `size` words; a text of fewer words, but not none, is one shingle."""
    count, words = word_hashes(column)
    rows = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    left = count[rows] - place
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        factor = np.uint64(pow(_STEP, k, 1 << 64))
        total += np.where(left > k, padded[k : k + len(words)] * factor, np.uint64(0))
    valid = (left >= size) | (place == 0)
    return rows[valid], mix(total[valid]) >> np.uint64(16)


def shingle_sets(column: pa.Array, size: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of at most `rows` rows: first row, start of each row's shingles (with the end), sorted distinct hashes, counts."""
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        owner, hashes = shingle_hashes(part, size)
        keys = np.sort((owner.astype(np.uint64) << np.uint64(48)) | hashes)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        bounds = np.searchsorted(keys >> np.uint64(48), np.arange(len(part) + 1, dtype=np.uint64))
        yield at, bounds, keys & np.uint64((1 << 48) - 1), counts
