"""Word shingles of whole texts as sorted arrays of 64-bit hashes (numpy, inside tasks).

Words are maximal runs without blank, tab, newline, \\v, \\f, \\r after lower-casing A-Z.  A
text's set holds its distinct 5-word shingles; with fewer words the whole sequence is one
element; without words the set is empty.  Shingles are compared by a 64-bit hash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes hashed at once; longer texts are cut at white space.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (multiply, xor-shift) over uint64."""
    x = (x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) & _MASK)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_values() -> np.ndarray:
    folded = np.arange(256)
    folded[65:91] += 32
    return mix(folded.astype(np.uint64), 7) | np.uint64(1)


@functools.cache
def _is_space() -> np.ndarray:
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return space


_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a byte buffer."""
    space = _is_space()[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge if space[:1].all() else np.concatenate([[0], edge])
    if not len(data) or (len(starts) and space[starts[0]]):
        starts = starts[1:]
    bounds = starts
    starts = bounds[0::2]
    ends = bounds[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    up, down = _powers_to(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts], 1), starts


def _cuts(data: np.ndarray):
    """Stretches of at most about CHUNK bytes that end before white space."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + CHUNK)
        while end < n:
            gaps = np.flatnonzero(_is_space()[data[end : end + CHUNK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(n, end + CHUNK)
        yield start, end
        start = end


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = (out + words[k : n + k]) * np.uint64((int(_BASE) * (2 * k + 3)) & _MASK)
        out ^= out >> np.uint64(29)
    return mix(out, 2)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) < 2:
        return hashes
    hashes = np.sort(hashes)
    keep = np.empty(len(hashes), bool)
    keep[0] = True
    np.not_equal(hashes[1:], hashes[:-1], out=keep[1:])
    return hashes[keep]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Distinct sorted hashes of the shingles of one word sequence."""
    return _distinct(_windows(words, min(len(words), WIDTH))) if len(words) else words


def text_sets(texts: pa.Array):
    """One sorted uint64 array per text of an Arrow string array (null: empty)."""
    texts = texts.cast(pa.large_binary())
    size = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + size + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < size:
        last = row + 1  # rows row..last-1 are hashed in one go
        while last < size and offsets[last + 1] - offsets[row] <= CHUNK:
            last += 1
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo > CHUNK:
            one = data[lo:hi]
            parts = [word_hashes(one[a:b])[0] for a, b in _cuts(one)]
            yield shingle_hashes(np.concatenate(parts))
        else:
            # a blank before each text keeps words of neighbours apart
            firsts = offsets[row:last] - lo + np.arange(last - row)
            padded = np.full(hi - lo + last - row, 32, np.uint8)
            fill = np.ones(len(padded), bool)
            fill[firsts] = False
            padded[fill] = data[lo:hi]
            words, starts = word_hashes(padded)
            cut = np.searchsorted(starts, np.append(firsts, len(padded)))
            runs = _windows(words, WIDTH) if len(words) >= WIDTH else words[:0]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if b - a >= WIDTH:
                    yield _distinct(runs[a : b - WIDTH + 1])
                else:
                    yield shingle_hashes(words[a:b])
        row = last


def digests(sets: list) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit fingerprints of each set of hashes (0, 0 for an empty one)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full.tolist()])
        heads = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for k in range(2):
            sums = np.add.reduceat(mix(flat, 3 + k), heads)
            out[k, full] = mix(sums + sizes[full].astype(np.uint64), 5)
    return out[0].view(np.int64), out[1].view(np.int64)
