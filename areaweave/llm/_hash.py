"""Words, hashes and least places of byte arrays, in numpy.

Hashes of 64 bits propose: equal inputs have equal hashes, and what unequal inputs do is checked by those who use them.
They are not linear, so no pattern of letters makes different words cancel out. Where a hash decides, it is a digest
of 128 bits (`digest`).
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are mixed eight at a time; a longer word is hashed as a whole.
_LANES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Bits of a packed value that hold a place; a stretch given to `least_places` is shorter than that.
PLACE_BITS = 23


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (one more: the number of words)."""
    inside = ~_SEPARATOR[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begin[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    end[at] = inside[at]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; words of up to eight bytes and equal length never share one."""
    size = ends - starts
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(np.uint64) * MULTIPLIER)
    live, k = np.flatnonzero(size <= _LANES), 0
    while len(live):
        left = size[live] - k
        lane = eight[starts[live] + k] & _MASKS[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ lane) * MULTIPLIER)
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(size > _LANES).tolist():
        h[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` hashes in a row, by doubling: a run of 2n is two runs of n."""
    out, done, length = None, 0, 1
    run, rest = h, size
    while rest:
        if rest & 1:
            if out is None:
                out, done = run, length
            else:
                n = len(h) - done - length + 1
                out = mix(out[:n] * MULTIPLIER + run[done : done + n]) if n > 0 else out[:0]
                done += length
        rest >>= 1
        if rest:
            n = len(run) - length
            run = mix(run[:n] * MULTIPLIER + run[length : length + n]) if n > 0 else run[:0]
            length *= 2
    return out


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """From each place on, where the least of ``width`` values is, the leftmost of equals.

    Blocks of ``width`` values have running minima from both ends, of which every window takes one each. Value and
    place go packed, so values count by their upper bits: alike for equal stretches, wherever they are.
    """
    n = len(h)
    many = n - width + 1
    if many <= 0:
        return np.zeros(0, np.int64)
    if n >= 1 << PLACE_BITS:
        raise ValueError("a stretch is too long for packed places")
    low = np.uint64((1 << PLACE_BITS) - 1)
    grid = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    grid[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (np.minimum(back[:many], ahead[width - 1 : width - 1 + many]) & low).astype(np.int64)
