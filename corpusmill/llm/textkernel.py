"""Vectorised text kernels over Arrow string columns (NumPy on the raw UTF-8 bytes).

Every function works on a *block*: the concatenated bytes of some documents and the
offsets that separate them. Blocks are cut to about ``BLOCK_BYTES`` (a longer document
is a block of its own), so the memory of a Python worker doesn't depend on the size of
an Arrow batch. White space is the set 0x20, 0x09-0x0D, which is ASCII, so splitting
bytes and splitting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    return np.array([_mix_int((seed + 1) * _GOLD + i * 0xD1342543DE82EF95) | 1 for i in range(n)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes (returns a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: lower case, every digit as 0
LINE_NORMAL = LOWER.copy()
LINE_NORMAL[48:58] = 48
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


SEEDS = {"a": 11, "b": 23, "word": 37}
#: keeps the first 0..8 bytes of a little-endian lane
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def _keys(places: np.ndarray, seed: int) -> np.ndarray:
    """One pseudo-random key for each place."""
    return mix(places.astype(U64) * U64(_GOLD) + U64(_mix_int(seed * _GOLD + 1)))


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of data[start:end].

    The bytes are read in lanes of eight; every lane is added to the key of its place and
    mixed before the lanes are summed, so no arithmetic pattern in a text cancels out (as
    it does in a polynomial modulo 2 ** 64). Strings of up to eight bytes never collide.
    """
    if len(starts) == 0:
        return np.zeros(0, U64)
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    lengths = ends - starts
    h = mix((lanes[starts] & _KEEP[np.minimum(lengths, 8)]) + _keys(np.zeros(1, np.int64), seed))
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long] - 1) >> 3
        total = np.cumsum(more)
        place = np.arange(1, int(total[-1]) + 1) - np.repeat(total - more, more)
        left = np.repeat(lengths[long], more) - 8 * place
        lane = lanes[np.repeat(starts[long], more) + 8 * place] & _KEEP[np.minimum(left, 8)]
        table = _keys(np.arange(int(more.max()) + 1), seed)
        h[long] += np.add.reduceat(mix(lane + table[place]), total - more)
    return mix(h + lengths.astype(U64) * U64(_GOLD))


def hash_sequence(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of the values[start:start+count] of sequences that follow each other without gaps."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    begin = int(starts[0])
    place = np.arange(begin, begin + int(counts.sum())) - np.repeat(starts, counts)
    table = _keys(np.arange(int(counts.max())), seed)
    return mix(np.add.reduceat(mix(values[begin : begin + len(place)] + table[place]), starts - begin) + counts.astype(U64))


class Block:
    """Bytes of some documents; ``offsets`` has one entry more than there are documents."""

    __slots__ = ("data", "offsets", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column into blocks of at most ``limit`` bytes or one document."""
    data, offsets = string_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of `[^\\x20\\x09-\\x0D]+`."""
    data, offsets = block.data, block.offsets
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] |= solid[inner]
    stop[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their edges."""
    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live := live[(starts[live] < ends[live]) & _PUNCT[data[np.minimum(starts[live], len(data) - 1)]]]):
        starts[live] += 1
    live = np.arange(len(starts))
    while len(live := live[(starts[live] < ends[live]) & _PUNCT[data[np.maximum(ends[live] - 1, 0)]]]):
        ends[live] -= 1
    return starts, ends


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str = "a") -> np.ndarray:
    """64-bit hash of each word. Kinds "a" and "b" are independent; "word" ignores ASCII punctuation at a word's edges."""
    if kind == "word":
        starts, ends = stripped(data, starts, ends)
    return hash_bytes(data, starts, ends, SEEDS[kind])


def roll(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (documents aren't looked at)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = constants(seed, size)
    out = hashes[:n] * c[0]
    for j in range(1, size):
        out += hashes[j : j + n] * c[j]
    return mix(out)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a whole window of one document starts, and their document."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
    return first[:-1][doc] + place, doc


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0
