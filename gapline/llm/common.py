"""Helpers shared by the text operators: narrow inputs, flat byte buffers, hashes, sizes.

Operators work on two columns, an id and a text, and give their own columns back, so
further columns of the input can have any name. Null texts count as empty. An id names one
document; null is an id like any other and sorts before the numbers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20     # text handled at once inside a task
NO_ID = -(1 << 63)        # stands for a null id inside numpy code
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
pa.set_memory_pool(pa.system_memory_pool())      # one allocator, so that `give_back` reaches all freed memory


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts empty."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that one piece holds about `size` bytes of the column."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.diff(offsets_of(batch.column(batch.schema.get_field_index(column))))
        cut = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // size)) + 1
        edges = [0, *cut.tolist(), n]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        batch = None
        give_back()


def offsets_of(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(
        column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the n + 1 row edges in it."""
    edges = offsets_of(column)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), edges - edges[0]
    return np.frombuffer(data, np.uint8)[edges[0]:edges[-1]], edges - edges[0]


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(column))
    return c.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(values) -> pa.Array:
    """Ids as Arrow, nulls restored."""
    values = np.asarray(values, np.int64)
    return pa.array(values, mask=values == NO_ID)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a fresh array of unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


M31 = np.uint64((1 << 31) - 1)
_S31 = np.uint64(31)
_BLOCK = 1 << 13          # positions handled at once: arrays that stay in a core's cache
_BASES = tuple(int(b) for b in np.random.default_rng(31).integers(1 << 20, (1 << 31) - 1, 2))
_ODD = 0x9E3779B97F4A7C15


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same rest modulo 2**31 - 1, in place."""
    high = x >> _S31
    x &= M31
    x += high
    return x


def _rest(x: np.ndarray) -> np.ndarray:
    _fold(_fold(_fold(x)))
    x[x == M31] = 0
    return x


@lru_cache(maxsize=32)
def _power_table(base: int, size: int, prime: bool) -> np.ndarray:
    """base**i for i below a power of two, modulo 2**31 - 1 or 2**64."""
    out, done, step = np.ones(size, np.uint64), 1, base
    modulus = int(M31) if prime else 1 << 64
    while done < size:
        out[done:2 * done] = out[:done] * np.uint64(step)
        if prime:
            _rest(out[done:2 * done])
        done, step = 2 * done, step * step % modulus
    return out


def _powers(base: int, n: int, prime: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers by place in a block, and by block, for n positions: 64 KB and 8 bytes a block."""
    modulus = int(M31) if prime else 1 << 64
    blocks = 1 << max(n // _BLOCK, 1).bit_length()
    return _power_table(base, _BLOCK, prime), _power_table(pow(base, _BLOCK, modulus), blocks, prime)


class Rolling:
    """Hashes of any substrings of a sequence of codes.

    Two polynomials over the prime field of 2**31 - 1 with random bases, over random numbers for the codes: unlike
    polynomials modulo a power of two they have no texts that always collide. Different strings of n codes are
    equal with a chance of at most (n / 2**31)**2. Needs 16 bytes a code.
    """

    def __init__(self, codes: np.ndarray, noise: np.ndarray):
        self.n = n = len(codes)
        self.sums = np.zeros((2, n + 1), np.uint64)
        tables = [_powers(base, n, True) for base in _BASES]
        for a in range(0, n, _BLOCK):
            drawn = noise[codes[a:a + _BLOCK]]
            for k, (low, high) in enumerate(tables):
                part = (drawn & M31) if k == 0 else (drawn >> np.uint64(33))
                part *= low[:len(part)]
                _fold(part)
                part *= high[a // _BLOCK]
                _fold(part)
                part[:1] += self.sums[k, a:a + 1]
                np.cumsum(part, out=self.sums[k, a + 1:a + 1 + len(part)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of codes[start:end]."""
        out = np.zeros(len(starts), np.uint64)
        tables = [_powers(pow(base, -1, int(M31)), self.n + 1, True) for base in _BASES]
        for a in range(0, len(starts), _BLOCK):
            first, last, both = starts[a:a + _BLOCK], ends[a:a + _BLOCK], None
            place, block = first & (_BLOCK - 1), first // _BLOCK
            for k, (low, high) in enumerate(tables):
                x = self.sums[k][last]
                x -= self.sums[k][first]
                _fold(_fold(x))
                x *= low[place]
                _fold(x)
                x *= high[block]
                _rest(x)
                both = x if both is None else (both << _S31) | x
            out[a:a + _BLOCK] = mix(both + (last - first).astype(np.uint64) * np.uint64(_ODD))
        return out


class Wrapping:
    """Cheap hashes of substrings that only select: polynomials modulo 2**64, which some texts can fool."""

    def __init__(self, codes: np.ndarray, noise: np.ndarray):
        self.n = n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        low, high = _powers(_ODD, n, False)
        for a in range(0, n, _BLOCK):
            part = noise[codes[a:a + _BLOCK]]
            part *= low[:len(part)]
            part *= high[a // _BLOCK]
            part[:1] += self.sums[a:a + 1]
            np.cumsum(part, out=self.sums[a + 1:a + 1 + len(part)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = _powers(pow(_ODD, -1, 1 << 64), self.n + 1, False)
        x = self.sums[ends] - self.sums[starts]
        x *= low[starts & (_BLOCK - 1)]
        x *= high[starts // _BLOCK]
        return mix(x + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all strings of `size` codes."""
        out = np.zeros(max(self.n + 1 - size, 0), np.uint64)
        low, high = _powers(pow(_ODD, -1, 1 << 64), self.n + 1, False)
        for a in range(0, len(out), _BLOCK):
            b = min(a + _BLOCK, len(out))
            x = self.sums[a + size:b + size] - self.sums[a:b]
            x *= low[:b - a]
            x *= high[a // _BLOCK]
            out[a:b] = mix(x)
        return out


@lru_cache(maxsize=1)
def character_noise() -> np.ndarray:
    """A random number for every code point, shared by all operators of a worker."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back when its task is done and its own arrays are gone."""
    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


def binary_rows(lists: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in lists], pa.binary())
