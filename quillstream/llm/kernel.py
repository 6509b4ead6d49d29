"""Vectorised text primitives on the byte buffers of Arrow batches.

A chunk is a run of rows whose texts lie in one uint8 array, with row limits in an int64 array.
Hashes are 64-bit polynomials of the bytes (prefix sums modulo 2**64), finished by a mixer, so
the hash of any slice costs two lookups. Powers of two have known colliding strings from 512 bytes on (Thue-Morse), so
what rests on the hash of a long slice adds a second polynomial modulo a prime (`Hasher.wide`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEEDS = np.random.RandomState(20240117).randint(1, 2**63 - 1, 256).astype(np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_PRIME = np.uint64(2**31 - 1)
_prime_powers: list[np.ndarray] = []


def _prime_series(factor: int, n: int) -> np.ndarray:
    """Powers of factor modulo the prime, by doubling."""
    p = int(_PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(factor, len(out), p)) % _PRIME])
    return out[:n]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _prime_powers or len(_prime_powers[0]) < n:
        base = 0x2545F491 % int(_PRIME)
        _prime_powers[:] = [_prime_series(base, n), _prime_series(pow(base, -1, int(_PRIME)), n)]
    return _prime_powers[0], _prime_powers[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [_series(_BASE, n), _series(_INVERSE, n)]
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of slices of one byte array."""

    def __init__(self, data: np.ndarray):
        self.data, self.primes = data, None
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_SEEDS[data] * power[: len(data)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def wide(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """raw() with the polynomial modulo the prime mixed in."""
        if self.primes is None:
            power, self.prime_inverse = prime_powers(len(self.data) + 1)
            self.primes = np.zeros(len(self.data) + 1, dtype=np.uint64)
            # terms below 2**31, so sums of up to 2**33 of them are exact
            np.cumsum((_SEEDS % _PRIME)[self.data] * power[: len(self.data)] % _PRIME, out=self.primes[1:])
        second = (self.primes[ends] - self.primes[starts]) % _PRIME * self.prime_inverse[starts] % _PRIME
        return self.raw(starts, ends) ^ mix(second + np.uint64(1))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """uint64 hashes of data[starts[i]:ends[i]]; the length counts too."""
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, limits) of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    limits = np.frombuffer(at, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[limits[0] : limits[-1]], limits - limits[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about `most` bytes; a longer single text is a run."""
    if not batch.num_rows:
        return
    data, limits = text_buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(limits, limits[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield slice(first, last), data[limits[first] : limits[last]], limits[first : last + 1] - limits[first]
        first = last


def words(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words, maximal runs of bytes that are not ASCII white space."""
    ink = ~WHITE[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    inner = limits[1:-1]
    before[inner[inner < n]] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    inner = inner[(inner > 0) & (inner <= n)]
    after[inner - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    rows = np.searchsorted(limits, starts, side="right") - 1
    return starts, ends, rows


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words inside a row."""
    if len(word_hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    total = np.zeros(len(word_hashes) - n + 1, np.uint64)
    for j, factor in enumerate(_SEEDS[:n] | np.uint64(1)):
        total += word_hashes[j : len(word_hashes) - n + 1 + j] * factor
    return at, mix(total[at])


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the half-open ranges."""
    steps = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
