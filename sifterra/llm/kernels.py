"""NumPy kernels over whole texts, called inside Arrow batches on the executors."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial over word hashes.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Blanks of the contracts, as a table over bytes.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Bytes hashed at a time.
SEGMENT = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 to n - 1 and their inverses modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        base = int(MULTIPLIER)
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            run = np.full(max(n, SEGMENT + (1 << 16)), x, np.uint64)
            run[0] = 1
            _POWERS[name] = np.cumprod(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def powers(n: int) -> np.ndarray:
    """The multiplier's powers 0 to n - 1 modulo 2^64."""
    return _powers(n)[0]


def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit number for each byte; with ``fold`` A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64), 5)
    if fold:
        values[65:91] = values[97:123]
    return values


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows; NULL is empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def hashed_words(column: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string column, and the first word of each row (one more at the end).

    Words are runs of anything but ASCII blanks; with ``fold`` A-Z hash as a-z. A word's
    hash is a polynomial over its bytes, taken as a difference of running sums.
    """
    data, at = flat_bytes(column)
    n, values = len(data), byte_values(fold)
    blank = BLANK[data]
    begins, stops = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]]
    after_blank, before_blank = np.ones(n, bool), np.ones(n, bool)
    after_blank[1:] = blank[:-1]
    before_blank[:-1] = blank[1:]
    after_blank[begins] = True
    before_blank[stops - 1] = True
    starts, ends = np.flatnonzero(~blank & after_blank), np.flatnonzero(~blank & before_blank) + 1
    hashes, done = np.empty(len(starts), np.uint64), 0
    while done < len(starts):
        # whole words whose bytes fill about a segment
        base = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
        up, down = _powers(int(ends[upto - 1] - base))
        sums = np.zeros(len(up) + 1, np.uint64)
        np.cumsum(values[data[base : ends[upto - 1]]] * up, out=sums[1:])
        a, b = starts[done:upto] - base, ends[done:upto] - base
        hashes[done:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64), 1)
        done = upto
    return hashes, np.searchsorted(starts, at)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise 64-bit values; other salts give independent orders."""
    x = x ^ np.uint64(salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= MULTIPLIER
        out += hashes[i : i + n]
    return mix(out, width)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted set of shingles; with fewer words the whole sequence is one, without words none."""
    if len(hashes) == 0:
        return hashes
    return distinct(windows(hashes, min(width, len(hashes))))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def shingle_sets(column: pa.Array, width: int, fold: bool = True) -> Iterator[np.ndarray]:
    """``shingles`` of each row of a string column."""
    hashes, first = hashed_words(column, fold)
    runs = windows(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield distinct(runs[a : b - width + 1]) if b - a >= width else shingles(hashes[a:b], width)


def trim() -> None:
    """Give freed memory back to the system: Python workers are kept for later tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Text bytes that a worker handles at once.
SLICE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE`` bytes of column ``at``: memory follows the longest text, not the batch size."""
    for batch in batches:
        column = batch.column(at)
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(column), 0), np.int64))
        done = 0
        while done < batch.num_rows:
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SLICE, side="right")))
            yield batch.slice(done, upto - done)
            done = upto
    trim()


def binaries(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def texts(column: pa.Array) -> Iterator[str]:
    """Texts of a string column; NULL is empty and broken UTF-8 is replaced."""
    for raw in binaries(column):
        yield (raw or b"").decode("utf-8", "replace")
