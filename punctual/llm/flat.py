"""Texts as one flat run of bytes: words, lines and hashes of spans by whole-array steps, never by the word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end last. Null texts are empty."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that cross no text: start, end, text number."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets[1:], start, "right")


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are no white space: start, end, text number."""
    return runs(~BLANK[data], offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of ``data``, from which :func:`spans` takes the hash of any span."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * _power("up", int(_BASE), len(data))[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: equal bytes have equal hashes."""
    back = _power("down", pow(int(_BASE), -1, 1 << 64), len(sums))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(_U) * _U(0xA0761D6478BD642F))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hashes of spans in order, without running sums over more than ``step`` bytes (or the longest span) at a time."""
    out, k = np.empty(len(start), _U), 0
    while k < len(start):
        to, base = max(k + 1, int(np.searchsorted(end, start[k] + step, "right"))), start[k]
        out[k:to] = spans(prefix(data[base : end[to - 1]]), start[k:to] - base, end[k:to] - base)
        k = to
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` consecutive hashes; callers drop those that cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, width, _U)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by text number."""
    return np.bincount(text, values, n).astype(np.int64)


def blocks(batches, text: str, most: int = 1 << 21):
    """Arrow batches cut into slices of about ``most`` bytes of text (a longer single text stays whole)."""
    for batch in batches:
        at = 0
        if not batch.num_rows:
            continue
        ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays by name."""
    got = {k: v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v for k, v in columns.items()}
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f in schema for v in [got[f.name]]]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
