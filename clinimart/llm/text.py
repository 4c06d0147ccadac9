"""Helpers shared by the text operators: columns, folds, and flat byte arrays.

Inside tasks a batch of texts is one run of UTF-8 bytes with the bounds of its
texts, so that words are found and hashed by array operations and no text is
handled byte by byte in Python. Long texts are worked through in blocks of
``BLOCK`` bytes cut at word ends; they are never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"

_codes = np.arange(256, dtype=np.uint8)
LOWERED = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IS_SPACE = (_codes == 32) | ((_codes >= 9) & (_codes <= 13))
_random = np.random.RandomState(20240229)
_BYTE_VALUE = _random.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(parts)


def with_bytes(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes in ``_utf8``; a null text is empty."""
    utf8 = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(*columns, utf8.alias("_utf8"))


def rows_of(docs: DataFrame) -> DataFrame:
    """Whole rows as one column ``_row`` next to the text, for operators that hand
    rows on: names of other columns cannot clash with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str = "_utf8", limit: int = 4 * BLOCK
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the bounds of each text in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = offsets.astype(np.int64) - int(offsets[0])
    data = column.buffers()[2]
    if data is None or not bounds[-1]:
        return np.empty(0, np.uint8), bounds
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], bounds


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last+1 byte of each word, and the bounds of each text in the words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values (the finalizer of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()
) -> list[np.ndarray]:
    """64-bit hash of each lower-cased word, then of its first bytes for each of
    ``prefixes``. Two different words agree with a chance of about 2^-64."""
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(prefixes))]
    at, up, down = 0, _powers(_STEP, BLOCK + 1), _powers(_STEP_BACK, BLOCK + 1)
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        a, b = starts[at:stop] - base, ends[at:stop] - base
        size = int(b[-1])
        if size > BLOCK:  # one word longer than a block
            up, down = _powers(_STEP, size + 1), _powers(_STEP_BACK, size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[LOWERED[data[base : base + size]]] * up[:size], out=sums[1:])
        begin, back = sums[a], down[a]
        for k, width in enumerate((None, *prefixes)):
            stops = b if width is None else np.minimum(b, a + width)
            out[k][at:stop] = mixed((sums[stops] - begin) * back)
        at = stop
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and in all, of one UTF-8 text."""
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=counts[1:])
    return counts
