"""Words, shingles and hashes of many texts at once, on the UTF-8 bytes that Arrow holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillgraph.functions.batches import BATCH_ROWS, lean, mapped  # noqa: F401  for the operators

U = np.uint64
#: Texts are worked on in pieces of about so many bytes.
CHUNK_BYTES = 1 << 19
#: Words of a longer text are found in pieces of about so many bytes.
SEGMENT_BYTES = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; only those that a usual chunk needs are kept."""
    most = CHUNK_BYTES + 1
    if n <= most and base in _powers:
        return _powers[base][:n]
    table = np.full(max(n, most), base & (2**64 - 1), U)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if n <= most:
        _powers[base] = table
    return table[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair; equal runs have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(values) + 1)[starts])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and n + 1 offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    kind = np.int64 if column.type == pa.large_string() else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches of about `limit` bytes of text (one text at least), each with its bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D within a text: first bytes, ends, and hashes (of A-Z in lower case, if lower).

    A very long text is worked on in pieces of about SEGMENT_BYTES that end with a word.
    """
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))], 0
    while at < len(data):
        end = _cut(data, offsets, at)
        inner = offsets[(offsets > at) & (offsets < end)] if end < len(data) or at else offsets
        starts, ends, hashes = _words(data[at:end], np.unique(np.concatenate([[0], inner - at, [end - at]])), lower)
        found.append((starts + at, ends + at, hashes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found)) if len(found) != 2 else found[1]


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where a piece that begins at `at` ends: after white space or a text, about SEGMENT_BYTES on; later, if one word is longer."""
    end = at + SEGMENT_BYTES
    if end >= len(data):
        return len(data)
    text = int(offsets[np.searchsorted(offsets, end, "right") - 1])
    space = np.flatnonzero(_SPACE[data[at:end]])
    if max(text, at + int(space[-1]) + 1 if len(space) else 0) > at:
        return max(text, at + int(space[-1]) + 1 if len(space) else 0)
    after = int(offsets[np.searchsorted(offsets, end)])
    while end < after and not _SPACE[data[end : end + SEGMENT_BYTES]].any():
        end += SEGMENT_BYTES
    return after if end >= after else min(after, end + int(_SPACE[data[end : end + SEGMENT_BYTES]].argmax()) + 1)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = inside[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, run_hashes(_LETTER[_LOWER[data] if lower else data], starts, stops)


def text_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For positions in the bytes, the number of the text each is in."""
    return np.searchsorted(offsets, starts, "right") - 1


def second(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits for words of these hashes: runs of both are told apart by 128 bits."""
    return mix(hashes ^ U(0x5851F42D4C957F2D))


def digests(owner: np.ndarray, values: np.ndarray, others: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each of n owners (ascending) that stand for its values and the others beside them, in their order."""
    ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
    both = np.stack([values, others], axis=1) if len(values) else np.zeros((0, 2), U)
    return [hashlib.md5(both[s:e].tobytes()).digest() for s, e in zip([0, *ends], ends)]


def shingles(hashes: np.ndarray, text: np.ndarray, n: int, twice: bool = False) -> tuple[np.ndarray, ...]:
    """Texts and hashes of all distinct n-word shingles, sorted by both; a text of fewer words has its whole sequence as one. If twice, also other 64 bits of each."""
    if not len(hashes):
        return (text[:0], hashes[:0], hashes[:0])[: 2 + twice]
    bounds = np.flatnonzero(np.diff(text)) + 1
    first = np.concatenate([[0], bounds])
    size = np.diff(np.concatenate([first, [len(text)]]))
    number = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(text))
    whole = at + n <= (first + size)[number]
    whole[first[size < n]] = True
    at = at[whole]
    ends = at + np.minimum(n, size[number[at]])
    found = run_hashes(hashes, at, ends)
    owner = text[at]
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    if not twice:
        return owner[new], found[new]
    return owner[new], found[new], run_hashes(second(hashes), at, ends)[order][new]
