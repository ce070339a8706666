"""64-bit hashes of the words of whole texts, by numpy over the bytes of a batch.

Words part at ASCII white space and A-Z count as a-z. A word is hashed as a polynomial of its bytes modulo 2^64, whose
bits are then mixed; equal words have equal hashes, and two different words meet with odds of about one in 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE = 1 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values() -> np.ndarray:
    """What each byte counts: 0 for white space, else one more than the byte in lower case."""
    out = np.arange(1, 257, dtype=np.uint64)
    out[ord("A") + np.arange(26)] += np.uint64(32)
    out[_SPACES] = 0
    return out


_VALUES = _values()
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """_BASE to the power of 0 to n - 1."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE))])
    return _powers


def _hashes(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that ``marks`` part ``data`` into, and where those of each text begin and end."""
    value = _VALUES[data]
    within = value != 0
    start = within.copy()
    start[1:] &= ~within[:-1]
    edges = marks[:-1][marks[:-1] < len(data)]
    start[edges] = within[edges]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(marks), np.int64)
    place = np.arange(at[0], len(data))
    place -= np.repeat(at, np.diff(at, append=len(data)))
    own = value[at[0] :]
    place[own == 0] = 0
    own *= _power(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(own, at - at[0])), np.searchsorted(at, marks)


def batches(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, offsets) of slices of texts: text ``first + i`` has hashes[offsets[i] : offsets[i + 1]]. Null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    marks = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    groups = (marks[1:] - marks[0]) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, *_hashes(data[marks[a] : marks[b]], marks[a : b + 1] - marks[a])


def hash_all(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out = []
    for _, hashes, at in batches(pa.array(texts, pa.large_string())):
        out += [hashes[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
    return out


def runs(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of each run of ``n`` words within one text."""
    total = len(hashes) - n + 1
    if total < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    out = np.full(total, n, np.uint64)
    for k in range(n):
        out *= MIX
        out += hashes[k : total + k]
        out ^= out >> np.uint64(29)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:total]
    place = np.arange(total)
    own = np.flatnonzero(place + n <= offsets[1:][text])
    return mix(out[own]), text[own], place[own] - offsets[:-1][text[own]]
