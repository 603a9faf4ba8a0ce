"""Words, shingles and their hashes over Arrow batches of texts, in numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes. All of it works on
the UTF-8 bytes, half a megabyte at a time, so memory follows the piece and not the batch: the arrays of a piece take some
forty times its bytes, and a worker keeps them for its next task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
PIECE_BYTES = 1 << 19
#: Rows taken together where sums of floats depend on it.
SLICE_BYTES = 4 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: Runs of letters and digits: every other ASCII byte separates.
_IS_NOT_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)


_POWERS = _powers(256)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after one another, and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(texts) else data[:0], offsets - offsets[0] if len(texts) else offsets


def _piece(data: np.ndarray, breaks: np.ndarray, lower: bool,
           separates: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one piece; a word never crosses a position of ``breaks``."""
    b = _LOWER[data] if lower else data
    word = ~separates[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    if len(breaks):
        first[breaks] = word[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    bounds = np.append(starts, len(b))
    sizes = np.diff(bounds)
    at = np.arange(starts[0], len(b)) - np.repeat(starts, sizes)
    powers = _POWERS if at.max() < len(_POWERS) else _powers(int(at.max()) + 1)
    values = np.where(word[starts[0]:], b[starts[0]:].astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[at]
    lengths = np.add.reduceat(word[starts[0]:].astype(np.int64), starts - starts[0])
    return mix(np.add.reduceat(values, starts - starts[0])), starts, starts + lengths


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: bool = False) -> tuple[np.ndarray, ...]:
    """Hash, start and end of every word, and the first word of each text (one more entry than texts).

    With ``letters``, punctuation and symbols of ASCII separate words as white space does.
    """
    separates = _IS_NOT_LETTER if letters else _IS_SPACE
    hashes, starts, ends, low = [], [], [], 0
    while low < len(data):
        high = min(len(data), low + PIECE_BYTES)
        # Cut at the start of a text or else before a white space, so that no word is cut.
        if high < len(data):
            text = offsets[np.searchsorted(offsets, high, "right") - 1]
            if text > low:
                high = int(text)
            else:
                space = np.flatnonzero(_IS_SPACE[data[low + 1:high]])
                while not len(space) and high < len(data):
                    grown = min(len(data), high + PIECE_BYTES)
                    space = np.flatnonzero(_IS_SPACE[data[low + 1:grown]])
                    high = grown
                if len(space):
                    high = low + 1 + int(space[-1])
        inner = offsets[(offsets >= low) & (offsets < high)] - low
        h, s, e = _piece(data[low:high], inner, lower, separates)
        hashes.append(h), starts.append(s + low), ends.append(e + low)
        low = high
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words; for fewer words one hash of the whole sequence."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j:len(words) - n + 1 + j] * weights[j]
    return mix(total + np.uint64(n))


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``max_bytes`` of text, or one longer row."""
    sizes = np.diff(buffers(texts)[1])
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > max_bytes:
            yield low, i
            low, held = i, 0
        held += int(size)
    if low < len(sizes):
        yield low, len(sizes)
