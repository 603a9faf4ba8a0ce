"""Byte-level BPE over a slice of the corpus at a time: merges replayed in rank order from an inverted index."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SHIFT = 20
GAP, GONE = -1, -2
NO_PAIR = np.int32(np.iinfo(np.int32).max)
#: Text whose distinct words are merged together. Merging a slice takes some twenty times its bytes.
SLICE_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """The vocabulary as mergeable pairs of ranks."""

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.results = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NO_PAIR; a gap pairs with nothing."""
        key = left << SHIFT | right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[slot] == key) & (right >= 0) & (left >= 0), self.results[slot], NO_PAIR)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all ``words`` (none empty) after one another, and where each word's begin and end.

    All words lie after one another as single bytes. An inverted index holds, for the rank of every
    mergeable neighbour pair, the positions of that pair. Ranks are taken from the lowest. All words
    that hold the pair merge their leftmost one at once, and only the two neighbours of a merged
    position get new index entries. Further positions of the same word go back to the index, so
    a word sees its merges exactly as if its lowest pair, leftmost first, were merged each time.
    Words are independent of each other.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    whole = np.array([merges.ranks.get(w, GAP) for w in words])
    sizes = np.array([len(w) for w in words])
    last = np.cumsum(sizes + 1) - 1
    current = merges.of_byte[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)]
    current[last] = GAP
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes + 1)
    total = len(current)
    after = np.arange(1, total + 1, dtype=np.int32)
    before = np.arange(-1, total - 1, dtype=np.int32)
    lookup = merges.lookup

    pair = np.full(total, NO_PAIR, np.int32)
    pair[:-1] = lookup(current[:-1], current[1:])
    # A word that is a token is that token, whatever its merges.
    pair[whole[word] >= 0] = NO_PAIR
    at = np.flatnonzero(pair != NO_PAIR).astype(np.int32)
    index: dict[int, list[np.ndarray]] = {}
    open_ranks: list[int] = []

    def add(ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, len(ranks)]):
            rank = int(ranks[low])
            held = index.get(rank)
            if held is None:
                index[rank] = [places[low:high]]
                heapq.heappush(open_ranks, rank)
            else:
                held.append(places[low:high])

    if len(at):
        add(pair[at], at)
    while open_ranks:
        rank = heapq.heappop(open_ranks)
        held = index.pop(rank)
        places = held[0] if len(held) == 1 else np.concatenate(held)
        places = places[pair[places] == rank]
        if not len(places):
            continue
        if len(places) > 1:
            places = np.sort(places)
            of = word[places]
            more = of[1:] == of[:-1]
            if more.any():
                rest = np.append(False, more)
                index[rank] = [places[rest]]
                heapq.heappush(open_ranks, rank)
                places = places[~rest]
        there = after[places]
        beyond = after[there]
        ahead = before[places]
        current[places] = rank
        current[there] = GONE
        pair[there] = NO_PAIR
        after[places] = beyond
        before[beyond] = places
        right = lookup(current[places], current[beyond])
        pair[places] = right
        ahead = np.maximum(ahead, 0)
        left = lookup(current[ahead], current[places])
        # Before the first byte lies a gap or, at the very beginning, nothing.
        left[(ahead == places)] = NO_PAIR
        has = current[ahead] >= 0
        has &= ahead != places
        pair[ahead[has]] = left[has]
        fresh = np.concatenate([right, left])
        good = fresh != NO_PAIR
        if good.any():
            add(fresh[good], np.concatenate([places, ahead])[good])
    first = np.append(0, last[:-1] + 1)
    known = np.flatnonzero(whole >= 0)
    current[(whole >= 0)[word]] = GONE
    current[first[known]] = whole[known]
    kept = current >= 0
    return current[kept], np.append(0, np.cumsum(kept)[last])


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[starts[i]:starts[i] + sizes[i]]`` for all i, after one another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Table:
    """Byte strings by token id, to be put together for many ids at once."""

    def __init__(self, strings: Mapping[int, bytes]):
        size = max(strings) + 1
        rows = [strings.get(i, b"") for i in range(size)]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return _gather(self.data, self.starts[ids], self.sizes[ids]).tobytes()


class Codec:
    """Encoding and decoding of the texts of one slice."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.split = regex.compile(pattern).findall
        self.tokens = Table(merges.tokens)
        self.digits = Table({rank: b"%d," % rank for rank in merges.tokens})

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The token ids of each text. Distinct words are merged once for all texts."""
        vocabulary: dict[str, int] = {}
        known = vocabulary.setdefault
        found = [np.array([known(w, len(vocabulary)) for w in self.split(t)], np.int64) for t in texts]
        flat, bounds = replay([w.encode() for w in vocabulary], self.merges)
        sizes = np.diff(bounds)
        for at in found:
            yield _gather(flat, bounds[at], sizes[at])

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.digits.join(ids)[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.join(ids)


def _per_slice(ranks, pattern: str, row: Callable, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Merges(ranks.value), pattern)
        for batch in batches:
            for low, high in W.slices(batch.column(1), SLICE_BYTES):
                texts = [t or "" for t in batch.column(1).slice(low, high - low).to_pylist()]
                rows = [row(codec, ids) for ids in codec.ids(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *map(pa.array, zip(*rows))], ["id", *columns])

    return run


def _ids(codec: Codec, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    return ids.astype(np.int32), codec.decode(ids)


def _digest(codec: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(codec.decimal(ids)).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())


def _apply(docs: DataFrame, path: str, pattern: str, row: Callable, columns: str, id_column: str, text_column: str):
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    id_type = docs.schema[id_column].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        _per_slice(ranks, pattern, row, names), f"id {id_type}, {columns}")


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, decoded) of each row: token ids by the ranks in the file ``path``, and their bytes again.

    Each match of ``pattern`` is encoded by itself, without special tokens. A task takes slices of a few
    megabytes of whole texts (one longer text is a slice), replays the merges over
    the slice's distinct words, and puts the words' ids together. Nothing is shuffled. A null or
    empty text has no tokens. Rows are independent of each other; other columns are not read. The
    vocabulary file, read by the driver, is of a fixed size.
    """
    return _apply(docs, path, pattern, _ids, "ids array<int>, decoded binary", id_column, text_column)


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, in lowercase hex; the ids as in ``encode``."""
    return _apply(docs, path, pattern, _digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                  id_column, text_column)
