"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see, and the direction in which each may move the score: more of it never helps where -1 stands.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "unique_share": 0, "upper_share": -1, "digit_share": 0, "mark_share": 0, "top_word_share": -1,
    "words_per_line": 0, "longest_word": 0,
}
#: Labelled documents that the trees learn from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 40, 4, 64, 0.2, 10, 1.0
KEEP = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the values of ``FEATURES`` of one text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(W.SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeated = unique = top = longest = 0
    if n:
        number: dict[bytes, int] = {}
        known = number.setdefault
        ids = np.array([known(w, len(number)) for w in words], np.int64)
        unique, top, longest = len(number), int(np.bincount(ids).max()), max(map(len, words))
        if n >= 4:
            # Pairs are numbered anew, so that three words fit one long whatever the vocabulary.
            _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
            triple = pair[:-1] * np.int64(len(number)) + ids[2:]
            order = np.argsort(triple, kind="stable")
            same = triple[order[1:]] == triple[order[:-1]]
            again = order[np.append(same, False) | np.append(False, same)]
            repeated = _covered(again, n)
    size = max(1, chars)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    features = [
        np.log1p(n), chars / max(1, n), symbols / size, dup_lines / max(1, len(lines)), repeated / max(1, n), unique / max(1, n),
        bytes_of[65:91].sum() / size, bytes_of[48:58].sum() / size, (bytes_of[[33, 44, 46, 58, 59, 63]].sum()) / size,
        top / max(1, n), n / max(1, len(lines)), min(longest, 1000),
    ]
    return [n, chars, symbols, dup_lines, repeated], [float(f) for f in features]


def _covered(starts: np.ndarray, n: int) -> int:
    """Words inside a window of three that begins at one of ``starts``."""
    inside = np.zeros(n, bool)
    for j in range(3):
        inside[starts + j] = True
    return int(inside.sum())


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, features = [], []
        for low, high in W.slices(batch.column(1)):
            for text in batch.column(1).slice(low, high - low).to_pylist():
                c, f = statistics(text)
                counts.append(c)
                features.append(f)
        columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(features, pa.list_(pa.float64()))],
                                         ["id", *COUNTS, "features"])


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, counts, features) of each row: the columns of ``COUNTS`` and an array in the order of ``FEATURES``."""
    id_type = docs.schema[id_column].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        _stat_batches, f"id {id_type}, {counts}, features array<double>")


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child, so every walk takes ``DEPTH`` steps."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values for the rows of ``x``; goes left where the feature is at most the threshold."""
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Boosting for the logistic loss with histogram splits.

    A feature with a direction only takes splits whose two sides are ordered that way, and each side
    keeps to its half of the interval cut at their middle, so the whole sum is monotonic in it.
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not len(y):
        return Trees(base, np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    raw = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + RIDGE), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        node = len(feature)
        own = leaf(g[rows].sum(), h[rows].sum(), low, high)
        feature.append(0), threshold.append(np.inf), left.append(node), right.append(node), value.append(RATE * own)
        if depth == DEPTH or len(rows) < 2 * LEAST:
            raw[rows] += RATE * own
            return node
        best = (1e-6, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gs = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            one = np.clip(-gs / (hs + RIDGE), low, high)
            two = np.clip(-(total_g - gs) / (total_h - hs + RIDGE), low, high)

            def loss(gg, hh, v):
                return gg * v + 0.5 * (hh + RIDGE) * v * v

            gain = loss(total_g, total_h, own) - loss(gs, hs, one) - loss(total_g - gs, total_h - hs, two)
            gain[(ns < LEAST) | (len(rows) - ns < LEAST) | ((two - one) * directions[f] < 0)] = -np.inf
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at, one[at], two[at]))
        if best[1] is None:
            raw[rows] += RATE * own
            return node
        f, at, one, two = best[1]
        middle = (one + two) / 2
        bounds = [(low, high), (low, high)]
        if directions[f] > 0:
            bounds = [(low, middle), (middle, high)]
        elif directions[f] < 0:
            bounds = [(middle, high), (low, middle)]
        goes = binned[rows, f] <= at
        feature[node], threshold[node], value[node] = f, float(cuts[f][at]), 0.0
        left[node] = grow(rows[goes], g, h, depth + 1, *bounds[0])
        right[node] = grow(rows[~goes], g, h, depth + 1, *bounds[1])
        return node

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
    return Trees(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def train(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> Trees:
    """Trees from the statistics of labelled documents, at most ``SAMPLE`` of them in the order of a hash of the id.

    Labels other than 0 and 1 teach nothing. Without any, every document gets the same score.
    """
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    sample = stats.join(known, "id").select("id", "label", "features").orderBy(
        F.xxhash64("id", F.lit(5)), "id", "label", "features").limit(SAMPLE).collect()
    x = np.array([r["features"] for r in sample]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in sample], np.float64), list(FEATURES.values()))


def verdicts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, counts, base_failed, score, kept) of each row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows of three. ``kept``:
    not failed, and the trees' probability of good quality is at least one half. A null text counts as
    empty and fails. Repeated rows give repeated results; other columns are not read.
    """
    stats = materialize(document_statistics(docs, id_column, text_column), "statistics")
    trees = train(stats, labels, id_column)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["features"].to_list(), np.float64).reshape(-1, len(FEATURES))
            yield frame.drop(columns="features").assign(score=trees.probability(x))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name != "features")
    scored = stats.mapInPandas(score, f"{fields}, score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= KEEP))
