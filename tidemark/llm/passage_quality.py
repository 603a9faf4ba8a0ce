"""Quality of documents by attention-based multiple-instance learning, in numpy.

A document is a bag of passages of ``PASSAGE`` words, all of them. Each passage has ``WIDTH`` numbers: shares of kinds
of characters, words and repetitions, and a histogram of word shapes. A layer encodes it, gated attention weighs
the passages of a document, and the weighted sum of their codes gives the score. Only documents are
labelled; which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .sampling import settled_labels, smallest_hashes

PASSAGE = 64
SHAPES, STATISTICS = 64, 10
WIDTH = SHAPES + STATISTICS
CODE, LOOK = 24, 12
#: Labelled documents to learn from at most, and passages of each, evenly spaced. Scoring reads all passages.
SAMPLE, BAG = 8000, 32
ROUNDS, BATCH, RATE, DECAY = 30, 128, 0.01, 1e-4
_SEED = 23

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_DIGIT = (_B >= 48) & (_B <= 57)
_LETTER = _UPPER | (_B >= 97) & (_B <= 122) | (_B >= 128)
_SYMBOL = (_B > 32) & (_B < 127) & ~_LETTER & ~_DIGIT
#: Kinds of bytes in a word's shape.
_KIND = (_UPPER * 1 + _DIGIT * 2 + _SYMBOL * 3 + (_B >= 128) * 4).astype(np.uint64)
_PER_BYTE = [_UPPER, _DIGIT, _SYMBOL, _B == 10]


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of every passage, and the first passage of each text (one more than texts).

    A text without words has one passage without words.
    """
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(count)])
    nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    start = np.repeat(first[:-1], count) + nth * PASSAGE
    return start, np.minimum(PASSAGE, np.repeat(n, count) - nth * PASSAGE), bounds


def _repeated(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of ``size`` words from each word on stands earlier in the same text."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < size:
        return out
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:len(text) - size + 1] == text[size - 1:]
    keys = W.shingle_hashes(hashes, size) ^ W.mix(text[:len(inside)].astype(np.uint64) + np.uint64(1))
    places = np.flatnonzero(inside)
    _, earliest = np.unique(keys[places], return_index=True)
    out[places] = True
    out[places[earliest]] = False
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``WIDTH`` numbers per passage, and the first passage of each text (one more entry than texts)."""
    data, offsets = W.buffers(texts)
    hashes, start, end, first = W.hashed_words(data, offsets, lower=True)
    at, size, bounds = passages(first)
    out = np.zeros((len(at), WIDTH), np.float32)
    if not len(hashes):
        return out, bounds
    some = np.flatnonzero(size)
    at, size, owner = at[some], size[some], np.repeat(some, size[some])
    low, high = start[at], end[at + size - 1]
    length = (high - low).astype(np.float32)

    def per_passage(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float32), at)

    for i, kind in enumerate(_PER_BYTE):
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        out[some, i] = (sums[high] - sums[low]) / length
    letters = np.minimum(end - start, 40)
    out[some, 4] = per_passage(letters) / size / 10
    out[some, 5] = per_passage(letters.astype(np.float32) ** 2) / size / 100
    out[some, 6] = per_passage(_repeated(hashes, first, 1)) / size
    out[some, 7] = per_passage(_repeated(hashes, first, 3)) / size
    out[some, 8] = size / PASSAGE
    # Words of the whole text, as a number of doublings.
    own = np.searchsorted(bounds, some, "right") - 1
    out[some, 9] = np.log2(1 + np.diff(first)[own]) / 16
    shape = _KIND[data[start]] + np.uint64(5) * _KIND[data[end - 1]] + np.uint64(25) * np.minimum(end - start, 12).astype(np.uint64)
    bucket = (W.mix(shape + np.uint64(1)) % np.uint64(SHAPES)).astype(np.int64)
    counts = np.bincount(owner * SHAPES + bucket, minlength=len(out) * SHAPES).reshape(-1, SHAPES)
    out[some, STATISTICS:] = counts[some] / size[:, None]
    return out, bounds


def new_parameters() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    shapes = {"e": (WIDTH, CODE), "c": (CODE,), "v": (CODE, LOOK), "u": (CODE, LOOK), "a": (LOOK,), "o": (CODE,), "b": (1,)}
    scale = {"e": WIDTH ** -0.5, "v": 0.3, "u": 0.3, "a": 0.3, "o": 0.3}
    q = {k: rng.normal(0, scale.get(k, 0), s) for k, s in shapes.items()}
    return q | {"mean": np.zeros(WIDTH), "spread": np.ones(WIDTH)}


def forward(q: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray):
    """Logit of each bag, and what the gradients need: codes, both sides of the gate, weights and sums."""
    z = (x - q["mean"]) / q["spread"]
    h = np.tanh(z @ q["e"] + q["c"])
    t, s = np.tanh(h @ q["v"]), 1 / (1 + np.exp(-(h @ q["u"])))
    e = (t * s) @ q["a"]
    first, sizes = bounds[:-1], np.diff(bounds)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
    alpha = e / np.repeat(np.add.reduceat(e, first), sizes)
    pool = np.add.reduceat(alpha[:, None] * h, first)
    return pool @ q["o"] + q["b"][0], (z, h, t, s, alpha, pool)


def gradients(q: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray, label: np.ndarray):
    """Loss over the bags and its gradients."""
    logit, (z, h, t, s, alpha, pool) = forward(q, x, bounds)
    p = 1 / (1 + np.exp(-logit))
    loss = -np.mean(np.where(label > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
    sizes = np.diff(bounds)
    d = (p - label) / len(label)
    g = {"o": pool.T @ d, "b": np.array([d.sum()])}
    d_pool = np.repeat(d, sizes)[:, None] * q["o"]
    d_alpha = (d_pool * h).sum(1)
    d_e = alpha * (d_alpha - np.repeat(np.add.reduceat(alpha * d_alpha, bounds[:-1]), sizes))
    g["a"] = (t * s).T @ d_e
    gate = d_e[:, None] * q["a"]
    d_t, d_s = gate * s * (1 - t * t), gate * t * s * (1 - s)
    g["v"], g["u"] = h.T @ d_t, h.T @ d_s
    d_h = (alpha[:, None] * d_pool + d_t @ q["v"].T + d_s @ q["u"].T) * (1 - h * h)
    g["e"], g["c"] = z.T @ d_h, d_h.sum(0)
    return loss, g


def fit(bags: list[np.ndarray], label: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters by Adam over shuffled bags; the order is fixed."""
    q = new_parameters()
    every = np.concatenate(bags)
    q["mean"], q["spread"] = every.mean(0), every.std(0) + 0.02
    q["b"][0] = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))
    rng = np.random.default_rng(_SEED)
    learned = [k for k in q if k not in ("mean", "spread")]
    moments = {k: (np.zeros_like(q[k]), np.zeros_like(q[k])) for k in learned}
    rounds = max(ROUNDS, -(-600 * BATCH // len(bags)))
    step, steps = 0, rounds * -(-len(bags) // BATCH)
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            pick = order[low:low + BATCH]
            bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            _, g = gradients(q, np.concatenate([bags[i] for i in pick]), bounds, label[pick])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in learned:
                one, two = moments[k]
                one += 0.1 * (g[k] + DECAY * q[k] - one)
                two += 0.01 * (g[k] ** 2 - two)
                q[k] -= rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-6)
    return q


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of each text, at most ``BAG`` of them evenly spaced, as bytes of 32-bit numbers."""
    for batch in batches:
        for low, high in W.slices(batch.column(2)):
            x, bounds = features(batch.column(2).slice(low, high - low))
            held = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                at = a + (np.arange(min(BAG, b - a)) * (b - a)) // min(BAG, b - a)
                held.append(x[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                                              pa.array(held, pa.binary())], ["id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality") -> dict[str, np.ndarray] | None:
    """Parameters from documents with a label in ``labels``, or None where either label is missing.

    At most ``SAMPLE`` labelled ids teach, those of the smallest hashes: their list is what is sent to all tasks, and no text
    is shuffled. Ids whose labels contradict each other teach nothing. Of documents with equal ids the one
    with the smallest bag teaches.
    """
    known = smallest_hashes(settled_labels(labels, id_column, label_column), "id", SAMPLE, _SEED)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # At most SAMPLE ids.
    taught = texts.join(F.broadcast(known), "id").select("id", "label", "text")
    id_type = taught.schema["id"].dataType.simpleString()
    found = taught.mapInArrow(_bags, f"id {id_type}, label int, bag binary").groupBy("id").agg(
        F.min(F.struct("bag", "label")).alias("one")).select(F.col("id").cast("string"), "one.label", "one.bag").toArrow()
    found = found.sort_by("id")
    label = found["label"].to_numpy().astype(np.float64)
    if len(set(label.tolist())) < 2:
        return None
    return fit([np.frombuffer(b.as_py(), np.float32).reshape(-1, WIDTH) for b in found["bag"]], label)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = shared.value
            for low, high in W.slices(batch.column(1)):
                if q is None:
                    score = np.full(high - low, 0.5)
                else:
                    x, bounds = features(batch.column(1).slice(low, high - low))
                    score = 1 / (1 + np.exp(-forward(q, x, bounds)[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score)], ["id", "score"])

    return run


def scores(docs: DataFrame, parameters: dict[str, np.ndarray] | None, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(id, score) of each row: the probability that its quality is good, from all passages of the whole text.

    Without parameters every score is 0.5. A null or empty text is one passage without words. Equal texts get equal
    scores, repeated rows repeated ones; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parameters)
    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        _scorer(shared), f"id {id_type}, score double")


def attention(parameters: dict[str, np.ndarray], text: str) -> np.ndarray:
    """The weight of each passage of one text."""
    x, bounds = features(pa.array([text], pa.large_string()))
    return forward(parameters, x, bounds)[1][4]


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees: crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
