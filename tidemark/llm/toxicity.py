"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of four table rows: one for the whole word and three for its characters
(the first four and five bytes, the last three). Each row holds the log-odds of toxic
documents, counted over the training documents, and a few learned numbers. All overlapping windows of
``WINDOW`` words are scored, and the highest window decides for the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import words as W
from .sampling import settled_labels, smallest_hashes

WINDOW, STRIDE = 24, 12
HIDDEN, LEARNED, LOOK = 8, 4, 4
#: Rows of the tables: whole words, first four bytes, first five, last three.
BUCKETS = (1 << 17, 1 << 15, 1 << 15, 1 << 14)
#: Labelled ids over whose documents log-odds are counted, at most.
COUNTED = 50_000
#: Documents of either label from which the network learns, and windows of each.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2000, 4000
PER_TOXIC, PER_CLEAN = 1, 3
#: A word's log-odds count from this many documents on, with so many documents' worth of prior.
LEAST_SEEN, PRIOR = 3, 2.0
_SEED = 11
_STARTS = np.cumsum([0, *BUCKETS])[:-1]
_CHUNK = 4096


def _bytes_of(data: np.ndarray, at: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` bytes from each position, at most ``size`` of them, as one number."""
    key = np.zeros(len(at), np.uint64)
    for j in range(n):
        b = W._LOWER[data[np.minimum(at + j, len(data) - 1)]].astype(np.uint64)
        key |= np.where(j < size, b, 0).astype(np.uint64) << np.uint64(8 * j)
    return key


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of every word (words x 4) and the first word of each text (one more entry than texts)."""
    data, offsets = W.buffers(texts)
    hashes, start, end, first = W.hashed_words(data, offsets, letters=True)
    size = end - start
    tail = np.minimum(size, 3)
    keys = (hashes, _bytes_of(data, start, size, 4), _bytes_of(data, start, size, 5), _bytes_of(data, end - tail, tail, 3))
    rows = [(W.mix(k + np.uint64(i + 1)) % np.uint64(b)).astype(np.int32) + np.int32(s)
            for i, (k, b, s) in enumerate(zip(keys, BUCKETS, _STARTS))]
    return np.stack(rows, 1), first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window; each text has one, its last window ends with the text."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, first[:-1][text] + nth * STRIDE, np.minimum(WINDOW, n[text] - nth * STRIDE)


@dataclass
class Network:
    """Tables, and the parameters of both directions, of the attention and of the output."""

    table: np.ndarray
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, log_odds: np.ndarray) -> Network:
        rng = np.random.default_rng(_SEED)
        width = len(BUCKETS) + LEARNED
        table = np.zeros((len(log_odds), width), np.float32)
        table[:, len(BUCKETS):] = rng.normal(0, 0.05, (len(log_odds), LEARNED))
        for i, (start, size) in enumerate(zip(_STARTS, BUCKETS)):
            table[start:start + size, i] = log_odds[start:start + size]
        shapes = {"v": (LOOK,), "a": (2 * HIDDEN, LOOK), "w": (2 * HIDDEN,), "b": (1,)}
        for way in ("f", "g"):
            shapes |= {way + "x": (width, 3 * HIDDEN), way + "c": (3 * HIDDEN,), way + "u": (HIDDEN, 3 * HIDDEN)}
        parameters = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}
        parameters["b"][:] = 0
        return cls(table, parameters)

    def seeing(self, log_odds: np.ndarray) -> Network:
        """The same network with other log-odds."""
        table = self.table.copy()
        for i, (start, size) in enumerate(zip(_STARTS, BUCKETS)):
            table[start:start + size, i] = log_odds[start:start + size]
        return Network(table, self.parameters)

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        x = self.table[rows[..., 0]]
        for i in range(1, rows.shape[-1]):
            x = x + self.table[rows[..., i]]
        return x

    def run(self, way: str, p: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps x windows x hidden) for inputs ``p`` (steps x windows x 3 hidden)."""
        steps, n, _ = p.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        u = self.parameters[way + "u"]
        full = bool(mask.all())
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = np.tanh((p[t, :, :2 * HIDDEN] + hu[:, :2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN:]
            c = np.tanh(p[t, :, 2 * HIDDEN:] + r * q)
            new = c + z * (h - c)
            if not full:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, q, c))
            h = out[t] = new
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One number per window for inputs ``x`` (steps x windows x width)."""
        q = self.parameters
        h = np.concatenate([self.run(way, x @ q[way + "x"] + q[way + "c"], mask) for way in ("f", "g")], 2)
        return self.pooled(h, mask)[0]

    def pooled(self, h: np.ndarray, mask: np.ndarray):
        q = self.parameters
        s = np.tanh(h @ q["a"])
        e = np.where(mask, s @ q["v"], np.float32(-30))
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        alpha = alpha * mask
        pool = np.einsum("tn,tnh->nh", alpha, h)
        return pool @ q["w"] + q["b"][0], alpha, s, pool

    def gradients(self, rows: np.ndarray, mask: np.ndarray, label: np.ndarray, unseen: list[np.ndarray]):
        """Loss and gradients for windows ``rows`` (steps x windows x 4); the last one is that of the inputs.

        The log-odds are those ``unseen`` by the window's own document, by its label.
        """
        q = self.parameters
        x = self.inputs(rows)
        x[..., :len(BUCKETS)] = np.where(label[:, None] > 0, unseen[1][rows], unseen[0][rows])
        kept: dict[str, list] = {"f": [], "g": []}
        h = np.concatenate([self.run(w, x @ q[w + "x"] + q[w + "c"], mask, kept[w]) for w in kept], 2)
        logit, alpha, s, pool = self.pooled(h, mask)
        p = 1 / (1 + np.exp(-logit))
        loss = -np.mean(np.where(label > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7)))
        d = ((p - label) / len(label)).astype(np.float32)
        g = {"w": pool.T @ d, "b": np.array([d.sum()], np.float32)}
        d_pool = d[:, None] * q["w"]
        d_h = alpha[:, :, None] * d_pool
        d_alpha = np.einsum("tnh,nh->tn", h, d_pool)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["v"] = np.einsum("tn,tnk->k", d_e, s)
        d_s = d_e[:, :, None] * q["v"] * (1 - s * s)
        g["a"] = np.einsum("tnh,tnk->hk", h, d_s)
        d_h = d_h + d_s @ q["a"].T
        d_x = np.zeros_like(x)
        for side, way in enumerate(("f", "g")):
            u = q[way + "u"]
            g[way + "u"] = np.zeros_like(u)
            d_p = np.zeros((len(x), x.shape[1], 3 * HIDDEN), np.float32)
            carried = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, before, z, r, k, c in reversed(kept[way]):
                m = mask[t][:, None]
                total = carried + d_h[t, :, side * HIDDEN:(side + 1) * HIDDEN]
                inner = np.where(m, total, 0)
                d_z = inner * (before - c) * z * (1 - z)
                d_c = inner * (1 - z) * (1 - c * c)
                d_r = d_c * k * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                d_p[t] = np.concatenate([d_z, d_r, d_c], 1)
                g[way + "u"] += before.T @ d_u
                carried = np.where(m, inner * z, total) + d_u @ u.T
            g[way + "x"] = np.einsum("tni,tnj->ij", x, d_p)
            g[way + "c"] = d_p.sum((0, 1))
            d_x += d_p @ q[way + "x"].T
        return loss, g, d_x

    def fit(self, rows: np.ndarray, mask: np.ndarray, label: np.ndarray, unseen: list[np.ndarray], steps: int = 500,
            batch: int = 256) -> None:
        """Adam on the parameters, plain steps on the learned columns of the tables. The order is fixed."""
        rng = np.random.default_rng(_SEED)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.parameters.items()}
        step = 0
        for _ in range(max(4, -(-steps * batch // len(label)))):
            order = rng.permutation(len(label))
            for low in range(0, len(order), batch):
                pick = order[low:low + batch]
                r, m = rows[pick].transpose(1, 0, 2), mask[pick].T
                _, g, d_x = self.gradients(r, m, label[pick], unseen)
                step += 1
                for k, v in self.parameters.items():
                    one, two = moments[k]
                    one += 0.1 * (g[k] - one)
                    two += 0.01 * (g[k] ** 2 - two)
                    v -= 0.01 * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-6)
                learned = d_x[..., len(BUCKETS):] * m[:, :, None]
                for i in range(r.shape[-1]):
                    np.add.at(self.table, (r[..., i].ravel()[:, None], np.arange(len(BUCKETS), self.table.shape[1])),
                              -0.5 * learned.reshape(-1, LEARNED))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The highest window logit of each text."""
        best = np.full(len(texts), -np.inf, np.float32)
        for low, high in W.slices(texts):
            rows, first = word_rows(texts.slice(low, high - low))
            text, start, size = windows(first)
            x = self.inputs(rows) if len(rows) else np.zeros((1, self.table.shape[1]), np.float32)
            # Windows of full length first, so that only the last chunks need their masks.
            order = np.argsort(-size, kind="stable")
            steps = np.arange(WINDOW)[:, None]
            for at in range(0, len(order), _CHUNK):
                pick = order[at:at + _CHUNK]
                mask = steps < size[pick]
                places = np.minimum(start[pick] + np.where(mask, steps, 0), len(x) - 1)
                np.maximum.at(best, low + text[pick], self.logits(x[places], mask))
        return best


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each table row, by label, of one task."""
    total = np.zeros((2, sum(BUCKETS)), np.int64)
    documents = np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        documents += np.bincount(labels, minlength=2)
        for low, high in W.slices(batch.column(0)):
            rows, first = word_rows(batch.column(0).slice(low, high - low))
            text = np.repeat(np.arange(high - low), np.diff(first)).astype(np.int64)
            for i in range(rows.shape[1]):
                seen = np.unique(text << 32 | rows[:, i])
                owner = labels[low:high][seen >> 32]
                for label in (0, 1):
                    total[label] += np.bincount((seen & 0xFFFFFFFF)[owner == label], minlength=total.shape[1])
    at = np.flatnonzero(total.any(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], documents[0])),
         pa.array(np.append(total[1, at], documents[1]))], ["row", "clean", "toxic"])


def _log_odds(counted: pa.Table, without: int | None = None) -> np.ndarray:
    """From columns row, clean, toxic, row -1 holding the numbers of documents.

    ``without`` a label: as a training document of that label sees them, itself not counted.
    """
    out = np.zeros(sum(BUCKETS), np.float32)
    clean, toxic = _numbers(counted)
    at = counted["row"].to_numpy()
    held = at >= 0
    if clean and toxic and held.any():
        c, t = (counted[k].to_numpy()[held].astype(np.float64) for k in ("clean", "toxic"))
        seen = t + c
        if without is not None:
            c, t = (np.maximum(c - 1, 0), t) if without == 0 else (c, np.maximum(t - 1, 0))
        share = toxic / (toxic + clean)
        odds = np.log((t + PRIOR * share) / (c + PRIOR * (1 - share)) * (clean / toxic))
        out[at[held]] = np.where(seen >= LEAST_SEEN, np.clip(odds, -2, 6) / 2, 0)
    return out


def _numbers(counted: pa.Table) -> tuple[int, int]:
    """Clean and toxic documents counted."""
    last = counted["row"].to_numpy() == -1
    return tuple(int(counted[k].to_numpy()[last].sum()) for k in ("clean", "toxic"))


def _hardest(odds: list[np.ndarray]):
    """The windows of each text with the highest sums of its label's log-odds, as table rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in W.slices(batch.column(1)):
                rows, first = word_rows(batch.column(1).slice(low, high - low))
                text, start, size = windows(first)
                labels = batch.column(2).slice(low, high - low).to_numpy(zero_copy_only=False)
                own = np.repeat(labels, np.diff(first))
                each = np.where(own == 1, odds[1][rows].sum(1), odds[0][rows].sum(1))
                sums = np.concatenate([[0], np.cumsum(each, dtype=np.float64)])
                prior = sums[start + size] - sums[start]
                order = np.lexsort((start, -prior, text))
                nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
                pick = order[nth < np.where(labels[text[order]] == 1, PER_TOXIC, PER_CLEAN)]
                pick = pick[size[pick] > 0]
                held = [rows[s:s + n].ravel() for s, n in zip(start[pick], size[pick])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(text[pick])),
                     batch.column(2).slice(low, high - low).take(pa.array(text[pick])),
                     pa.array(held, pa.list_(pa.int32()))], ["id", "label", "rows"])

    return run


@dataclass
class Model:
    """A trained network with the line that turns its highest logit into a probability."""

    network: Network
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.network.scores(texts).astype(np.float64) + self.shift)))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic") -> Model:
    """A model from the documents with a label of 0 or 1 in ``labels``; other and null labels teach nothing.

    Ids whose labels contradict each other teach nothing either; labels that are repeated count once. Log-odds are counted over
    the documents of at most ``COUNTED`` labelled ids, those of the smallest hashes: their list is sent to all tasks, and no text
    is shuffled for it. The network learns from at most ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE`` of these ids and the ``PER_TOXIC`` or
    ``PER_CLEAN`` windows of each with the highest log-odds; of documents with equal ids the one whose text comes
    first. Without both labels the model gives every text a probability of 0.
    """
    known = materialize(smallest_hashes(settled_labels(labels, id_column, label_column), "id", COUNTED, _SEED), "known")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # At most COUNTED ids.
    taught = texts.join(F.broadcast(known), "id").select("text", "label")
    counted = (
        taught.mapInArrow(_counts, "row long, clean long, toxic long").groupBy("row")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().sort_by("row")
    )
    log_odds = _log_odds(counted)
    unseen = [_log_odds(counted, without=label) for label in (0, 1)]
    network = Network.new(log_odds)
    chosen = [smallest_hashes(known.filter(F.col("label") == label), "id", n, _SEED)
              for label, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    # At most TOXIC_SAMPLE + CLEAN_SAMPLE ids, and one text of each.
    sample = materialize(texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").groupBy("id", "label").agg(
        F.min("text").alias("text")).select("id", "text", "label"), "sample")
    id_type = texts.schema["id"].dataType.simpleString()
    lessons = sample.mapInArrow(_hardest(unseen), f"id {id_type}, label int, rows array<int>").toArrow()
    # Rows as big-endian bytes compare as their numbers do.
    held = [np.asarray(r.values, ">i4").tobytes() for r in lessons["rows"]]
    lessons = sorted(zip(map(str, lessons["id"].to_pylist()), lessons["label"].to_pylist(), held), key=lambda r: (r[0], r[2]))
    label = np.array([r[1] for r in lessons], np.float32)
    if len(set(label.tolist())) < 2:
        return Model(network, 0.0, -np.inf)
    rows = np.zeros((len(lessons), WINDOW, len(BUCKETS)), np.int32)
    mask = np.zeros((len(lessons), WINDOW), bool)
    for i, (_, _, own) in enumerate(lessons):
        own = np.frombuffer(own, ">i4").reshape(-1, len(BUCKETS))
        n = len(own)
        rows[i, :n] = own
        mask[i, :n] = True
    network.fit(rows, mask, label, unseen)
    model = Model(network)
    x, y = [], []
    for own in (0, 1):
        shared = docs.sparkSession.sparkContext.broadcast(_packed(Model(network.seeing(unseen[own]))))
        scored = sample.filter(F.col("label") == own).mapInArrow(_scorer(shared, raw=True), f"id {id_type}, label int, score double").toArrow()
        shared.destroy()
        x.append(scored["score"].to_numpy())
        y.append(scored["label"].to_numpy().astype(np.float64))
    x, y = np.concatenate(x), np.concatenate(y)
    # The share of toxic documents in the sample is not theirs among all: weigh each label by its own.
    numbers = _numbers(counted)
    weight = np.where(y > 0, numbers[1] / max(1, y.sum()), numbers[0] / max(1, (1 - y).sum()))
    weight /= weight.sum()
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(line[0] * x + line[1])))
        pull = weight * (p - y)
        gradient = np.array([(pull * x).sum(), pull.sum()]) + 1e-4 * line * [1, 0]
        curve = weight * p * (1 - p)
        hessian = np.array([[(curve * x * x).sum(), (curve * x).sum()], [(curve * x).sum(), curve.sum()]]) + 1e-4 * np.eye(2)
        line = line - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    model.slope, model.shift = float(line[0]), float(line[1])
    return model


def _packed(model: Model) -> bytes:
    """The model as bytes with its classes, so that executors need no copy of this package to read the broadcast."""
    return cloudpickle.dumps(model)


def _scorer(shared, raw: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(shared.value)
        for batch in batches:
            texts = batch.column(1)
            score = own.network.scores(texts).astype(np.float64) if raw else own.probability(texts)
            rest = [batch.column(2)] if raw else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(score)],
                                             ["id", *["label"] * raw, "score"])

    return run


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of each row: the probability that the text is toxic.

    Whole texts are read, a few megabytes at a time. A null or empty text has one window without words; its
    score is the same for all. Equal texts get equal scores; other columns are not read.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        _scorer(docs.sparkSession.sparkContext.broadcast(_packed(model))), f"id {id_type}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees: crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def probability(spark, model: Model):
    """A column function: the probability that a text is toxic, as in ``scores``."""
    shared = spark.sparkContext.broadcast(_packed(model))

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = cloudpickle.loads(shared.value)
        for texts in batches:
            yield pa.array(own.probability(texts))

    return of
