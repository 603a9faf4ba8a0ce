"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Candidates are written in blocks along a Hilbert curve through the dimensions in which they vary most. Each block has
a zone map: the least and greatest value in every dimension, and its labels. The product of an anchor with
any vector of a block lies in an interval that follows from the zone map, and an anchor reads the blocks whose interval
meets what it looks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import with_ordinal
from ..session import materialize

#: Rows of a block of candidates, anchors that meet a block in one task, and zone maps that they meet in one task.
BLOCK, ANCHORS, ZONES = 2048, 2048, 2048
#: Dimensions of the curve and bits of each.
CURVE, BITS = 8, 7
#: Up to here a double holds every integer.
_EXACT = float(1 << 53)
#: Scores computed at once.
_CELLS = 1 << 22


def usable(vectors: DataFrame, label: Callable[[Column, Column], Column], id_column: str, label_column: str,
           vector_column: str) -> DataFrame:
    """(id, label, v): rows without nulls whose components are finite; of rows with one id the smallest label and vector."""
    v = F.col(vector_column)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & (F.size(v) > 0)).filter(good)
    own = label(F.col(id_column), F.col(label_column)).cast("long")
    return (rows.select(F.col(id_column).cast("long").alias("id"), F.struct(own.alias("label"), v.alias("v")).alias("row"))
            .groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v"))


def integers(rows, scale: int, width: int = 0) -> np.ndarray:
    """floor(scale * x) of each component, filled up with zeros; doubles hold them."""
    width = max([width, *map(len, rows)]) if len(rows) else width
    out = np.zeros((len(rows), width), np.float64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return np.floor(out * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if a.size and b.size and width * np.abs(a).max() * np.abs(b).max() >= _EXACT:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of ``cells`` (n x d, values of ``bits`` bits) on the Hilbert curve through d dimensions.

    Skilling's method (2004): from the highest bit plane down the bits of a plane choose an orthant; within it the curve is
    the same curve, with axes reflected and exchanged so that it joins its neighbours.
    """
    x = cells.astype(np.int64).T.copy()
    d, n = x.shape
    for plane in range(bits - 1, 0, -1):
        below = (1 << plane) - 1
        for i in range(d):
            high = (x[i] >> plane & 1).astype(bool)
            # Upper half: the first axis is reflected. Lower half: it is exchanged with axis i.
            differ = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ differ)
            x[i] = x[i] ^ differ
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= turn
    out = np.zeros(n, np.int64)
    for plane in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> plane & 1)
    return out


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per dimension: number, sum, sum of squares, least and greatest value of one task's rows."""
    parts: dict[int, np.ndarray] = {}
    for frame in frames:
        for size, rows in frame.groupby(frame["v"].map(len))["v"]:
            x = np.array(rows.tolist(), np.float64)
            new = np.stack([np.full(size, len(x)), x.sum(0), (x ** 2).sum(0), x.min(0), x.max(0)])
            old = parts.get(size)
            if old is not None:
                new = np.stack([*(old[:3] + new[:3]), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])])
            parts[size] = new
    for size, p in parts.items():
        yield pd.DataFrame({"dimension": np.arange(size, dtype=np.int32), "n": p[0], "one": p[1], "two": p[2], "least": p[3], "most": p[4]})


def _along_curve(axes: list[tuple[int, float, float]]):
    """Adds to (id, label, v) the place on the curve through ``axes`` (dimension, least, greatest value)."""
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            cells = np.zeros((len(frame), len(axes)), np.int64)
            for i, (dimension, least, most) in enumerate(axes):
                x = np.array([v[dimension] if dimension < len(v) else 0.0 for v in frame["v"]], np.float64)
                cells[:, i] = np.clip((x - least) / max(most - least, 1e-300) * (1 << BITS), 0, (1 << BITS) - 1)
            yield frame.assign(place=hilbert_index(cells, BITS))

    return place


def _in_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` in the order of (place, hash of id), written, numbered from 0 in blocks of ``size`` neighbours.

    The hash spreads rows of one place over partitions; blocks are full however many partitions there are.
    """
    placed = with_ordinal(rows, [F.col("place"), F.xxhash64("id"), F.col("id")], name="at")
    return materialize(placed.withColumn(name, ((F.col("at") - 1) / size).cast("long")).drop("at"), name)


def _zone_parts(scale: int):
    """Zone maps of what each batch holds of a block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for block, own in frame.groupby("block"):
                x = integers(own["v"], scale)
                rows.append((block, x.min(0), x.max(0), np.unique(own["label"])))
            yield pd.DataFrame(rows, columns=["block", "low", "high", "labels"])

    return run


def _merged_zone(frame: pd.DataFrame) -> pd.DataFrame:
    width = max(map(len, frame["low"]))
    # A part with shorter vectors holds zeros behind them.
    low, high = (np.stack([np.pad(v, (0, width - len(v))) for v in frame[c]]) for c in ("low", "high"))
    labels = np.unique(np.concatenate(frame["labels"].tolist()))
    return pd.DataFrame({"block": frame["block"].iloc[:1], "low": [low.min(0)], "high": [high.max(0)], "labels": [labels]})


def zone_maps(blocks: DataFrame, scale: int = 256) -> DataFrame:
    """(block, low, high, labels): per block the least and greatest scaled value in each dimension, and its labels."""
    schema = "block long, low array<double>, high array<double>, labels array<long>"
    parts = blocks.select("block", "v", "label").mapInPandas(_zone_parts(scale), schema)
    return parts.groupBy("block").applyInPandas(_merged_zone, schema)


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor with any vector inside each zone."""
    width = max(anchors.shape[1], low.shape[1])
    q, low, high = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (anchors, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-9 * (np.abs(least) + np.abs(most) + up.sum(1)[:, None] + 1)
    return least - slack, most + slack


# What an anchor looks for: rows of its own label with a product of at least ``floor`` ...
def _wants_positives(asked: pd.DataFrame, zones: pd.DataFrame, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    numbers = {label: i for i, label in enumerate(sorted(set(asked["label"])))}
    has = np.zeros((len(numbers), len(zones)), bool)
    for j, labels in enumerate(zones["labels"]):
        for label in labels:
            if label in numbers:
                has[numbers[label], j] = True
    own = has[asked["label"].map(numbers).to_numpy(int)]
    return own & (most >= asked["floor"].to_numpy()[:, None])


# ... or rows of other labels with a product in one of its windows.
def _wants_negatives(asked: pd.DataFrame, zones: pd.DataFrame, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    one = zones["labels"].map(len).to_numpy() == 1
    first = zones["labels"].map(lambda labels: labels[0]).to_numpy()
    other = ~(one & (first == asked["label"].to_numpy()[:, None]))
    out = np.zeros_like(other)
    for i, windows in enumerate(asked["windows"]):
        for window in windows:
            out[i] |= (most[i] >= window["floor"]) & (least[i] <= window["top"])
    return out & other


def _choose(wants: Callable, scale: int):
    def choose(key, asked: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(zones):
            return pd.DataFrame({"anchors": np.zeros(0, np.int64), "block": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)})
        q = integers(asked["v"], scale)
        width = max(map(len, zones["low"]))
        low, high = (np.stack([np.pad(v, (0, width - len(v))) for v in zones[c]]) for c in ("low", "high"))
        row, column = np.nonzero(wants(asked, zones, *intervals(q, low, high)))
        return pd.DataFrame({"anchors": key[0], "block": zones["block"].to_numpy()[column], "id": asked["id"].to_numpy()[row]})

    return choose


def _best_positives(k: int, scale: int):
    """The ``k`` best rows of the anchor's own label in one block."""
    def solve(key, asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = []
        for i, own, ids, labels, scores in _meetings(asked, data, scale):
            at = np.flatnonzero((labels == own.label) & (ids != own.id))
            at = _first(at, scores[at], k)
            found.append(pd.DataFrame({"anchor_id": own.id, "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "vec_id", "score")})

    return solve


def _best_negatives(k: int, scale: int):
    """The ``k`` best rows of other labels in each window of the anchor, in one block."""
    columns = ("anchor_id", "positive_id", "positive_score", "vec_id", "score")

    def solve(key, asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = []
        for i, own, ids, labels, scores in _meetings(asked, data, scale):
            other = labels != own.label
            for w in own.windows:
                at = np.flatnonzero(other & (scores >= w["low"]) & (scores <= w["top"]))
                at = _first(at, scores[at], k)
                found.append(pd.DataFrame({"anchor_id": own.id, "positive_id": w["positive_id"], "positive_score": w["own"],
                                           "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})

    return solve


def _meetings(asked: pd.DataFrame, data: pd.DataFrame, scale: int):
    """Each anchor with the ids, labels and scores of the block; ids ascend."""
    if not len(asked) or not len(data):
        return
    data = data.sort_values("id", kind="stable")
    ids, labels, x = data["id"].to_numpy(), data["label"].to_numpy(), integers(data["v"], scale)
    step = max(1, _CELLS // len(data))
    for low in range(0, len(asked), step):
        part = asked.iloc[low:low + step]
        scores = products(integers(part["v"], scale), x)
        for i, own in enumerate(part.itertuples(index=False)):
            yield i, own, ids, labels, scores[i]


def _first(at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``at`` with the highest scores; among equal ones those that come first."""
    if len(at) > k:
        least = np.partition(scores, len(at) - k)[len(at) - k]
        at, scores = at[scores >= least], scores[scores >= least]
    return at[np.argsort(-scores, kind="stable")[:k]]


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, best score first; each task cuts its groups before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Mine:
    """Candidates in blocks with their zone maps, and the anchors that ask them."""

    def __init__(self, rows: DataFrame, anchors: Callable[[Column], Column], scale: int):
        rows = materialize(rows, "usable")
        spread = rows.select("v").mapInPandas(_spread, "dimension int, n double, one double, two double, least double, most double")
        # One row per dimension; the components that shorter vectors lack count as zeros.
        by_dimension = spread.groupBy("dimension").agg(
            F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"),
            F.min("least").alias("least"), F.max("most").alias("most")).collect()
        self.empty = not by_dimension
        if self.empty:
            return
        widest = sorted(by_dimension, key=lambda r: (-(r["two"] / r["n"] - (r["one"] / r["n"]) ** 2), r["dimension"]))[:CURVE]
        axes = [(r["dimension"], r["least"], r["most"]) for r in widest]
        vector = rows.schema["v"].dataType.simpleString()
        placed = rows.mapInPandas(_along_curve(axes), f"id long, label long, v {vector}, place long")
        self.scale = scale
        self.vector = vector
        self.blocks = _in_blocks(placed, BLOCK, "block")
        self.zones = materialize(zone_maps(self.blocks, scale), "zones")
        # Anchors keep the order of the curve, so those that meet in a task look for the same blocks.
        self.anchors = _in_blocks(self.blocks.filter(anchors(F.col("id"))).withColumnRenamed("block", "home"), ANCHORS, "anchors").drop("place")

    def at_home(self, asked: DataFrame) -> DataFrame:
        """(anchors, block, id): each anchor with the block in which it lies."""
        return asked.select("anchors", F.col("home").alias("block"), "id")

    def chosen(self, asked: DataFrame, wants: Callable) -> DataFrame:
        """(anchors, block, id): the blocks that each anchor must read by ``wants``. Groups of anchors meet groups of zone maps."""
        n = max(1, -(-self.zones.count() // ZONES))
        zones = self.zones.withColumn("zone_group", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int"))
        # One row per ANCHORS anchors.
        groups = asked.select("anchors").distinct()
        met = groups.select(F.col("anchors").alias("by"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("zone_group"))
        zones = zones.join(met, "zone_group").withColumnRenamed("zone_group", "met")
        asked = asked.withColumn("zone_group", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return asked.groupBy("anchors", "zone_group").cogroup(zones.groupBy("by", "met")).applyInPandas(
            _choose(wants, self.scale), "anchors long, block long, id long")

    def read(self, asked: DataFrame, needs: DataFrame, solve: Callable, schema: str) -> DataFrame:
        """What ``solve`` finds where anchors meet the blocks they need; a block goes to a group of anchors once."""
        wanted = needs.select(F.col("anchors").alias("by"), F.col("block").alias("read")).distinct()
        data = self.blocks.select("id", "label", "v", "block").join(wanted, F.col("block") == F.col("read")).drop("block")
        theirs = asked.drop("home").join(needs, ["anchors", "id"])
        return theirs.groupBy("anchors", "block").cogroup(data.groupBy("by", "read")).applyInPandas(solve, schema)


def hard_negatives(vectors: DataFrame, anchors: Callable[[Column], Column], positives: int = 5, negatives: int = 5,
                   lowest: int = 80, highest: int = 100, label: Callable[[Column, Column], Column] = lambda i, own: own,
                   id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
                   scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row whose id satisfies ``anchors``.

    The score of two rows is the inner product of their integer vectors, floor(scale * x). An anchor's positives are its
    best other rows of the same label; ``label`` may change labels by (id, label). For each positive the best
    rows of other labels count whose score is ``lowest`` to ``highest`` percent of the positive's. Ties go to the
    smaller id. Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; of rows
    that share an id one does. Shorter vectors count as filled up with zeros.

    An anchor first reads its own block of candidates; the scores found there bound what is looked for. Then it
    reads the blocks whose interval of scores meets that. Groups of ``ANCHORS`` anchors meet blocks of ``BLOCK`` rows, so no
    task grows with the data, whatever share of the rows has one label or one vector.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    mine = Mine(usable(vectors, label, id_column, label_column, vector_column), anchors, scale)
    if mine.empty:
        return spark.createDataFrame([], schema)
    pair = "anchor_id long, vec_id long, score long"
    asked = mine.anchors
    at_home = mine.read(asked, mine.at_home(asked), _best_positives(positives, scale), pair)
    # With k positives at home, no better one scores less than the k-th.
    known = at_home.groupBy(F.col("anchor_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= positives, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    bounded = materialize(asked.join(known, "id", "left").withColumn("floor", floor).drop("n", "least"), "floors")
    needs = materialize(mine.chosen(bounded, _wants_positives), "positive-needs")
    best = materialize(_top(mine.read(asked, needs, _best_positives(positives, scale), pair), ["anchor_id"], positives), "positives")

    # A window of scores per positive; nothing lies in it where the positive's score is negative.
    low, top = F.expr(f"(score * {lowest} + 99) div 100"), F.expr(f"score * {highest} div 100")
    open_windows = best.filter("score >= 0").select(
        F.col("anchor_id").alias("id"), F.col("vec_id").alias("positive_id"), low.alias("low"), top.alias("top"), F.col("score").alias("own"))
    window = F.struct("positive_id", "low", "top", "own", F.col("low").cast("double").alias("floor"))
    windows = open_windows.groupBy("id").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    looking = materialize(asked.join(windows, "id"), "windows")
    found = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    keys = ["anchor_id", "positive_id"]
    home = mine.read(looking, mine.at_home(looking), _best_negatives(negatives, scale), found)
    sure = home.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= negatives)
    sure = sure.groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "least"))).alias("sure"))
    raised = F.transform("windows", lambda w: w.withField("floor", F.coalesce(
        F.try_element_at("sure", w["positive_id"]).cast("double"), w["floor"])))
    narrowed = materialize(looking.join(sure, "id", "left").withColumn("windows", raised).drop("sure"), "narrowed")
    needs = materialize(mine.chosen(narrowed, _wants_negatives), "negative-needs")
    mined = _top(mine.read(narrowed, needs, _best_negatives(negatives, scale), found), keys, negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))
