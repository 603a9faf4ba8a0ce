"""Passage quality, hard negatives and fill-in-middle: against brute force, plain loops and round trips."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, hard_negatives, passage_quality, sampling, toxicity

from ..conftest import SF_DIR
from .test_llm import AWKWARD, FIELDS

# A clash for every column that the operators make.
CLASHES = "n long, form string, output string, score double, label int, bag string, block long, place long, anchors long, v string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, s, "clash", 7, "clash", 1, "f", "o", 0.5, 1, "b", 2, 3, 4, "v") for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, f"{FIELDS}, {CLASHES}")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], f"{FIELDS}, {CLASHES}")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


# samples and labels

@pytest.mark.parametrize("rows,n", [(0, 5), (40, 40), (5000, 300), (5000, 3)])
def test_smallest_hashes(spark, rows, n):
    ids = spark.range(rows).withColumnRenamed("id", "key")
    got = {r.key for r in sampling.smallest_hashes(ids, "key", n, seed=1).collect()}
    assert len(got) <= n and len(got) >= min(rows, n) * 15 // 16
    place = {r.key: r.h for r in ids.withColumn("h", sampling._place(F.col("key"), 1)).collect()}
    assert all(place[g] < place[k] for g in got for k in place if k not in got)


def test_settled_labels(spark):
    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (3, 0), (None, 1), (4, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {(r.id, r.label) for r in sampling.settled_labels(labels, "doc_id", "quality").collect()}
    assert got == {(1, 1), (3, 0)}


# op 11

def test_gradients_of_the_attention():
    rng = np.random.default_rng(4)
    q = passage_quality.new_parameters()
    bounds = np.array([0, 1, 4, 9])
    x, label = rng.normal(0, 1, (9, passage_quality.WIDTH)), np.array([1.0, 0.0, 1.0])
    _, g = passage_quality.gradients(q, x, bounds, label)
    for name, own in g.items():
        flat = q[name].reshape(-1)
        for at in {0, len(flat) // 2, len(flat) - 1}:
            was = flat[at]
            flat[at] = was + 1e-5
            up = passage_quality.gradients(q, x, bounds, label)[0]
            flat[at] = was - 1e-5
            down = passage_quality.gradients(q, x, bounds, label)[0]
            flat[at] = was
            assert (up - down) / 2e-5 == pytest.approx(own.reshape(-1)[at], abs=1e-6)


def plain_features(text):
    """The passages' numbers in plain Python, but for the histogram of shapes."""
    text = text or ""
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    data = text.encode()
    lower = [data[a:b].translate(bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])) for a, b in spans]
    single = [w in lower[:i] for i, w in enumerate(lower)]
    threes = [tuple(lower[i:i + 3]) for i in range(max(0, len(lower) - 2))]
    triple = [t in threes[:i] for i, t in enumerate(threes)] + [False] * min(2, len(lower))
    rows = []
    for at in range(0, max(1, len(lower)), passage_quality.PASSAGE):
        own = spans[at:at + passage_quality.PASSAGE]
        if not own:
            rows.append([0.0] * passage_quality.STATISTICS)
            continue
        piece = data[own[0][0]:own[-1][1]]
        n = len(own)
        kinds = [sum(65 <= b <= 90 for b in piece), sum(48 <= b <= 57 for b in piece),
                 sum(32 < b < 127 and not chr(b).isalnum() for b in piece), piece.count(b"\n")]
        sizes = [min(40, b - a) for a, b in own]
        rows.append([*(k / len(piece) for k in kinds), sum(sizes) / n / 10, sum(s * s for s in sizes) / n / 100,
                     sum(single[at:at + n]) / n, sum(triple[at:at + n]) / n, n / passage_quality.PASSAGE,
                     np.log2(1 + len(lower)) / 16])
    return rows


def plain_score(q, x):
    """Gated attention over one bag, passage by passage."""
    codes, pulls = [], []
    for row in x:
        h = np.tanh(((row - q["mean"]) / q["spread"]) @ q["e"] + q["c"])
        codes.append(h)
        pulls.append(sum(a * np.tanh(h @ v) / (1 + np.exp(-(h @ u))) for a, v, u in zip(q["a"], q["v"].T, q["u"].T)))
    weights = np.exp(np.array(pulls) - max(pulls))
    pool = sum(w * h for w, h in zip(weights / weights.sum(), codes))
    return 1 / (1 + np.exp(-(pool @ q["o"] + q["b"][0])))


def test_scores_like_plain_loops(spark, docs):
    q = passage_quality.new_parameters()
    rows = docs.select("doc_id", "text").orderBy(F.desc(F.length("text"))).limit(40).collect()
    texts = [r.text for r in rows] + [None, "", " \n ", "A one-word-text"]
    x, bounds = passage_quality.features(pa.array(texts, pa.string()))
    want = [plain_features(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    assert np.allclose(x[:, :passage_quality.STATISTICS], np.concatenate(want), atol=1e-5)
    words = np.array([w[8] * passage_quality.PASSAGE for b in want for w in b])
    assert np.allclose(x[:, passage_quality.STATISTICS:].sum(1), words > 0, atol=1e-5)
    got = {r.id: r.score for r in passage_quality.scores(docs, q).collect()}
    for i, r in enumerate(rows):
        assert got[r.doc_id] == pytest.approx(plain_score(q, x[bounds[i]:bounds[i + 1]]), abs=1e-9)


def test_quality_is_learned(spark):
    """Only whole documents are labelled: a bad one has one passage of junk among good ones, which attention finds."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(300)]
    rows = []
    for i in range(600):
        text = [" ".join(rng.choices(words, k=passage_quality.PASSAGE)) for _ in range(rng.randrange(2, 7))]
        if i % 3 == 0:
            text[rng.randrange(len(text))] = " ".join(w + "###" for w in rng.choices(words, k=passage_quality.PASSAGE))
        rows.append((i, " ".join(text), int(i % 3 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    q = passage_quality.train(df, df.filter("doc_id < 450").select("doc_id", "quality"))
    got = {r.id: r.score for r in passage_quality.scores(df, q).collect()}
    assert sum((got[i] >= 0.5) == bool(label) for i, _, label in rows[450:]) >= 145
    for i, text, label in rows[450:480]:
        if not label:
            weights = passage_quality.attention(q, text)
            junk = ["###" in p for p in re.findall(r"(?:\S+ ?){1,64}", text)]
            assert weights.argmax() == junk.index(True)
    again = passage_quality.train(df.repartition(3), df.filter("doc_id < 450").select("doc_id", "quality").repartition(2))
    assert all(np.allclose(q[k], again[k]) for k in q)


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 1), (6, None), (9, 0), (9, 0), (10, 5), (4, 0)], "doc_id long, quality int")
    q = passage_quality.train(awkward, labels)
    got = passage_quality.scores(awkward, q).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id == 4}) == 1
    assert {round(r.score, 9) for r in got if r.id == 1} == {round(r.score, 9) for r in got if r.id == 2}
    assert passage_quality.train(awkward, labels.filter("quality = 1")) is None
    assert passage_quality.train(nothing, labels) is None
    assert passage_quality.scores(nothing, q).count() == 0
    assert {r.score for r in passage_quality.scores(awkward, None).collect()} == {0.5}


# op 12

@pytest.mark.parametrize("d,bits", [(2, 4), (3, 2), (4, 2), (8, 1)])
def test_hilbert_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    index = hard_negatives.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_intervals_hold_all_products():
    rng = np.random.default_rng(6)
    q = rng.integers(-9, 9, (20, 5)).astype(float)
    blocks = [rng.integers(-9, 9, (30, 5)) + rng.integers(-20, 20, 5) for _ in range(6)]
    low, high = (np.array([f(b, axis=0) for b in blocks], float) for f in (np.min, np.max))
    least, most = hard_negatives.intervals(q, low, high)
    for j, block in enumerate(blocks):
        scores = q @ block.T
        assert (scores.min(1) >= least[:, j]).all() and (scores.max(1) <= most[:, j]).all()


def brute(rows, is_anchor):
    """Hard negatives of (id, label, v) in plain Python; a null or odd row takes no part, of equal ids the smallest row does."""
    by_id = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            by_id[i] = min(by_id.get(i, (label, v)), (label, v))
    whole = {i: (label, [int(np.floor(256.0 * x)) for x in v]) for i, (label, v) in by_id.items()}
    out = set()
    for a in filter(is_anchor, whole):
        own, q = whole[a]
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, (label, v) in whole.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == own][:5]:
            hard = [(n, t) for t, n, label in scores if label != own and 80 * -s <= 100 * -t <= 100 * -s]
            out |= {(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(hard[:5])}
    return out


VECTORS = "vec_id long, label int, embedding array<double>, block string, place string, anchors string"


def mined(spark, rows, is_anchor=lambda i: i % 10 == 0):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(df, is_anchor).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_hard_negatives_of_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, 1, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(200 + i, 2, [0.4, 0.5, 0.5, 0.5]) for i in range(40)]
    rows += rows[:30] + [(7, 0, [9.0] * 4), (300, 1, [0.25, 0.5]), (310, 2, [1e3] * 4), (320, 0, [0.0] * 4)]
    rows += [(None, 1, [1.0] * 4), (401, None, [1.0] * 4), (402, 1, None), (403, 1, []), (404, 1, [None, 1.0]),
             (405, 1, [float("nan"), 1.0]), (406, 1, [float("-inf"), 1.0])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == mined(spark, [(1, None, [1.0])]) == mined(spark, [(10, 1, [1.0])]) == set()


def test_zone_maps_skip_blocks(spark, monkeypatch):
    """On clustered vectors with a hot one, blocks that cannot hold an answer are not read, and nothing is lost."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "ZONES", 16)
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (12, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, int(rng.integers(2)), (centres[i % 12] + rng.normal(0, 0.02, 6)).tolist()) for i in range(1800)]
    rows += [(2000 + i, 3, centres[0].tolist()) for i in range(900)]
    read = []
    chosen = hard_negatives.Mine.chosen

    def counted(self, asked, wants):
        found = chosen(self, asked, wants)
        read.append((found.count(), asked.count() * self.zones.count()))
        return found

    monkeypatch.setattr(hard_negatives.Mine, "chosen", counted)
    is_anchor = lambda i: i % 100 == 0
    assert mined(spark, rows, is_anchor) == brute(rows, is_anchor)
    assert all(n < 0.35 * every for n, every in read), read


# op 13

def arranged(identity, text):
    """The plan and output of one text, by the definition."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if identity is None else identity}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


MARKED = [(20, "a\n<S>b\nc"), (21, "<P"), (22, "x\n" * 50_000 + "<M"), (23, "é \U0001f600\r\nb\n\n"), (24, "\n"), (25, "y" * 100_000 + "\nz"),
          (26, "S>\n<\nP>\n<"), (27, "\x00\n\x00")]


@pytest.mark.parametrize("piece", [1 << 15, 3])
def test_fill_in_middle(spark, awkward, nothing, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    texts = [(i, t) for i, t, _ in AWKWARD] + MARKED + [(30, "l1\nl2\n")] * 50
    if piece == 3:
        texts = [(i, t) for i, t in texts if len(t or "") < 10_000]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = sorted(map(str, [(i, *arranged(i, t)) for i, t in texts]))
    outputs = fill_middle.fill_in_middle(df)
    assert sorted(str(tuple(r)) for r in outputs.collect()) == want
    back = fill_middle.restored(outputs)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t in texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [(i, *arranged(i, t)[:4], sha(arranged(i, t)[4]), sha(t or "")) for i, t in texts]
    assert sorted(map(str, map(tuple, fill_middle.digests(df).collect()))) == sorted(map(str, digests))
    assert fill_middle.digests(awkward).count() == len(AWKWARD)
    assert fill_middle.digests(nothing).count() == fill_middle.fill_in_middle(nothing).count() == 0


def test_share_of_changed_texts(spark, docs):
    forms = {r.form: r["count"] for r in fill_middle.digests(docs, rate=40, spm=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 0.25 < forms["psm"] / sum(forms.values()) < 0.55


def test_outputs_that_do_not_fit_their_form(spark):
    odd = spark.createDataFrame([(1, "psm", "<S>a<P>b<M>c")], "id long, form string, output string")
    with pytest.raises(Exception, match="does not fit"):
        fill_middle.restored(odd).collect()


def test_restoring_needs_no_second_shuffle(docs):
    """The second sort finds its rows where they are: one shuffle in the whole lineage."""
    lineage = fill_middle.digests(docs)._jdf.queryExecution().toRdd().toDebugString()
    assert lineage.count("ShuffledRDD") == 1


# op 10: the scorer by plain loops, and labels that repeat or contradict

def plain_toxicity(network, text):
    """The highest logit over all windows, one word and one cell at a time."""
    rows, _ = toxicity.word_rows(pa.array([text], pa.large_string()))
    q, n = network.parameters, len(rows)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    best = -np.inf
    starts = [0] if n <= toxicity.WINDOW else list(range(0, n - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE))
    for start in starts:
        x = [sum(network.table[r] for r in row) for row in rows[start:start + toxicity.WINDOW]]
        states = {}
        for way in ("f", "g"):
            h, found = np.zeros(toxicity.HIDDEN), [None] * len(x)
            for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
                a, b = x[t] @ q[way + "x"] + q[way + "c"], h @ q[way + "u"]
                k = toxicity.HIDDEN
                z, r = sigmoid(a[:k] + b[:k]), sigmoid(a[k:2 * k] + b[k:2 * k])
                h = (1 - z) * np.tanh(a[2 * k:] + r * b[2 * k:]) + z * h
                found[t] = h
            states[way] = found
        both = [np.concatenate(p) for p in zip(states["f"], states["g"])]
        pulls = np.array([np.tanh(h @ q["a"]) @ q["v"] for h in both])
        weights = np.exp(pulls - pulls.max()) / np.exp(pulls - pulls.max()).sum()
        best = max(best, sum(w * h for w, h in zip(weights, both)) @ q["w"] + q["b"][0])
    return best


def test_windows_like_plain_loops(docs):
    rng = np.random.default_rng(5)
    network = toxicity.Network.new(rng.normal(0, 1, sum(toxicity.BUCKETS)).astype(np.float32))
    texts = [r.text for r in docs.orderBy("doc_id").limit(12).collect()] + ["one", "a b c, d."]
    texts = [" ".join(t.split()[:150]) for t in texts]
    got = network.scores(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_toxicity(network, t) for t in texts], atol=1e-4)


def test_repeated_and_contradicting_labels(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=30) + ["vile"] * (2 * (i % 3 == 0))), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    odd = labels.union(labels).union(spark.createDataFrame([(500, 0), (500, 1), (None, 1), (501, None), (502, 7)], "doc_id long, toxic int"))
    more = df.union(spark.createDataFrame([(500, "vile vile", 0), (3, "zzz", 1)] * 50, df.schema)).repartition(5)
    once, again = toxicity.train(df.union(more.filter("text = 'zzz'")), labels), toxicity.train(more, odd)
    texts = pa.array(["w1 w2 vile", "w3 w4"], pa.string())
    a, b = once.probability(texts), again.probability(texts)
    assert a[0] > 0.5 > a[1] and b[0] > 0.5 > b[1]
    assert np.allclose(b, toxicity.train(more.repartition(2), odd.repartition(3)).probability(texts), atol=1e-5)
