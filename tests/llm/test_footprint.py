"""What a task holds and writes, besides its results."""

import gc
import os
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import minhash_dedup, substring_dedup


def test_sketches_hold_pieces_and_not_batches():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(10**6)}" for _ in range(300)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in minhash_dedup._sketch_batches(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and peak < 64 << 20


def test_passages_write_keys_once_and_number_items(spark, monkeypatch):
    written = {}

    def spy(df, label):
        written.setdefault(label, dict(df.dtypes))
        return kept(df, label)

    kept = substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", spy)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, f"before {text}"), (3, text.replace("w30", "other"))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 2 in {r.id for r in found}
    assert "smallest" not in written["items"]
    assert written["shingles"]["item"] == written["postings"]["item"] == "bigint"


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{top}/{name}" for folder in folders for top, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    gc.collect()
    before = shuffle_files(spark)
    rows = spark.range(100000).repartition(7).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    written = session.materialize(rows, "sums")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert written.count() == 1000 and written.agg(F.sum("s")).first()[0] == sum(range(100000))


def test_passing_tables_go_and_kept_ones_stay(spark, monkeypatch):
    paths = {}
    kept_workspace = session.workspace
    monkeypatch.setattr(session, "workspace", lambda s, label: paths.setdefault(label, kept_workspace(s, label)))
    with session.passing(spark, but=("d",)):
        session.materialize(spark.range(3), "a")
        with session.passing(spark, but=("c", "d")):
            session.materialize(spark.range(4), "b")
            held = session.materialize(spark.range(5), "c")
            stays = session.materialize(spark.range(6), "d")
        assert held.count() == 5 and not os.path.exists(paths["b"])
    assert stays.count() == 6
    assert [os.path.exists(paths[x]) for x in "abcd"] == [False, False, False, True]


def test_passages_keep_only_the_tables_still_read(spark, monkeypatch):
    paths = []

    def spy(s, label):
        paths.append((label, kept(s, label)))
        return paths[-1][1]

    kept = session.workspace
    monkeypatch.setattr(session, "workspace", spy)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, f"before {text}"), (2, f"before {text}"), (3, text.replace("w30", "other"))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 2 in {r.id for r in found.collect()}
    assert {label for label, path in paths if os.path.exists(path)} == {"places", "clusters", "runs", "contexts"}


def test_few_shared_keys_are_no_candidates_and_no_link_is_lost(spark):
    rng = random.Random(3)

    def fresh(n):
        return {rng.randrange(1 << 62) for _ in range(n)}

    sets = []
    for _ in range(80):
        one = fresh(rng.choice([12, 13, 15, 16, 16, 16]))
        sets.append(one)
        # Linked copies of all sizes.
        for _ in range(3):
            left = set(rng.sample(sorted(one), rng.randrange(11, len(one) + 1)))
            sets.append(left | fresh(rng.randrange(0, 17 - len(left))))
    # Sets that share their smallest value only; before, they stayed.
    alone = range(len(sets), len(sets) + 40)
    sets += [fresh(15) | {i // 2} for i in range(40)]
    linked = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= 75 * len(a | b)}
    rows = []
    for i, one in enumerate(sets):
        shingles = np.array([(sorted(one) * 2)[:16]], np.uint64)
        rows.append((i, 0, i.to_bytes(16, "big"), substring_dedup.smallest(shingles)[0].view(np.int64).tolist(), len(one) < 16))
    rows = spark.createDataFrame(rows, "id long, word int, item binary, smallest array<bigint>, short boolean")
    items = rows.select("item", F.struct("id", "word").alias("first"))
    met = {r.id for r in substring_dedup._met(rows.union(rows), items).collect()}
    assert len(linked) > 100 and linked <= met
    assert not met & set(alone)
