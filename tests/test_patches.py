"""Patches against a plain loop over them in order."""

import random

import pytest
from pyspark.errors import PySparkException

from tidemark.operators import patches as ops
from tidemark.operators import skew

TABLE = "k string, a int, b string"
PATCH = "k string, version string, seq long, named array<string>, after struct<a: int, b: string>"


def patched(rows, patches):
    state = {r[0]: [r[1], r[2]] for r in rows}
    before = {}
    for k, version, seq, named, after in sorted(patches, key=lambda p: p[1:3]):
        if k in state:
            before[k, version, seq] = tuple(state[k][i] if c in (named or []) else None for i, c in enumerate("ab"))
            for i, c in enumerate("ab"):
                if c in (named or []):
                    state[k][i] = after[i]
    return {(k, *v) for k, v in state.items()}, before


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    rows = [(f"k{i}", i, None if i % 4 == 0 else f"b{i}") for i in range(12)]
    # One key holds a third of all patches; k12 to k14 are not in the table.
    patches = []
    for n in range(150):
        k = "k0" if n % 3 == 0 else f"k{rng.randrange(15)}"
        named = rng.choice([["a"], ["b"], ["a", "b"], [], None, ["b", "b"]])
        after = (rng.choice([None, n]), rng.choice([None, f"p{n}"]))
        patches.append((k, f"24010{1 + n // 50}_000000", n, named, after))
    return rows, patches


def test_apply_and_record(spark, made):
    rows, patches = made
    table, given = spark.createDataFrame(rows, TABLE), spark.createDataFrame(patches, PATCH)
    assert given.schema.simpleString() == ops.patch_schema(table.schema, ["k"]).simpleString()
    now, before = patched(rows, patches)
    assert {tuple(r) for r in ops.apply_patches(table, given, ["k"]).collect()} == now
    recorded = ops.with_before(table, given, ["k"])
    assert {(r.k, r.version, r.seq): tuple(r.before or (None, None)) for r in recorded.collect()} == before


@pytest.mark.parametrize("kept", [0, 50, 100, 150])
def test_revert_gives_each_state(spark, made, kept):
    rows, patches = made
    table, given = spark.createDataFrame(rows, TABLE), spark.createDataFrame(patches, PATCH)
    now = ops.apply_patches(table, given, ["k"])
    back = ops.revert_patches(now, ops.with_before(table, given, ["k"]).filter(f"seq >= {kept}"), ["k"])
    assert {tuple(r) for r in back.collect()} == patched(rows, patches[:kept])[0]


def test_each_patch_and_each_row_is_one_point(spark, made, monkeypatch):
    """The sort sees one row per patch and one per patched row of the table, whatever number of columns they name."""
    rows, patches = made
    table, given = spark.createDataFrame(rows, TABLE), spark.createDataFrame(patches, PATCH)
    sorted_rows, in_parts = [], skew._in_parts

    def counted(df, keys, order):
        sorted_rows.append(df.count())
        return in_parts(df, keys, order)

    monkeypatch.setattr(skew, "_in_parts", counted)
    own = [p for p in patches if p[0] in {r[0] for r in rows}]
    recorded = ops.with_before(table, given, ["k"])
    assert recorded.count() == len(own) and sorted_rows == [len(own) + len({p[0] for p in own})]
    now, before = patched(rows, patches)
    assert {(r.k, r.version, r.seq): tuple(r.before or (None, None)) for r in recorded.collect()} == before


def test_a_patch_without_version_comes_before_the_row(spark):
    table = spark.createDataFrame([("x", 1, "y")], TABLE)
    given = spark.createDataFrame([("x", None, None, ["a"], (None, None)), ("x", "v", 1, ["a"], (5, None))], PATCH)
    recorded = {r.version: r.before for r in ops.with_before(table, given, ["k"]).collect()}
    assert recorded[None] is None and recorded["v"].a == 1


def test_empty_null_and_unknown(spark):
    table = spark.createDataFrame([("x", 1, "y"), (None, 2, "z")], TABLE)
    none = spark.createDataFrame([], PATCH)
    rows = {("x", 1, "y"), (None, 2, "z")}
    assert {tuple(r) for r in ops.apply_patches(table, none, ["k"]).collect()} == rows
    assert ops.with_before(table, none, ["k"]).count() == 0
    unnamed = spark.createDataFrame([(None, "v", 1, ["a"], (9, None))], PATCH)
    assert {tuple(r) for r in ops.apply_patches(table, unnamed, ["k"]).collect()} == rows
    assert ops.apply_patches(table.limit(0), unnamed, ["k"]).count() == 0
    wrong = spark.createDataFrame([("x", "v", 1, ["c"], (9, None))], PATCH)
    with pytest.raises(PySparkException, match="no such column to patch"):
        ops.apply_patches(table, wrong, ["k"]).collect()
