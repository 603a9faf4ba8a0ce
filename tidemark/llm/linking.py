"""Exact links between sets that share an index key, without emitting all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import local_frame, materialize
from .components import components


#: Keys of an item that go with each of its rows, one per hash slot, so that their number is bounded.
CARRIED = 32


def similar(a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, for arrays without repetitions."""
    shared = F.size(F.array_intersect(a, b))
    return F.lit(100) * shared >= F.lit(percent) * (F.size(a) + F.size(b) - shared)


def linked_components(members: DataFrame, check: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(item, component) of every item of ``members`` (key, item, n[, left]); one without a link is its own component.

    ``left`` is the number of values of the item that others have too, from ``key`` on in the order of the keys (``n``
    if not given). A pair
    shares no more than the smaller ``left`` at its first common key, so a pair that is compared there or nowhere loses
    no link. Two items are compared when they share a key, ``left`` and their sizes ``n`` allow ``percent``, and no
    chain of links joins them yet. ``check`` takes pairs (a, b, ...) and adds the boolean ``linked``.

    Each round names one leader per key and hash slot, sixteen times as many slots as the round before.
    Every other member of the key is compared with the leaders outside its component. A leader
    has then met its whole key, so it leaves the key; a key whose members have become one
    component leaves altogether. The rounds end when no key holds two components, so the
    components are those of comparing all pairs. A key of n copies of one text costs n
    comparisons, and only a key whose members are truly unlike each other needs more. Items that share
    many keys meet in the first of them: every row carries the ``CARRIED`` first keys of its
    item, and a join row with a smaller common one is not made. A pair beyond those may meet
    again and is found out by its ids.
    """
    item_type = members.schema["item"].dataType.simpleString()
    if "left" not in members.columns:
        members = members.withColumn("left", F.col("n"))
    tried = local_frame(members.sparkSession, f"a {item_type}, b {item_type}")
    firsts = (
        members.groupBy("item", F.pmod(F.xxhash64("key"), F.lit(CARRIED)).alias("slot")).agg(F.min("key").alias("first"))
        .groupBy("item").agg(F.array_sort(F.collect_set("first")).alias("firsts"))
    )
    active = members.join(firsts, "item").select("key", "item", "n", "left", "firsts", F.col("item").alias("component"))
    known = members.select("item", F.col("item").alias("component")).distinct()
    turn = 0
    while True:
        open_keys = (
            active.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .filter(F.col("low") != F.col("high")).select("key")
        )
        active = materialize(active.join(open_keys, "key", "left_semi"), "members")
        if active.isEmpty():
            return known
        slot = F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(1 << min(4 * turn, 20)))
        leaders = materialize(
            active.groupBy("key", slot.alias("slot"))
            .agg(F.min(F.struct("item", "component", "n", "left", "firsts")).alias("leader"))
            .select("key", F.col("leader.item").alias("leader"), F.col("leader.component").alias("its_component"),
                    F.col("leader.n").alias("its_n"), F.col("leader.left").alias("its_left"), F.col("leader.firsts").alias("its_firsts")), "leaders")
        pairs = (
            active.join(leaders, "key")
            .filter((F.col("component") != F.col("its_component"))
                    & (100 * F.least("n", "its_n") >= percent * F.greatest("n", "its_n"))
                    # The intersection of a linked pair is percent / (100 + percent) of both sizes together.
                    & ((100 + percent) * F.least("left", "its_left") >= percent * (F.col("n") + F.col("its_n")))
                    & (F.coalesce(F.array_min(F.array_intersect("firsts", "its_firsts")), F.col("key")) >= F.col("key")))
            .select(F.least("item", "leader").alias("a"), F.greatest("item", "leader").alias("b"),
                    F.least("component", "its_component").alias("low"), F.greatest("component", "its_component").alias("high"))
            .distinct()
        )
        checked = materialize(check(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        tried = tried.union(checked.select("a", "b"))
        active = active.join(leaders.select("key", F.col("leader").alias("item")), ["key", "item"], "left_anti")
        joined = checked.filter("linked").select(F.col("low").alias("a"), F.col("high").alias("b"))
        if not joined.isEmpty():
            # Components grow together: only they, not all links so far, are followed.
            moved = components(joined).select(F.col("item").alias("component"), F.col("component").alias("now"))
            known, active = (
                rows.join(moved, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
                for rows in (known, active)
            )
            known = materialize(known.select("item", "component"), "known")
        turn += 1
