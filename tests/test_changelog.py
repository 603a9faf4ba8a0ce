"""Random command sequences against a plain Python model."""

import random

import pytest

from tidemark.operators.changes import change_schema
from tidemark.sources.batches import AlreadyApplied, BatchStore, NotApplied, Refused
from tidemark.sources.changelog import ChangeLog, TrackedTable

ROW = "id bigint, v string"
BASE = {1: "a", 2: "b", 3: "c"}
VERSIONS = [f"24010{i}_000000_v{i}" for i in range(1, 6)]
# Each version sets or removes some keys.
EDITS = [{1: "A", 4: "d"}, {2: None}, {4: None, 5: "e"}, {2: "B", 1: None}, {3: "C"}]


@pytest.fixture
def log(spark, folder):
    base = spark.createDataFrame(list(BASE.items()), ROW)
    log = ChangeLog(BatchStore(spark, folder), {"t": TrackedTable(base, ["id"])})
    schema = change_schema(base.schema, ["id"])
    for n, (version, edit) in enumerate(zip(VERSIONS, EDITS)):
        rows = [(k, version, 10 * n + i, "delete" if v is None else "update", (k, "?"), None if v is None else (k, v))
                for i, (k, v) in enumerate(edit.items())]
        log.add(version, {"t": spark.createDataFrame(rows, schema)})
    return log


class Model:
    def __init__(self):
        self.done = {}  # version -> apply time

    def pending(self):
        return [v for v in VERSIONS if v not in self.done]

    def newest(self):
        return sorted(self.done, key=lambda v: (self.done[v], v), reverse=True)

    def apply(self, versions, at, step=1):
        for i, v in enumerate(versions):
            self.done[v] = at + i * step

    def revert(self, versions):
        for v in versions:
            del self.done[v]

    def run(self, command, arg, at):
        if command == "up":
            self.apply(self.pending()[:arg], at)
        elif command == "down":
            self.revert(self.newest()[:arg])
        elif command == "redo":
            last = self.newest()[:arg]
            self.revert(last)
            self.apply(last[::-1], at)
        elif command == "release":
            self.apply(self.pending(), at, 0)
        elif command == "rollback":
            if self.done:
                self.revert([v for v in self.done if self.done[v] == max(self.done.values())])
        elif arg[:13] in {v[:13] for v in self.done}:
            self.revert([v for v in self.done if v[:13] > arg[:13]])
        else:
            self.apply([v for v in self.pending() if v[:13] <= arg[:13]], at)

    def rows(self):
        state = dict(BASE)
        for v, edit in zip(VERSIONS, EDITS):
            if v in self.done:
                state.update(edit)
        return {k: v for k, v in state.items() if v is not None}


@pytest.mark.parametrize("seed", range(3))
def test_random_commands(log, seed):
    rng, model = random.Random(seed), Model()
    for i in range(8):
        command = rng.choice(["up", "down", "redo", "release", "rollback", "to"])
        if i % 3 == 2:
            log.fold(rng.choice([None, *VERSIONS]))
            assert {r.id: r.v for r in log.rows("t").collect()} == model.rows(), (seed, i)
        arg = rng.choice(VERSIONS + ["240103_120000", "240101_000000"]) if command == "to" else rng.choice([1, 2, None])
        at = 100 * (i + 1)
        model.run(command, arg, at)
        call = getattr(log, command)
        if command == "to":
            call(arg, apply_time=at)
        elif command == "release":
            call(apply_time=at)
        elif command == "rollback":
            call()
        elif command == "down":
            call(arg)
        else:
            call(arg, apply_time=at)
        assert {r.version: r.apply_time for r in log.applied().collect()} == model.done, (seed, i, command, arg)
    assert {r.id: r.v for r in log.rows("t").collect()} == model.rows()
    assert [r.version for r in log.pending().collect()] == model.pending()
    assert [r.version for r in log.history(None).collect()] == model.newest()


def test_bad_versions_and_counts(log):
    for version in ("nonsense", "000000_000000_base", "990101_000000_later"):
        with pytest.raises(Refused):
            log.add(version, {})
    for call in (log.up, log.down, log.redo):
        with pytest.raises(ValueError):
            call(0)


def test_single_versions(log):
    with pytest.raises(Refused, match="not defined"):
        log.apply("240109_000000_v9")
    log.apply(VERSIONS[2], 10)
    with pytest.raises(AlreadyApplied):
        log.apply(VERSIONS[2], 11)
    assert {r.id: r.v for r in log.rows("t").collect()} == {1: "a", 2: "b", 3: "c", 5: "e"}
    log.revert(VERSIONS[2])
    with pytest.raises(NotApplied):
        log.revert(VERSIONS[2])


def test_folds_are_used_only_while_they_fit(log):
    log.up(3, 10)
    assert log.fold() == 1
    assert log._best_fold({*VERSIONS[:2]}) == (1, set(VERSIONS[:2]))
    log.apply(VERSIONS[4], 20)
    assert log._best_fold({VERSIONS[0], VERSIONS[1], VERSIONS[4]})[0] == 1
    assert log._best_fold({VERSIONS[0], VERSIONS[2]}) == (None, set())
    log.revert(VERSIONS[1])
    assert {r.id: r.v for r in log.rows("t").collect()} == {1: "A", 2: "b", 3: "C", 5: "e"}
    with pytest.raises(Refused, match="part of a fold"):
        log.add(VERSIONS[1], {})


def test_an_applied_version_is_not_staged_again(spark, log):
    log.up(1, 10)
    with pytest.raises(AlreadyApplied):
        log.add(VERSIONS[0], {"t": log.store.staged("t", log.tables["t"].base.schema)})
    log.down()
    log.add(VERSIONS[0], {})


def test_a_version_staged_in_part_is_not_defined(spark, log):
    log.store.stage("t", spark.createDataFrame([], log.store.staged("t", log.tables["t"].base.schema).schema), "240106_000000_v6")
    assert log.pending().count() == len(VERSIONS)
    assert log.up() == VERSIONS and log.up() == []


def test_very_many_versions_are_read_and_folded(log):
    log.up(2, 10)
    log.store.commit([f"230101_{n:06d}_old" for n in range(100_001)], 5)
    want = {1: "A", 3: "c", 4: "d"}
    assert {r.id: r.v for r in log.rows("t").collect()} == want
    assert log.fold() == 1
    assert {r.id: r.v for r in log.rows("t").collect()} == want
    assert log._fitting_fold(log.applied())[0] == 1


def test_a_command_is_one_commit(log):
    def commits():
        return log.store.commits().select("n").distinct().count()

    for n, call in enumerate((lambda: log.up(None, 10), lambda: log.redo(3, 100), lambda: log.down(4), lambda: log.up(2, 200),
                              lambda: log.to(VERSIONS[0])), 1):
        call()
        assert commits() == n
    assert log.down(1) == VERSIONS[:1] and log.down(1) == [] and commits() == 6


@pytest.mark.parametrize("command", ["up", "release", "down", "rollback", "redo"])
def test_a_command_that_was_overtaken_is_refused(log, command):
    log.up(2, apply_time=10)
    owner, name = (log.store, "newest") if command == "rollback" else (log, "_versions")
    read = getattr(owner, name)

    def late(*args):
        found = read(*args)
        setattr(owner, name, read)
        # A release would meet another's version by itself, so there a version is taken back meanwhile.
        log.revert(VERSIONS[1]) if command == "release" else log.apply(VERSIONS[3], apply_time=50)
        return found

    setattr(owner, name, late)
    with pytest.raises(Refused, match="start over"):
        getattr(log, command)(*[1] if command == "up" else [])
    left = VERSIONS[:1] if command == "release" else [*VERSIONS[:2], VERSIONS[3]]
    assert sorted(r.version for r in log.applied().collect()) == left
