import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import ledger_state as state
from tidemark.plans import steps
from tidemark.sources.ledger import Ledger, from_properties, to_properties


@pytest.fixture
def ledger(spark, folder):
    made = Ledger(spark, f"{folder}/ledger")
    made.initialize(apply_time=0)
    return made


def keys(spark, *versions, scope="s"):
    return spark.createDataFrame([(scope, v) for v in versions], "scope string, version string")


def versions(df):
    return [r.version for r in df.orderBy("version").collect()]


A, B, C = "240101_000000_aa", "240102_000000_bb", "240103_000000_cc"


def test_base_plus_applied(spark, ledger):
    ledger.record(keys(spark, A, B), 100)
    assert versions(ledger.applied()) == [state.BASE_VERSION, A, B]
    assert versions(state.history(ledger.applied(), None)) == [A, B]
    assert [r.version for r in state.history(ledger.applied(), 1).collect()] == [B]


def test_second_initialisation_does_nothing(spark, ledger):
    ledger.record(keys(spark, A), 100)
    assert ledger.initialize() is False
    assert versions(ledger.applied()) == [state.BASE_VERSION, A]


def test_unfinished_first_write_is_no_ledger(spark, folder):
    rows = spark.range(1).select(F.lit("x").alias("version"))
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/l/g=000000")
    made = Ledger(spark, f"{folder}/l")
    assert not made.exists() and made.log().isEmpty()
    with pytest.raises(ValueError, match="not initialised"):
        made.record(keys(spark, A), 1)
    assert made.initialize(0) and versions(made.applied()) == [state.BASE_VERSION]


def test_tombstone_in_a_later_month_wins(spark, ledger):
    ledger.record(keys(spark, A, B), 1_700_000_000)
    ledger.remove(keys(spark, A), 1_710_000_000)
    assert versions(ledger.applied()) == [state.BASE_VERSION, B]
    ledger.record(keys(spark, A), 1_720_000_000)
    assert versions(ledger.applied()) == [state.BASE_VERSION, A, B]


def test_equal_seconds_are_ordered_by_seq(spark, ledger):
    ledger.record(keys(spark, A), 50)
    ledger.remove(keys(spark, A), 50)
    assert versions(ledger.applied()) == [state.BASE_VERSION]


def test_compaction_and_purge_keep_the_answer(spark, ledger):
    ledger.record(keys(spark, A, B, C), 100)
    ledger.remove(keys(spark, B), 200)
    before = versions(ledger.applied())
    old = ledger.log()
    ledger.compact()
    assert versions(ledger.applied()) == before and ledger.log().count() == 4
    assert old.count() == 5, "readers of the old generation go on"
    ledger.purge(keys(spark, A))
    assert versions(ledger.applied()) == [state.BASE_VERSION, C]


def test_base_row_is_reserved(spark, ledger):
    for change in (ledger.record, ledger.remove):
        with pytest.raises(PySparkException, match="reserved"):
            change(keys(spark, state.BASE_VERSION), 1)


def test_month_folders_prune(spark, ledger):
    ledger.record(keys(spark, A), 1_700_000_000)
    ledger.record(keys(spark, B), 1_710_000_000)
    assert versions(ledger.log(months=["202311"])) == [A]
    plan = ledger.log(months=["202311"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan or "yyyymm" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_properties(spark):
    bags = spark.createDataFrame(
        [("s", {"migrate.v1": "5", "owner": "x", "migrated": "y"}), ("t", {"migrate.": "7"})],
        "scope string, properties map<string,string>")
    got = sorted(tuple(r) for r in from_properties(bags).collect())
    assert got == [("s", "v1", 5), ("t", "", 7)]
    back = to_properties(from_properties(bags)).filter("scope = 's'").first()
    assert back.properties == {"migrate.v1": "5"}


@pytest.mark.parametrize("value", ["", "x", "1.5", "99999999999999999999"])
def test_bad_property_value_fails(spark, value):
    bags = spark.createDataFrame([({"migrate.v1": value},)], "properties map<string,string>")
    with pytest.raises(PySparkException):
        from_properties(bags).collect()


def test_dry_run_on_a_missing_ledger(spark):
    plan = steps.dry_run(keys(spark, state.BASE_VERSION, A, B), None).first()
    assert (plan.n_planned, plan.first_version, plan.last_version) == (2, A, B)


def test_limits_must_be_positive(spark, ledger):
    with pytest.raises(ValueError):
        steps.redo_plan(ledger.applied(), 0)


def test_plan_to(spark):
    defined = keys(spark, A, B, C)
    done = spark.createDataFrame([("s", B, 10), ("s", C, 20)], "scope string, version string, apply_time bigint")

    def plan(target):
        rows = steps.plan_to(defined, done, target).orderBy("step").collect()
        return [(r.direction, r.version) for r in rows]

    # An applied target does not bring in earlier pending versions; an unknown one does.
    assert plan("240102_000000") == [("revert", C)]
    assert plan("240103_000000") == []
    assert plan("240102_000001") == [("apply", A)]
    assert plan("231231_000000") == []


def test_redo_of_everything(spark):
    done = spark.createDataFrame([("s", v, i) for i, v in enumerate((A, B, C))], "scope string, version string, apply_time bigint")
    got = [(r.direction, r.version) for r in steps.redo_plan(done, None).orderBy("step").collect()]
    assert got == [("revert", C), ("revert", B), ("revert", A), ("apply", A), ("apply", B), ("apply", C)]


@pytest.mark.parametrize("change", ["compact", "purge"])
def test_an_append_during_a_rewrite_is_kept(spark, ledger, change):
    ledger.record(keys(spark, A, B), 100)
    write = ledger._write

    def overtaken(rows, folder, mode):
        ledger._write = write
        Ledger(spark, ledger.path).record(keys(spark, C), 200)
        write(rows, folder, mode)

    ledger._write = overtaken
    ledger.compact() if change == "compact" else ledger.purge(keys(spark, A))
    left = [state.BASE_VERSION, *([A, B] if change == "compact" else [B])]
    assert versions(ledger.applied()) == [*left, C]
    # The next rewrite merges it, and rows are counted once.
    for _ in range(2):
        ledger.compact()
        assert versions(ledger.log()) == [*left, C]


def test_a_failed_append_is_not_read(spark, ledger):
    ledger.record(keys(spark, A), 100)
    rows = ledger.log().filter(F.col("version") == A).withColumn("version", F.lit(B))
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("yyyymm").parquet(
        f"{ledger.path}/appends/append=broken")
    assert versions(ledger.applied()) == [state.BASE_VERSION, A]


def test_a_failed_rewrite_leaves_the_log_and_can_be_repeated(spark, ledger):
    ledger.record(keys(spark, A), 100)
    write, ledger._write = ledger._write, None
    with pytest.raises(TypeError):
        ledger.compact()
    ledger._write = write
    ledger.record(keys(spark, B), 200)
    assert versions(ledger.applied()) == [state.BASE_VERSION, A, B]
    ledger.compact()
    assert versions(ledger.log()) == [state.BASE_VERSION, A, B]


def test_purge_reaches_null_scopes(spark, ledger):
    ledger.record(keys(spark, A, B, scope=None), 100)
    ledger.record(keys(spark, A), 100)
    ledger.purge(keys(spark, A, scope=None))
    found = sorted((str(r.scope), r.version) for r in ledger.log().filter(F.col("version") != state.BASE_VERSION).collect())
    assert found == [("None", B), ("s", A)]


def test_months_prune_generations_and_appends(spark, ledger):
    ledger.record(keys(spark, A), 1_700_000_000)
    ledger.compact()
    ledger.record(keys(spark, B), 1_710_000_000)
    ledger.record(keys(spark, C), 1_700_000_001)
    assert versions(ledger.log(["202311"])) == [A, C]
    assert versions(ledger.log(["202403"])) == [B]
