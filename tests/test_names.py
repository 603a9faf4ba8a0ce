import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import names

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("version, reason", [
    ("240601_000000_ab", None),
    ("200905_192800_create-table_2", None),
    ("240601_075959_soon", None),
    ("240601_080001_late", "future"),
    ("", "empty"),
    ("240230_000000_ab", "calendar"),
    ("241301_000000_ab", "calendar"),
    ("240101_250000_ab", "calendar"),
    ("240101_006000_ab", "calendar"),
    ("240100_000000_ab", "calendar"),
    ("240101_000000", "pattern"),
    ("240101_000000_a", "pattern"),
    ("240101_000000_Ab", "pattern"),
    ("240101_000000_1a", "pattern"),
    ("240101000000_ab", "pattern"),
    ("240101_000000_a b", "pattern"),
    ("240101_000000_a.b", "pattern"),
    ("240101_000000_ab\n", "pattern"),
])
def test_version(spark, version, reason):
    found = one(spark, names.parse_version(F.lit(version), now()))
    assert (found.reason, found.valid) == (reason, reason is None)
    if reason is None:
        assert found.name == version[14:] and found.ts.strftime("%y%m%d_%H%M%S") == version[:13]
    else:
        assert found.ts is None and found.name is None


@pytest.mark.parametrize("file, safe, direction", [
    ("200905_192800_make.up.sql", False, "up"),
    ("200905_192800_make.down.sql", False, "down"),
    ("200905_192800_make.safe.up.sql", True, "up"),
    ("200905_192800_make-it_2.safe.down.sql", True, "down"),
])
def test_script_name(spark, file, safe, direction):
    found = one(spark, names.parse_script(F.lit(file), now()))
    assert found.valid and (found.safe, found.direction) == (safe, direction)
    assert found.version == file.split(".")[0]


@pytest.mark.parametrize("file", [
    "200905_192800_make.up", "200905_192800_make.sql", "200905_192800_make.up.txt", "200905_192800_make.up.safe.sql",
    "200905_192800_make.UP.sql", "200905_192800_make..up.sql", "200905_192800_.up.sql", "x.up.sql",
])
def test_bad_script_name(spark, file):
    found = one(spark, names.parse_script(F.lit(file), now()))
    assert not found.valid and found.reason == "pattern" and found.version is None


@pytest.mark.parametrize("target, stamp", [
    ("150101_185401", "150101_185401"),
    ("150101_185401_create_news", "150101_185401"),
    ("2015-01-01 18:54:01", "150101_185401"),
    ("2015-01-01 8:54:01", "150101_085401"),
    ("2015-01-01 18:54:01.25", "150101_185401"),
    ("1392853618", "140219_234658"),
    ("946684799", "991231_235959"),
    ("12345678", None),
    ("12345678901", None),
    ("2015-02-30 00:00:00", None),
    ("yesterday", None),
    ("", None),
])
def test_target(spark, target, stamp):
    assert one(spark, names.normalize_target(F.lit(target))) == stamp


def test_unknown_target_fails_when_strict(spark):
    with pytest.raises(PySparkException, match="no such target format"):
        one(spark, names.normalize_target(F.lit("yesterday"), strict=True))


@pytest.mark.parametrize("name, valid", [
    ("", True), ("Table_1", True), ("_", True), ("a" * 256, True), ("a" * 257, False),
    ("a b", False), ("a-b", False), ("a.b", False), ("a'b", False), ("a\n", False), ("таблица", False),
])
def test_identifier(spark, name, valid):
    assert one(spark, names.is_identifier(F.lit(name))) is valid


@pytest.mark.parametrize("name, expected", [
    ("a.b.c", (["a", "b"], "c", None)),
    ("Lake.a.b", (["a"], "b", None)),
    (" a . b", (None, None, "invalid")),
    ("a. b ..c", (["a", "b"], "c", None)),
    ("lake.b", (None, None, "namespace required")),
    ("b", (None, None, "namespace required")),
    ("", (None, None, "empty")),
    ("1a.b", (None, None, "invalid")),
])
def test_qualified_name(spark, name, expected):
    assert tuple(one(spark, names.qualify_name(F.lit(name), "lake"))) == expected


def test_namespace_and_schema_table(spark):
    assert one(spark, names.qualify_namespace(F.lit("lake.a.b"), "LAKE")) == ["a", "b"]
    assert one(spark, names.qualify_namespace(F.lit("lake"), "lake")) is None
    assert tuple(one(spark, names.split_schema_table(F.lit("s.t"), "d"))) == ("s", "t", True)
    assert tuple(one(spark, names.split_schema_table(F.lit("t"), "d"))) == ("d", "t", True)
    assert one(spark, names.split_schema_table(F.lit("s-1.t"), "d")).valid is False
