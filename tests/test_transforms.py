import datetime
import decimal
import random
import subprocess
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import transforms as tf
from tidemark.operators.schema import declare


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def signed(h):
    return h - 2**32 if h >> 31 else h


@pytest.mark.parametrize("value, kind, expected", [
    (34, T.IntegerType(), 2017239379),
    (34, T.LongType(), 2017239379),
    (datetime.date(2017, 11, 16), T.DateType(), -653330422),
    (datetime.datetime(2017, 11, 16, 22, 31, 8), T.TimestampNTZType(), -2047944441),
    ("iceberg", T.StringType(), 1210000089),
    (bytes([0, 1, 2, 3]), T.BinaryType(), -188683207),
    (uuid.UUID("f79c3e09-677c-4bbd-a479-3f349cb785e7").bytes, T.BinaryType(), 1488055340),
    (decimal.Decimal("14.20"), T.DecimalType(9, 2), -500754589),
])
def test_published_hashes(spark, value, kind, expected):
    rows = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", kind)]))
    assert signed(rows.select(tf.hash_value("c", kind).alias("h")).first().h) == expected


def plain_murmur3(data: bytes) -> int:
    def rotate(x, r):
        return (x << r | x >> 32 - r) & 0xFFFFFFFF

    def word(k):
        return rotate(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF

    h, whole = 0, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = rotate(h ^ word(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if whole < len(data):
        h ^= word(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_hash_of_texts_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "é", "x" * 100_001] + ["".join(chr(rng.randint(32, 1200)) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r.i: r.h for r in rows.select("i", tf.hash_value("t", T.StringType()).alias("h")).collect()}
    assert got == {i: None if t is None else plain_murmur3(t.encode()) for i, t in enumerate(texts)}


def test_hash_of_decimals_against_brute_force(spark):
    rng = random.Random(4)
    values = [rng.randint(-10**rng.randint(1, 37), 10**rng.randint(1, 37)) for _ in range(300)]
    values += [0, -1, 127, 128, -128, -129, 255, 256, 32767, 32768, -32768, -32769]
    rows = spark.createDataFrame([(i, decimal.Decimal(v)) for i, v in enumerate(values)], "i int, d decimal(38,0)")
    got = {r.i: r.h for r in rows.select("i", tf.hash_value("d", T.DecimalType(38, 0)).alias("h")).collect()}
    def shortest(v):
        return v.to_bytes((v if v >= 0 else ~v).bit_length() // 8 + 1, "big", signed=True)

    assert got == {i: plain_murmur3(shortest(v)) for i, v in enumerate(values)}


def test_hash_of_longs_against_brute_force(spark):
    values = [0, 1, -1, 2**31, -2**31, 2**63 - 1, -2**63] + [random.Random(5).randint(-2**63, 2**63 - 1) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = [r.h for r in rows.select(tf.hash_long("v").alias("h")).collect()]
    assert got == [plain_murmur3(v.to_bytes(8, "little", signed=True)) for v in values]


def test_uuid_bucket_uses_bytes(spark):
    schema = declare({"id": "uuid"}).columns
    rows = spark.createDataFrame([("f79c3e09-677c-4bbd-a479-3f349cb785e7",)], schema)
    field = tf.PartitionField("bucket", "id", 1000)
    assert rows.select(field.value(schema).alias("b")).first().b == (1488055340 & 0x7FFFFFFF) % 1000


def test_times_before_1970(spark):
    moment = F.lit("1969-12-31 22:59:59.5").cast("timestamp_ntz")
    assert one(spark, tf.hours(moment)) == -2
    assert one(spark, tf.days(moment)) == -1
    assert one(spark, tf.months(moment)) == -1
    assert one(spark, tf.years(moment)) == -1


@pytest.mark.parametrize("value, width, kind, expected", [
    (-1, 10, T.IntegerType(), -10),
    (1, 10, T.IntegerType(), 0),
    (19, 10, T.LongType(), 10),
    (decimal.Decimal("10.65"), 50, T.DecimalType(9, 2), decimal.Decimal("10.50")),
    (decimal.Decimal("-0.05"), 10, T.DecimalType(9, 2), decimal.Decimal("-0.10")),
    ("äöüß", 3, T.StringType(), "äöü"),
])
def test_truncate(spark, value, width, kind, expected):
    rows = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", kind)]))
    assert rows.select(tf.truncate("c", width, kind).alias("v")).first().v == expected


def test_field_errors():
    for bad in (("weeks", "ts"), ("bucket", "id"), ("days", "ts", 3), ("bucket", "id", 0)):
        with pytest.raises(ValueError):
            tf.PartitionField(*bad)
    with pytest.raises(ValueError, match="not found"):
        tf.PartitionField("days", "nope").value(T.StructType())
    with pytest.raises(ValueError, match="no bucket"):
        tf.bucket(4, F.lit(True), T.BooleanType())


def test_byte_hash_needs_no_package_on_executors(tmp_path):
    """The Python function travels by value, so a worker without this package can run it."""
    pickled = tmp_path / "hash.bin"
    pickled.write_bytes(cloudpickle.dumps(tf._hash_binary.func))
    code = (
        "import pickle, sys, pyarrow; sys.modules['tidemark'] = None; "
        f"f = pickle.load(open({str(pickled)!r}, 'rb')); print(f(pyarrow.array([b'iceberg', None])).to_pylist())"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True)
    assert ran.stdout.strip() == "[1210000089, None]", ran.stderr
