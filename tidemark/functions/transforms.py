"""Partition transforms as column functions, with the values of the public table specification."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .datatypes import WRITTEN_TYPE

# Executors get the byte hash by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LOW32 = 0xFFFFFFFF

# Constants of 32-bit MurmurHash3.
_C1, _C2 = 0xCC9E2D51, 0x1B873593
_ADD, _MIX1, _MIX2 = 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def years(c: Column | str) -> Column:
    return F.year(_col(c)) - 1970


def months(c: Column | str) -> Column:
    c = _col(c)
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def days(c: Column | str) -> Column:
    return F.unix_date(_col(c).cast("date"))


def hours(c: Column | str) -> Column:
    seconds = F.unix_seconds(_col(c).cast("timestamp"))
    return F.floor(seconds / F.lit(3600)).cast("int")


def truncate(c: Column | str, width: int, kind: T.DataType) -> Column:
    """First ``width`` characters of a string, or a number rounded down to a multiple of ``width``.

    For a decimal the width counts units of its last digit.
    """
    c = _col(c)
    if isinstance(kind, T.StringType):
        return F.substring(c, 1, width)
    if isinstance(kind, T.BinaryType):
        return F.substring(c, 1, width)
    if isinstance(kind, T.DecimalType):
        step = F.lit(width).cast(T.DecimalType(38, 0)) * F.lit(f"1e-{kind.scale}").cast(T.DecimalType(38, kind.scale))
        return (c - F.pmod(c, step.cast(kind))).cast(kind)
    return (c - F.pmod(c, F.lit(width).cast(kind))).cast(kind)


def _times(x: Column, factor: int) -> Column:
    # A signed factor keeps the product of two 32-bit numbers within 64 bits.
    signed = factor - (1 << 32) if factor >> 31 else factor
    return (x * F.lit(signed).cast("bigint")).bitwiseAND(F.lit(_LOW32))


def _rotate(x: Column, bits: int) -> Column:
    both = F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 32 - bits))
    return both.bitwiseAND(F.lit(_LOW32))


def _mix(h: Column, word: Column) -> Column:
    word = _times(_rotate(_times(word, _C1), 15), _C2)
    return (_rotate(h.bitwiseXOR(word), 13) * 5 + _ADD).bitwiseAND(F.lit(_LOW32))


def hash_long(c: Column | str) -> Column:
    """MurmurHash3 (seed 0) of the 8 bytes of a long, as an unsigned number in a bigint.

    Plain 64-bit arithmetic, so it is compiled with the rest of the stage and folds to a
    constant on literals.
    """
    value = _col(c).cast("bigint")
    h = _mix(F.lit(0).cast("bigint"), value.bitwiseAND(F.lit(_LOW32)))
    h = _mix(h, F.shiftrightunsigned(value, 32)).bitwiseXOR(F.lit(8).cast("bigint"))
    h = _times(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), _MIX1)
    h = _times(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), _MIX2)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def murmur3(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """MurmurHash3 (seed 0) of the byte ranges (start, length) of ``data``.

    One numpy step handles one 4-byte word of all rows that are long enough. Rows are
    visited longest first, so a few long values do not cost a pass over all rows.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    h = np.zeros(len(order), np.uint32)

    def rotate(x: np.ndarray, bits: int) -> np.ndarray:
        return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))

    def scramble(word: np.ndarray) -> np.ndarray:
        return rotate(word * np.uint32(_C1), 15) * np.uint32(_C2)

    def words(at: np.ndarray) -> np.ndarray:
        parts = [data[at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4)]
        return parts[0] | parts[1] | parts[2] | parts[3]

    blocks = length // 4
    for block in range(int(blocks[0]) if len(blocks) else 0):
        n = int(np.searchsorted(-blocks, -block))
        h[:n] = rotate(h[:n] ^ scramble(words(start[:n] + 4 * block)), 13) * np.uint32(5) + np.uint32(_ADD)
    spare = (length % 4).astype(np.uint32)
    tail = words(start + 4 * blocks) & ((np.uint32(1) << (8 * spare)) - np.uint32(1))
    h ^= np.where(spare > 0, scramble(tail), np.uint32(0))
    h ^= length.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(_MIX1)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(_MIX2)
    out = np.empty_like(h)
    out[order] = h ^ (h >> np.uint32(16))
    return out


def _with_nulls(hashes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.array(hashes.astype(np.int64), mask=np.asarray(values.is_null()))


@F.arrow_udf(T.LongType())
def _hash_binary(values: pa.Array) -> pa.Array:
    filled = values.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
    return _with_nulls(murmur3(data, offsets[:-1], np.diff(offsets)), values)


@F.arrow_udf(T.LongType())
def _hash_decimal(values: pa.Array) -> pa.Array:
    """Hash of the unscaled value as the shortest big-endian two's complement."""
    raw = np.frombuffer(values.buffers()[1], np.uint8).reshape(-1, 16)
    raw = raw[values.offset : values.offset + len(values), ::-1]
    sign = np.where(raw[:, :1] >= 128, np.uint8(255), np.uint8(0))
    # A leading byte can go while it only repeats the sign of the byte after it.
    spare = (raw[:, :-1] == sign) & ((raw[:, 1:] >= 128) == (sign == 255))
    dropped = np.cumprod(spare, axis=1).sum(axis=1)
    start = 16 * np.arange(len(raw)) + dropped
    return _with_nulls(murmur3(np.ascontiguousarray(raw).reshape(-1), start, 16 - dropped), values)


def hash_value(c: Column | str, kind: T.DataType) -> Column:
    """The hash a bucket is taken from, by column type.

    Texts, bytes and decimals need a byte loop, which runs in Python on Arrow batches.
    """
    c = _col(c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return hash_long(c)
    if isinstance(kind, T.DateType):
        return hash_long(F.unix_date(c))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return hash_long(F.unix_micros(c.cast("timestamp")))
    if isinstance(kind, T.StringType):
        return _hash_binary(c.cast("binary"))
    if isinstance(kind, T.BinaryType):
        return _hash_binary(c)
    if isinstance(kind, T.DecimalType):
        return _hash_decimal(c)
    raise ValueError(f"no bucket for type {kind.simpleString()}")


def bucket(n: int, c: Column | str, kind: T.DataType) -> Column:
    return F.pmod(hash_value(c, kind).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


# Transform names.
TRANSFORMS = ("identity", "years", "months", "days", "hours", "bucket", "truncate")


@dataclass(frozen=True)
class PartitionField:
    """One partition or sort source: ``transform(param, source)``."""

    transform: str
    source: str
    param: int | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        if self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {self.transform}")
        if (self.transform in ("bucket", "truncate")) != (self.param is not None):
            raise ValueError(f"wrong number of arguments for {self.transform}")
        if self.param is not None and self.param < 1:
            raise ValueError("the transform argument must be positive")

    @property
    def column(self) -> str:
        if self.name:
            return self.name
        suffix = "" if self.param is None else f"_{self.param}"
        return f"{self.source}_{self.transform}{suffix}"

    def same_as(self, other: PartitionField) -> bool:
        return (self.transform, self.source, self.param) == (other.transform, other.source, other.param)

    def value(self, schema: T.StructType, c: Column | None = None) -> Column:
        """The transform of its source column, or of ``c`` instead."""
        if self.source not in schema.fieldNames():
            raise ValueError(f"source column {self.source} not found")
        kind = schema[self.source].dataType
        c = F.col(self.source) if c is None else c
        match self.transform:
            case "identity":
                return c
            case "years":
                return years(c)
            case "months":
                return months(c)
            case "days":
                return days(c)
            case "hours":
                return hours(c)
            case "bucket":
                if schema[self.source].metadata.get(WRITTEN_TYPE) == "uuid":
                    # A uuid is hashed as its 16 bytes, not as its text.
                    c, kind = F.unhex(F.replace(c, F.lit("-"), F.lit(""))), T.BinaryType()
                return bucket(self.param, c, kind)
            case _:
                return truncate(c, self.param, kind)
