"""A batch data source of TFRecord files of Example messages: ``spark.dataSource.register(TFRecordSource)``, then ``spark.read.format("tfrecord")``.

Files are framed records (length, its checksum, payload, its checksum); the payload is an
Example protocol message, which a few lines of wire-format reading decode. Values
are arrays. Columns and their types come from the schema that the reader is given, or
from the first record: lists of bytes, floats and integers.

A large file is read in parts of ``splitBytes`` (64 MB unless given): a part begins at the first
place at or behind its offset where a length agrees with its checksum and the frame
behind it does too, so nothing but the part itself is read to find its records. Compressed
files, and those whose lengths have no right checksum, are read whole. Comparisons of
scalar columns are pushed down with the option ``pushdown`` (and, in the session,
``spark.sql.python.filterPushdown.enabled``): only the columns they name are decoded of records that fail them.
"""

from __future__ import annotations

import glob
import gzip
import operator
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StructField, StructType


@lru_cache(1)
def _crc_table() -> list[int]:
    """What the checksum's polynomial (Castagnoli's) leaves of each byte."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0x82F63B78 if b & 1 else 0)
        out.append(b)
    return out


def checksum(data: bytes) -> int:
    """A frame's checksum: CRC-32C, turned by 15 bits and shifted by a constant."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = table[(crc ^ b) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _length(head: bytes) -> int | None:
    """The length that a frame's first twelve bytes give, if its checksum is right."""
    if len(head) == 12 and checksum(head[:8]) == struct.unpack("<I", head[8:])[0]:
        return struct.unpack("<Q", head[:8])[0]
    return None


def first_frame(data, size: int, begin: int, end: int) -> int | None:
    """Where the first frame at or behind ``begin`` and before ``end`` starts, in a file of ``size`` bytes."""
    at, step = begin, 1 << 20
    while at < end:
        data.seek(at)
        window = data.read(step + 12)
        for i in range(min(len(window) - 11, step, end - at)):
            if window[i + 5 : i + 8] == b"\0\0\0" and (n := _length(window[i : i + 12])) is not None:  # no record has a terabyte
                behind = at + i + 16 + n
                data.seek(behind)
                if behind == size or (behind < size and _length(data.read(12)) is not None):
                    return at + i
        at += step
    return None


def frames(data) -> Iterator[bytes]:
    while head := data.read(12):
        if len(head) < 12:
            raise ValueError("cut-off record")
        size = struct.unpack("<Q", head[:8])[0]
        body = data.read(size)
        if len(body) < size or len(data.read(4)) < 4:
            raise ValueError("cut-off record")
        yield body


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
        if b < 128:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, int, object]]:
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = buf[at : at + n], at + n
        yield tag >> 3, kind, value


def _values(feature: bytes) -> list:
    """The list of one Feature: 1 bytes, 2 floats, 3 integers, packed or not."""
    out: list = []
    for which, _, body in _fields(feature):
        for _, kind, v in _fields(body):
            if which == 1:
                out.append(bytes(v))
            elif which == 2:
                out += struct.unpack(f"<{len(v) // 4}f", v)
            elif kind == 0:
                out.append(v - (1 << 64) if v >> 63 else v)
            else:
                at = 0
                while at < len(v):
                    x, at = _varint(v, at)
                    out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _features(buf: bytes) -> Iterator[tuple[str, bytes]]:
    for n, _, features in _fields(buf):
        for m, _, entry in _fields(features) if n == 1 else ():
            parts = {k: v for k, _, v in _fields(entry)} if m == 1 else {}
            if 1 in parts:
                yield parts[1].decode(), parts.get(2, b"")


def decode_example(buf: bytes, names: set[str] | None = None) -> dict[str, list]:
    """The lists of a record, or those of ``names`` only."""
    return {name: _values(feature) for name, feature in _features(buf) if names is None or name in names}


def feature_kinds(buf: bytes) -> dict[str, int]:
    """1 for lists of bytes, 2 for floats, 3 for integers; features that say neither are left out."""
    kinds = {name: next((which for which, _, _ in _fields(feature)), 0) for name, feature in _features(buf)}
    return {name: which for name, which in kinds.items() if which in (1, 2, 3)}


def _encode_varint(n: int) -> bytes:
    out, n = bytearray(), n & (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, body: bytes) -> bytes:
    return _encode_varint(number << 3 | 2) + _encode_varint(len(body)) + body


def encode_example(row: dict[str, list]) -> bytes:
    """An Example of lists of bytes or text, floats, or integers."""
    entries = b""
    for name, values in row.items():
        if values and isinstance(values[0], float):
            feature = _block(2, _block(1, struct.pack(f"<{len(values)}f", *values)))
        elif values and isinstance(values[0], (bytes, str)):
            feature = _block(1, b"".join(_block(1, v.encode() if isinstance(v, str) else v) for v in values))
        else:
            feature = _block(3, _block(1, b"".join(map(_encode_varint, values))))
        entries += _block(1, _block(1, name.encode()) + _block(2, feature))
    return _block(1, entries)


def frame(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return head + struct.pack("<I", checksum(head)) + body + struct.pack("<I", checksum(body))


class _Part(InputPartition):
    """Bytes of a file from ``begin`` to ``end``; a whole one where ``end`` is None."""

    def __init__(self, path: str, begin: int = 0, end: int | None = None):
        super().__init__((path, begin, end))


COMPARISONS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _compressed(path: str, options: dict) -> bool:
    return path.endswith((".gz", ".gzip")) or options.get("compression") == "gzip"


def _found(options: dict) -> list[str]:
    return sorted(p for path in options["path"].split(",") for p in glob.glob(path))


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.options, self.tests = [(f.name, f.dataType.simpleString()) for f in schema], options, []

    def partitions(self):
        split, out = int(self.options.get("splitbytes", self.options.get("splitBytes", 64 << 20))), []
        for path in _found(self.options):
            size, whole = os.path.getsize(path), _compressed(path, self.options)
            if not whole and size > split:
                with open(path, "rb") as f:
                    whole = _length(f.read(12)) is None
            out += [_Part(path)] if whole or size <= split else [_Part(path, at, min(at + split, size)) for at in range(0, size, split)]
        return out

    def _bodies(self, path: str, begin: int, end: int | None) -> Iterator[bytes]:
        with (gzip.open if _compressed(path, self.options) else open)(path, "rb") as f:
            if end is None:
                yield from frames(f)
                return
            at = first_frame(f, os.path.getsize(path), begin, end)
            if at is not None:
                f.seek(at)
                for body in frames(f):
                    yield body
                    at += 16 + len(body)
                    if at >= end:
                        return

    def read(self, partition):
        kinds = dict(self.columns)
        tested = {c for c, _, _ in self.tests}
        for body in self._bodies(*partition.value):
            if self.tests:
                first = {c: self._cast(v, kinds[c]) for c, v in decode_example(body, tested).items()}
                if not all((v := first.get(c)) is not None and (test is None or test(v, value)) for c, test, value in self.tests):
                    continue
            row = decode_example(body, set(kinds))
            yield tuple(self._cast(row.get(c), kind) for c, kind in self.columns)

    @staticmethod
    def _cast(values, kind):
        if values is not None and "string" in kind:
            values = [v.decode() if isinstance(v, bytes) else str(v) for v in values]
        return values if values is None or kind.startswith("array") else (values[0] if values else None)


class _Pushing(_Reader):
    def pushFilters(self, filters):
        kinds = dict(self.columns)
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            plain = not kinds.get(column, "array").startswith(("array", "struct", "map"))
            if plain and type(f) in COMPARISONS:
                self.tests.append((column, COMPARISONS[type(f)], f.value))
            elif plain and isinstance(f, IsNotNull):
                self.tests.append((column, None, None))
            else:
                yield f


class TFRecordSource(DataSource):
    @classmethod
    def name(cls):
        return "tfrecord"

    def schema(self):
        """Columns of the first record of the first file that has one."""
        for path in _found(dict(self.options)):
            with (gzip.open if _compressed(path, dict(self.options)) else open)(path, "rb") as f:
                for body in frames(f):
                    kinds = {1: BinaryType(), 2: FloatType(), 3: LongType()}
                    return StructType([StructField(name, ArrayType(kinds[which])) for name, which in sorted(feature_kinds(body).items())])
        raise ValueError("no record to take columns from: give the reader a schema")

    def reader(self, schema):
        pushing = self.options.get("pushdown") == "true"
        return (_Pushing if pushing else _Reader)(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    """A file for each task, named when its attempt succeeded. Null columns are left out of a record, scalars are lists of one."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        name, out = f"part-{uuid.uuid4().hex}.tfrecord", None
        for row in iterator:
            if out is None:
                os.makedirs(f"{self.path}/_staged", exist_ok=True)
                out = open(f"{self.path}/_staged/{name}", "wb")
            values = {k: v for k, v in row.asDict().items() if v is not None}
            out.write(frame(encode_example({k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in values.items()})))
        if out:
            out.close()
        return _Named(name if out else None)

    def commit(self, messages):
        old = glob.glob(f"{self.path}/part-*.tfrecord") if self.overwrite else []
        for m in messages:
            if m and m.name:
                os.replace(f"{self.path}/_staged/{m.name}", f"{self.path}/{m.name}")
        for f in old:
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m and m.name:
                os.remove(f"{self.path}/_staged/{m.name}")


@dataclass
class _Named(WriterCommitMessage):
    name: str | None
