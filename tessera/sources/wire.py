"""Documents in wire formats: MessagePack both ways in Arrow batches, a compact tagged binary (Spark's variant), Protobuf schemas.

Reading works from a schema; fields that are missing come back as nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..spec import QueryError


def pack(v: Any) -> bytes:
    """A value as MessagePack."""
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128:
            return bytes([v])
        if -32 <= v < 0:
            return struct.pack("b", v)
        return b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        head = bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xdb" + struct.pack(">I", len(raw))
        return head + raw
    if isinstance(v, (bytes, bytearray)):
        return b"\xc6" + struct.pack(">I", len(v)) + bytes(v)
    if isinstance(v, dict):
        return _sized(0x80, 0xDF, len(v)) + b"".join(pack(k) + pack(x) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return _sized(0x90, 0xDD, len(v)) + b"".join(map(pack, v))
    raise QueryError(f"no wire form of {type(v).__name__}")


def _sized(short: int, long: int, n: int) -> bytes:
    return bytes([short | n]) if n < 16 else bytes([long]) + struct.pack(">I", n)


#: Formats of numbers, and sizes of lengths, by first byte (fixed values of the format).
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
LENGTHS = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}


def unpack(data: bytes, at: int = 0) -> tuple[Any, int]:
    """A value and where it ends."""
    b = data[at]
    at += 1
    if b < 0x80 or b >= 0xE0:
        return (b if b < 0x80 else b - 256), at
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
    if b in NUMBERS:
        return struct.unpack_from(NUMBERS[b], data, at)[0], at + struct.calcsize(NUMBERS[b])
    if b in LENGTHS:
        size, kind = LENGTHS[b]
        n, at = struct.unpack_from(size, data, at)[0], at + struct.calcsize(size)
    elif b < 0xC0:
        n, kind = (b & 31, "str") if b >= 0xA0 else (b & 15, "list" if b >= 0x90 else "map")
    else:
        raise QueryError(f"bad MessagePack byte {b:#x}")
    if kind in ("bin", "str"):
        raw = data[at : at + n]
        return (raw.decode() if kind == "str" else raw), at + n
    out: list = []
    for _ in range(n * (2 if kind == "map" else 1)):
        v, at = unpack(data, at)
        out.append(v)
    return (dict(zip(out[::2], out[1::2], strict=True)) if kind == "map" else out), at


def _plain(v: Any) -> Any:
    """Rows and numpy values as Python ones."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _typed(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _typed(v.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [_typed(x, kind.elementType) for x in v]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    return int(v) if isinstance(kind, T.IntegralType) else v


class Irregular(Exception):
    """Bytes that aren't laid out as the schema says; they are read a document at a time."""


def _woven(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of rows that consist of a part of each piece; a piece is lengths by row, and all its bytes."""
    sizes = sum(n for n, _ in pieces)
    out = np.empty(int(sizes.sum()), np.uint8)
    to = np.cumsum(sizes) - sizes
    for n, data in pieces:
        out[np.repeat(to - (np.cumsum(n) - n), n) + np.arange(len(data))] = data
        to = to + n
    return sizes, out


def _same(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, len(raw), np.int64), np.tile(np.frombuffer(raw, np.uint8), n)


def _headed(first: np.ndarray, count: np.ndarray, short: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A first byte each, and where it isn't short a number of some bytes behind it."""
    slots = np.empty((len(first), width + 1), np.uint8)
    slots[:, 0] = first
    slots[:, 1:] = count.astype(f">{'i' if count.dtype.kind in 'iu' else 'f'}{width}").view(np.uint8).reshape(-1, width)
    sizes = np.where(short, 1, width + 1).astype(np.int64)
    return sizes, slots[np.arange(width + 1) < sizes[:, None]]


def _bytes_in(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of texts or byte strings."""
    a = a.cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    return np.diff(at), data[at[0] : at[-1]]


def packed(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of an array's values as MessagePack, as ``pack`` makes them."""
    n, kind = len(a), a.type
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if a.null_count:
        there = np.asarray(a.is_valid())
        sizes = np.zeros(n, np.int64)
        sizes[there], data = packed(a.filter(pa.array(there)))
        return _woven([((~there).astype(np.int64), np.full(n - there.sum(), 0xC0, np.uint8)), (sizes, data)])
    if pa.types.is_struct(kind):
        pieces = [_same(_sized(0x80, 0xDF, kind.num_fields), n)]
        for i, child in enumerate(a.flatten()):
            pieces += [_same(pack(kind.field(i).name), n), packed(child)]
        return _woven(pieces)
    if pa.types.is_list(kind):
        counts = np.asarray(pc.list_value_length(a), np.int64)
        sizes, data = packed(a.flatten())
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        short = counts < 16
        return _woven([_headed(np.where(short, 0x90 | counts, 0xDD), counts, short, 4), (np.diff(ends), data)])
    if pa.types.is_integer(kind):
        v = np.asarray(a).astype(np.int64)
        short = (v >= -32) & (v < 128)
        return _headed(np.where(short, v & 0xFF, 0xD3), v, short, 8)
    if pa.types.is_floating(kind):
        v = np.asarray(a).astype(np.float64)
        return _headed(np.full(n, 0xCB), v, np.zeros(n, bool), 8)
    if pa.types.is_boolean(kind):
        return np.ones(n, np.int64), np.where(np.asarray(a), 0xC3, 0xC2).astype(np.uint8)
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        sizes, data = _bytes_in(a)
        short = (sizes < 32) & pa.types.is_string(kind)
        return _woven([_headed(np.where(short, 0xA0 | sizes, 0xDB if pa.types.is_string(kind) else 0xC6), sizes, short, 4), (sizes, data)])
    each = [pack(_plain(dict(v) if pa.types.is_map(kind) else v)) for v in a.to_pylist()]
    return np.array([*map(len, each)], np.int64), np.frombuffer(b"".join(each), np.uint8)


def _numbers(data: np.ndarray, at: np.ndarray, form: str) -> np.ndarray:
    return data[at[:, None] + np.arange(int(form[-1]))].copy().view(form)[:, 0]


def _placed(a: pa.Array, there: np.ndarray) -> pa.Array:
    """The values of ``a`` where they are there, else nulls."""
    return a.take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))


def unpacked(kind: T.DataType, data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Values of one type that begin at some places, all read in step, and where they end."""
    of, n = to_arrow_type(kind), len(at)
    if not n:
        return pa.array([], of), at
    b = data[at].astype(np.int64)
    if (b == 0xC0).any():
        there, ends = b != 0xC0, at + 1
        some, ends[there] = unpacked(kind, data, at[there])
        return _placed(some, there), ends
    if isinstance(kind, T.StructType):
        at = _expect(data, at, _sized(0x80, 0xDF, len(kind)))
        children = []
        for f in kind:
            child, at = unpacked(f.dataType, data, _expect(data, at, pack(f.name)))
            children.append(child)
        return pa.StructArray.from_arrays(children, fields=[*of]), at
    if isinstance(kind, T.ArrayType):
        short = b & 0xF0 == 0x90
        if not (short | (b == 0xDD)).all():
            raise Irregular
        counts = b & 15
        counts[~short] = _numbers(data, at[~short] + 1, ">u4")
        ends, rows, parts = at + np.where(short, 1, 5), [], []
        for j in range(int(counts.max())):
            own = np.flatnonzero(counts > j)
            part, ends[own] = unpacked(kind.elementType, data, ends[own])
            rows.append(own)
            parts.append(part)
        if parts:
            values = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows), kind="stable")))
        else:
            values = pa.array([], of.value_type)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values, type=of), ends
    if isinstance(kind, T.IntegralType):
        short = (b < 0x80) | (b >= 0xE0)
        if not (short | (b == 0xD3)).all():
            raise Irregular
        values = np.where(b < 0x80, b, b - 256)
        values[~short] = _numbers(data, at[~short] + 1, ">i8")
        return pa.array(values).cast(of), at + np.where(short, 1, 9)
    if isinstance(kind, (T.DoubleType, T.FloatType)) and (b == 0xCB).all():
        return pa.array(_numbers(data, at + 1, ">f8").astype(np.float64)).cast(of, safe=False), at + 9
    if isinstance(kind, T.BooleanType) and ((b == 0xC2) | (b == 0xC3)).all():
        return pa.array(b == 0xC3), at + 1
    if isinstance(kind, (T.StringType, T.BinaryType)):
        text = isinstance(kind, T.StringType)
        short = (b & 0xE0 == 0xA0) & text
        if not (short | (b == (0xDB if text else 0xC6))).all():
            raise Irregular
        sizes = b & 31
        sizes[~short] = _numbers(data, at[~short] + 1, ">u4")
        begin, to = at + np.where(short, 1, 5), np.cumsum(sizes) - sizes
        raw = data[np.repeat(begin - to, sizes) + np.arange(sizes.sum())]
        found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(to, sizes.sum())), pa.py_buffer(raw)])
        return found.cast(of), begin + sizes
    raise Irregular


def _expect(data: np.ndarray, at: np.ndarray, raw: bytes) -> np.ndarray:
    if not (data[at[:, None] + np.arange(len(raw))] == np.frombuffer(raw, np.uint8)).all():
        raise Irregular
    return at + len(raw)


#: Documents that are encoded or read in step.
IN_STEP = 2048


def to_msgpack(df: DataFrame) -> DataFrame:
    """A column ``data`` of each row as a MessagePack map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, IN_STEP):
                rows = batch.slice(start, IN_STEP)
                sizes, data = packed(pa.StructArray.from_arrays(rows.columns, names=rows.schema.names))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                made = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([made.cast(pa.binary())], names=["data"])

    return df.mapInArrow(run, "data binary")


def from_msgpack(df: DataFrame, schema: T.StructType, column: str = "data") -> DataFrame:
    """Documents that hold the schema's fields in order, as ``to_msgpack`` writes them, are read in step; others one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, IN_STEP):
                rows = batch.column(0).slice(start, IN_STEP)
                try:
                    if rows.null_count:
                        raise Irregular
                    sizes, data = _bytes_in(rows)
                    ends = np.cumsum(sizes)
                    found, at = unpacked(schema, np.append(data, np.zeros(16, np.uint8)), ends - sizes)
                    if (at != ends).any():
                        raise Irregular
                except (Irregular, IndexError):
                    found = pa.array([_typed(unpack(bytes(d))[0], schema) for d in rows.to_pylist()], to_arrow_type(schema))
                yield pa.RecordBatch.from_arrays(found.flatten(), names=schema.names)

    return df.select(column).mapInArrow(run, schema)


SCALARS = {"string": "string", "int": "int64", "bigint": "int64", "smallint": "int64", "double": "double", "float": "float", "boolean": "bool", "binary": "bytes", "timestamp": "int64"}


def proto_schema(schema: T.StructType, name: str = "Item") -> str:
    """The ``.proto`` text of a namespace's documents: fields numbered in order, arrays repeated, structs as messages."""

    def message(kind: T.StructType, title: str, depth: int) -> list[str]:
        pad = "  " * depth
        inner, fields = [], []
        for i, f in enumerate(kind, 1):
            of, many = (f.dataType.elementType, "repeated ") if isinstance(f.dataType, T.ArrayType) else (f.dataType, "optional ")
            if isinstance(of, T.StructType):
                inner += message(of, f"{f.name.title().replace('_', '')}Value", depth + 1)
                fields.append(f"{pad}  {many}{f.name.title().replace('_', '')}Value {f.name} = {i};")
            elif of.simpleString() in SCALARS:
                fields.append(f"{pad}  {many}{SCALARS[of.simpleString()]} {f.name} = {i};")
            else:
                raise QueryError(f"no Protobuf type of {of.simpleString()}")
        return [f"{pad}message {title} {{", *inner, *fields, f"{pad}}}"]

    return "\n".join(['syntax = "proto3";', *message(schema, name, 0), ""])


def to_variant(df: DataFrame) -> DataFrame:
    """A column ``data`` of each row as a tagged binary document."""
    return df.select(F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("data"))


def from_variant(df: DataFrame, schema: T.StructType, column: str = "data") -> DataFrame:
    return df.select(F.try_variant_get(column, "$", schema.simpleString()).alias("r")).select("r.*")
