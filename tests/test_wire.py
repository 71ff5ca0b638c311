"""MessagePack in arrays against the plain functions, and documents that are laid out otherwise."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources import wire

DDL = "a bigint, b int, c double, d string, e boolean, f binary, g array<bigint>, h array<struct<x: int, y: string, z: array<double>>>, i struct<p: bigint, q: string>, j smallint"


def documents(n: int) -> list[dict]:
    rng = random.Random(2)
    some = lambda f: None if rng.random() < 0.15 else f()
    whole = lambda: rng.choice([0, 1, -1, 127, 128, -32, -33, 2**62 + 1, -(2**62), rng.randrange(-200, 200)])
    text = lambda: rng.choice(["", "a", "é" * 20, "x" * 31, "x" * 32, "x" * 300])
    item = lambda: {"x": some(lambda: rng.randrange(500)), "y": some(text), "z": some(lambda: [rng.random()] * rng.randrange(3))}
    return [
        {"a": some(whole), "b": some(lambda: rng.randrange(-300, 300)), "c": some(rng.random), "d": some(text), "e": some(lambda: rng.random() < 0.5), "f": some(lambda: bytes(rng.randrange(40))),
         "g": some(lambda: [some(whole) for _ in range(rng.choice([0, 1, 3, 15, 16, 40]))]), "h": some(lambda: [some(item) for _ in range(rng.randrange(4))]), "i": some(lambda: {"p": some(whole), "q": some(text)}), "j": some(lambda: rng.randrange(-300, 300))}
        for _ in range(n)
    ]


def test_arrays_equal_the_plain_functions(spark):
    schema, rows = spark.createDataFrame([], DDL).schema, documents(2000)
    made = pa.array(rows, to_arrow_type(schema))
    sizes, data = wire.packed(made)
    ends = np.cumsum(sizes)
    assert [data[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)] == [wire.pack(r) for r in rows]
    found, at = wire.unpacked(schema, np.append(data, np.zeros(16, np.uint8)), ends - sizes)
    assert (at == ends).all() and found.to_pylist() == rows
    assert wire.packed(made.slice(100, 500))[1].tobytes() == b"".join(map(wire.pack, rows[100:600]))


def test_round_trip_of_documents(spark):
    """Whole numbers beside nulls keep all their digits."""
    df = spark.createDataFrame([tuple(r.values()) for r in documents(3000)], DDL)
    back = wire.from_msgpack(wire.to_msgpack(df), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_documents_laid_out_otherwise(spark):
    """Other orders, missing and further fields, short and long forms of numbers and lists."""
    schema = spark.createDataFrame([], "a bigint, g array<bigint>, d string").schema
    plain = [{"a": 1, "g": [2, 300], "d": "x"}, {"d": "y", "a": 5}, {"a": 7, "more": [1], "g": [], "d": None}]
    other = [b"\x83\xa1a\xcd\x01\x00\xa1g\xdc\x00\x01\xcc\xff\xa1d\xd9\x01z", b"\xde\x00\x01\xa1a\xd0\xff"]
    data = spark.createDataFrame([(bytearray(x),) for x in [*map(wire.pack, plain), *other]], "data binary")
    want = [(1, [2, 300], "x"), (5, None, "y"), (7, [], None), (256, [255], "z"), (-1, None, None)]
    assert sorted(map(tuple, wire.from_msgpack(data, schema).collect()), key=str) == sorted(want, key=str)
