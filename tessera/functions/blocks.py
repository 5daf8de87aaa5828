"""Compressed blocks, for binary columns: Arrow-batched, since Spark has no such expressions.

A block has a 9-byte header: two letters of the algorithm, a method byte, and the compressed and plain sizes in 3
bytes each, low byte first; a value is a run of blocks.  Values under ``LEAST`` bytes, and values that do not shrink,
stay as they are.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Algorithms by number and by block letters; smallest value that is compressed; most plain bytes of a block.  Fixed values.
LETTERS = {1: b"ZL", 2: b"XZ", 4: b"L4", 5: b"ZS"}
LEAST, MOST = 512, 0xFFFFFF


def _pack(algorithm: int, level: int, data: bytes) -> bytes:
    if algorithm == 1:
        return zlib.compress(data, level)
    if algorithm == 2:
        return lzma.compress(data, preset=level)
    if algorithm == 4:
        body = pa.compress(data, codec="lz4_raw", asbytes=True)
        return xxhash.xxh64(body, seed=0).digest() + body
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unpack(letters: bytes, body: bytes, size: int) -> bytes:
    if letters == b"ZL":
        return zlib.decompress(body)
    if letters == b"XZ":
        return lzma.decompress(body)
    if letters == b"L4":
        if xxhash.xxh64(body[8:], seed=0).digest() != body[:8]:
            raise ValueError("block checksum mismatch")
        return pa.decompress(body[8:], decompressed_size=size, codec="lz4_raw", asbytes=True)
    if letters == b"ZS":
        return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
    raise ValueError(f"unknown block {letters!r}")


def compress_bytes(data: bytes, algorithm: int, level: int) -> bytes:
    if algorithm not in LETTERS:
        raise ValueError(f"algorithms are {', '.join(map(str, LETTERS))}")
    if level <= 0 or len(data) < LEAST:
        return data
    out = []
    for k in range(0, len(data), MOST):
        plain = data[k : k + MOST]
        body = _pack(algorithm, level, plain)
        if len(body) > MOST:
            return data
        out.append(LETTERS[algorithm] + bytes([1]) + len(body).to_bytes(3, "little") + len(plain).to_bytes(3, "little") + body)
    packed = b"".join(out)
    return packed if len(packed) < len(data) else data


def decompress_bytes(data: bytes, size: int) -> bytes:
    """The plain value of ``size`` bytes; a value of that size was never compressed."""
    if len(data) == size:
        return data
    out, at = [], 0
    while at < len(data):
        head = data[at : at + 9]
        n, plain = int.from_bytes(head[3:6], "little"), int.from_bytes(head[6:9], "little")
        body = data[at + 9 : at + 9 + n]
        if len(head) < 9 or len(body) < n:
            raise ValueError("cut block")
        part = _unpack(head[:2], body, plain)
        if len(part) != plain:
            raise ValueError("block of another size than its header says")
        out.append(part)
        at += 9 + n
    whole = b"".join(out)
    if len(whole) != size:
        raise ValueError("blocks of another size than the value")
    return whole


def compress(column: Column, algorithm: int = 1, level: int = 1) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else compress_bytes(bytes(v), algorithm, level))

    return run(column)


def decompress(column: Column, size: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else decompress_bytes(bytes(v), int(n)) for v, n in zip(values, sizes, strict=True)])

    return run(column, size)


def round_trips(df: DataFrame, column: str, level: int = 1, algorithms: tuple[int, ...] = tuple(LETTERS)) -> DataFrame:
    """``df`` with ``same`` in place of a binary column: whether all algorithms give a value back; null stays null.

    Values are packed and unpacked one by one, so that a task holds the blocks of one value beside an Arrow batch.
    """
    kept = [f for f in df.schema.fields if f.name != column]

    def given_back(data: bytes) -> bool:
        return all(decompress_bytes(compress_bytes(data, a, level), len(data)) == data for a in algorithms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [v is None or given_back(v) for v in (x.as_py() for x in batch.column(column))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(same, pa.bool_())], names=[*(f.name for f in kept), "same"])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField("same", T.BooleanType())]))
