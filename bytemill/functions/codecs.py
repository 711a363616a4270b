"""Codecs by name and id, and Arrow functions that run them on columns.

brotli keeps its id, but its library may be absent: it then stays out of every search, and using it by name or
decoding its id is an error; no other codec takes its place.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from bytemill.schema import CODECS, NOT_SEARCHED, MissingCodecError

try:
    import brotli
except ImportError:
    brotli = None


@dataclass(frozen=True)
class Codec:
    """Default level with its range (None: no levels), and functions that make a compressor for a level, and a decompressor."""

    level: int | None
    levels: range | None
    compressor: Callable[[int | None], Callable[[bytes], bytes]]
    decompress: Callable[[bytes], bytes]


def _zstd(level):
    return zstandard.ZstdCompressor(level=level).compress


_KNOWN = {
    "store": Codec(None, None, lambda level: bytes, bytes),
    "gzip": Codec(6, range(10), lambda level: lambda b: gzip.compress(b, level, mtime=0), gzip.decompress),
    "bzip2": Codec(9, range(1, 10), lambda level: lambda b: bz2.compress(b, level), bz2.decompress),
    "lzma": Codec(6, range(10), lambda level: lambda b: lzma.compress(b, preset=level), lzma.decompress),
    "zstd": Codec(9, range(1, 23), _zstd, lambda b: zstandard.ZstdDecompressor().decompress(b)),
}
if brotli:
    _KNOWN["brotli"] = Codec(9, range(12), lambda level: lambda b: brotli.compress(b, quality=level), lambda b: brotli.decompress(b))


def get(name: str) -> Codec:
    """KeyError for a name that is no codec's, MissingCodecError for one whose library is absent."""
    if name not in CODECS:
        raise KeyError(f"unknown codec {name!r}; known: {', '.join(CODECS)}")
    if name not in _KNOWN:
        raise MissingCodecError(f"the library of codec {name!r} isn't installed")
    return _KNOWN[name]


def compress(data: bytes, name: str, level: int | None = None) -> bytes:
    codec = get(name)
    if level is not None and codec.levels is not None and level not in codec.levels:
        raise ValueError(f"{name} has levels {codec.levels.start} to {codec.levels.stop - 1}")
    return codec.compressor(codec.level if level is None else level)(bytes(data))


def decompress(data: bytes, name: str) -> bytes:
    return get(name).decompress(bytes(data))


def names(everything: bool = False, installed: bool = False) -> list[str]:
    """Codecs in the order of ids; without `everything` those of a search; with `installed` those that can run."""
    return [c for c in CODECS if (everything or c not in NOT_SEARCHED) and (not installed or c in _KNOWN)]


def id_of(name: str) -> int:
    get_known = {c: i for i, c in enumerate(CODECS)}
    if name not in get_known:
        raise KeyError(f"unknown codec {name!r}")
    return get_known[name]


def name_of(number: int) -> str:
    if not 0 <= number < len(CODECS):
        raise KeyError(f"no codec has the id {number}")
    return CODECS[number]


def registry(spark: SparkSession) -> DataFrame:
    """algorithm_id, name, in_default_search."""
    rows = [(i, c, c not in NOT_SEARCHED) for i, c in enumerate(CODECS)]
    return spark.createDataFrame(rows, "algorithm_id int, name string, in_default_search boolean")


def id_column(name: Column) -> Column:
    """Id of the codec in a column; null for names that are no codec's."""
    return F.try_element_at(F.create_map(*[x for i, c in enumerate(CODECS) for x in (F.lit(c), F.lit(i))]), name)


def name_column(number: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for i, c in enumerate(CODECS) for x in (F.lit(i), F.lit(c))]), number.cast("int"))


@F.pandas_udf(BinaryType())
def compressed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """compressed(content, algorithm): a compressor is made once per codec and task."""
    made: dict[str, Callable] = {}
    for content, algorithm in parts:
        out = []
        for data, name in zip(content, algorithm, strict=True):
            if name not in made:
                codec = get(name)
                made[name] = codec.compressor(codec.level)
            out.append(made[name](bytes(data)))
        yield pd.Series(out, dtype=object)


@F.pandas_udf(BinaryType())
def decompressed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """decompressed(payload, algorithm)."""
    for payload, algorithm in parts:
        yield pd.Series([decompress(data, name) for data, name in zip(payload, algorithm, strict=True)], dtype=object)


def check_names(*wanted: str) -> None:
    """Raises before a job starts for names that are unknown or can't run."""
    for name in wanted:
        get(name)
