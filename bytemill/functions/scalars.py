"""Column functions of bytes and sizes, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"printable": r"[^\t\n\r -~]", "hex": r"[^0-9a-fA-F]"}


def class_share(content: Column, kind: str) -> Column:
    """Share of the bytes of a class ('printable' or 'hex'); 0 for no bytes."""
    n = F.octet_length(content)
    others = F.regexp_replace(F.decode(content, "ISO-8859-1"), KINDS[kind], "")
    return F.when(n == 0, 0.0).otherwise(F.length(others) / n)


def ratio(original: Column, compressed: Column) -> Column:
    """original / compressed; infinity where nothing is left."""
    return F.when(compressed == 0, float("inf")).otherwise(original / compressed)


def human_size(n: Column) -> Column:
    """Bytes with separators, or KB to TB with one decimal (ties to even), base 1024."""
    def scaled(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))

    return (
        F.when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" B")))
        .when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).when(n < 1024**4, scaled(3, "GB")).otherwise(scaled(4, "TB"))
    )


def unsigned(content: Column, at: int, size: int) -> Column:
    """The big-endian number in `size` bytes from position `at` (from 0); up to eight bytes below 2**63."""
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def packed(number: Column, size: int) -> Column:
    """A number as `size` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))
