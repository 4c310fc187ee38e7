"""Scalar functions as column expressions; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of 0..255 channels, truncated, in exact integer arithmetic."""
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def bin_128(byte: Column) -> Column:
    """128 bins over bytes: 1 to 128 go to 0 to 127, then again from 0."""
    return ((byte + 127) % 128).cast("int")


def bin_letter(byte: Column) -> Column:
    """27 bins over bytes: letters of either case go to 1 to 26, all else to 0."""
    return (
        F.when(byte.between(65, 90), byte - 64).when(byte.between(97, 122), byte - 96).otherwise(F.lit(0)).cast("int")
    )


#: A mapping is an expression from byte to bin and the number of bins.
MAPPINGS: dict[str, tuple[Callable[[Column], Column], int]] = {"128": (bin_128, 128), "letter": (bin_letter, 27)}


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Sum of squared differences over unrolled coordinates."""
    return reduce(lambda s, t: s + t, ((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def distance(a: Sequence[Column], b: Sequence[Column], metric: str = "l2") -> Column:
    if metric not in ("l2", "sqeuclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    d = squared_distance(a, b)
    return F.sqrt(d) if metric == "l2" else d


def rounded(x: Column, digits: int) -> Column:
    """x, not negative, to so many digits as DuckDB rounds it: the product with 10^digits decides, half goes up.

    Spark's round takes the shortest decimal text of x instead: other results where the product is a tie, and most of a row's time.
    """
    scale = F.lit(float(10**digits))
    y = x * scale
    near = F.rint(y)
    out = F.when(y - near == 0.5, near + 1).otherwise(near) / scale
    return F.when(y == float("inf"), x).otherwise(out)


def array_distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """The same over two arrays of any length."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(d) if metric == "l2" else d


def without_prefix(name: Column, prefix: str) -> Column:
    return F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot begins none."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def last_digit(text: Column) -> Column:
    return F.right(text, F.lit(1)).cast("int")


def grouped_number(text: Column) -> Column:
    """A number whose thousands are set apart by ' or , as double."""
    return F.regexp_replace(text, "[',]", "").cast("double")


def microseconds(nanoseconds: Column) -> Column:
    return grouped_number(nanoseconds) / 1000


def passes(n: Column, base: int = 1024) -> Column:
    """How many times a list of n shrinks by ``base`` until one is left; exact where logarithms are not."""
    steps = F.lit(0)
    power = 1
    while power < 2**62:
        steps = steps + F.when(n > power, 1).otherwise(0)
        power *= base
    return steps.cast("int")


def previous_power_of_two(n: Column) -> Column:
    """The largest power of two below n; 0 for 1."""
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1)) - 1))


def darken(color: Column, factor: float = 0.4) -> Column:
    """A #rrggbb color with every channel scaled by 1 - factor and truncated."""
    digits = F.regexp_replace(color, "^#", "")

    def channel(k: int) -> Column:
        v = F.conv(F.substr(digits, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")
        v = F.greatest(F.lit(0), F.floor(v * (1 - factor))).cast("int")
        return F.lpad(F.lower(F.hex(v)), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def shown_byte(code: Column) -> Column:
    """A printable label of a byte: control characters are their number."""
    return F.when(code < 32, code.cast("string")).otherwise(F.chr(code))


def stamp(ts: Column) -> Column:
    """A timestamp as in folder names: date, dash, time to milliseconds."""
    return F.date_format(ts, "yyyyMMdd-HHmmssSSS")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
