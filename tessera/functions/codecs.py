"""Scalar codecs as column expressions: packed floats, packed times, settings, names with cycles, key sizes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cycle that stands for "the latest"; a fixed value of the naming rule.
LATEST = 9999
#: Offset from which records use 8-byte pointers, and the version that such files and records add.
BIG_FILE, BIG_RECORD = 2_000_000_000, 1000


def ranged(x: Column, low: float, high: float, bits: int = 32) -> Column:
    """A double packed into ``bits`` bits over [low, high]; ties go to the even code, codes out of range fail the query."""
    factor = (2.0**bits if bits < 32 else 4294967295.0) / (high - low)
    code = F.bround((x - low) * factor, 0)
    bad = (code < 0) | (code > 4294967295.0)
    return F.when(bad, F.raise_error(F.lit("value out of the packed range"))).otherwise(code).cast("long")


def unranged(code: Column, low: float, high: float, bits: int = 32) -> Column:
    factor = (2.0**bits if bits < 32 else 4294967295.0) / (high - low)
    return code / factor + low


def through_float(x: Column) -> Column:
    """A double kept as a float."""
    return x.cast("float").cast("double")


def short_float(x: Column, bits: int = 12) -> Column:
    """The stored code of a float without a range: 8 bits of exponent, a sign bit, and ``bits`` bits of mantissa.

    The mantissa is rounded to nearest, and cut to its largest value where rounding would carry into the exponent.
    Codes are ``exponent * 65536 + sign and mantissa``; null stays null.
    """
    a = F.abs(x.cast("float").cast("double"))
    guess = F.floor(F.log2(F.greatest(a, F.lit(2.0**-126)))).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(two(guess) > a, guess - 1).when(two(guess + 1) <= a, guess + 1).otherwise(guess)
    tiny = a < 2.0**-126  # kept without the leading bit
    whole = F.floor(a / two(F.when(tiny, F.lit(-126)).otherwise(e) - bits) + 0.5).cast("long")
    mantissa = F.least(whole - F.when(tiny, 0).otherwise(1 << bits), F.lit((1 << bits) - 1))
    sign = F.when(x < 0, 1 << (bits + 1)).otherwise(0)
    return (F.when(tiny, 0).otherwise(e + 127) * 65536 + sign + mantissa).cast("long")


def from_short_float(code: Column, bits: int = 12) -> Column:
    """The float of a code of ``short_float``."""
    exponent, rest = F.shiftright(code, 16), code.bitwiseAND(0xFFFF)
    fraction = rest.bitwiseAND((1 << bits) - 1) / float(1 << bits)
    value = F.when(exponent == 0, fraction * 2.0**-126).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 127))
    return F.when(rest.bitwiseAND(1 << (bits + 1)) != 0, -value).otherwise(value).cast("float")


_PI = re.compile(r"(2\*?|two)?pi(/[24](?!\d))?")


def _bound(text: str) -> float | None:
    """A number, or a multiple of pi, as titles spell them."""
    if found := _PI.search(text):
        size = 2 * math.pi if found[1] else math.pi / int(found[2][1]) if found[2] else math.pi
        return -size if "-" in text else size
    try:
        return float(text)
    except ValueError:
        return None


def parse_range(title: str) -> tuple[float, float, int] | None:
    """(low, high, bits) of a title that ends in ``[low,high]`` or ``[low,high,bits]``.

    The last bracket counts, at the title's beginning or right behind ``/`` and one letter; bits are 2 to 32, 32 where
    none are given.  Where low is not below high there is no range, and under 15 bits stand in ``low`` instead, a tenth
    more.  Other titles have no range: None.
    """
    text, _, tail = title.rpartition("[")
    body, closed, _ = tail.rpartition("]")
    parts = [p.strip().lower() for p in body.split(",")]
    if "[" not in title or not closed or len(parts) not in (2, 3) or text and (len(text) < 2 or text[-2] != "/" or text[-1] == "/"):
        return None
    bits = 32
    if len(parts) == 3:
        if not re.fullmatch(r"\+?[0-9]+", parts[2]) or not 2 <= int(parts[2]) <= 32:
            return None
        bits = int(parts[2])
    low, high = _bound(parts[0]), _bound(parts[1])
    if low is None or high is None:
        return None
    return (bits + 0.1 if low >= high and bits < 15 else low), high, bits


def range_bits(low: float, high: float) -> int:
    """Mantissa bits of a float without a range: folded into ``low`` by ``parse_range``, else 12."""
    return int(low) if low >= high and 0 < low < 15 else 12


def packed(x: Column, title: str) -> Column:
    """The stored code of a float whose column has this title: scaled where it gives a range, else a short float."""
    low, high, bits = parse_range(title) or (0.0, 0.0, 32)
    return ranged(x, low, high, bits) if low < high else short_float(x, range_bits(low, high))


def unpacked(code: Column, title: str) -> Column:
    """The value of a code of ``packed``."""
    low, high, bits = parse_range(title) or (0.0, 0.0, 32)
    return unranged(code, low, high, bits) if low < high else from_short_float(code, range_bits(low, high))


def pack_time(t: Column) -> Column:
    """A time to the second in 32 bits: years from 1995, month, day, hour, minute, second; null before 1995 and after 2058."""
    parts = [(F.year(t) - 1995, 26), (F.month(t), 22), (F.dayofmonth(t), 17), (F.hour(t), 12), (F.minute(t), 6), (F.second(t), 0)]
    out = F.lit(0).cast("long")
    for value, shift in parts:
        out = out.bitwiseOR(F.shiftleft(value.cast("long"), shift))
    return F.when((F.year(t) >= 1995) & (F.year(t) <= 2058), out)


def unpack_time(code: Column) -> Column:
    """The time of a packed code; months and days below 1 count as 1."""
    part = lambda shift, width: F.shiftright(code, shift).bitwiseAND((1 << width) - 1).cast("int")
    one = F.lit(1)
    return F.make_timestamp_ntz(part(26, 6) + 1995, F.greatest(part(22, 4), one), F.greatest(part(17, 5), one), part(12, 5), part(6, 6), part(0, 6))


def compression(setting: Column) -> tuple[Column, Column]:
    """(algorithm, level) of a setting such as 505."""
    return F.floor(setting / 100).cast("int"), (setting % 100).cast("int")


def compression_setting(algorithm: Column, level: Column) -> Column:
    return (algorithm * 100 + level).cast("int")


def name_cycle(text: Column) -> tuple[Column, Column]:
    """(name, cycle) of ``name;cycle``, split at the last ``;``: none and ``*`` mean the latest, another suffix belongs to the name."""
    whole = text.rlike(r";(\d+|\*)$")
    name = F.when(whole, F.regexp_replace(text, r";(\d+|\*)$", "")).otherwise(text)
    digits = F.regexp_extract(text, r";(\d+)$", 1)
    return name, F.when(whole & (digits != ""), F.expr("0") + digits.try_cast("int")).otherwise(LATEST).cast("int")


def string_size(text: Column) -> Column:
    """Bytes of a stored string: one of length, or five from 255 bytes on, and the bytes themselves."""
    n = F.octet_length(text)
    return F.when(n < 255, n + 1).otherwise(n + 5).cast("int")


def key_size(name: Column, title: Column, class_name: Column, big: Column | None = None, basket: bool = False) -> Column:
    """Bytes of a record's header: 26 fixed ones and three strings, 8 more beyond BIG_FILE, 19 more for a basket."""
    big = F.lit(False) if big is None else big
    return (26 + string_size(class_name) + string_size(name) + string_size(title) + F.when(big, 8).otherwise(0) + (19 if basket else 0)).cast("int")


def is_compressed(object_bytes: Column, record_bytes: Column, key_bytes: Column) -> Column:
    return object_bytes != record_bytes - key_bytes


def is_gap(record_bytes: Column) -> Column:
    return record_bytes < 0


def is_big(version: Column) -> Column:
    return version > BIG_RECORD
