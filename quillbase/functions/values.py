"""Date rounding, arithmetic that keeps a number's width, key bytes, hybrid clock versions."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NUMBERS, ModelError

#: Units of date histograms, short to long; index 8 of the format is unused.
UNITS = ("nanos", "micros", "millis", "seconds", "minutes", "hours", "days", "months", "quarters", "years", "decades", "centuries", "millennia")
_TRUNC = {"micros": "MICROSECOND", "millis": "MILLISECOND", "seconds": "SECOND", "minutes": "MINUTE", "hours": "HOUR", "days": "DAY", "months": "MONTH", "quarters": "QUARTER", "years": "YEAR"}
_YEARS = {"decades": 10, "centuries": 100, "millennia": 1000}
_NANOS = {"nanos": 1, "micros": 1_000, "millis": 1_000_000, "seconds": 10**9, "minutes": 60 * 10**9, "hours": 3600 * 10**9}


def round_to(c: Column, unit: str, kind: str = "datetime") -> Column:
    """The start of the unit that holds a date, datetime or time (a long of nanoseconds)."""
    if unit not in UNITS:
        raise ModelError(f"no date unit {unit}")
    if kind == "time":
        if unit not in _NANOS:
            return c - c
        return c - F.pmod(c, F.lit(_NANOS[unit]))
    if unit == "nanos":
        return c
    if kind == "date":
        if unit in _YEARS:
            return F.make_date(F.year(c) - F.year(c) % _YEARS[unit], F.lit(1), F.lit(1))
        return c if unit in _NANOS or unit == "days" else F.trunc(c, _TRUNC[unit]).cast("date")
    if unit in _YEARS:
        return F.make_date(F.year(c) - F.year(c) % _YEARS[unit], F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(_TRUNC[unit], c).cast("timestamp_ntz")


def _wrap(total: Column, kind: str) -> Column:
    bits, signed, carrier = NUMBERS[kind]
    span = F.lit(str(1 << bits)).cast("decimal(38,0)")
    low = F.pmod(total, span)
    if signed:
        low = F.when(low >= F.lit(str(1 << (bits - 1))).cast("decimal(38,0)"), low - span).otherwise(low)
    return low.cast(carrier)


def sum_of(c: Column, kind: str, precision: int = 38, scale: int = 0) -> Column:
    """Null without values; integers wrap in their own width, decimals raise beyond their digits, floats as usual."""
    if kind in NUMBERS and NUMBERS[kind][0]:
        return _wrap(F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)"), kind)
    if kind == "decimal":
        total = F.sum(c)
        return F.when(F.abs(total) < F.lit("1" + "0" * (precision - scale)).cast("decimal(38,0)"), total.cast(f"decimal({precision},{scale})")).when(total.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("a decimal sum has too many digits")))
    return F.sum(c)


def average_of(c: Column, kind: str, precision: int = 38, scale: int = 0) -> Column:
    """Integers: the wrapped sum by the count, towards zero, where the count narrows to the width too (a count that
    narrows to 0 gives null). Decimals keep their scale, half to even, from the unscaled sum's quotient and remainder.
    Floats as usual."""
    if kind in NUMBERS and NUMBERS[kind][0]:
        carrier = NUMBERS[kind][2]
        n = F.nullif(_wrap(F.count(c).cast("decimal(38,0)"), kind).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
        t = sum_of(c, kind).cast("decimal(20,0)")
        return ((t - t % n) / n).cast("decimal(20,0)").cast(carrier)
    if kind == "decimal":
        n = F.count(c).cast("decimal(20,0)")
        t = F.sum((c * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal({min(precision, 28)},0)"))
        rest = t % F.nullif(n, F.lit(0).cast("decimal(20,0)"))
        q = ((t - rest) / n).cast(f"decimal({precision},0)")
        twice = F.abs(rest) * 2
        q = q + F.when((twice > n) | ((twice == n) & (q % 2 != 0)), F.signum(t).cast("int")).otherwise(0)
        return F.when(n > 0, (q.cast(f"decimal({precision},0)") / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal({precision},{scale})"))
    return F.avg(c)


def arithmetic(kind: str) -> None:
    if kind not in NUMBERS and kind != "decimal":
        raise ModelError(f"no arithmetic on {kind}")


def key_bytes(c: Column, kind: str, reverse: bool = False) -> Column:
    """Bytes whose order is the value's: big-endian, sign turned; reversed parts have all bits turned."""
    if kind in NUMBERS and NUMBERS[kind][0]:
        bits, signed, _ = NUMBERS[kind]
        if bits == 64 and signed:
            h = F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63))))
        elif bits == 64:
            h = F.conv(c.cast("string"), 10, 16)
        else:
            h = F.hex(c.cast("long") + F.lit(1 << (bits - 1) if signed else 0))
        digits = F.lpad(h, bits // 4, "0")
    elif kind == "enum":
        digits = F.lpad(F.hex(c.cast("long")), 4, "0")
    elif kind == "boolean":
        digits = F.when(c, F.lit("01")).otherwise(F.lit("00"))
    elif kind == "date":
        return key_bytes(F.unix_date(c), "sint32", reverse)
    elif kind == "datetime":
        return key_bytes(F.unix_micros(c.cast("timestamp")), "sint64", reverse)
    elif kind == "string":
        digits = F.hex(F.encode(c, "utf-8"))
    else:
        digits = F.hex(c)
    return F.unhex(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210") if reverse else digits)


class Clock:
    """Hybrid logical clock: 44 bits of milliseconds and 20 of a counter, always rising."""

    LOGICAL = 20

    def __init__(self):
        self._last, self._lock = 0, threading.Lock()

    def next(self, seen: int = 0) -> int:
        with self._lock:
            self._last = max(int(time.time() * 1000) << self.LOGICAL, self._last + 1, seen + 1)
            return self._last

    @classmethod
    def parts(cls, version: int) -> tuple[int, int]:
        return version >> cls.LOGICAL, version & ((1 << cls.LOGICAL) - 1)


def uuid_v4(seed: Column) -> Column:
    """Bytes of a version 4 UUID from a seed of its own: the same whenever a task runs again."""
    h = F.md5(seed.cast("string"))
    return F.unhex(F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), F.lit("a"), F.substring(h, 18, 15)))


def uuid_v7(version: int, seed: Column) -> Column:
    """Milliseconds of a version, then bits from a seed."""
    h = F.md5(seed.cast("string"))
    return F.unhex(F.concat(F.lit(f"{Clock.parts(version)[0]:012X}"), F.lit("7"), F.substring(h, 14, 3), F.lit("a"), F.substring(h, 18, 15)))
