"""Composite case keys: category digit, district(4), unit(4), year(4), serial(5)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import CASE_KEY_FIRST_DIGITS
from .text import _col


def _pad(c: Column | str, width: int) -> Column:
    text = _col(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def case_key(category, district, unit, year, serial) -> Column:
    return F.concat(_col(category).cast("string"), _pad(district, 4), _pad(unit, 4), _pad(year, 4), _pad(serial, 5))


def case_number(year, serial) -> Column:
    return F.concat(_col(year).cast("string"), _pad(serial, 5))


def parse_case_key(key: Column | str) -> Column:
    k = _col(key)
    piece = lambda start, n: F.substring(k, start, n).try_cast("int")
    return F.struct(piece(1, 1).alias("category"), piece(2, 4).alias("district"), piece(6, 4).alias("unit"),
                    piece(10, 4).alias("year"), piece(14, 5).alias("serial"))


def valid_case_key(key: Column | str, first_digits=CASE_KEY_FIRST_DIGITS) -> Column:
    digits = "".join(str(d) for d in first_digits)
    return F.coalesce(_col(key).rlike(f"^[{digits}][0-9]{{17}}$"), F.lit(False))


def number_matches_key(number: Column | str, key: Column | str) -> Column:
    """The case number is the tail of the key (year and serial)."""
    return F.coalesce(_col(number) == F.substring(_col(key), 10, 9), F.lit(False))
