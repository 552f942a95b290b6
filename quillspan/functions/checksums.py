"""Check digits as column expressions: name -> (string column -> boolean column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control letters by number mod 23, and the digits that stand for a leading letter.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NIE_FIRST = ("XYZ", "012")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _dni(plain: Column) -> Column:
    number = F.try_element_at(F.array(F.substring(plain, 1, 8).try_cast("int")), F.lit(1))
    letter = F.substring(F.lit(DNI_LETTERS), (F.pmod(number, F.lit(23)) + 1).cast("int"), F.lit(1))
    return F.when(plain.rlike("^[0-9]{8}[A-Za-z]$"), F.upper(F.substring(plain, 9, 1)) == letter).otherwise(F.lit(False))


def dni_mod23(c: Column) -> Column:
    return _dni(_plain(c))


def nie_mod23(c: Column) -> Column:
    plain = F.upper(_plain(c))
    digits = F.concat(F.translate(F.substring(plain, 1, 1), *NIE_FIRST), F.substring(plain, 2, 100))
    return F.when(plain.rlike("^[XYZ]"), _dni(digits)).otherwise(F.lit(False))


def _figures(c: Column) -> Column:
    return F.transform(F.split(F.reverse(_digits(c)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def luhn(c: Column) -> Column:
    """Digits only, two at least; every second one from the right doubled."""
    doubled = F.transform(_figures(c), lambda x, i: F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return (F.length(_digits(c)) >= 2) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mod10(c: Column) -> Column:
    return (F.length(_digits(c)) >= 1) & (F.aggregate(_figures(c), F.lit(0), lambda a, x: a + x) % 10 == 0)


CHECKSUMS: dict[str, Callable[[Column], Column]] = {"dni_mod23": dni_mod23, "nie_mod23": nie_mod23, "luhn": luhn, "mod10": mod10}
