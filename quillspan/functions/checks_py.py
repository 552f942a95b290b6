"""The check digits for rules that run outside the JVM."""

from __future__ import annotations

from quillspan.functions.checksums import DNI_LETTERS, NIE_FIRST


def _figures(s: str) -> list[int]:
    return [int(c) for c in s if c in "0123456789"]


def dni_mod23(s: str) -> bool:
    plain = "".join(c for c in s if c.isalnum())
    number, letter = plain[:8], plain[8:].upper()
    return len(plain) == 9 and number.isascii() and number.isdigit() and letter == DNI_LETTERS[int(number) % 23]


def nie_mod23(s: str) -> bool:
    plain = "".join(c for c in s if c.isalnum()).upper()
    return plain[:1] in tuple(NIE_FIRST[0]) and dni_mod23(plain[:1].translate(str.maketrans(*NIE_FIRST)) + plain[1:])


def luhn(s: str) -> bool:
    d = _figures(s)[::-1]
    return len(d) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod10(s: str) -> bool:
    d = _figures(s)
    return bool(d) and sum(d) % 10 == 0
