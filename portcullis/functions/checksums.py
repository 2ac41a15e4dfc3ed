"""Check digits as column expressions over texts of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public weights of each number, and the national lengths of account numbers.
PESEL = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON = (8, 9, 2, 3, 4, 5, 6, 7)
ID_CARD = (7, 3, 1, 9, 7, 3, 1, 7, 3)
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "NL": 18, "PL": 28, "PT": 25, "SE": 24, "SK": 24}


def _digit(text: Column, at: int) -> Column:
    return F.substring(text, at, 1).try_cast("int")


def weighted(text: Column, weights: tuple[int, ...]) -> Column:
    """The weighted sum of the first digits."""
    return sum((_digit(text, i + 1) * w for i, w in enumerate(weights)), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled and its digits added, makes the sum a multiple of 10."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)),
    )
    return F.length(digits).between(13, 19) & (F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0)


def pesel(digits: Column) -> Column:
    return (F.length(digits) == 11) & ((10 - weighted(digits, PESEL) % 10) % 10 == _digit(digits, 11))


def nip(digits: Column) -> Column:
    """A remainder of 10 is never valid: no digit equals it."""
    return (F.length(digits) == 10) & (weighted(digits, NIP) % 11 == _digit(digits, 10))


def regon(digits: Column) -> Column:
    """A remainder of 10 counts as 0."""
    return (F.length(digits) == 9) & (weighted(digits, REGON) % 11 % 10 == _digit(digits, 9))


def id_card(text: Column) -> Column:
    """Three letters (A is 10) and six digits; the weighted sum is a multiple of 10."""
    value = lambda i: F.ascii(F.substring(text, i, 1)) - F.when(F.lit(i <= 3), 55).otherwise(48)
    return (F.length(text) == 9) & (sum((value(i + 1) * w for i, w in enumerate(ID_CARD)), F.lit(0)) % 10 == 0)


def iban(text: Column) -> Column:
    """Mod-97 over the rearranged number; spaces are left out before."""
    plain = F.regexp_replace(text, r"\s", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda s, c: F.when(c.rlike("[A-Z]"), (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv]), F.substring(plain, 1, 2))
    return (F.length(plain) == known) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def ip_address(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda x: x.try_cast("int") <= 255)
