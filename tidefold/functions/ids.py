"""Sortable 128-bit job ids: 48 bits of milliseconds, 80 random bits, 26 base-32 characters.

Built-in functions only: an id is split into pieces that fit a long, each is converted between
bases and its digits are translated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet of the ids, and the digits that Spark's conv uses for base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
MAX_MS = (1 << 48) - 1


def _base32(hexadecimal: Column, length: int) -> Column:
    return F.lpad(F.translate(F.conv(hexadecimal, 16, 32), DIGITS, ALPHABET), length, "0")


def encode(binary: Column) -> Column:
    """26 characters of a 16-byte id."""
    h = F.lower(F.hex(binary))  # 128 bits read as 8 + 40 + 40 + 40, the first padded to two characters
    text = F.concat(_base32(F.substring(h, 1, 2), 2), *[_base32(F.substring(h, 3 + 10 * k, 10), 8) for k in range(3)])
    return F.when(F.octet_length(binary) == 16, text)


def normalize(text: Column) -> Column:
    """Upper case, with the look-alikes I, L and O read as 1, 1 and 0; null if it's no id."""
    upper = F.translate(F.upper(text), "ILO", "110")
    return F.when(upper.rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), upper)


def decode(text: Column) -> Column:
    """The 16 bytes of an id's text, null if it's no id."""
    digits = F.translate(normalize(text), ALPHABET, DIGITS)
    part = lambda start, n, width: F.lpad(F.conv(F.substring(digits, start, n), 32, 16), width, "0")
    return F.unhex(F.concat(part(1, 2, 2), part(3, 8, 10), part(11, 8, 10), part(19, 8, 10)))


def time_ms(text: Column) -> Column:
    """The milliseconds in an id's text."""
    return F.conv(F.translate(F.substring(normalize(text), 1, 10), ALPHABET, DIGITS), 32, 10).cast("long")


def build(ms: Column, randomness: Column) -> Column:
    """The id of a time and 10 random bytes; null for times before the epoch or beyond 48 bits."""
    fits = (ms >= 0) & (ms <= MAX_MS) & (F.octet_length(randomness) == 10)
    return F.when(fits, encode(F.unhex(F.concat(F.lpad(F.hex(ms.cast("long")), 12, "0"), F.hex(randomness)))))


def from_hash(ms: Column, *of: Column) -> Column:
    """A reproducible id: the random bytes come from a hash of other columns."""
    return build(ms, F.unhex(F.substring(F.sha2(F.concat_ws("|", *of), 256), 1, 20)))


def to_json(binary: Column) -> Column:
    """An id as a JSON string."""
    return F.concat(F.lit('"'), encode(binary), F.lit('"'))


def from_json(text: Column) -> Column:
    """The 16 bytes of an id that is a JSON string, null for anything else."""
    return decode(F.when(text.rlike('^".*"$'), F.substring(text, F.lit(2), F.length(text) - 2)))


def is_zero(binary: Column) -> Column:
    return binary == F.unhex(F.lit("0" * 32))
