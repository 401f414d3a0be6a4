"""Column functions on matched values: checksums, masks, digests, severity."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
BULLET = "•"


def severity_rank(severity: Column) -> Column:
    """1 for INFO to 5 for CRITICAL; null for null and unknown names."""
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(place > 0, place.cast("int"))


def severity_of(rank: Column) -> Column:
    return F.when(rank.between(1, 5), F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int")))


# The decimal digits of all scripts stand in runs of ten; a run begins where the value is 0.
_ZEROS = [chr(c) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), -1) == 0]
_DIGITS = "".join(chr(ord(z) + k) for z in _ZEROS for k in range(10))


def digits_of(value: Column) -> Column:
    """Decimal digits only; those of other scripts count as their ASCII forms. Plain text is not translated."""
    ascii_form = F.when(value.rlike(r"^[\x00-\x7F]*\z"), value).otherwise(F.translate(value, _DIGITS, "0123456789" * len(_ZEROS)))
    return F.regexp_replace(ascii_form, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    d = digits_of(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def nhs_valid(value: Column) -> Column:
    """Ten digits, the last being 11 minus the weighted sum mod 11 (11 counts as 0, 10 is never valid)."""
    d = digits_of(value)
    total = sum(F.substring(d, i + 1, 1).cast("int") * (10 - i) for i in range(9))
    check = F.lit(11) - total % 11
    return (F.length(d) == 10) & (F.when(check == 11, 0).otherwise(check) == F.substring(d, 10, 1).cast("int"))


def iban_valid(value: Column) -> Column:
    """15 to 34 ASCII letters and digits that, rearranged and read as a number, leave 1 when divided by 97."""
    flat = F.upper(F.regexp_replace(value, r"(?U)[^\p{L}\p{N}]", ""))
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    step = lambda acc, c: F.when(
        c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97
    ).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
    return flat.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


VALIDATORS = {"none": lambda v: F.lit(True), "luhn": luhn_valid, "nhs_mod11": nhs_valid, "iban_mod97": iban_valid}


def validator(name: str):
    """Registers a predicate (Column) -> Column under a name that rules may use."""

    def register(f):
        VALIDATORS[name] = f
        return f

    return register


def letters_and_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}\p{N}]", "")


def mask(value: Column, keep: Column | int = 0) -> Column:
    """A bullet for each letter or digit; the last ``keep`` stay readable only where more than keep + 3 are there."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    plain = letters_and_digits(value)
    shown = F.when((keep > 0) & (F.length(plain) > keep + 3), keep).otherwise(0)
    return F.concat(F.repeat(F.lit(BULLET), F.length(plain) - shown), F.when(shown > 0, F.right(plain, shown)).otherwise(""))


_NOT_COUNTING = regex.compile(r"[^\p{L}\p{N}]+")
_DOTLESS = str.maketrans("ı", "i")  # full case folding keeps it apart from i


def normalised(value: str | None) -> str | None:
    """The form by which values are compared: compatibility-composed, fully case-folded, dotless i as i, then only what is
    a letter or a number. Plain ASCII needs no more than lower case."""
    if value is None or value.isascii():
        return value and _NOT_COUNTING.sub("", value.lower())
    return _NOT_COUNTING.sub("", unicodedata.normalize("NFKC", value).casefold().translate(_DOTLESS))


@F.pandas_udf(T.StringType())
def _normalised(values: pd.Series) -> pd.Series:
    return values.map(normalised)


def normalise(value: Column) -> Column:
    """As :func:`normalised`; values of plain ASCII never leave the JVM."""
    ascii_only = value.rlike(r"^[\x00-\x7F]*\z")
    return F.when(ascii_only, F.regexp_replace(F.lower(value), "[^a-z0-9]", "")).otherwise(_normalised(F.when(~ascii_only, value)))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, of the UTF-8 bytes of a string column, built from sha2 with pads made on the driver."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def digest(value: Column, key: bytes) -> Column:
    """Keyed digest by which equal values are linked: 32 hex digits over the normalised value."""
    return F.substring(hmac_sha256(normalise(value), key), 1, 32)


def digest_of(value: str, key: bytes) -> str:
    """The same digest for a value typed in; blank and over-long values are refused."""
    if not value.strip() or len(value) > 256:
        raise ValueError("a value of 1 to 256 characters is wanted")
    return hmac.new(key, normalised(value).encode(), hashlib.sha256).hexdigest()[:32]


def csv_safe(cell: Column) -> Column:
    """Cells a spreadsheet would take for a formula get a leading quote."""
    return F.when(F.substring(cell, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), cell)).otherwise(cell)


def capped(value: Column, most: int = 4096, marker: str = "…[truncated]") -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit(marker))).otherwise(value)


def flat_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
