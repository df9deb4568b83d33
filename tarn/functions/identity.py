"""Normalisers and format checks for the fields that identify people and companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.scalars import normalize_email

# Brazilian country code, document lengths and check-digit weights.
COUNTRY_CODE = "55"
CPF_LENGTH = 11
CNPJ_LENGTH = 14
CPF_WEIGHTS = ([10, 9, 8, 7, 6, 5, 4, 3, 2], [11, 10, 9, 8, 7, 6, 5, 4, 3, 2])
CNPJ_WEIGHTS = (
    [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2],
    [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2],
)
EMAIL_PATTERN = r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def only_digits(col: Column | str) -> Column:
    return F.regexp_replace(_col(col), r"[^0-9]", "")


def normalize_phone(col: Column | str) -> Column:
    """Digits without international prefix; NULL when nothing is left."""
    digits = F.regexp_replace(only_digits(col), "^00", "")
    local = F.when(
        digits.startswith(COUNTRY_CODE) & (F.length(digits) > 11), F.regexp_replace(digits, f"^{COUNTRY_CODE}", "")
    ).otherwise(digits)
    return F.nullif(local, F.lit(""))


def normalize_field(field: str, col: Column | str | None = None) -> Column:
    """Normal form of an identity field, chosen by its name; '' becomes NULL."""
    col = _col(field if col is None else col).cast("string")
    if "email" in field:
        normal = normalize_email(col)
    elif "phone" in field:
        return normalize_phone(col)
    elif "cnpj" in field:
        digits = only_digits(col)
        normal = F.when(digits != "", F.lpad(digits, CNPJ_LENGTH, "0"))
    elif "cpf" in field:
        digits = only_digits(col)
        normal = F.when(digits != "", F.lpad(digits, CPF_LENGTH, "0"))
    else:
        normal = F.trim(col)
    return F.nullif(normal, F.lit(""))


def is_valid_email(col: Column | str) -> Column:
    return normalize_email(col).rlike(EMAIL_PATTERN)


def digits_of(col: Column | str) -> Column:
    """The decimal digits of a text, as an array of numbers."""
    return F.transform(F.split(only_digits(col), ""), lambda d: d.try_cast("int"))


def check_digit(digits: Column, weights: list[int]) -> Column:
    """Modulo-11 check digit over the leading ``len(weights)`` digits of an array."""
    factors = F.array(*[F.lit(w) for w in weights])
    products = F.zip_with(F.slice(digits, 1, len(weights)), factors, lambda d, w: d * w)
    rest = F.aggregate(products, F.lit(0), lambda total, p: total + p) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _valid_document(col: Column | str, length: int, weights: tuple) -> Column:
    def valid(digits: Column) -> Column:
        shaped = (F.size(digits) == length) & (F.size(F.array_distinct(digits)) > 1)
        right = [check_digit(digits, w) == F.get(digits, F.lit(len(w))) for w in weights]
        return shaped & right[0] & right[1]

    # The one-element transform names the array, so its digits are taken apart once.
    return F.element_at(F.transform(F.array(digits_of(col)), valid), 1)


def is_valid_cpf(col: Column | str) -> Column:
    """Eleven digits, not all equal, both check digits right."""
    return _valid_document(col, CPF_LENGTH, CPF_WEIGHTS)


def is_valid_cnpj(col: Column | str) -> Column:
    """Fourteen digits, not all equal, both check digits right."""
    return _valid_document(col, CNPJ_LENGTH, CNPJ_WEIGHTS)
