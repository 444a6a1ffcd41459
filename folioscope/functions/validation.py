"""Validators of dates, identity numbers, totals and contact data."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import constants as C
from folioscope.functions.text import plain_digits, stripped

_YEAR, _MONTH, _DAY = r"(\d{4})", r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9])"
# The formats in the order in which they are tried, with the places of year, month and day.
DATE_FORMATS = [
    (f"^{_YEAR}-{_MONTH}-{_DAY}$", (1, 2, 3)), (f"^{_DAY}-{_MONTH}-{_YEAR}$", (3, 2, 1)), (f"^{_DAY}/{_MONTH}/{_YEAR}$", (3, 2, 1)), (f"^{_YEAR}/{_MONTH}/{_DAY}$", (1, 2, 3)),
    (f"^{_MONTH}/{_DAY}/{_YEAR}$", (3, 1, 2)), (rf"^{_DAY}\.{_MONTH}\.{_YEAR}$", (3, 2, 1)), (rf"^{_YEAR}\.{_MONTH}\.{_DAY}$", (1, 2, 3)), (f"^{_YEAR}{_MONTH}{_DAY}$", (1, 2, 3)),
]


def parse_date(text: Column) -> Column:
    """The date of a text in the first format that holds it, from 1900 to 2100; null if none does."""
    value = F.regexp_replace(plain_digits(text), r"[\s\p{Z}]", "")

    def read(pattern: str, places: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(value, pattern, i) for i in places)
        found = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        return F.when(F.year(found).between(1900, 2100), found)

    return F.coalesce(*(F.when(value.rlike(p), read(p, at)) for p, at in DATE_FORMATS))


def date_check(text: Column, as_of: Column, past: bool = False, future: bool = False) -> Column:
    """struct(valid, date, reason); what is past or future counts from ``as_of``."""
    found = parse_date(text)
    wrong = F.lit(None).cast("string")
    if past:
        wrong = F.when(found > as_of, F.concat(F.lit("Date "), found.cast("string"), F.lit(" is in the future but must be past")))
    if future:
        wrong = F.coalesce(wrong, F.when(found < as_of, F.concat(F.lit("Date "), found.cast("string"), F.lit(" is in the past but expected future/active"))))
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "Empty date")
        .when(found.isNull(), F.concat(F.lit("Invalid date format or calendar date: "), text))
        .otherwise(F.coalesce(wrong, F.lit("Valid date")))
    )
    return F.struct((found.isNotNull() & wrong.isNull()).alias("valid"), found.alias("date"), reason.alias("reason"))


def governorate(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(C.GOVERNORATES.items())))
    return F.try_element_at(table, code)


def national_id(text: Column, as_of: Column) -> Column:
    """struct(valid, birth_date, governorate_code, governorate, gender, reason) of a 14-digit identity number."""
    n = F.regexp_replace(plain_digits(text), r"[^0-9]", "")
    century = F.substring(n, 1, 1)
    shown = F.concat(F.when(century == "2", "19").otherwise("20"), F.substring(n, 2, 2), F.lit("-"), F.substring(n, 4, 2), F.lit("-"), F.substring(n, 6, 2))
    born, code = F.try_to_date(shown, "yyyy-MM-dd"), F.substring(n, 8, 2)
    name = governorate(code)
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "National ID is missing")
        .when(F.length(n) != 14, F.concat(F.lit("National ID must be 14 digits, got "), F.length(n).cast("string")))
        .when(~century.isin("2", "3"), F.concat(F.lit("Invalid century indicator '"), century, F.lit("' (must be 2 or 3)")))
        .when(born.isNull(), F.concat(F.lit("Invalid birth date digits in ID: "), shown))
        .when(born > as_of, F.concat(F.lit("Birth date "), born.cast("string"), F.lit(" is in the future")))
        .when(name.isNull(), F.concat(F.lit("Unknown governorate code '"), code, F.lit("'")))
        .otherwise("Valid Egyptian National ID")
    )
    valid = reason == "Valid Egyptian National ID"
    gender = F.when(F.substring(n, 13, 1).try_cast("int") % 2 != 0, "Male").otherwise("Female")
    return F.struct(
        valid.alias("valid"), *(F.when(valid, c).alias(a) for c, a in ((born.cast("string"), "birth_date"), (code, "governorate_code"), (name, "governorate"), (gender, "gender"))), reason.alias("reason")
    )


def invoice_math(subtotal: Column, tax: Column, discount: Column, total: Column, tolerance: float = 0.05) -> Column:
    """Whether subtotal + tax - discount is the total; true where there is nothing to check."""
    made = subtotal + F.coalesce(tax, F.lit(0.0)) - F.coalesce(discount, F.lit(0.0))
    return F.when(total.isNull() | subtotal.isNull(), True).otherwise(F.abs(made - total) <= tolerance)


def passport_number(text: Column) -> Column:
    return F.coalesce(F.upper(stripped(text)).rlike("^[A-Z0-9]{7,10}$"), F.lit(False))


def mrz_check_digit(text: Column) -> Column:
    """Check digit of machine-readable data: weights 7, 3, 1 on digits and letters from A = 10; all else counts 0."""

    def value(i: Column) -> Column:
        c = F.substring(text, i + 1, F.lit(1))
        n = F.when(c.rlike("[0-9]"), c.try_cast("int")).when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(0)
        return n * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)

    places = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i)) % 10


def email(text: Column) -> Column:
    return F.coalesce(stripped(text).rlike(C.VALID_EMAIL), F.lit(False))


def phone(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[\s\p{Z}\-().]", "")).between(7, 15), F.lit(False))
