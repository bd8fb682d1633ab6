"""Scalar expressions. All are built-in column functions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, functions as F

DateLike = Column | date | str

# Fixed values.
UNSPECIFIED = "غير محدد"
UNSPECIFIED_UNIT = "غير محددة"
AGE_GROUPS = ["أقل من 18", "18-45", "46-65", "أكبر من 65", UNSPECIFIED]
SHIFT_HOURS = {"M": 8, "A": 8, "L": 12, "N": 12, "NM": 18, "AN": 18}
DEFAULT_SESSION_PRICE = 200.0
DEFAULT_BAG_PRICE = 150.0
SHEET_EPOCH_DAYS = 25569
# Days from 1970-01-01 to 0001-01-01 and 9999-12-31.
FIRST_DAY, LAST_DAY = -719_162, 2_932_896
EXPIRING_DAYS = 30
LOW_STOCK = 10
INVOICE_PREFIX = "INV-"
CLAIM_FROM, CLAIM_TO = "من ", " إلى "

NUMERIC_PREFIX = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: DateLike) -> Column:
    """A date parameter as a column; text is read as yyyy-MM-dd."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def age_years(dob: Column | str, as_of: DateLike) -> Column:
    """Full years lived on `as_of`."""
    dob, day = column(dob), as_date(as_of)
    before_birthday = F.date_format(day, "MMdd") < F.date_format(dob, "MMdd")
    return F.year(day) - F.year(dob) - F.when(before_birthday, 1).otherwise(0)


def age_group(dob: Column | str, as_of: DateLike) -> Column:
    """Age label from the difference of the calendar years alone."""
    years = F.year(as_date(as_of)) - F.year(column(dob))
    return bucket_age(years)


def bucket_age(years: Column | str) -> Column:
    years = column(years)
    under, middle, senior, over, unknown = AGE_GROUPS
    return (
        F.when(years.isNull(), unknown)
        .when(years < 18, under)
        .when(years <= 45, middle)
        .when(years <= 65, senior)
        .otherwise(over)
    )


def add_months_overflow(day: Column | str, months: Column | int) -> Column:
    """Same day number `months` later; days past the month end run into the next month."""
    day = column(day)
    months = F.lit(months) if isinstance(months, int) else months
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)


def referral_expiry(referral_date: Column | str, months: Column | str) -> Column:
    """Expiry after a number of months given as text; blank, zero or unreadable means 12."""
    digits = F.regexp_extract(column(months).cast("string"), r"^\s*[+-]?[0-9]+", 0)
    given = F.expr("try_cast(null as int)") if months is None else F.trim(digits).try_cast("int")
    return add_months_overflow(referral_date, F.coalesce(F.nullif(given, F.lit(0)), F.lit(12)))


# Months covered by each report period.
PERIOD_MONTHS = {"monthly": 1, "quarterly": 3, "semi-annually": 6, "annually": 12}


def period_bounds(kind: str, day: DateLike) -> tuple[Column, Column]:
    """First and last day of the calendar period that holds `day`."""
    if kind not in PERIOD_MONTHS:
        raise ValueError(f"unknown period {kind!r}, expected one of {list(PERIOD_MONTHS)}")
    span, day = PERIOD_MONTHS[kind], as_date(day)
    first_month = F.floor((F.month(day) - 1) / span) * span + 1
    start = F.make_date(F.year(day), first_month.cast("int"), F.lit(1))
    return start, F.last_day(F.add_months(start, span - 1))


def previous_period(start: DateLike, end: DateLike) -> tuple[Column, Column]:
    """The period of equal length that ends the day before `start`."""
    start, end = as_date(start), as_date(end)
    prev_end = F.date_sub(start, 1)
    return F.date_sub(prev_end, F.datediff(end, start)), prev_end


def month_bounds(month: str) -> tuple[Column, Column]:
    """First day of 'YYYY-MM' and first day of the next month."""
    start = F.lit(f"{month}-01").cast("date")
    return start, F.add_months(start, 1)


def month_days(month: str) -> list[date]:
    """The days of 'YYYY-MM'."""
    year, number = (int(part) for part in month.split("-"))
    first = date(year, number, 1).toordinal()
    after = date(year + number // 12, number % 12 + 1, 1).toordinal()
    return [date.fromordinal(n) for n in range(first, after)]


WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def dates_by_weekday(month: str) -> dict[str, list[date]]:
    """The days of 'YYYY-MM' by weekday token."""
    days = month_days(month)
    return {name: [d for d in days if d.weekday() == i] for i, name in enumerate(WEEKDAYS)}


def month_label(day: Column | str) -> Column:
    return F.date_format(column(day), "yyyy-MM")


def parse_sheet_date(value: Column | str) -> Column:
    """ISO date text or a sheet serial number; anything else is NULL.

    Serials run to the last day a date can hold, 9999-12-31 (2958465).
    """
    text = F.trim(column(value))
    serial = F.nullif(text.try_cast("double"), F.lit(0.0)) - SHEET_EPOCH_DAYS
    days = F.floor(serial).cast("string").try_cast("int")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.coalesce(
        iso.try_cast("date"),
        F.when(days.between(FIRST_DAY, LAST_DAY), F.date_add(F.lit("1970-01-01").cast("date"), days)),
    )


def ascii_lower(c: Column | str) -> Column:
    """Lower case for A-Z only; other letters compare as they are."""
    return F.translate(column(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matches_any(term: str, cols: list[str]) -> Column:
    """Any column holds the term; `%` and `_` in it stay wildcards, `\\` is plain."""
    folded = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in term)
    pattern = "%" + folded.replace("\\", "\\\\") + "%"
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(ascii_lower(F.col(c).cast("string")).like(pattern), F.lit(False)) for c in cols],
    )


def sqlite_real(text: Column | str) -> Column:
    """The longest numeric prefix as a double, 0.0 when there is none."""
    number = F.trim(F.regexp_extract(column(text), NUMERIC_PREFIX, 0)).try_cast("double")
    return F.when(column(text).isNotNull(), F.coalesce(number, F.lit(0.0)))


def normalise_text(c: Column | str) -> Column:
    return ascii_lower(F.trim(column(c)))


def abnormal(
    result_type: Column | str,
    value: Column | str,
    low: Column | str,
    high: Column | str,
    normal_text: Column | str,
) -> Column:
    """Number outside its bounds, or text other than the stated normal text."""
    result_type, normal_text = column(result_type), column(normal_text)
    number = sqlite_real(value)
    outside = F.coalesce(number < column(low), F.lit(False)) | F.coalesce(number > column(high), F.lit(False))
    differs = F.coalesce(normalise_text(value) != normalise_text(normal_text), F.lit(False))
    return F.coalesce(
        F.when(result_type == "number", outside).when(result_type == "text", differs), F.lit(False)
    )


def weekday_token(day: Column | str) -> Column:
    """Sun, Mon, Tue, Wed, Thu, Fri or Sat."""
    return F.date_format(column(day), "EEE")


def tokens(c: Column | str) -> Column:
    """The trimmed entries of a comma list."""
    return F.transform(F.split(column(c), ","), lambda entry: F.trim(entry))


def days_in_month(day: Column | str) -> Column:
    return F.dayofmonth(F.last_day(column(day)))


def date_of(month: str, day: Column | str) -> Column:
    """Day number of 'YYYY-MM' as a date; NULL if the month has no such day."""
    text = F.concat(F.lit(f"{month}-"), F.lpad(column(day).cast("string"), 2, "0"))
    return text.try_cast("date")


def invoice_id(month: str, patient_id: Column | str) -> Column:
    return F.concat(F.lit(f"{INVOICE_PREFIX}{month.replace('-', '', 1)}-"), column(patient_id).cast("string"))


def claim_period(first: Column | str, last: Column | str, month: str) -> Column:
    first, last = column(first), column(last)
    text = F.concat(F.lit(CLAIM_FROM), first.cast("string"), F.lit(CLAIM_TO), last.cast("string"))
    return F.when(first.isNotNull() & last.isNotNull(), text).otherwise(month)


def label_or_default(c: Column | str, label: str) -> Column:
    """NULL and '' become the label."""
    return F.coalesce(F.nullif(column(c), F.lit("")), F.lit(label))


def number_or_default(c: Column | str, value: float) -> Column:
    """NULL and 0 become the value."""
    return F.coalesce(F.nullif(column(c), F.lit(0.0)), F.lit(value))


def shift_hours(code: Column | str) -> Column:
    """Hours of a shift code, 0 for any other text."""
    pairs = [F.lit(x) for pair in SHIFT_HOURS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column(code)), F.lit(0))


def is_non_negative_int(c: Column | str) -> Column:
    number = column(c).cast("string").try_cast("double")
    return F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False))


def int_part(c: Column | str) -> Column:
    """Whole part of a number or numeric text, cut toward zero; NULL if not numeric."""
    number = column(c).cast("string").try_cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return whole.cast("string").try_cast("bigint")


def plain_text(c: Column | str, dtype: str) -> Column:
    """Value as text. Doubles as a script writes them: the shortest digits, without exponent
    from 0.000001 up to below 1e21."""
    c = column(c)
    if dtype not in ("double", "float"):
        return c.cast("string")
    text = F.abs(c).cast("string")
    # Most numbers need none of what follows: their text has no exponent.
    without = F.when(text.endswith(".0"), F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    without = F.when(c < 0, F.concat(F.lit("-"), without)).otherwise(without)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^([0-9.]+)E", 1), r"\.0$", "")
    digits = F.regexp_replace(mantissa, r"\.", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    size = F.length(digits)
    whole = F.when(size <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(
        F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, size))
    )
    tail = F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), size))).otherwise("")
    sign = F.when(power > 0, "e+").otherwise("e-")
    short = F.concat(F.substr(digits, F.lit(1), F.lit(1)), tail, sign, F.abs(power).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when((power < -6) | (power > 20), short).when(power < 0, small).otherwise(whole)
    signed = F.when(c < 0, F.concat(F.lit("-"), plain)).otherwise(plain)
    return F.when(~text.contains("E"), without).otherwise(signed)


def sql_literal(text: Column) -> Column:
    """Quoted SQL text, or NULL unquoted."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(quoted, F.lit("NULL"))


def non_blank(c: Column | str) -> Column:
    """Not NULL and not ''."""
    c = column(c)
    return c.isNotNull() & (c.cast("string") != "")
