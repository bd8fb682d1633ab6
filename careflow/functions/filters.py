"""Row filters. Each takes and returns a DataFrame and leaves pushdown to Catalyst."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from careflow.functions import scalars as S


def search(df: DataFrame, term: str | None, cols: list[str]) -> DataFrame:
    """Rows where any column holds the term; no term keeps all rows."""
    return df.where(S.matches_any(term, cols)) if term else df


def equals_if_given(df: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """Equality on every column whose wanted value is given and whose column exists."""
    for name, value in wanted.items():
        if value not in (None, "") and name in df.columns:
            df = df.where(F.col(name) == F.lit(value))
    return df


def contains(df: DataFrame, col: str, token: str | None) -> DataFrame:
    return search(df, token, [col])


def has_token(df: DataFrame, col: str, token: Column | str) -> DataFrame:
    """Rows whose comma list holds the token."""
    token = F.lit(token) if isinstance(token, str) else token
    return df.where(F.array_contains(S.tokens(col), token))


def expiry_condition(col: str, as_of: S.DateLike, status: str, days: int = S.EXPIRING_DAYS) -> Column:
    """active: from `as_of` on; expiring: within `days`, both ends in; expired: before."""
    day, c = S.as_date(as_of), F.col(col)
    if status == "active":
        return c >= day
    if status == "expiring":
        return c.between(day, F.date_add(day, days))
    if status == "expired":
        return c < day
    raise ValueError(f"unknown expiry status {status!r}")


def expiry_status(
    df: DataFrame, col: str, as_of: S.DateLike, status: str, days: int = S.EXPIRING_DAYS
) -> DataFrame:
    return df.where(expiry_condition(col, as_of, status, days))


def date_between(df: DataFrame, col: str, start: S.DateLike, end: S.DateLike) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(col).between(S.as_date(start), S.as_date(end)))


def in_month(df: DataFrame, col: str, month: str) -> DataFrame:
    """Rows of one 'YYYY-MM', as a half-open range so that it reaches the scan."""
    start, after = S.month_bounds(month)
    return df.where((F.col(col) >= start) & (F.col(col) < after))


def low_stock(df: DataFrame, threshold: int = S.LOW_STOCK, col: str = "quantity") -> DataFrame:
    return df.where(F.col(col) < threshold)


def non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(S.non_blank(col))


def in_set(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    return df.where(F.col(col).isin(values))


def public_columns(df: DataFrame, secret: list[str], order: list[str]) -> DataFrame:
    """Listing without the secret columns."""
    return df.drop(*secret).orderBy(*order)


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)
