"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.catalogue import (
    ASSESSMENT, ATTEMPT_CODE, OTHER_ATTEMPT_CODE, OTHER_ATTEMPT_TITLE, TITLE_TAIL,
)


def is_attempt(type_="type", code="event_code", title="title") -> Column:
    usual = (F.col(code) == ATTEMPT_CODE) & (F.col(title) != OTHER_ATTEMPT_TITLE)
    other = (F.col(code) == OTHER_ATTEMPT_CODE) & (F.col(title) == OTHER_ATTEMPT_TITLE)
    return (F.col(type_) == ASSESSMENT) & (usual | other)


def is_success(event_data="event_data", parse: bool = False) -> Column:
    """'true' anywhere in the text; with ``parse``, the value of the key ``correct``."""
    if parse:
        return F.coalesce(json_value(event_data, "correct", "boolean"), F.lit(False))
    return F.col(event_data).contains("true")


def accuracy_group(attempts: Column, successes: Column) -> Column:
    """3, 2, 1, 0 for a success ratio of 1, one half, below one half, 0; anything else is 0."""
    ratio = F.try_divide(successes.cast("double"), attempts.cast("double"))
    return (
        F.when(ratio == 1, 3).when(ratio == 0.5, 2).when((ratio < 0.5) & (ratio > 0), 1).otherwise(0)
    )


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def fill0(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]


def assign_where(mask: Column, value: Column, otherwise: Column | None = None) -> Column:
    """``value`` on rows under the mask; the others keep their value, or null."""
    return F.when(mask, value).otherwise(otherwise if otherwise is not None else F.lit(None))


def round_int(x: Column) -> Column:
    return F.round(x).cast("int")


def parse_time(text: Column, strict: bool = True) -> Column:
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def date_parts(ts: str) -> dict[str, Column]:
    """Calendar columns; the day of the week counts from Monday = 0."""
    t = F.col(ts)
    return {
        "date": F.to_date(t), "month": F.month(t), "hour": F.hour(t), "year": F.year(t),
        "dayofweek": F.weekday(t),
    }


def strip_right(text: Column, characters: str = TITLE_TAIL) -> Column:
    """Remove trailing characters of a set (not a suffix)."""
    return F.rtrim(text, F.lit(characters))


def title_level(title: Column) -> Column:
    """Last digit of a title that names a level, 0 for other titles, null for a level without one."""
    return F.when(title.contains("Level"), F.right(F.trim(title), F.lit(1)).try_cast("int")).otherwise(0)


def row_sum(*names: str) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


def json_value(column: str, key: str, type_: str) -> Column:
    """One key of a JSON object text; null when the text or the value does not fit."""
    return F.get_json_object(column, f"$.{key}").try_cast(type_)


def paste(*columns: str, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


def collapse(df: DataFrame, columns: Sequence[str], order: Sequence[str], collapse_by: str,
             by: Sequence[str], sep: str = " ") -> DataFrame:
    """One string per group: the pasted rows joined in the given order.

    The text of a group is one value by definition, so a group has to fit one row.
    """
    pair = F.struct(*order, paste(*columns, sep=sep).alias("_text"))
    texts = F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["_text"])
    return df.groupBy(*by).agg(F.array_join(texts, collapse_by).alias("pasted"))


def prefixed(prefix: str, names: Sequence[str]) -> list[str]:
    return [f"{prefix}{n}" for n in names]


def clip(x: Column, bound: float = 0.999) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def fisher_z(k: Column) -> Column:
    return 0.5 * F.log((1 + k) / (1 - k))


def inverse_fisher_z(z: Column) -> Column:
    return (F.exp(2 * z) - 1) / (F.exp(2 * z) + 1)
