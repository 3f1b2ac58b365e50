"""Value clean-up, flags and conforming tables to a wanted column list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(value: Column) -> Column:
    """NaN becomes NULL, so that comparisons and averages treat both alike."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def number_of(text: Column) -> Column:
    """Double of a text field; blank, ``nan`` and anything unreadable become NULL."""
    return clean(F.trim(text).try_cast("double"))


def is_positive(value: Column) -> Column:
    """True for v > 0. NaN is excluded: Spark would sort it above every number."""
    return (value > 0) & ~F.isnan(value)


def exceeds(value: Column, limit: float) -> Column:
    """1.0 when the value is above the limit, else 0.0 (also for NULL)."""
    return F.when(clean(value) > limit, 1.0).otherwise(0.0)


def clipped(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; NULL stays NULL."""
    bounded = F.greatest(F.lit(low), F.least(value, F.lit(high)))
    return F.when(value.isNotNull(), bounded)


def utc_text(field: Column) -> Column:
    """``utc`` of a JSON object given as text; plain text is returned as it is."""
    given = F.coalesce(F.get_json_object(field, "$.utc"), field)
    return F.when(F.contains(field, F.lit("{")), given).otherwise(field)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order: existing ones cast, missing ones NULL."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
