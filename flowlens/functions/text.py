"""Coercion, normalisation, labels and levels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.schema import LABEL_NAMES


def number(c: Column, fill: float | None = None) -> Column:
    """A number, or `fill` where there is none; NaN counts as none."""
    value = c.try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def plain(c: Column) -> Column:
    """Lower case without white space at the ends; NULL is the empty string."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", ""))


def label_name(c: Column, numeric: bool = False) -> Column:
    """Canonical label: 1 is attack and other numbers benign; texts by name, unknown ones as they are."""
    if numeric:
        # NULL and NaN are no number: they become the text 'nan'
        return F.when(number(c).isNull(), "nan").when(number(c).cast("long") == 1, "attack").otherwise("benign")
    text = F.when(c.isNull(), "nan").otherwise(plain(c))
    names = F.create_map(*map(F.lit, chain.from_iterable(LABEL_NAMES.items())))
    return F.coalesce(F.try_element_at(names, text), text)


def label_from_score(*scores: Column) -> Column:
    """attack from 70, tampered from 40, benign below; of the first score there is, NULL without."""
    s = F.coalesce(*[number(x) for x in scores])
    return F.when(s >= 70, "attack").when(s >= 40, "tampered").when(s.isNotNull(), "benign")


def confidence_label(p: Column) -> Column:
    """Of the largest class probability, whatever the class."""
    return F.when(p >= 0.90, "attack").when(p >= 0.80, "tampered").otherwise("benign")


def risk_level(score: Column) -> Column:
    s = F.least(F.greatest(score, F.lit(0)), F.lit(100))
    return F.when(s >= 90, "very high").when(s >= 70, "high").when(s >= 40, "medium").otherwise("low")


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def aligned(df: DataFrame, names: list[str]) -> DataFrame:
    """df with every column of names, 0 where it was missing."""
    return df.withColumns({c: F.lit(0) for c in names if c not in df.columns})
