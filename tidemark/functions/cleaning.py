"""Clean-up of dimensions, keys and amounts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.minutes import day_number, minute_text
from tidemark.functions.text import strip_space
from tidemark.spec import (
    DEFAULT_DIM_LABELS,
    MISSING_KEY_TEXTS,
    MISSING_KEY_WORDS,
    DimLabel,
    MetricSpec,
)


def strip_headers(df: DataFrame) -> DataFrame:
    """Trim the column names of a detail file."""
    return df.toDF(*[str(c).strip() for c in df.columns])


def require_columns(df: DataFrame, spec: MetricSpec) -> None:
    """One error that lists all missing metric and dimension columns."""
    present = set(df.columns)
    metrics = [c for c in [*spec.distincts, *spec.sums] if c not in present]
    dims = [c for c in spec.dims if c not in present]
    problems = []
    if metrics:
        problems.append(f"metric columns missing: {metrics}")
    if dims:
        problems.append(f"dimension columns missing: {dims}")
    if spec.time_col not in present:
        problems.append(f"time column missing: {spec.time_col}")
    if spec.day_col and spec.day_col not in present:
        problems.append(f"day column missing: {spec.day_col}")
    if problems:
        raise ValueError("; ".join(problems))


def select_spec(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Only the columns the spec names, in spec order."""
    require_columns(df, spec)
    return df.select(*spec.input_columns)


def coalesce_columns(df: DataFrame, out: str, columns: Sequence[str]) -> DataFrame:
    """Add ``out`` as the first non-null column; an existing ``out`` is kept."""
    if out in df.columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise ValueError(f"cannot build {out}: missing input columns {missing}")
    return df.withColumn(out, F.coalesce(*columns))


def dim_value(col: Column, rule: DimLabel) -> Column:
    """P10 for one column."""
    if rule.label is None:
        return col
    return F.coalesce(F.nullif(col, F.lit("")) if rule.blank_is_missing else col, F.lit(rule.label))


def normalize_dims(
    df: DataFrame,
    dims: Sequence[str],
    labels: Mapping[str, DimLabel] = DEFAULT_DIM_LABELS,
    blank_is_missing: bool = True,
) -> DataFrame:
    """P10: dimensions as text with a label for missing values."""
    default = DimLabel(blank_is_missing=blank_is_missing)
    present = [d for d in dims if d in df.columns]
    return df.withColumns(
        {d: dim_value(F.col(d).cast("string"), labels.get(d, default)) for d in present}
    )


def valid_key(
    col: Column | str,
    texts: Sequence[str] = MISSING_KEY_TEXTS,
    words: Sequence[str] = MISSING_KEY_WORDS,
) -> Column:
    """True for a key that counts; null and null-like texts do not."""
    col = F.col(col) if isinstance(col, str) else col
    text = strip_space(col.cast("string"))
    good = ~text.isin(*texts) if texts else F.lit(True)
    if words:
        good = good & ~F.lower(text).isin(*words)
    return col.isNotNull() & good


def key_or_null(df: DataFrame, name: str, spec: MetricSpec) -> Column:
    """The key, or null when it must not count. Only text can hold null-like texts."""
    if df.schema[name].dataType.typeName() != "string":
        return F.col(name)
    return F.when(valid_key(name, spec.key_texts, spec.key_words), F.col(name))


def amount(col: Column | str, sum_type: str = "double") -> Column:
    """A number to add up; a bad or missing value counts as 0.

    A double holds any amount, however large or small. A decimal type keeps only what fits it; the rest counts as bad.
    """
    col = F.col(col) if isinstance(col, str) else col
    value = col.try_cast(sum_type)
    if sum_type == "double":
        value = F.nanvl(value, F.lit(None).cast("double"))
    return F.coalesce(value, F.lit(0).cast(sum_type))


def numeric_metrics(df: DataFrame, columns: Sequence[str], sum_type: str = "double") -> DataFrame:
    """P9 for several columns."""
    return df.withColumns({c: amount(c, sum_type) for c in columns})


def export_names(
    df: DataFrame,
    bucket: str = "bucket",
    period: str = "period",
    minute_name: str = "date_minute",
    day_name: str = "date_p",
) -> DataFrame:
    """Bucket as ``date_minute`` text, period as ``date_p`` integer."""
    return df.withColumns({bucket: minute_text(bucket), period: day_number(period)}).withColumnsRenamed(
        {bucket: minute_name, period: day_name}
    )
