"""Cleaning (P1-P10, A5-A7): filters, recodes, coercion and imputation.

Each operator is a projection or filter that Catalyst pushes to the scan
(P2/P4 reach Parquet as pushed filters); the imputation statistics are one
aggregate whose few numbers are folded back in as literals.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from privtab.functions.exprs import finite_or as _finite_or
from privtab.functions.exprs import recode as _recode
from privtab.operators.quantile import exact_medians

# Sentinel texts that mean "no answer" in the source surveys.
SENTINELS = ["Missing", "Unknown", "NA", "NaN"]


#: What counts as a number in text (no type suffixes as in "1.5d").
NUMBER = r"(?i)^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity)$"


def keep_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose ``col`` is in ``values`` (pushed down to Parquet)."""
    return df.where(F.col(col).isin(list(values)))


def drop_sentinels(df: DataFrame, cols: Iterable[str],
                   values: Sequence[str] = tuple(SENTINELS)) -> DataFrame:
    """Drop rows holding a sentinel in any of ``cols``; NULLs survive."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.coalesce(~F.col(c).cast("string").isin(list(values)), F.lit(True))
    return df.where(cond)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any (or the given) column."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """P5: value map; unmapped values become NULL."""
    return df.withColumn(out or col, _recode(col, mapping))


def to_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Coercing cast to double; text that is not a number becomes NULL."""
    cols = list(cols)
    for c in cols:
        text = F.trim(F.col(c).cast("string"))
        df = df.withColumn(c, F.when(text.rlike(NUMBER), text.try_cast("double")))
    return nan_to_null(df, cols)


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN is missing; make it NULL before any min/max/median."""
    for f in df.schema.fields:
        if (cols is None or f.name in cols) and f.dataType.typeName() in ("double", "float"):
            df = df.withColumn(f.name, F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)))
    return df


def finite_or(df: DataFrame, cols: Iterable[str], value: float = 0.0) -> DataFrame:
    """NULL/NaN/inf become ``value``."""
    for c in cols:
        df = df.withColumn(c, _finite_or(c, value))
    return df


def impute_const(df: DataFrame, cols: Iterable[str], value: str = "Unknown") -> DataFrame:
    """Categorical NULL becomes a constant.  A column of another type
    (boolean, date) becomes text, which the constant is."""
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(value)))
    return df


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    cols = df.columns if cols is None else list(cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], NumericType)]


def impute_median(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Numeric NULL becomes the column's exact median.

    The medians are narrowed by rank for all columns together
    (``quantile.exact_medians``); only edges and counts reach the driver.
    """
    cols = list(cols)
    medians = exact_medians(df, cols)
    fill = {c: float(v) for c, v in medians.items() if v is not None}
    for c, v in fill.items():
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(v)))
    return df


def null_ratio(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """A5: one row, the NULL share of every column (one scan).  NaN and inf
    count as present, as in the source data frames."""
    cols = df.columns if cols is None else list(cols)
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])


def prune_sparse(df: DataFrame, threshold: float = 0.5,
                 cols: Iterable[str] | None = None) -> DataFrame:
    """Keep columns whose NULL share is strictly below ``threshold``.

    The one-row ratio table (size = number of columns) decides the schema."""
    cols = df.columns if cols is None else list(cols)
    ratios = null_ratio(df, cols).first().asDict()
    keep = [c for c in df.columns if c not in cols or (ratios[c] or 0.0) < threshold]
    return df.select(*keep)


def impute_recipe(df: DataFrame, features: Sequence[str], threshold: float = 0.5,
                  fill_text: str = "Unknown") -> DataFrame:
    """The ``impute`` cleaning recipe: prune sparse columns, median-fill
    numeric ones, constant-fill text ones, then non-finite -> 0."""
    df = nan_to_null(df, features)
    kept = prune_sparse(df.select(*features), threshold).columns
    other = [c for c in df.columns if c not in features]
    df = df.select(*other, *kept)
    nums = numeric_columns(df, kept)
    texts = [c for c in kept if c not in nums]
    df = impute_median(df, nums)
    df = impute_const(df, texts, fill_text)
    return finite_or(df, nums, 0.0)


def strict_recipe(df: DataFrame, features: Sequence[str], target: str,
                  positive, negative, sentinels: Sequence[str] = tuple(SENTINELS)) -> DataFrame:
    """The ``strict`` cleaning recipe: project, drop sentinels, drop NULLs,
    keep the two target values and recode them to 1/0."""
    df = df.select(*features, target)
    df = drop_sentinels(df, [*features, target], sentinels)
    df = drop_nulls(df)
    df = keep_values(df, target, [positive, negative])
    return recode(df, target, {positive: 1, negative: 0}).withColumn(
        target, F.col(target).cast("int"))
