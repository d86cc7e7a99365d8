"""Scans and sinks (S1-S7): reading, column guards, writing, profiling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from privtab.operators.clean import nan_to_null


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: CSV that any column type comes back from as it was written: quotes doubled,
#: blanks kept, NULL an empty field and an empty text a pair of quotes.
CSV = {"header": "true", "quote": '"', "escape": '"',
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
       "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
       "positiveInf": "Infinity", "negativeInf": "-Infinity"}


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str | None = None,
               null_values: str | None = None, corrupt: str | None = None, multi_line: bool = False,
               keep_nan: bool = False) -> DataFrame:
    """Read a headered CSV or a Parquet table; NaN becomes NULL
    unless ``keep_nan``.

    Pass ``schema`` for CSV in production: inference costs a full extra scan.
    With a schema, a row that does not fit it stops the read, unless ``corrupt``
    names a column that takes the text of such rows (their other fields that do
    not fit are NULL; see ``accepted``).  ``multi_line``: fields may hold line
    breaks; files are then not split, so only for files of bounded size.
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
        return df if keep_nan else nan_to_null(df)
    # a field without quotes that is empty reads as NULL whatever the null text is;
    # one that no table holds keeps a pair of quotes an empty text
    reader = spark.read.options(**CSV).option("multiLine", str(multi_line).lower()).option("nullValue", "\0NULL")
    if null_values is not None:
        reader = reader.option("nullValue", null_values)
    if schema is None:
        reader = reader.option("inferSchema", "true")
    elif corrupt is None:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    else:
        if corrupt in schema.fieldNames():
            raise ValueError(f"{corrupt} is a column of the schema")
        reader = (reader.schema(StructType([*schema.fields, StructField(corrupt, StringType())]))
                  .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).option("enforceSchema", "true"))
    df = reader.csv(path)
    return df if keep_nan else nan_to_null(df)


def accepted(df: DataFrame, corrupt: str) -> DataFrame:
    """The rows that fitted their schema, without the channel of the others."""
    return df.where(F.col(corrupt).isNull()).drop(corrupt)


def refused(df: DataFrame, corrupt: str) -> DataFrame:
    """The text of the rows that did not; every column is named, as Spark
    refuses to read that channel alone."""
    return df.where(F.col(corrupt).isNotNull())


def read_first(spark: SparkSession, paths: Sequence[str], **kwargs) -> DataFrame:
    """The first readable table among candidates, else an error naming them."""
    errors = []
    for path in paths:
        try:
            df = read_table(spark, path, **kwargs)
            df.schema  # resolve now so a missing path fails here
            return df
        except AnalysisException as exc:  # PATH_NOT_FOUND and friends
            errors.append(f"{path}: {exc.getCondition() or exc}")
    raise FileNotFoundError("none of the candidate tables exists; expected one of "
                            f"{list(paths)} ({'; '.join(errors)})")


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "overwrite", single_file: bool = False) -> None:
    """S3: write a table; a CSV reads back as it was with ``read_table`` and its
    schema.  ``single_file`` only for small report tables."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.options(**CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def existing(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The requested columns that the table has, in request order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def resolve_target(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate target column present; ValueError otherwise."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no target column found; expected one of {list(candidates)}")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows of a table, as a look at it (no order implied)."""
    return df.limit(n)


def profile(df: DataFrame) -> DataFrame:
    """One-row shape of a table (rows, columns) as a DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("int"))
