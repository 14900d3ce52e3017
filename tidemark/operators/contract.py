"""Contract validation, projection, filters and dedup of raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row for each required header that df lacks; headers are compared without outer blanks, the first of equal ones counts."""
    have = {c.strip() for c in df.columns}
    spark = df.sparkSession
    return spark.createDataFrame([(c,) for c in required if c not in have], "missing string")


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one of the columns is neither null nor empty."""
    return df.filter(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns)).isNotNull())


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: int = 2) -> DataFrame:
    """source_row by an index that the source gives; blank rows count, the header is row 1."""
    return df.withColumn("source_row", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (first - 1)).cast("long"))


def to_day(column: str) -> Column:
    """The day of a date, a timestamp or a text that starts like one; null if it is none."""
    return F.try_to_date(F.substring(F.col(column).cast("string"), 1, 10), "yyyy-MM-dd")


def invalid_dates(df: DataFrame, keys: Sequence[str], column: str, row: str = "source_row") -> DataFrame:
    """For each key with dates that can't be read: the source rows."""
    bad = df.filter(to_day(column).isNull())
    return bad.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def duplicate_dates(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Keys and dates that stand more than once, and how often."""
    return df.groupBy(*keys, date).agg(F.count("*").alias("n")).filter("n > 1")


def in_date_order(df: DataFrame, keys: Sequence[str], date: str, row: str) -> DataFrame:
    return df.orderBy(*keys, date, row)


def rename_fields(df: DataFrame, aliases: DataFrame, field: str, known: Sequence[str]) -> DataFrame:
    """Aliases to canonical names; canonical names stay, unknown ones go. aliases (alias, canonical) is a small dimension."""
    named = df.join(F.broadcast(aliases), F.col(field) == F.col("alias"), "left")
    named = named.withColumn(field, F.coalesce("canonical", field)).drop("alias", "canonical")
    return named.filter(F.col(field).isin(*known))


def distinct_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of the columns without nulls."""
    return df.select(*columns).dropna().distinct()


def future_measurements(df: DataFrame, keys: Sequence[str], date: str, as_of) -> DataFrame:
    """Each key's last date, and whether it lies behind as_of."""
    return df.groupBy(*keys).agg(F.max(date).alias("latest")).withColumn("future_dated", F.col("latest") > F.lit(as_of).cast("date"))


def drop_repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys stand only once: of repeated ones none stays."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """The last row of each key by the columns row."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(r) for r in row))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, null_share: one pass over all columns."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return one.unpivot([], list(columns), "column", "null_share")


def drop_sparse(df: DataFrame, columns: Sequence[str], most: float) -> DataFrame:
    """df without those of the columns whose share of nulls lies above most; the shares are one aggregate row."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns)).first()
    return df.drop(*(c for c in columns if (shares[c] or 0.0) > most))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]


def sequence_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that aren't derived from a window; any name with _load in it counts as derived."""
    return [c for c in numeric_columns(df, exclude) if not any(p in c for p in ("_load", "_lag", "_rmean", "_rstd"))]


def labelled(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def row_at(df: DataFrame, keys: Sequence[str], date: str, day, row: Sequence[str]) -> DataFrame:
    """Each key's last row of one day; the filter reaches the scan."""
    return keep_last(df.filter(F.col(date) == F.lit(day).cast("date")), [*keys, date], row)


def field_side(field: str) -> Column:
    """A or B from a field's name."""
    return F.nullif(F.regexp_extract(field, r"_([AB])(_|$)", 1), F.lit(""))


def field_variable(field: str) -> Column:
    """The field's name without its side."""
    return F.regexp_replace(field, r"_[AB](_.*)?$", "")


def json_number(c: str) -> Column:
    """A number that JSON can hold: null for NaN and infinities."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
