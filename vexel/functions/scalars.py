"""Expressions applied to tables, and registration of user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.compiler import compile_expression
from ..lang.values import Fields, Val


def result_column(v: Val):
    """The value as a Column; errors are null, dynamic values and objects are JSON."""
    c = v.col if v.ok is None else F.when(F.coalesce(v.ok, F.lit(False)), v.col)
    return F.to_json(c) if v.kind in ("value", "object") else c


def apply_expressions(df: DataFrame, ids: list[str], expressions: dict, zoom=None) -> DataFrame:
    """The id columns, and a column for each expression over the table's columns."""
    fields = Fields.of(df, zoom=zoom)
    return df.select(*ids, *[result_column(compile_expression(x, fields)).alias(n) for n, x in expressions.items()])


def register(spark: SparkSession, name: str, function: Callable, return_type: str) -> None:
    """A vectorized user function for SQL: it gets and returns pandas Series."""
    spark.udf.register(name, F.pandas_udf(function, return_type))
