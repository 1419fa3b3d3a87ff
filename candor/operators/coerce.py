"""Coercions of loosely typed columns: lists, booleans, numbers, ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.functions.text import strip


def flatten_strings(c: Column, nested: bool = False) -> Column:
    """Stripped, non-empty texts of an array (of arrays)."""
    return F.filter(F.transform(F.flatten(c) if nested else c, lambda x: strip(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parse_literal(texts: pd.Series) -> pd.Series:
    """Items of a list, tuple or set written as a Python literal, nested or not; null where the text is none."""
    import ast

    def items(value: object) -> list[str]:
        if value is None:
            return []
        if isinstance(value, dict):
            return items(value["text"]) if "text" in value else [str(value)]
        if isinstance(value, (list, tuple, set)):
            return [x for v in value for x in items(v)]
        s = str(value).strip()
        return [s] if s else []

    def one(t: str | None) -> list[str] | None:
        if t is None:
            return None
        try:
            return items(ast.literal_eval(t))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None

    return texts.map(one)


def as_list(df: DataFrame, column: str, literals: bool = True) -> Column:
    """An array of texts from an array, a struct with ``text``, a scalar, or text that holds a JSON or Python list.

    JSON is parsed in the JVM. ``literals`` sends what isn't JSON but looks like a Python collection through an Arrow function;
    anything else is one text. Null and empty give an empty array.
    """
    kind, c = df.schema[column].dataType, F.col(column)
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType) and "text" in kind.names:
        c, kind = c["text"], kind["text"].dataType
    if isinstance(kind, T.ArrayType):
        return F.coalesce(flatten_strings(c, isinstance(kind.elementType, T.ArrayType)), none)
    raw = strip(c.cast("string"))
    parsed = F.coalesce(F.from_json(raw, "array<string>"), F.from_json(raw, "struct<text:array<string>>")["text"])
    if literals:
        parsed = F.coalesce(parsed, F.when(raw.rlike(r"^[\[({]"), _parse_literal(F.when(raw.rlike(r"^[\[({]"), raw))))
    return F.when(raw.isNull() | (raw == ""), none).otherwise(flatten_strings(F.coalesce(parsed, F.array(raw))))


def gold_column(df: DataFrame) -> str:
    """The column that holds gold answers; an error if there is none."""
    for name in ("gold_answers_text", "answers"):
        if name in df.columns:
            return name
    raise ValueError("no column gold_answers_text or answers")


def flag_of(c: Column) -> Column:
    """1 for true and 1, 0 for false and 0, else null; whatever the type."""
    word = F.lower(strip(c.cast("string")))
    number = word.try_cast("double")
    return F.when(word.isin("true", "1") | (number == 1), 1).when(word.isin("false", "0") | (number == 0), 0)


def boolish(df: DataFrame, column: str) -> Column:
    """A numeric column as it is, any other by :func:`flag_of`, per row.

    Deviation, on purpose: whether to read text as numbers is decided per value, not by whether any value of the whole column is
    a number, so a row's result doesn't depend on other rows.
    """
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.NumericType):
        return c.cast("int")
    return F.coalesce(c.cast("string").try_cast("double").cast("int"), flag_of(c))


def to_binary(df: DataFrame, column: str) -> Column:
    """0 or 1: booleans as such, numbers by sign (null and NaN: 0), texts by whether they are true, 1 or yes."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False)).cast("int")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)).cast("int")
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False)).cast("int")


def number_or_zero(c: Column) -> Column:
    return F.nanvl(F.coalesce(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def positive_label(c: Column) -> Column:
    """Whether a label, read as a number (0 if it isn't one), is above 0; drop null labels first."""
    return (number_or_zero(c.cast("string")) > 0).cast("int")


def align(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The columns of ``schema`` in its order and types: missing ones null (or a default), others dropped."""
    defaults = defaults or {}
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def model_matrix(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """The feature columns in the order of the model; those that are missing are 0."""
    return df.select(*(keep or []), *((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in features))


def reorder(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, the rest after; an error names preferred columns that are missing."""
    if missing := [c for c in preferred if c not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*preferred, *(c for c in df.columns if c not in preferred))


def drop_features(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Without the named columns, and the names that it doesn't have."""
    return df.drop(*names), [n for n in names if n not in df.columns]


def comma_set(value: str) -> list[str]:
    return [p for p in (x.strip() for x in value.split(",")) if p]
