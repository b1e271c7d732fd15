"""Typed values: a Column with the kind the language sees in it, and how kinds are brought together."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, NULL, ARRAY, OBJECT, MIXED = "number", "string", "boolean", "null", "array", "object", "mixed"
PRIMITIVE = (NUMBER, STRING, BOOLEAN, NULL, MIXED)


@dataclass(frozen=True)
class Value:
    """kind is what the type of the data says; mixed values (VARIANT) decide row by row."""

    col: Column
    kind: str
    dtype: T.DataType | None = None
    integral: bool = False
    #: literal value, if known while compiling
    known: bool = False
    value: Any = None
    #: a whole number of any length as decimal text, where `col`, of 38 places at most, may be null
    digits: Column | None = None


def null(kind: str = NULL) -> Value:
    types = {NUMBER: "bigint", STRING: "string", BOOLEAN: "boolean"}
    return Value(F.lit(None).cast(types.get(kind, "string")), kind if kind in types else NULL, known=True)


def literal(v: Any) -> Value:
    if v is None:
        return null()
    if isinstance(v, bool):
        return Value(F.lit(v), BOOLEAN, known=True, value=v)
    if isinstance(v, int):
        if abs(v) < 2**63:
            return Value(F.lit(v).cast("bigint"), NUMBER, integral=True, known=True, value=v)
        return Value(F.lit(str(v)).try_cast("decimal(38,0)"), NUMBER, integral=True, known=True, value=v, digits=F.lit(str(v)))
    if isinstance(v, float):
        return Value(F.lit(v).cast("double"), NUMBER, known=True, value=v)
    return Value(F.lit(v), STRING, known=True, value=v)


def typed(col: Column, dtype: T.DataType) -> Value:
    """A column of a Spark type as a value: integers as long, other numbers as double, times as microseconds."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Value(col if isinstance(dtype, T.LongType) else col.cast("bigint"), NUMBER, T.LongType(), integral=True)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Value(col if isinstance(dtype, T.DoubleType) else col.cast("double"), NUMBER, T.DoubleType())
    if isinstance(dtype, T.TimestampNTZType):
        return Value(F.unix_micros(col.cast("timestamp")), NUMBER, T.LongType(), integral=True)
    if isinstance(dtype, T.TimestampType):
        return Value(F.unix_micros(col), NUMBER, T.LongType(), integral=True)
    if isinstance(dtype, T.BooleanType):
        return Value(col, BOOLEAN, dtype)
    if isinstance(dtype, (T.StringType, T.DateType)):
        return Value(col if isinstance(dtype, T.StringType) else col.cast("string"), STRING, T.StringType())
    if isinstance(dtype, T.ArrayType):
        return Value(col, ARRAY, dtype)
    if isinstance(dtype, (T.StructType, T.MapType)):
        return Value(col, OBJECT, dtype)
    if isinstance(dtype, T.VariantType):
        return Value(col, MIXED, dtype)
    return null()


_NUMERIC = "^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL.*)$"


def variant_kind(col: Column) -> Column:
    """The kind of a VARIANT, row by row."""
    s = F.schema_of_variant(col)
    return (
        F.when(col.isNull() | (s == "VOID"), F.lit(NULL))
        .when(s == "STRING", F.lit(STRING))
        .when(s == "BOOLEAN", F.lit(BOOLEAN))
        .when(s.rlike(_NUMERIC), F.lit(NUMBER))
        .when(s.startswith("ARRAY"), F.lit(ARRAY))
        .otherwise(F.lit(OBJECT))
    )


def variant_whole(col: Column) -> Column:
    """Whether a VARIANT is a whole number."""
    return F.schema_of_variant(col) == "BIGINT"


def as_kind(v: Value, kind: str) -> Value:
    """v if it is of a kind, null where it is not. Nothing is ever converted."""
    if v.kind == kind:
        return v
    if v.kind != MIXED:
        return null(kind)
    target = {NUMBER: "double", STRING: "string", BOOLEAN: "boolean", ARRAY: "array<variant>", OBJECT: "variant"}[kind]
    got = F.when(variant_kind(v.col) == kind, v.col if kind == OBJECT else F.try_variant_get(v.col, "$", target))
    dtype = {ARRAY: T.ArrayType(T.VariantType()), OBJECT: T.VariantType()}.get(kind)
    return Value(got, kind, dtype)


def double_of(v: Value) -> Column:
    """A number as the nearest double."""
    return v.col.cast("double") if v.digits is None else v.digits.try_cast("double")


def rank_of(v: Value) -> Column:
    """A whole number of any length as a struct that compares as the number does."""
    x = v.col.cast("string") if v.digits is None else v.digits
    below = x.startswith("-")
    size = F.length(x)
    flipped = F.translate(x, "0123456789", "9876543210")
    return F.when(x.isNotNull(), F.struct(F.when(below, -size).otherwise(size).alias("size"), F.when(below, flipped).otherwise(x).alias("text")))


def truth(v: Value) -> Column:
    """Truth as the language sees it: null stays unknown; 0, '' and empty arrays are false."""
    if v.kind == BOOLEAN:
        return v.col
    if v.kind == NUMBER:
        return v.col != 0 if v.digits is None else v.digits != "0"
    if v.kind == STRING:
        return v.col != ""
    if v.kind == ARRAY:
        return F.size(v.col) > 0
    if v.kind == OBJECT:
        return F.when(v.col.isNotNull(), F.lit(True))
    if v.kind == MIXED:
        k = variant_kind(v.col)
        out = F.when(k == OBJECT, F.lit(True))
        for kind in (BOOLEAN, NUMBER, STRING, ARRAY):
            out = out.when(k == kind, truth(as_kind(v, kind)))
        return out
    return F.lit(None).cast("boolean")


def text_of(v: Value) -> Value:
    """A primitive as string(): true and false in lower case, numbers as Python writes them."""
    if v.kind == STRING:
        return v
    if v.kind == BOOLEAN:
        return Value(v.col.cast("string"), STRING)
    if v.kind == NUMBER and v.integral:
        return Value(v.col.cast("string") if v.digits is None else v.digits, STRING)
    if v.kind == NUMBER:
        size = F.abs(v.col)
        plain = lambda scale: F.regexp_replace(F.regexp_replace(v.col.cast(f"decimal(38,{scale})").cast("string"), "0+$", ""), r"\.$", ".0")
        big = F.regexp_replace(F.regexp_replace(F.lower(v.col.cast("string")), r"\.0e", "e"), r"e(\d)", "e+$1")
        big = F.regexp_replace(big, r"e([+-])(\d)$", "e${1}0$2")
        out = F.when((size >= 1e7) & (size < 1e16), plain(6)).when((size < 1e-3) & (size >= 1e-4), plain(20)).when(size.isNotNull() & ((size >= 1e16) | (size > 0) & (size < 1e-4)), big).otherwise(v.col.cast("string"))
        return Value(out, STRING)
    if v.kind == MIXED:
        k, number = variant_kind(v.col), as_kind(v, NUMBER)
        whole = F.schema_of_variant(v.col) == "BIGINT"
        out = F.when(k == STRING, as_kind(v, STRING).col).when(k == BOOLEAN, as_kind(v, BOOLEAN).col.cast("string"))
        return Value(out.when(whole, F.try_variant_get(v.col, "$", "bigint").cast("string")).when(k == NUMBER, text_of(number).col), STRING)
    return null(STRING)
