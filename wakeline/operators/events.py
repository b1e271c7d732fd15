"""Event queries: filters on type and condition, and the keys that patterns and pipes share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.plans import tree as t
from wakeline.plans.compiler import Compiler, key
from wakeline.sources.frames import TYPE


def condition_of(compiler: Compiler, q: t.EventQuery) -> Column:
    """The type (case counts) and the condition, as one predicate that scans can push down."""
    always = isinstance(q.where, t.Literal) and q.where.value is True
    condition = F.lit(True) if always else compiler.condition(q.where)
    return condition if q.event == "any" else (F.col(TYPE) == q.event) & condition


def event(df: DataFrame, compiler: Compiler, q: t.EventQuery) -> DataFrame:
    return df.where(condition_of(compiler, q))


def step_key(compiler: Compiler, x: t.Node) -> Column:
    return key(compiler, x)
