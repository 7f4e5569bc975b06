"""JSON access that keeps the raw JSON type, and staged column bindings."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

I64_MAX = 2**63 - 1
U64_MAX = 2**64 - 1

Getter = Callable[[str], Column]
Stage = Callable[[Getter], dict[str, Column]]


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def elements(value: Column) -> Column:
    """``array<variant>``, NULL unless the value is a JSON array."""
    return value.try_cast("array<variant>")


def entries(value: Column) -> Column:
    """``map<string, variant>``, NULL unless the value is a JSON object."""
    return value.try_cast("map<string,variant>")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return kind(value) == "STRING"


def text(value: Column) -> Column:
    """The string, NULL for any other JSON type."""
    return F.when(is_string(value), F.variant_get(value, "$", "string"))


def unsigned(value: Column) -> Column:
    """Unsigned 64-bit integer as BIGINT, NULL for any other value.

    Integers over the signed range become its maximum: they are over every limit, and
    messages show the raw value. They arrive as a scale-0 decimal; a scale-0 decimal
    inside the signed range was written with a fraction (``3.0``) and does not count.
    """
    shape = kind(value)
    small = F.try_variant_get(value, "$", "bigint")
    wide = F.try_variant_get(value, "$", "decimal(20,0)")
    return F.when(shape == "BIGINT", F.when(small >= 0, small)).when(
        shape.startswith("DECIMAL(") & shape.endswith(",0)"),
        F.when(
            wide.between(F.lit(Decimal(I64_MAX + 1)), F.lit(Decimal(U64_MAX))), F.lit(I64_MAX)
        ),
    )


def per_session(build):
    """Cache expressions: building a large one takes thousands of calls into the JVM."""
    cache: dict = {}

    @functools.wraps(build)
    def cached(*args):
        key = (SparkContext._active_spark_context, *args)
        if key not in cache:
            cache[key] = build(*args)
        return cache[key]

    return cached


@per_session
def stage_columns(stage: Stage) -> dict[str, Column]:
    return stage(F.col)


def add_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """One projection per stage, each seeing the columns of those before it."""
    for stage in stages:
        df = df.withColumns(stage_columns(stage))
    return df


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on worked-out columns, which is judged where it stands.

    The planner moves a plain filter below the projections that make its columns, and below a
    repartitioning, and so works those columns out again, several times over. It does not
    move one on the output of a generator.
    """
    return df.select("*", F.explode(F.array(condition)).alias("_holds")).filter("_holds").drop("_holds")


def member(value: Column, name: str) -> Column:
    return F.variant_get(value, f"$.{name}", "variant")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chain_stages(first: dict[str, Column], stages: Sequence[Stage], result: str) -> Column:
    """The same stages inside an expression, for use on a lambda variable."""

    def step(known: dict[str, Column], rest: Sequence[Stage]) -> Column:
        new = rest[0](known.__getitem__)
        if len(rest) == 1:
            return new[result]

        def body(scope: Column) -> Column:
            inner = dict(known)
            inner.update({name: scope[name] for name in new})
            return step(inner, rest[1:])

        return bind(F.struct(*[c.alias(n) for n, c in new.items()]), body)

    return step(first, list(stages))
