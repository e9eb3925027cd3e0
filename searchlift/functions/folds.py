"""Folds in order over groups of any size: steps that compose are composed in pieces, and the pieces in a tree.

A fold whose steps are functions f(state) -> state that compose to functions of the same kind needs no
task that sees a whole group: rows are put in order by one range exchange, each thousand in a row
compose to one step inside their task, and the steps of a group are composed a thousand at a time
until one is left. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlift.sources.staging import staged

PIECE = 1_000


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Column, compose: Callable[[Column, Column], Column], piece: int = PIECE) -> DataFrame:
    """keys and `step`: the composition of a group's steps in order (equal rows of the order in any order).

    compose(first, then) gives the step of the same type that does both. A group of a billion rows is a
    million pieces, a thousand of these, then one; a group's rows never meet in one task.
    """
    slim = rows.select(*keys, *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], step.alias("step"))
    by = [*keys, *[f"__o{i}" for i in range(len(order))]]
    placed = slim.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, "step", F.monotonically_increasing_id().alias("__at"))
    folded = _pieces(placed, keys, compose, piece)
    # The first level has seen all rows; the rest is small, and its depth follows the largest group.
    folded = staged(folded, "fold")
    while (folded.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > 1:
        folded = staged(_pieces(folded, keys, compose, piece), "fold")
    return folded.drop("__at")


def _pieces(placed: DataFrame, keys: list[str], compose: Callable[[Column, Column], Column], piece: int) -> DataFrame:
    inside = F.array_sort(F.collect_list(F.struct("__at", "step")))
    steps = placed.groupBy(*keys, F.expr(f"__at div {piece}").alias("__piece")).agg(inside.alias("steps"))
    one = F.reduce(F.slice("steps", F.lit(2), F.greatest(F.size("steps"), F.lit(1))), F.get("steps", 0).step, lambda done, x: compose(done, x.step))
    return steps.select(*keys, one.alias("step"), F.col("__piece").alias("__at"))


#: A clamped straight line: x -> least(hi, greatest(lo, a * x + b)).
LINE = "struct<a: double, b: double, lo: double, hi: double>"


def line(a: float | Column = 1.0, b: float | Column = 0.0, lo: float | Column = float("-inf"), hi: float | Column = float("inf")) -> Column:
    of = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(of(a).alias("a"), of(b).alias("b"), of(lo).alias("lo"), of(hi).alias("hi"))


def on_line(f: Column, x: Column) -> Column:
    return F.least(f.hi, F.greatest(f.lo, f.a * x + f.b))


def lines(first: Column, then: Column) -> Column:
    """The clamped line that does both, for rising lines. One that both clamps leave a single value is that constant, so that slopes never overflow."""
    lo, hi = on_line(then, first.lo), on_line(then, first.hi)
    flat = lo >= hi
    a, b = F.when(flat, F.lit(0.0)).otherwise(first.a * then.a), F.when(flat, lo).otherwise(then.a * first.b + then.b)
    return F.struct(a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"))
