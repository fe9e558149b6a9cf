"""Ordered folds of each series as Catalyst expressions.

The rows of a series are collected, sorted by time, and folded by ``aggregate``: no Python, one
shuffle by series. A step's results are appended to an array in the accumulator, which suits series
of up to some hundred steps; longer ones belong to the Arrow fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates a value once and uses it in an expression."""
    return F.transform(F.array(value), body)[0]


def series_fold(rows: DataFrame, state: dict[str, float], step: Callable[[Column, Column], Column], columns: list[str], carried: list[str], reverse: bool = False) -> DataFrame:
    """One output row for each input row: series_id, k, the carried input columns, and the step's fields.

    ``rows`` has series_id, t, event_id, y. ``state`` gives the initial value of each state field;
    ``step(acc, m)`` returns a struct with the state fields first and then ``columns``. ``acc`` also
    holds ``k``. A null measurement is the step's business. Series order is time, then event_id.
    """
    names = list(state)
    items = F.array_sort(F.collect_list(F.struct("t", "event_id", "y")))
    gathered = rows.groupBy("series_id").agg((F.reverse(items) if reverse else items).alias("m"))
    fields = [*names, *columns]
    out_type = "array<struct<" + ",".join(["k:int", *[f"{c}:{'bigint' if c == 'event_id' else 'double'}" for c in carried], *[f"{c}:double" for c in columns]]) + ">>"
    zero = F.struct(*[F.lit(float(v)).alias(n) for n, v in state.items()], F.lit(0).alias("k"), F.array().cast(out_type).alias("out"))

    def merge(acc: Column, m: Column) -> Column:
        def after(r: Column) -> Column:
            row = F.struct(acc["k"].alias("k"), *[m[c].alias(c) for c in carried], *[r[c].alias(c) for c in columns])
            return F.struct(*[r[n].alias(n) for n in names], (acc["k"] + 1).alias("k"), F.concat(acc["out"], F.array(row.cast(out_type[6:-1]))).alias("out"))

        return let(step(acc, m), after)

    assert set(fields) >= set(names)
    folded = gathered.select("series_id", F.aggregate("m", zero, merge, lambda a: a["out"]).alias("out"))
    return folded.select("series_id", F.inline("out"))


def first(acc: Column) -> Column:
    """Whether this is the series' first step: it updates without predicting."""
    return acc["k"] == 0
