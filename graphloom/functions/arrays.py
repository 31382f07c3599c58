"""Values computed once, and running sums, inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 64  # numbers that are summed one by one; runs are then shifted as wholes


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the body's number of uses."""
    return F.transform(F.array(value), body)[0]


def _summed(xs: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))["out"]


def running(sizes: Column) -> Column:
    """Running sums of an array of int.

    An array that grows by one at each step is copied at each step, so only runs of ``RUN`` grow that
    way, and then the runs' totals: the work stays in proportion to the array.
    """

    def whole(xs):
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: _summed(F.slice(xs, i * RUN + 1, F.lit(RUN))))
        totals = _summed(F.transform(runs, lambda r: F.element_at(r, -1)))
        return F.flatten(F.zip_with(runs, totals, lambda r, t: F.transform(r, lambda x: x + t - F.element_at(r, -1))))

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(sizes, whole))


class Cutter:
    """Pieces of a text by place, cut from UTF-32, where a place is found without reading what is before it."""

    def __init__(self, wide: Column):
        self.wide = wide

    @staticmethod
    def widened(text: Column) -> Column:
        return F.encode(text, "UTF-32")

    def __call__(self, start: Column, size) -> Column:
        return F.decode(F.substring(self.wide, start * 4 + 1, size * 4), "UTF-32")
