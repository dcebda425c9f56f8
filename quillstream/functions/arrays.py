"""Joins, counts and running sums inside arrays, in n log n: sorting and binary search by built-in functions.

An argument that is read inside a lambda must be cheap to read there: a column, or a lambda's own variable (see let()).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _powers(n: Column) -> Column:
    """2 ** k from the greatest that is not above n down to 1; empty for 0."""
    return F.when(n > 0, F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))).otherwise(F.expr("cast(array() as array<int>)"))


def count_before(values: Column, before: Callable[[Column], Column]) -> Column:
    """How many elements come before a border: before() must hold of all up to it and of none after it."""
    n = F.size(values)
    on = lambda at, step: F.when((at + step <= n) & before(F.get(values, at + step - 1)), at + step).otherwise(at)
    return F.aggregate(_powers(n), F.lit(0), on)


def index(keys: Column) -> Column:
    """array<struct<key, place>> of the keys that aren't null, by key and then place from 0: what find() and count() search."""
    return F.sort_array(F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("place"))), lambda e: e["key"].isNotNull()))


def find(indexed: Column, key: Column, last: bool = False) -> Column:
    """The place of the first key like this, or the last; null if there is none."""
    if last:
        entry = F.get(indexed, count_before(indexed, lambda e: e["key"] <= key) - 1)
    else:
        entry = F.get(indexed, count_before(indexed, lambda e: e["key"] < key))
    return let(entry, lambda e: F.when(e["key"] == key, e["place"]))


def places(indexed: Column, key: Column) -> Column:
    """array<int> of all places of a key."""
    low, high = count_before(indexed, lambda e: e["key"] < key), count_before(indexed, lambda e: e["key"] <= key)
    return let(F.struct(low.alias("low"), high.alias("high")), lambda r: F.transform(F.slice(indexed, r["low"] + 1, F.greatest(r["high"] - r["low"], F.lit(0))), lambda e: e["place"]))


def count(indexed: Column, key: Column) -> Column:
    return count_before(indexed, lambda e: e["key"] <= key) - count_before(indexed, lambda e: e["key"] < key)


def among(values: Column, of: Column, wanted: bool = True) -> Column:
    """The values that stand among others, or those that don't, each as often as it is there and in order; nulls go."""
    return let(index(of), lambda x: F.filter(values, lambda v: v.isNotNull() & (find(x, v).isNotNull() if wanted else find(x, v).isNull())))


def running_sums(values: Column) -> Column:
    """The sums up to and with each element, by doubling: log n passes."""
    steps = F.reverse(_powers(F.size(values)))
    return F.aggregate(steps, values, lambda a, step: F.transform(a, lambda x, i: F.when(i >= step, x + F.get(a, i - step)).otherwise(x)))
