"""Integer helpers, simple times, typed arrays and distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def div_round_up(a: Column, b: Column) -> Column:
    """Quotient of non-negative numbers, rounded up."""
    return F.floor((a + b - 1) / b).cast("long")


def next_power_of_two(x: Column) -> Column:
    """The smallest power of two that is not below x (x of 2 or more)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1)))


def highest_bit(x: Column) -> Column:
    """The number of the highest bit set, from 0."""
    return F.length(F.bin(x)) - 1


def simple_seconds(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Seconds in a calendar of 12 months of 30 days each."""
    return ((((y * 12 + mo) * 30 + d) * 24 + h) * 60 + mi) * 60 + s


def simple_time(text: Column) -> Column:
    """Parses Y-M-D h:m:s into a struct, which compares field by field."""
    p = F.split(text, r"[- :]")
    names = ("year", "month", "day", "hour", "minute", "second")
    return F.struct(*(F.element_at(p, i + 1).cast("long").alias(n) for i, n in enumerate(names)))


def simple_time_text(t: Column) -> Column:
    """The time as Y-M-D h:m:s, numbers not padded."""
    g = lambda n: t.getField(n).cast("string")
    return F.concat(g("year"), F.lit("-"), g("month"), F.lit("-"), g("day"), F.lit(" "), g("hour"), F.lit(":"), g("minute"), F.lit(":"), g("second"))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance as DOUBLE (64-bit integers would overflow on wide vectors)."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def zip_arrays(**arrays: Column) -> Column:
    """An array of structs; raises when the lengths differ."""
    sizes = [F.size(a) for a in arrays.values()]
    same = sizes[0] == sizes[-1]
    for s in sizes[1:-1]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))
    fields = F.transform(zipped, lambda z: F.struct(*(z.getField(n).alias(n) for n in arrays)))
    return F.when(same, fields).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def slice_view(a: Column, begin: int, end: int) -> Column:
    """The elements at begin..end-1, from 0."""
    return F.slice(a, begin + 1, max(0, end - begin))


def visit(a: Column, f) -> Column:
    """Applies a column function to every element."""
    return F.transform(a, f)


def grow(a: Column, n: int, default) -> Column:
    """Appends n default elements."""
    return F.concat(a, F.array_repeat(F.lit(default), n))


def erase_at(a: Column, index: int) -> Column:
    """The array without the element at an index (from 0)."""
    return F.concat(F.slice(a, 1, index), F.slice(a, index + 2, F.greatest(F.size(a) - index - 1, F.lit(0))))


def insert_at(a: Column, index: int, value) -> Column:
    """The array with a value put before an index (from 0)."""
    return F.array_insert(a, index + 1, F.lit(value))


def pop_back(a: Column) -> Column:
    """The array without its last element."""
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def front(a: Column) -> Column:
    """The first element; null for an empty array."""
    return F.try_element_at(a, F.lit(1))


def back(a: Column) -> Column:
    """The last element; null for an empty array."""
    return F.try_element_at(a, F.lit(-1))


def resize(a: Column, n: int, default) -> Column:
    """The first n elements, filled up with a default."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(default), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def sorted_view(a: Column, descending: bool = False) -> Column:
    """The elements in order (nulls first, or last when descending); the array itself stays as it is."""
    return F.sort_array(a, asc=not descending)


def sorted_fields(arrays: dict[str, Column]) -> list[Column]:
    """Every typed array sorted by itself, under its name."""
    return [F.sort_array(a).alias(n) for n, a in arrays.items()]
