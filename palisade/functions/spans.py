"""Places of all matches of a pattern, as column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running combinations of an array, by doubling: n log n steps inside the row. combine must be associative."""

    def scan(v: Column) -> Column:
        rounds = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        steps = F.transform(rounds, lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(steps, v, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, combine(F.get(a, i - d), x)).otherwise(x)))

    return given(values, scan)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, size>> of the matches, 0-based, ends exclusive; size: characters of the group.

    Gaps between matches and the matches themselves, laid end to end, give the places.
    """
    p = F.lit(pattern)
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x))
    found = F.struct(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, p, F.lit(0))).alias("own"), lengths(F.regexp_extract_all(text, p, F.lit(group))).alias("size"))

    def laid(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gap"], 1, F.size(x["own"])), x["own"], lambda g, o: g + o)
        own = F.arrays_zip(x["own"].alias("own"), x["size"].alias("size"))
        return F.zip_with(running(both, lambda a, b: a + b), own, lambda end, o: F.struct((end - o["own"]).alias("start"), end.alias("end"), o["size"].alias("size")))

    return given(found, laid)
