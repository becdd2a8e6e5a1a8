"""Expressions whose plain Spark form would differ from the values that queries must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def py_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value half-even; never gives -0.0."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double") + F.lit(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, even where a lambda inside uses it for every element."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Sums up to each entry, by steps of 1, 2, 4, ... entries: an array of n takes n log n additions and is never copied entry by entry."""
    n = F.size(values)
    steps = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    add = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return F.aggregate(steps, values, add)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as structs of start, end (exclusive) and text. The text must not hold U+0001. A text without a match is gone through once only."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(F.regexp_replace(text, pattern, MARK), MARK, -1)

    def placed(m: Column) -> Column:
        sizes = F.zip_with(m, F.slice(between, F.lit(1), F.size(m)), lambda x, g: F.length(x) + F.length(g))
        one = lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("text"))
        return F.when(F.size(m) == 0, F.array().cast("array<struct<start:int,end:int,text:string>>")).otherwise(let(sizes, lambda n: F.zip_with(m, running_sums(n), one)))

    return let(found, placed)


def seeded(seed: int, *keys: Column) -> Column:
    """A random order by seed and keys that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def hashed_index(n: Column, *keys: Column) -> Column:
    """A number from 0 to n - 1 by the keys."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10)
    return F.pmod(word.cast("bigint"), n.cast("bigint"))


def number(text: Column) -> Column:
    """A double, or null where the text is not one; suffixes such as 1d do not count."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf|infinity)$"), trimmed.try_cast("double"))
