"""Predicates on properties and small column functions. A predicate is a function from a column to a boolean column; a missing property never passes."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def _sure(test: Predicate) -> Predicate:
    return lambda c: F.coalesce(test(c), F.lit(False))


def eq(value) -> Predicate:
    return _sure(lambda c: c == F.lit(value))


def neq(value) -> Predicate:
    return _sure(lambda c: c != F.lit(value))


def lt(value) -> Predicate:
    return _sure(lambda c: c < F.lit(value))


def lte(value) -> Predicate:
    return _sure(lambda c: c <= F.lit(value))


def gt(value) -> Predicate:
    return _sure(lambda c: c > F.lit(value))


def gte(value) -> Predicate:
    return _sure(lambda c: c >= F.lit(value))


def within(*values) -> Predicate:
    return _sure(lambda c: c.isin(*values))


def without(*values) -> Predicate:
    return _sure(lambda c: ~c.isin(*values))


def inside(low, high) -> Predicate:
    """Half open: low <= x < high."""
    return _sure(lambda c: (c >= F.lit(low)) & (c < F.lit(high)))


def outside(low, high) -> Predicate:
    return _sure(lambda c: (c < F.lit(low)) | (c >= F.lit(high)))


def contains(part: str) -> Predicate:
    return _sure(lambda c: c.contains(part))


def always() -> Predicate:
    return lambda c: F.lit(True)


def both(*tests: Predicate) -> Predicate:
    return lambda c: _fold(tests, c, lambda a, b: a & b)


def either(*tests: Predicate) -> Predicate:
    return lambda c: _fold(tests, c, lambda a, b: a | b)


def _fold(tests, c, f):
    found = tests[0](c)
    for t in tests[1:]:
        found = f(found, t(c))
    return found


def birth_month(birthday: Column) -> Column:
    """The month of a yyyymmdd number."""
    return F.floor(birthday / 100) % 100


def birth_day(birthday: Column) -> Column:
    return birthday % 100


def born_around(birthday: Column, month: int) -> Column:
    """From the 21st of the month to the 21st of the next one; December goes on in January."""
    then = 1 if month == 12 else month + 1
    return ((birth_month(birthday) == month) & (birth_day(birthday) >= 21)) | ((birth_month(birthday) == then) & (birth_day(birthday) < 22))
