"""Pages by cursor: the sort values of the last row seen, in place of an offset.

An offset ranks all rows before a page; a cursor is a predicate that reaches the
scan, so page 1000 costs what page 1 costs. Nulls come first in both directions.
The keys must tell the rows of a group apart, as those of the list queries do;
then pages neither overlap nor leave rows out, also when rows are added meanwhile.
Values of a cursor are text (null for null), so it can be handed out and back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions.ranking import top_per_group

PREFIX = "__after_"
# of one group as text, or of every group as rows
Cursor = dict[str, str | None] | DataFrame | None


@dataclass(frozen=True)
class Key:
    """One sort key; ``value`` is a column of the rows unless an expression is given."""

    name: str
    descending: bool = False
    expression: Column | None = None

    @property
    def value(self) -> Column:
        return F.col(self.name) if self.expression is None else self.expression

    def sort(self, backwards: bool = False) -> Column:
        if backwards:
            return self.value.asc_nulls_last() if self.descending else self.value.desc_nulls_last()
        return self.value.desc_nulls_first() if self.descending else self.value.asc_nulls_first()


def sort(keys: list[Key]) -> list[Column]:
    return [k.sort() for k in keys]


def _behind(key: Key, at: Column) -> Column:
    """Whether a row's key sorts after the cursor's; false for a null key, which sorts first."""
    beyond = key.value < at if key.descending else key.value > at
    return F.coalesce(F.when(at.isNull(), key.value.isNotNull()).otherwise(beyond), F.lit(False))


def _all_behind(keys: list[Key], at: list[Column]) -> Column:
    steps = list(zip(keys, at, strict=True))
    return reduce(lambda rest, s: _behind(*s) | (s[0].value.eqNullSafe(s[1]) & rest), reversed(steps), F.lit(False))


def _types(rows: DataFrame, keys: list[Key]) -> list:
    return [f.dataType for f in rows.select(*[k.value.alias(k.name) for k in keys]).schema.fields]


def cursor(page: DataFrame, keys: list[Key], **group: str) -> dict[str, str | None] | None:
    """Cursor behind the last row of one group's page (one row is fetched); None if the page is empty."""
    for name, value in group.items():
        page = page.filter(F.col(name) == value)
    last = page.orderBy(*[k.sort(backwards=True) for k in keys]).limit(1)
    row = last.select(*[k.value.cast("string").alias(k.name) for k in keys]).first()
    return {**group, **row.asDict()} if row else None


def after(rows: DataFrame, keys: list[Key], at: dict[str, str | None]) -> DataFrame:
    """Rows of the cursor's group that sort behind it.

    The bound of the first key is a condition of its own, as a whole lexicographic
    comparison is none that a parquet reader can use.
    """
    for name in [n for n in at if n not in {k.name for k in keys}]:
        rows = rows.filter(F.col(name) == at[name])
    values = [F.lit(at[k.name]).cast(t) for k, t in zip(keys, _types(rows, keys), strict=True)]
    first = keys[0]
    if at[first.name] is not None:
        rows = rows.filter(first.value <= values[0] if first.descending else first.value >= values[0])
    return rows.filter(_all_behind(keys, values))


def cursors(page: DataFrame, group: list[str], keys: list[Key]) -> DataFrame:
    """The cursor of every group of a page, one row each."""
    last = top_per_group(page, group, [k.sort(backwards=True) for k in keys], 1)
    return last.select(*group, *[k.value.alias(PREFIX + k.name) for k in keys])


def after_each(rows: DataFrame, group: list[str], keys: list[Key], at: DataFrame) -> DataFrame:
    """Rows behind the cursor of their group; groups without a cursor have come to their end."""
    joined = rows.join(at, group)
    behind = joined.filter(_all_behind(keys, [F.col(PREFIX + k.name) for k in keys]))
    return behind.select(*rows.columns)


def page(
    rows: DataFrame,
    group: list[str],
    keys: list[Key],
    limit: int,
    *,
    offset: int = 0,
    at: Cursor = None,
) -> DataFrame:
    """One page per group: the first rows behind the offset, or behind a cursor."""
    if isinstance(at, DataFrame):
        rows = after_each(rows, group, keys, at)
    elif at is not None:
        rows = after(rows, keys, at)
    return top_per_group(rows, group, sort(keys), limit, offset=offset)
