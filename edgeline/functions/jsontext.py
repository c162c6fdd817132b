"""High-volume JSON records as text fields: one parse per record, small generated code.

``from_json`` with text-only fields reads all wanted fields in a single pass and
gives nested values as JSON text. What is lost is the difference between 0 and
"0", or between an object and a string that looks like one. ``marked`` keeps it:
before parsing, such strings get a marker character, so a field's text alone
tells its kind, and ``plain`` takes the marker off again.

For configuration objects, where key presence matters, see ``jsonvals``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeline.functions.jsonvals import integer_text, strip

MARK = ""
# strings that read like an empty value, a decimal, an object or an array
LOOKALIKE = r'([:\[,]\s*")(?=(?:-?0(?:\.0+)?|false|[-+]?\d+\.\d*)"(?!\s*:)|[{\[])'
# one of these occurs in any text the pattern could match, decimals aside
HINTS = ['"0"', '"0.', '"-0', '"false"', '"{', '"[']
# texts of values that count as missing. Fixed values.
EMPTY_TEXTS = ["", "0", "0.0", "-0.0", "false", "{}", "[]"]


def unwrapped(payload: Column) -> Column:
    """The record's JSON text, also when it arrives inside a JSON string."""
    inner = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>")
    return F.when(payload.startswith('"'), F.get(inner, F.lit(0))).otherwise(payload)


def marked(payload: Column, *, decimals: bool = False) -> Column:
    """Mark look-alike strings; the pattern runs only on texts that may hold one.

    ``decimals`` also covers strings such as "100.7", for fields read by ``whole``.
    """
    replaced = F.regexp_replace(payload, LOOKALIKE, "$1" + MARK)
    if decimals:
        return replaced
    hinted = reduce(lambda a, b: a | b, [payload.contains(h) for h in HINTS])
    return F.when(hinted, replaced).otherwise(payload)


def plain(t: Column) -> Column:
    """A value without its marker (which stands in front)."""
    return F.ltrim(t, F.lit(MARK))


def plain_json(t: Column) -> Column:
    """Nested JSON text without the markers inside it."""
    return F.translate(t, MARK, "")


def struct_of(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def fixed(df: DataFrame, cols: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Compute columns once, behind a plan barrier.

    Catalyst copies an expression into every place that uses it when it pushes a
    filter through a projection. It cannot do that through ``inline``, so what
    is computed here is computed once per row.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select(*(keep if keep is not None else ["*"]), F.inline(row))


def pull(df: DataFrame, text: Column, names: list[str], prefix: str = "j_") -> DataFrame:
    """Add the named fields of a JSON object as text columns; null when absent or not JSON."""
    row = F.array(F.from_json(text, struct_of(names)))
    return df.select("*", F.inline(row).alias(*[prefix + n for n in names]))


def records(
    raw: DataFrame, names: list[str], *, decimals: bool = False, filtered: bool = False
) -> DataFrame:
    """Fields of a raw record.

    ``filtered`` is for callers that filter on these fields: it puts a barrier
    behind the parse, which else would be repeated inside the filter.
    """
    text = marked(unwrapped(F.col("payload")), decimals=decimals)
    if filtered:
        return pull(raw, text, names)
    parsed = raw.withColumn("__record", F.from_json(text, struct_of(names)))
    fields = [F.col("__record").getField(n).alias("j_" + n) for n in names]
    return parsed.select(*raw.columns, *fields)


def member(t: Column, name: str) -> Column:
    """One member of a nested object given as text."""
    return F.from_json(t, struct_of([name]))[name]


def truthy(t: Column) -> Column:
    return F.coalesce(~t.isin(EMPTY_TEXTS), F.lit(False))


def given(t: Column) -> Column:
    """The value, or null when it counts as missing."""
    return F.when(~t.isin(EMPTY_TEXTS), t)


def first(*ts: Column) -> Column:
    """First value that does not count as missing (marker kept)."""
    return F.coalesce(*[given(t) for t in ts])


def first_plain(*ts: Column) -> Column:
    return plain(first(*ts))


def either(*ts: Column) -> Column:
    """Like ``first``, but an empty last value is kept (a score of 0 stays 0)."""
    return F.coalesce(*[given(t) for t in ts[:-1]], ts[-1])


def is_object(t: Column) -> Column:
    return F.coalesce(t.startswith("{"), F.lit(False))


def is_array(t: Column) -> Column:
    return F.coalesce(t.startswith("["), F.lit(False))


def elements(t: Column) -> Column:
    """Elements of a JSON array as texts; null for anything else."""
    return F.when(is_array(t), F.from_json(t, "array<string>"))


def whole(t: Column) -> Column:
    """Numbers truncate; strings must hold a whole number."""
    number = F.when(~t.startswith(MARK), strip(t).try_cast("double").try_cast("bigint"))
    return F.coalesce(integer_text(plain(t)), number)


def score(t: Column) -> Column:
    """Whole number or text holding one; any other kind is null."""
    return integer_text(plain(t))
