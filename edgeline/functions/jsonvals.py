"""Open JSON as VARIANT: presence, type and truthiness tests.

Records carry the same field under several names, and a setting is often
expressed by which key is present, so a fixed struct schema loses information.
A payload is parsed once into a VARIANT and every helper below works on the
VARIANT of one field, which keeps "0" (text) apart from 0 (number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON texts that count as missing in an "a or b" chain. Fixed values.
EMPTY_JSON = ["null", '""', "0", "0.0", "-0.0", "false", "{}", "[]"]


def parse(payload: Column) -> Column:
    """JSON text -> VARIANT, null when the text is not JSON."""
    return F.try_parse_json(payload)


def pick(doc: Column, path: str) -> Column:
    """The field at ``path`` as a VARIANT; SQL null only when the key is absent."""
    return F.try_variant_get(doc, path, "variant")


def key(doc: Column, name: str) -> Column:
    """``pick`` for one top-level key of any spelling."""
    return pick(doc, f'$["{name}"]')


def text(v: Column) -> Column:
    return v.try_cast("string")


def present(v: Column) -> Column:
    """The key exists, even when its value is null or empty."""
    return v.isNotNull()


def not_null(v: Column) -> Column:
    return F.coalesce(F.to_json(v) != "null", F.lit(False))


def truthy(v: Column) -> Column:
    return F.coalesce(~F.to_json(v).isin(EMPTY_JSON), F.lit(False))


def first_truthy(*vs: Column) -> Column:
    """First VARIANT that is neither absent nor empty."""
    return F.coalesce(*[F.when(truthy(v), v) for v in vs])


def either(*vs: Column) -> Column:
    """Like ``first_truthy``, but an empty last value is kept (a score of 0 stays 0)."""
    return F.coalesce(first_truthy(*vs[:-1]), vs[-1])


def first_text(*vs: Column) -> Column:
    return text(first_truthy(*vs))


def is_object(v: Column) -> Column:
    return F.coalesce(F.to_json(v).startswith("{"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.to_json(v).startswith("["), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.to_json(v).startswith('"'), F.lit(False))


def is_integer(v: Column) -> Column:
    return F.coalesce(F.to_json(v).rlike(r"^-?\d+$"), F.lit(False))


def strip(s: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(s, F.lit(" \t\n\r\f\x0b"))


def integer_text(s: Column) -> Column:
    """Text holding a whole number -> bigint, else null ("100.7" is not one)."""
    t = strip(s)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def whole(v: Column) -> Column:
    """Counter cell: numbers truncate, strings must hold a whole number."""
    return F.when(is_string(v), integer_text(text(v))).when(
        F.to_json(v).rlike(r"^-?\d"), v.try_cast("bigint")
    )


def score(v: Column) -> Column:
    """Whole number or text holding one; any other kind is null."""
    return F.when(is_string(v), integer_text(text(v))).when(is_integer(v), v.try_cast("bigint"))


def real(v: Column) -> Column:
    return F.when(is_string(v), strip(text(v)).try_cast("double")).when(
        F.to_json(v).rlike(r"^-?\d"), v.try_cast("double")
    )


def items(v: Column) -> Column:
    """Elements of a JSON array as array<variant>; empty for anything else."""
    return F.when(is_array(v), v.try_cast("array<variant>")).otherwise(
        F.array().cast("array<variant>")
    )


def fields(v: Column) -> Column:
    """Members of a JSON object as map<string,variant>; empty for anything else."""
    return F.when(is_object(v), v.try_cast("map<string,variant>")).otherwise(
        F.create_map().cast("map<string,variant>")
    )


def first_key(payload: Column, path: str) -> Column:
    """First key of an object in text order (VARIANT sorts keys, so read the text)."""
    return F.get(F.json_object_keys(F.get_json_object(payload, path)), F.lit(0))


def leaves(df: DataFrame, doc: Column, paths: dict[str, str]) -> DataFrame:
    """Extract the named fields once, before anything computes on them.

    ``inline`` over a one-element array is a plan barrier: filters on derived
    columns stay above it, so Catalyst cannot push a predicate through the
    projection and parse each payload a second time.
    """
    one = F.array(F.struct(*[pick(doc, p).alias(n) for n, p in paths.items()]))
    return df.select("*", F.inline(one))
