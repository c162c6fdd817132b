"""Distinct counts from hourly sketches: exact while small, within the stated error beyond."""

from datetime import timedelta

from pyspark.sql import functions as F

from edgeline.operators import sketches
from helpers import dt, rows

T0 = dt("2024-05-01")


def events(spark, n, distinct):
    """``n`` events over two days; a hot tenant; some nulls."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), i % 4)).alias("tenant_id"),
        (F.lit(T0) + F.make_dt_interval(secs=(i * 7919 % 172_800).cast("decimal(18,6)"))).alias("event_time"),
        F.when(i % 11 != 0, F.concat(F.lit("ip"), F.hash(i) % distinct)).alias("source_ip"),
        F.concat(F.lit("u"), i % 37).alias("url"),
    )


def exact(df, columns, first, last):
    t = F.col("event_time")
    kept = df.filter((t >= first) & (t < last))
    return {
        (r["tenant_id"], c): r["n"]
        for c in columns
        for r in kept.filter(F.col(c).isNotNull()).groupBy("tenant_id").agg(F.count_distinct(c).alias("n")).collect()
    }


def found(df, value):
    return {(r["tenant_id"], r["name"]): r[value] for r in df.collect()}


COLUMNS = ["source_ip", "url"]


def test_small_sets_are_exact_and_late_rows_merge(spark):
    df = events(spark, 6000, 900)
    whole = sketches.distinct_hours(df, COLUMNS)
    late = df.sample(0.3, 1)
    parts = sketches.merged(sketches.distinct_hours(df.filter("url > 'u2'"), COLUMNS), sketches.distinct_hours(late, COLUMNS), whole)
    as_of = T0 + timedelta(hours=30, minutes=12)
    first, last = T0 + timedelta(hours=19), T0 + timedelta(hours=31)
    for hours in (whole, parts):
        got = found(sketches.distinct_over(hours, as_of=as_of, window_hours=12), "distinct_values")
        assert got == exact(df, COLUMNS, first, last)
    assert sketches.distinct_over(whole.limit(0), as_of=as_of, window_hours=3).isEmpty()
    assert rows(sketches.distinct_over(whole, as_of=T0 - timedelta(days=9), window_hours=3)) == []


def test_union_and_difference_within_the_error(spark):
    df = events(spark, 120_000, 50_000).cache()
    hours = sketches.distinct_hours(df, COLUMNS, size=10).cache()
    as_of, size = T0 + timedelta(hours=47), 10
    recent = exact(df, COLUMNS, T0 + timedelta(hours=24), T0 + timedelta(hours=48))
    both = exact(df, COLUMNS, T0, T0 + timedelta(hours=48))
    prior = exact(df, COLUMNS, T0, T0 + timedelta(hours=24))
    out = sketches.new_against(hours, as_of=as_of, window_hours=24, prior_hours=24, size=size)
    all_, fresh = found(out, "distinct_values"), found(out, "new_values")
    for key, n in recent.items():
        assert abs(all_[key] - n) <= 4 * n / 2 ** (size / 2)
        # the difference errs by a share of what both windows hold
        assert abs(fresh[key] - (both[key] - prior[key])) <= 4 * both[key] / 2 ** (size / 2)
    assert max(recent.values()) > 5000


def test_values_of_a_first_window_are_all_new(spark):
    hours = sketches.distinct_hours(events(spark, 500, 50), COLUMNS)
    out = sketches.new_against(hours, as_of=T0 + timedelta(hours=5), window_hours=6, prior_hours=24)
    assert found(out, "new_values") == found(out, "distinct_values") != {}
