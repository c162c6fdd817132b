"""Health grids: rows against brute force, and how often the cells are dealt out."""

from collections import defaultdict
from datetime import datetime

import pytest

from edgeline.operators import joins
from edgeline.plans.views import Views

CELLS = "tenant_id string, pool_id string, origin_address string, origin_port int, site_name string, classified_status string, consecutive_failures int"
ROWS = [
    ("t", "p", "a", 1, "s1", "healthy", 0),
    ("t", "p", "a", 1, "s2", "unhealthy", 3),
    ("t", "p", "a", None, "s3", None, None),
    ("t", "p", "b", 1, "s2", "healthy", 1),
    ("t", "p", "b", 1, "s2", "healthy", 1),
    ("t", "p", "b", 2, None, "healthy", 1),
    ("t", "p", None, 2, "s1", "warning", 2),
    ("u", "p", "a", 1, "s9", "healthy", 0),
    ("t", "q", "a", 1, "s1", "healthy", 0),
    (None, "q", "a", 1, "s1", "healthy", 0),
]


def _brute():
    """Origins with their cells, and the sites of their pools; rows without a tenant meet no pool."""
    origins, sites = defaultdict(list), defaultdict(set)
    for r in ROWS:
        if r[4] is not None and r[0] is not None:
            origins[r[:4]].append(r[4:])
            sites[r[:2]].add(r[4])
    return origins, sites


def test_grid_has_probed_and_missing_cells(spark):
    origins, sites = _brute()
    want = []
    for o, cells in origins.items():
        want += [(*o, *c) for c in cells]
        want += [(*o, s, "no probe", None) for s in sites[o[:2]] - {c[0] for c in cells}]
    got = [tuple(r) for r in joins.health_grid(spark.createDataFrame(ROWS, CELLS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_grid_by_origin_counts_and_names_missing_cells(spark):
    origins, sites = _brute()
    want = []
    for o, cells in origins.items():
        blind = sorted(sites[o[:2]] - {c[0] for c in cells})
        want.append((*o, sum(c[1] == "healthy" for c in cells), len(cells), len(blind), blind))
    got = [tuple(r) for r in joins.health_grid_by_origin(spark.createDataFrame(ROWS, CELLS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("grid", ["health_grid", "health_grid_by_origin"])
def test_cells_are_dealt_out_and_sorted_by_origin_once(spark, folder, grid):
    """From raw probes to origins the rows are shuffled once and sorted once; the pools' sites and the join take the rest."""
    line = (7, 3, 2, 1, 5.0, "A", "F", datetime(1998, 1, 1))
    shape = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame([line], shape).write.parquet(f"{folder}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = getattr(joins, grid)(Views(spark, folder).order_health)
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len([x for x in plan if "Exchange hashpartitioning" in x]) == 4
    assert len([x for x in plan if "- Sort [" in x and "origin_address" in x]) == 1
    assert not [x for x in plan if "ObjectHashAggregate(" in x and "origin_address" in x]
