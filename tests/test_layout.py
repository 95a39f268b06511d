"""How tables are dealt: once by the key that joins, sums and files share."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwise.operators import causal
from driftwise.session import joined_as_dealt
from driftwise.sources import prepared
from driftwise.sources.estate import Estate

DAY = dt.datetime(1996, 5, 1)
TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "ASIA"), (1, "EUROPE")]),
    "nation": ("n_nationkey long, n_regionkey long", [(0, 0), (1, 1)]),
    "customer": ("c_custkey long, c_nationkey long, c_mktsegment string", [(1, 0, "BUILDING"), (2, 1, "MACHINERY")]),
    "part": ("p_partkey long, p_type string, p_brand string, p_retailprice double", [(7, "PROMO", "Brand#1", 9.0)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double,"
               " o_orderstatus string", [(1, 1, DAY, "1-URGENT", 5.0, "F"), (20000, 2, DAY, "2-HIGH", 5.0, "O"), (3, 2, DAY, "2-HIGH", 5.0, "O")]),
    "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double,"
                 " l_quantity double, l_discount double, l_tax double, l_returnflag string",
                 [(1, 1, 7, 1, DAY, 10.0, 2.0, 0.1, 0.0, "N"), (1, 1, 7, 1, DAY, 10.0, 2.0, 0.1, 0.0, "N"), (1, 2, 8, 1, DAY, 6.0, 2.0, 0.0, 0.0, "R"),
                  (20000, 1, 7, 1, DAY, 8.0, 2.0, 0.0, 0.0, "N"), (20000, None, None, 1, DAY, 3.0, 1.0, 0.0, 0.0, "N"), (4, 1, 7, 1, DAY, 8.0, 2.0, 0.0, 0.0, "N")]),
}


@pytest.fixture
def estate(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Estate(spark, str(tmp_path))


def test_sales_are_dealt_by_slice_once(spark, estate):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_as_dealt(spark):
            frame = estate.built_sales(None, prepared.LEAST_WIDTH).repartition("slice")
            plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(slice") == 2, "lines and orders, and not their join"
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_prepared_sales_keep_every_line_of_a_known_order(estate):
    got = sorted((r.order_id, r.line_no or 0, r.region, r.category, r.sold, r.qty) for r in estate.prepared_sales().collect())
    assert got == [(1, 1, "ASIA", "PROMO", True, 2.0), (1, 2, "ASIA", None, False, 2.0),
                   (20000, 0, "EUROPE", None, False, 1.0), (20000, 1, "EUROPE", "PROMO", True, 2.0)]
    assert estate.prepared_sales().columns[:3] == ["part_id", "order_id", "line_no"]


def test_the_panel_is_dealt_before_it_is_multiplied(spark):
    """Sixteen layouts of a row are summed where they arise, in as many parts as the session has."""
    panel = spark.createDataFrame([(DAY.date(), r, c, "d", "c", "s", 1.0) for r in "NS" for c in ("web", "store")],
                                  "d date, region string, channel string, device string, category string, sku string, revenue double")
    out = causal.scoped_panel(panel)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(d" in plan
    told = {(r.layout, r.region): r.n for r in out.groupBy("layout", "region").agg(F.sum("revenue").alias("n")).collect()}
    assert len(told) == 32 and set(told.values()) == {2.0}
