"""Queries over the order stream (declarations, projections, tables, windows).

Struct columns are rendered as JSON text in registered outputs, the way a
push or pull query response carries them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import timestamp_to_string
from ..operators import flatten as fl
from ..operators import orders as op
from ..sources.orders import order_stream
from .registry import register, rounded

# Shared oracle CTE: the same derivation as rivulet.sources.orders.
ORDER_STREAM_SQL = """
order_stream AS (
  SELECT CAST(e.event_id AS VARCHAR) AS orderid,
         epoch_us(e.ts) // 1000 AS ordertime,
         e.event_type AS itemid,
         e.value AS orderunits,
         CASE WHEN c.c_custkey IS NOT NULL
              THEN {'city': c.c_name, 'state': n.n_name, 'zipcode': c.c_custkey} END AS address
  FROM events e
  LEFT JOIN orders o ON e.event_id = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

# Parameters of the sample queries, chosen for the generated data: the
# state and item literals of the original examples do not occur in it.
STATE = "NATION_1"
ITEM = "purchase"
MIN_UNITS = 5


def _json_address(df):
    return df.withColumn("address", F.to_json("address"))


@register("project_all", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT * REPLACE (to_json(address) AS address) FROM order_stream""")
def q_project_all(spark, sf):
    return _json_address(op.project_all(order_stream(spark, sf)))


@register("struct_field", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, address.city AS city, address.state AS state, address.zipcode AS zipcode
FROM order_stream""")
def q_struct_field(spark, sf):
    return order_stream(spark, sf).select(
        "orderid", F.col("address.city").alias("city"),
        F.col("address.state").alias("state"), F.col("address.zipcode").alias("zipcode"))


@register("alias", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT orderid AS order_key, itemid AS item, orderunits AS units FROM order_stream""")
def q_alias(spark, sf):
    return order_stream(spark, sf, ("orderid", "itemid", "orderunits")).select(
        F.col("orderid").alias("order_key"), F.col("itemid").alias("item"),
        F.col("orderunits").alias("units"))


@register("flatten_struct", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, ordertime, itemid, orderunits,
       address.city AS address_city, address.state AS address_state,
       address.zipcode AS address_zipcode
FROM order_stream""")
def q_flatten_struct(spark, sf):
    return fl.flatten(order_stream(spark, sf), "_")


FLAT_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, ordertime,
       strftime(make_timestamp(ordertime * 1000), '%Y-%m-%d %H:%M:%S') AS order_datetime,
       itemid, orderunits, address.city AS city, address.state AS state,
       address.zipcode AS zipcode
FROM order_stream"""


@register("flat_stream", oracle=FLAT_SQL)
def q_flat_stream(spark, sf):
    return op.flat_orders(order_stream(spark, sf))


@register("timestamp_to_string", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, strftime(make_timestamp(ordertime * 1000), '%Y-%m-%d %H:%M:%S') AS order_datetime
FROM order_stream""")
def q_timestamp_to_string(spark, sf):
    return order_stream(spark, sf, ("orderid", "ordertime")).select(
        "orderid", timestamp_to_string("ordertime", "yyyy-MM-dd HH:mm:ss").alias("order_datetime"))


@register("cast_varchar", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, CAST(orderunits AS VARCHAR) AS units_text FROM order_stream""")
def q_cast_varchar(spark, sf):
    return order_stream(spark, sf, ("orderid", "orderunits")).select(
        "orderid", F.col("orderunits").cast("string").alias("units_text"))


@register("concat_plus", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, itemid,
       CAST(orderunits AS VARCHAR) || ' units' AS quantity,
       address.city || ', ' || address.state AS location
FROM order_stream""")
def q_concat_plus(spark, sf):
    return op.formatted_orders(order_stream(spark, sf))


@register("filter_eq", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT * REPLACE (to_json(address) AS address) FROM order_stream
WHERE address.state = '{STATE}'""")
def q_filter_eq(spark, sf):
    return _json_address(order_stream(spark, sf, state=STATE))


FILTER_GT_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT orderid, itemid, orderunits, address.city AS city, address.state AS state
FROM order_stream WHERE orderunits > {MIN_UNITS}"""


@register("filter_gt", oracle=FILTER_GT_SQL)
def q_filter_gt(spark, sf):
    return op.large_orders(order_stream(spark, sf), MIN_UNITS)


ORDERS_BY_STATE_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT address.state AS state, COUNT(*) AS order_count,
       ROUND(SUM(orderunits), 6) AS total_units,
       COUNT(DISTINCT itemid) AS unique_items
FROM order_stream GROUP BY address.state"""


@register("orders_by_state", oracle=ORDERS_BY_STATE_SQL)
def q_orders_by_state(spark, sf):
    return rounded(op.orders_by_state(order_stream(spark, sf)), "total_units")


ORDERS_BY_ITEM_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT itemid, COUNT(*) AS order_count, ROUND(SUM(orderunits), 6) AS total_units
FROM order_stream GROUP BY itemid"""


@register("orders_by_item", oracle=ORDERS_BY_ITEM_SQL)
def q_orders_by_item(spark, sf):
    return rounded(op.orders_by_item(order_stream(spark, sf, ("itemid", "orderunits"))), "total_units")


@register("agg_avg", oracle=f"""WITH {ORDER_STREAM_SQL}
SELECT address.state AS state, ROUND(AVG(orderunits), 6) AS avg_units
FROM order_stream GROUP BY address.state""")
def q_agg_avg(spark, sf):
    return rounded(op.avg_units_by_state(order_stream(spark, sf)), "avg_units")


TUMBLING_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT itemid, ordertime - ordertime % 60000 AS window_start,
       ordertime - ordertime % 60000 + 60000 AS window_end,
       COUNT(*) AS order_count, ROUND(SUM(orderunits), 6) AS total_units
FROM order_stream GROUP BY itemid, ordertime - ordertime % 60000"""

HOPPING_SQL = f"""WITH {ORDER_STREAM_SQL},
panes AS (SELECT address.state AS state, ordertime - ordertime % 60000 AS pane, orderunits
          FROM order_stream),
fanned AS (SELECT state, unnest(range(pane - 240000, pane + 1, 60000)) AS window_start,
                  orderunits
           FROM panes)
SELECT state, window_start, window_start + 300000 AS window_end,
       COUNT(*) AS order_count, ROUND(AVG(orderunits), 6) AS avg_units
FROM fanned GROUP BY state, window_start"""


@register("tumbling_1m", oracle=TUMBLING_SQL)
def q_tumbling_1m(spark, sf):
    return rounded(op.tumbling_by_item(order_stream(spark, sf, ("ordertime", "itemid", "orderunits"))), "total_units")


@register("hopping_5m_1m", oracle=HOPPING_SQL)
def q_hopping_5m_1m(spark, sf):
    return rounded(op.hopping_by_state(order_stream(spark, sf)), "avg_units")


@register("window_bounds", oracle=f"""WITH t AS ({TUMBLING_SQL})
SELECT itemid, window_start, window_end, window_end - window_start AS window_ms FROM t""")
def q_window_bounds(spark, sf):
    t = op.tumbling_by_item(order_stream(spark, sf, ("ordertime", "itemid", "orderunits")))
    return t.select("itemid", "window_start", "window_end",
                    (F.col("window_end") - F.col("window_start")).alias("window_ms"))


@register("windowed_lookup", oracle=f"""WITH t AS ({TUMBLING_SQL})
SELECT * FROM t WHERE itemid = '{ITEM}'""")
def q_windowed_lookup(spark, sf):
    t = rounded(op.tumbling_by_item(order_stream(spark, sf, ("ordertime", "itemid", "orderunits"))), "total_units")
    return op.windowed_lookup(t, "itemid", ITEM)


PULL_STATE_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT address.state AS state, COUNT(*) AS order_count,
       ROUND(SUM(orderunits), 6) AS total_units,
       COUNT(DISTINCT itemid) AS unique_items
FROM order_stream WHERE address.state = '{STATE}' GROUP BY address.state"""

PULL_ITEM_SQL = f"""WITH {ORDER_STREAM_SQL}
SELECT itemid, COUNT(*) AS order_count, ROUND(SUM(orderunits), 6) AS total_units
FROM order_stream WHERE itemid = '{ITEM}' GROUP BY itemid"""
