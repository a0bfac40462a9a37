"""Order-stream projections, filters, keyed aggregates and windowed tables.

The functions accept batch or streaming DataFrames with the order schema
(``orderid, ordertime, itemid, orderunits, address``); where the streaming
form needs a different primitive it is noted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cast_varchar
from ..functions.time import timestamp_to_string

MINUTE_MS = 60_000


def project_all(orders: DataFrame) -> DataFrame:
    """``SELECT * FROM orders_stream``."""
    return orders.select("*")


def flat_orders(orders: DataFrame) -> DataFrame:
    """The flattened derived stream: address fields lifted, time formatted."""
    return orders.select(
        "orderid",
        "ordertime",
        timestamp_to_string("ordertime", "yyyy-MM-dd HH:mm:ss").alias("order_datetime"),
        "itemid",
        "orderunits",
        F.col("address.city").alias("city"),
        F.col("address.state").alias("state"),
        F.col("address.zipcode").alias("zipcode"))


def orders_in_state(orders: DataFrame, state: str) -> DataFrame:
    """Orders whose nested ``address.state`` equals ``state`` (all columns)."""
    return orders.where(F.col("address.state") == F.lit(state))


def large_orders(orders: DataFrame, min_units: float) -> DataFrame:
    """Orders with more than ``min_units`` units, address fields projected."""
    return orders.where(F.col("orderunits") > F.lit(min_units)).select(
        "orderid", "itemid", "orderunits",
        F.col("address.city").alias("city"),
        F.col("address.state").alias("state"))


def formatted_orders(orders: DataFrame) -> DataFrame:
    """``CAST(units AS VARCHAR) + ' units'`` and ``city + ', ' + state``."""
    return orders.select(
        "orderid", "itemid",
        F.concat(cast_varchar("orderunits"), F.lit(" units")).alias("quantity"),
        F.concat(F.col("address.city"), F.lit(", "), F.col("address.state")).alias("location"))


# ---------------------------------------------------------------- aggregates

def orders_by_state(orders: DataFrame, approx: bool = False) -> DataFrame:
    """Count, unit total and distinct items per nested ``address.state``.

    Batch plans a partial/final hash aggregate (the per-state partials are
    combined map-side before the shuffle, so a hot state costs one row per
    task).  Streams cannot run an exact distinct aggregate; there the table is derived
    from maintained (state, item) rows (``streaming.tables.state_items``).
    ``approx=True`` uses a HyperLogLog++ sketch instead (as the source
    engine's ``COUNT_DISTINCT`` does): constant state per group whatever the
    item cardinality, with a small relative error.
    """
    if approx:
        distinct = F.approx_count_distinct("itemid")
    else:
        distinct = F.count_distinct("itemid")
    return (orders.groupBy(F.col("address.state").alias("state"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum("orderunits").alias("total_units"),
                 distinct.alias("unique_items")))


def orders_by_item(orders: DataFrame) -> DataFrame:
    """Count and unit total per item."""
    return (orders.groupBy("itemid")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum("orderunits").alias("total_units")))


def avg_units_by_state(orders: DataFrame) -> DataFrame:
    """``AVG(orderunits)`` per state."""
    return (orders.groupBy(F.col("address.state").alias("state"))
            .agg(F.avg("orderunits").alias("avg_units")))


# ---------------------------------------------------------------- windows

def tumbling_by_item(orders: DataFrame, size_ms: int = MINUTE_MS) -> DataFrame:
    """``WINDOW TUMBLING (SIZE size)`` grouped by item, bounds in epoch ms.

    In batch the window is a derived grouping key (``ordertime`` floored to
    the window size), which keeps the whole job in one codegen stage before
    the partial aggregate.  :func:`rivulet.streaming.tables` uses ``F.window``
    on event time instead so that watermarks apply.
    """
    start = F.col("ordertime") - F.pmod(F.col("ordertime"), F.lit(size_ms))
    return (orders.groupBy("itemid", start.alias("window_start"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum("orderunits").alias("total_units"))
            .select("itemid", "window_start",
                    (F.col("window_start") + F.lit(size_ms)).alias("window_end"),
                    "order_count", "total_units"))


def hopping_by_state(orders: DataFrame, size_ms: int = 5 * MINUTE_MS,
                     advance_ms: int = MINUTE_MS) -> DataFrame:
    """``WINDOW HOPPING (SIZE size, ADVANCE BY advance)`` by state: count, avg.

    Computed from panes: rows are first aggregated per (state, advance-sized
    pane), then each pane's partial count/sum is fanned out to the
    ``size/advance`` windows that cover it and merged.  The fan-out therefore
    multiplies the number of panes, not the number of rows, and the average
    is the exact merged ``sum / count``.  ``size`` must be a multiple of
    ``advance``.
    """
    if size_ms % advance_ms:
        raise ValueError("window size must be a multiple of the advance")
    k = size_ms // advance_ms
    pane = F.col("ordertime") - F.pmod(F.col("ordertime"), F.lit(advance_ms))
    panes = (orders.groupBy(F.col("address.state").alias("state"), pane.alias("pane"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("orderunits").alias("s")))
    fanned = panes.select(
        "state", "n", "s",
        F.explode(F.sequence(F.col("pane") - F.lit((k - 1) * advance_ms), F.col("pane"),
                             F.lit(advance_ms))).alias("window_start"))
    return (fanned.groupBy("state", "window_start")
            .agg(F.sum("n").alias("order_count"), F.sum("s").alias("sum_units"))
            .select("state", "window_start",
                    (F.col("window_start") + F.lit(size_ms)).alias("window_end"),
                    "order_count",
                    (F.col("sum_units") / F.col("order_count")).alias("avg_units")))


def windowed_lookup(windowed: DataFrame, key_col: str, key) -> DataFrame:
    """Point lookup of one key in a windowed table (all its windows)."""
    return windowed.where(F.col(key_col) == F.lit(key))


def pull(table: DataFrame, key_col: str | None = None, key=None) -> DataFrame:
    """Pull query: the table's current rows, optionally for one key."""
    return table if key_col is None else table.where(F.col(key_col) == F.lit(key))
