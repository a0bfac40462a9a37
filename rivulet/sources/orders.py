"""The order stream, derived from the given tables.

Mapping (one order per ``events`` row):

* ``orderid``    = ``events.event_id`` as text (the stream key is VARCHAR)
* ``ordertime``  = ``events.ts`` as epoch milliseconds
* ``itemid``     = ``events.event_type``
* ``orderunits`` = ``events.value``
* ``address``    = struct(city = ``c_name``, state = ``n_name``,
  zipcode = ``c_custkey``) through ``orders`` (``event_id = o_orderkey``),
  ``customer`` and ``nation``.

All joins are left joins from the event side so that no order is lost when
a dimension row is missing; the address is then NULL, as an absent struct
would be in the source.  ``nation`` is a fixed 25-row table and the planner
broadcasts it from its file-size statistics; the two large joins are
equi-joins that Spark plans as shuffle (sort-merge) joins at scale, with AQE
splitting skewed customer keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_millis
from .tables import read_table


def addresses(spark: SparkSession, sf_dir: str, state: str | None = None, orders: DataFrame | None = None) -> DataFrame:
    """``o_orderkey -> address`` for every order (of one state, if given).

    ``orders`` may hold a few order keys, in one column: they are broadcast, and only their orders and customers are kept.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    if orders is not None:
        o = o.join(F.broadcast(orders.toDF("_key").distinct()), F.col("o_orderkey") == F.col("_key"), "left_semi")
        c = c.join(F.broadcast(o.select(F.col("o_custkey").alias("_cust")).distinct()), F.col("c_custkey") == F.col("_cust"), "left_semi")
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    how = "left" if state is None else "inner"
    if state is not None:
        n = n.where(F.col("n_name") == F.lit(state))
    cust = c.join(n, c.c_nationkey == n.n_nationkey, how)
    joined = o.join(cust, o.o_custkey == cust.c_custkey, how)
    return joined.select(
        "o_orderkey",
        F.when(F.col("c_custkey").isNotNull(),
               F.struct(F.col("c_name").alias("city"),
                        F.col("n_name").alias("state"),
                        F.col("c_custkey").alias("zipcode"))).alias("address"))


COLUMNS = ("orderid", "ordertime", "itemid", "orderunits", "address")


def order_stream(spark: SparkSession, sf_dir: str, columns: Sequence[str] = COLUMNS,
                 state: str | None = None) -> DataFrame:
    """Batch view of the order stream: ``columns`` of the declared value schema.

    The address is joined only when it is among ``columns`` (an unused left join
    is not removed by the optimizer).  With ``state`` only orders of that
    ``address.state`` are returned; the predicate is placed on ``nation`` before any
    join, so it reaches that scan and the joins carry matching rows only.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    made = {"orderid": F.col("event_id").cast("string"), "ordertime": epoch_millis("ts"),
            "itemid": F.col("event_type"), "orderunits": F.col("value"), "address": F.col("address")}
    if "address" in columns or state is not None:
        addr = addresses(spark, sf_dir, state)
        ev = ev.join(addr, ev.event_id == addr.o_orderkey, "left" if state is None else "inner")
    return ev.select(*[made[c].alias(c) for c in columns])
