"""rivulet: order-stream and metric analytics expressed as Spark DataFrame jobs.

Two data models live side by side:

* keyed order records (a stream of nested order events, tables derived
  from it, and the topic records that carry them), and
* labelled metric samples (``metric, labels, ts, value``) with the
  time-series, rewrite and alerting operators that run over them.

Every operator is a function that takes and returns DataFrames; nothing
collects rows to the driver.
"""

__version__ = "0.1.0"
