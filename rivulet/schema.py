"""Declared schemas of the record types the library reads and writes."""

from pyspark.sql import types as T

ADDRESS = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("zipcode", T.LongType()),
])

# The order stream: key + Avro value fields.
ORDER = T.StructType([
    T.StructField("orderid", T.StringType()),
    T.StructField("ordertime", T.LongType()),
    T.StructField("itemid", T.StringType()),
    T.StructField("orderunits", T.DoubleType()),
    T.StructField("address", ADDRESS),
])

# The upsert sink table after flattening (orderid is the primary key).
SINK_ORDER = T.StructType([
    T.StructField("orderid", T.IntegerType(), False),
    T.StructField("ordertime", T.LongType(), False),
    T.StructField("itemid", T.StringType(), False),
    T.StructField("orderunits", T.DoubleType(), False),
    T.StructField("address_city", T.StringType()),
    T.StructField("address_state", T.StringType()),
    T.StructField("address_zipcode", T.LongType()),
])

# A topic record as a log consumer sees it.
TOPIC_RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.LongType()),           # epoch ms (CreateTime)
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
])

# A labelled metric sample (long form).
SAMPLE = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.LongType()),          # epoch ms
    T.StructField("value", T.DoubleType()),
])

# A raw managed-bean reading before name/label rewriting.
BEAN_ROW = T.StructType([
    T.StructField("component", T.StringType()),
    T.StructField("bean", T.StringType()),
    T.StructField("ts", T.LongType()),                  # epoch ms
    T.StructField("value", T.DoubleType()),
])
