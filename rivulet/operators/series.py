"""Label sets as fixed-width ids, with a catalogue that gives them back.

A sample's label set is a map and its text, some hundred bytes each; a vector operator needs them only to tell
series apart and to print the result.  Here samples and vectors carry ``lid``, eight bytes that follow
from the label set's text, through every window, join and aggregate; the catalogue, one row per label set, is
joined to the finished vector.

The id is a hash, so building the catalogue proves that no two label sets share one: such a pair is an error, never a
wrong result.  (Among 100 million label sets the chance of a pair is about 3 in 10,000.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import all_match, labels_key


def label_id(lkey: str | Column) -> Column:
    """Eight bytes for the canonical text of a label set."""
    return F.xxhash64(lkey)


def catalogue(samples: DataFrame) -> DataFrame:
    """``lid, lkey, labels``: one row per label set of ``samples`` (which has ``labels``).

    Label sets are made distinct by a hash aggregate in the scan's stage, so the shuffle carries one row per task and label set.
    """
    key = labels_key("labels")
    sets = (samples.select(key.alias("lkey"), F.array_sort(F.map_entries("labels")).alias("entries")).distinct()
            .select(label_id("lkey").alias("lid"), "lkey", "entries"))
    sharing = sets.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("lid")))     # the partitioning of the join with a vector
    clash = F.raise_error(F.concat(F.lit("two label sets share an id, one is "), F.col("lkey"))).cast("string")
    return sharing.select("lid", F.when(F.col("_n") == 1, F.col("lkey")).otherwise(clash).alias("lkey"),
                          F.map_from_entries("entries").alias("labels"))


def select_ids(series: DataFrame, matchers=()) -> DataFrame:
    """Ids of the label sets that match: the side that a stored table of samples is semi-joined with."""
    return series.where(all_match("labels", matchers)).select("lid")


def named(vec: DataFrame, series: DataFrame) -> DataFrame:
    """``t, metric (NULL), labels, lkey, value`` of a vector by id."""
    return (vec.join(series, "lid")
            .select("t", F.lit(None).cast("string").alias("metric"), "labels", "lkey", "value"))
