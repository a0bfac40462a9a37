"""Topic read, replay, offset, lag and sizing operators over topic records.

Records carry ``topic, partition, offset, timestamp, key, value``; stored as
parquet partitioned by ``topic``/``partition`` the partition and offset
filters below prune files, the way a consumer seeks instead of scanning.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import carry_forward


def from_beginning(records: DataFrame) -> DataFrame:
    """Every record of the topic (a bounded read from the earliest offsets)."""
    return records.select("topic", "partition", "offset", "timestamp", "key", "value")


def from_partition_offset(records: DataFrame, partition: int, offset: int) -> DataFrame:
    """One partition from an offset on."""
    return from_beginning(records).where((F.col("partition") == partition) & (F.col("offset") >= offset))


def from_timestamp(records: DataFrame, ts_ms: int) -> DataFrame:
    """Replay from a point in time: records whose timestamp is at or after it."""
    return from_beginning(records).where(F.col("timestamp") >= F.lit(ts_ms))


def first_n(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records by (timestamp, partition, offset).

    ``orderBy(...).limit(n)`` plans as a top-k (``TakeOrderedAndProject``):
    each task keeps its ``n`` smallest rows, no global sort.
    """
    return from_beginning(records).orderBy("timestamp", "partition", "offset").limit(n)


def console_lines(records: DataFrame, separator: str = " | ", print_key: bool = True,
                  print_timestamp: bool = True) -> DataFrame:
    """Console-consumer lines: ``CreateTime:<ts><sep><key><sep><value>``.

    A NULL key or value prints as ``null``.
    """
    parts = []
    if print_timestamp:
        parts.append(F.concat(F.col("timestamp_type"), F.lit(":"), F.col("timestamp").cast("string")))
    if print_key:
        parts.append(F.coalesce(F.col("key"), F.lit("null")))
    parts.append(F.coalesce(F.col("value"), F.lit("null")))
    return records.select("partition", "offset", F.concat_ws(separator, *parts).alias("line"))


def decode_json(records: DataFrame, schema: T.StructType, corrupt_col: str = "_corrupt_record") -> DataFrame:
    """Parse JSON values with a declared schema; unparsable values keep their
    text in ``corrupt_col`` and NULL fields (PERMISSIVE)."""
    s = T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())])
    parsed = F.from_json(F.col("value"), s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col})
    return records.select("partition", "offset", "key", parsed.alias("v")).select(
        "partition", "offset", "key", "v.*")


def decode_base64(df: DataFrame, col: str = "value") -> DataFrame:
    """Binary-format values arrive as base64 text; decode to UTF-8 text."""
    return df.withColumn(col, F.unbase64(F.col(col)).cast("string"))


def _before_after(text: Column, separator: str) -> tuple[Column, Column, Column]:
    """(found, text before the first separator, text after it); the separator is literal."""
    at = F.instr(text, F.lit(separator))
    return at > 0, F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(separator), F.length(text))


def parse_producer_lines(lines: DataFrame, key_separator: str = ":", headers_delimiter: str = "\t",
                         headers_separator: str = ",", header_key_separator: str = ":",
                         with_headers: bool = True) -> DataFrame:
    """Split producer input lines into headers, key and value.

    With headers the line is ``h1:v1,h2:v2<TAB>key:value``; the key ends at the first
    key separator, so values may contain it.  Separators may have several characters
    and are taken literally.  ``headers`` is an array of (key, value) in line order, as a
    record may carry one header several times.

    No line is lost: one without a delimiter or separator it should have keeps its whole
    remaining text in ``value`` with a NULL ``key``, and ``error`` says what is missing
    (a header without a separator has a NULL value, as a record header may).
    """
    line = F.col("line")
    if with_headers:
        delimited, head, rest = _before_after(line, headers_delimiter)
        rest = F.when(delimited, rest).otherwise(line)
        pairs = F.split(head, re.escape(headers_separator), -1)

        def pair(text):
            found, key, value = _before_after(text, header_key_separator)
            return F.struct(F.when(found, key).otherwise(text).alias("key"), F.when(found, value).alias("value"))
        headers = F.when(delimited & (head != ""), F.transform(pairs, pair)).otherwise(
            F.array().cast("array<struct<key:string,value:string>>"))
    else:
        delimited, rest = F.lit(True), line
        headers = F.array().cast("array<struct<key:string,value:string>>")
    keyed, key, value = _before_after(rest, key_separator)
    error = (F.when(line.isNull(), F.lit("null line"))
             .when(~delimited, F.lit("no headers delimiter"))
             .when(~keyed, F.lit("no key separator")))
    return lines.select("*", headers.alias("headers"), F.when(keyed, key).alias("key"),
                        F.when(keyed, value).otherwise(rest).alias("value"), error.alias("error"))


def header(headers, name: str) -> Column:
    """Value of the last header called ``name`` (NULL if there is none)."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.element_at(F.filter(h, lambda x: x["key"] == F.lit(name)), -1)["value"]


def end_offsets(records: DataFrame) -> DataFrame:
    """Log-end offset (next offset to be written) per partition."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("log_end_offset"))


def start_offsets(records: DataFrame) -> DataFrame:
    """Earliest available offset per partition."""
    return records.groupBy("topic", "partition").agg(F.min("offset").alias("log_start_offset"))


def message_count(records: DataFrame) -> DataFrame:
    """Messages in the topic: the sum of the partitions' log-end offsets."""
    return end_offsets(records).groupBy("topic").agg(F.sum("log_end_offset").alias("messages"))


def positions(records: DataFrame, groups: Sequence[tuple[str, int]], reset_ms: int = 0) -> DataFrame:
    """Everything that offsets, lag and resets need, from one aggregate over the topic.

    ``groups`` are (name, time): a group has consumed every record written before its
    time (offsets are dense, so its position is that count).  One row per group and
    partition: ``current_offset``, log start ``lo``, log end ``hi``, and ``first_at``, the
    first offset at or after ``reset_ms``.  Commits are conditional sums in the same
    aggregate, so the topic is read once whatever the number of groups.
    """
    ts = F.col("timestamp")
    agg = records.groupBy("topic", "partition").agg(
        F.min("offset").alias("lo"), (F.max("offset") + 1).alias("hi"),
        F.min(F.when(ts >= F.lit(reset_ms), F.col("offset"))).alias("first_at"),
        *[F.sum((ts < F.lit(until)).cast("bigint")).alias(f"c{i}") for i, (_, until) in enumerate(groups)])
    committed = F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"c{i}").alias("current_offset"))
                          for i, (g, _) in enumerate(groups)])
    return (agg.select("topic", "partition", "lo", "hi", "first_at", F.explode(committed).alias("g"))
            .select("g.group", "topic", "partition", "g.current_offset", "lo", "hi", "first_at"))


def consumer_lag(at: DataFrame) -> DataFrame:
    """Lag per group and partition: log-end offset minus committed position."""
    return at.select("group", "topic", "partition", "current_offset", F.col("hi").alias("log_end_offset"),
                     (F.col("hi") - F.col("current_offset")).alias("lag"))


def lag_by_topic(lag: DataFrame) -> DataFrame:
    return lag.groupBy("group", "topic").agg(F.sum("lag").alias("lag"))


def lag_over_time(records: DataFrame, commits: DataFrame, step_ms: int, bucket_steps: int = 1440) -> DataFrame:
    """Lag per group, partition and evaluation step ``t`` (a multiple of ``step_ms``).

    ``commits`` is the commit history ``group, topic, partition, committed_at, commit_id, position``: a group stands at the
    position of its latest commit at or before ``t`` (ties: largest ``commit_id``), which an offset reset may
    move back.  The log ends behind the largest offset written at or before ``t``, whatever the order of the records' times.
    Steps run from the first one that knows both to the topic's last record or commit.

    Records and commits are first aggregated to the step that sees them (map-side), so what is merged is bounded by
    span / step and not by rows; each merged row is spread only to the steps until the next one.  A commit of a
    partition without records gives no row.
    """
    def seen_at(ts: str) -> Column:
        return (F.ceil(F.col(ts) / F.lit(step_ms)) * F.lit(step_ms)).cast("bigint").alias("t")
    ends = records.groupBy("topic", "partition", seen_at("timestamp")).agg((F.max("offset") + 1).alias("log_end_offset"))
    made = commits.groupBy("group", "topic", "partition", seen_at("committed_at")).agg(
        F.max_by("position", F.struct("committed_at", "commit_id")).alias("current_offset"))
    until = (ends.select("topic", "t").unionByName(made.select("topic", "t"))
             .groupBy("topic").agg(F.max("t").alias("_until")))                                      # a row per topic
    members = made.select("group", "topic", "partition").distinct()
    events = (ends.join(members, ["topic", "partition"])
              .unionByName(made, allowMissingColumns=True)
              .groupBy("group", "topic", "partition", "t").agg(F.max("log_end_offset").alias("log_end_offset"),
                                                               F.max("current_offset").alias("current_offset")))
    known = carry_forward(events, ["group", "topic", "partition"], "t", ["current_offset"], bucket_steps * step_ms,
                          largest=["log_end_offset"])
    stop = F.coalesce(F.col("_next") - F.lit(step_ms), F.col("_until"))
    return (known.where(F.col("current_offset").isNotNull() & F.col("log_end_offset").isNotNull())
            .join(until, "topic")
            .select("group", "topic", "partition", F.explode(F.sequence("t", stop, F.lit(step_ms).cast("bigint"))).alias("t"),
                    "current_offset", "log_end_offset", (F.col("log_end_offset") - F.col("current_offset")).alias("lag")))


def storage_required(records: DataFrame, retention_days: float, replication: int,
                     brokers: int, margin: float = 1.2) -> DataFrame:
    """Disk needed: daily bytes x retention days x replication x margin, and
    per broker.  Bytes are those of the UTF-8 text, a NULL key or value counting none; daily
    bytes are the mean over the days present."""
    day = F.floor(F.col("timestamp") / F.lit(86_400_000))
    daily = (records.groupBy("topic", day.alias("day"))
             .agg(F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes")))
    per_topic = daily.groupBy("topic").agg(F.count(F.lit(1)).alias("days"),
                                            F.avg("bytes").alias("daily_bytes"))
    req = F.col("daily_bytes") * F.lit(retention_days) * F.lit(replication) * F.lit(margin)
    return per_topic.select("topic", "days", "daily_bytes", req.alias("required_bytes"),
                            (req / F.lit(brokers)).alias("per_broker_bytes"))


def mirror(records: DataFrame, topics_regex: str = ".*", target_prefix: str = "source.",
           source_prefix: str = "") -> DataFrame:
    """Records of topics matching the pattern, renamed for the target cluster."""
    full = f"^(?:{source_prefix}{topics_regex})$"
    return (records.where(F.col("topic").rlike(full))
            .withColumn("topic", F.concat(F.lit(target_prefix), F.col("topic"))))


def reset_plan(at: DataFrame, strategies: Sequence[tuple[str, int | None]]) -> DataFrame:
    """Dry run of consumer-group offset resets over :func:`positions`.

    One row per group, partition and strategy with the new position: ``to-earliest``,
    ``to-latest``, ``to-offset`` N (clamped to the available range) or ``to-datetime`` (the
    first offset at or after the time given to ``positions``, the log end if none).
    """
    lo, hi = F.col("lo"), F.col("hi")
    new = {"to-earliest": lambda v: lo, "to-latest": lambda v: hi,
           "to-offset": lambda v: F.least(F.greatest(F.lit(int(v)), lo), hi),
           "to-datetime": lambda v: F.coalesce(F.col("first_at"), hi)}
    unknown = [s for s, _ in strategies if s not in new]
    if unknown:
        raise ValueError(f"unknown reset strategies {unknown}")
    plans = F.array(*[F.struct(F.lit(s).alias("strategy"), new[s](v).cast("bigint").alias("new_offset"))
                      for s, v in strategies])
    return (at.select("group", "topic", "partition", "current_offset", F.explode(plans).alias("p"))
            .select("group", "topic", "partition", "p.strategy", "current_offset", "p.new_offset"))


def from_positions(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Read on after an executed reset: the records at or after each group's new positions.

    The plan has one row per group and partition (one strategy), so it is the small side
    of an equi-join on the partition.
    """
    at = plan.select("group", F.col("topic").alias("_t"), F.col("partition").alias("_p"), "new_offset")
    joined = records.join(at, (records.topic == at["_t"]) & (records.partition == at["_p"]))
    return joined.where(F.col("offset") >= F.col("new_offset")).drop("_t", "_p", "new_offset")
